"""Settings with checked ranges; every operator takes them as arguments or literals."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

ENV_PREFIX = "GENOPLANE_"


class ConfigError(ValueError):
    """A setting outside its range."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class Alignment:
    use_trusted_cutoffs: bool = True
    max_evalue: float = 1e-10
    min_coverage: float = 0.7
    min_bitscore: float = 80.0
    max_overlap_fraction: float = 0.2

    def __post_init__(self) -> None:
        _check(self.max_evalue > 0, "max_evalue has to be positive")
        _check(0 <= self.min_coverage <= 1, "min_coverage has to be in [0, 1]")
        _check(self.min_bitscore >= 0, "min_bitscore has to be 0 or more")
        _check(0 <= self.max_overlap_fraction <= 1, "max_overlap_fraction has to be in [0, 1]")


@dataclass(frozen=True)
class Synteny:
    max_gap_bp: int = 5000
    max_divergent_gap_bp: int = 1500
    min_core_genes: int = 2
    edge_margin_bp: int = 1000

    def __post_init__(self) -> None:
        _check(self.max_gap_bp > 0 and self.max_divergent_gap_bp > 0, "gap limits have to be positive")
        _check(self.min_core_genes > 0, "min_core_genes has to be positive")
        _check(self.edge_margin_bp >= 0, "edge_margin_bp has to be 0 or more")


@dataclass(frozen=True)
class SplitShares:
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        _check(all(0 <= getattr(self, f.name) <= 1 for f in fields(self)), "shares have to be in [0, 1]")
        _check(round(self.train + self.validation + self.test, 5) == 1.0, "shares have to add up to 1")


@dataclass(frozen=True)
class Paths:
    """Folders; relative ones are under `base_dir`, and that under the working folder. Profiles fall back to their default folder."""

    base_dir: str = "."
    genomes_dir: str = "data/raw/genomes"
    metadata_dir: str = "data/raw/metadata"
    zip_dir: str = "data/raw/zip"
    annotation_dir: str = "data/interim/annotation"
    output_dir: str = "data/processed"
    models_dir: str = "models"
    log_dir: str = "logs"
    hmm_profiles: str = "data/hmm_profiles"

    def __post_init__(self) -> None:
        base = Path(self.base_dir).resolve()
        default = base / "data" / "hmm_profiles"
        for f in fields(self):
            value = getattr(self, f.name)
            object.__setattr__(self, f.name, str(base) if f.name == "base_dir" else value if "://" in value else str((base / value).resolve()))
        if "://" not in self.hmm_profiles and not Path(self.hmm_profiles).exists() and default.exists():
            object.__setattr__(self, "hmm_profiles", str(default))

    def create(self) -> None:
        """Make the folders that are local and not there yet."""
        for f in fields(self):
            if "://" not in getattr(self, f.name):
                Path(getattr(self, f.name)).mkdir(parents=True, exist_ok=True)


@dataclass(frozen=True)
class Settings:
    alignment: Alignment = field(default_factory=Alignment)
    synteny: Synteny = field(default_factory=Synteny)
    shares: SplitShares = field(default_factory=SplitShares)
    paths: Paths = field(default_factory=Paths)


# Names that older settings files use.
LEGACY_NAMES = {"e_value_max": "max_evalue", "min_bit_score": "min_bitscore", "max_intergenic_distance_bp": "max_gap_bp", "min_core_genes_required": "min_core_genes", "contig_edge_margin_bp": "edge_margin_bp"}


def _section(kind: type, given: dict, env: dict[str, str]) -> object:
    known = {f.name: f for f in fields(kind)}
    named = {LEGACY_NAMES.get(k, k): v for k, v in given.items()}
    values = {k: v for k, v in named.items() if k in known}
    for name, f in known.items():
        raw = env.get(f"{ENV_PREFIX}{name.upper()}")
        if raw is not None:
            default = f.default
            values[name] = raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw)
    return kind(**values)


def _parsed(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    try:
        if path.suffix.lower() in (".yaml", ".yml"):
            try:
                import yaml
            except ModuleNotFoundError as e:
                raise ConfigError("settings in YAML need the package yaml; write them as JSON") from e
            given = yaml.safe_load(text)
        else:
            given = json.loads(text)
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"{path} cannot be read: {e}") from e
    if not isinstance(given, dict) or not all(isinstance(v, dict) for v in given.values()):
        raise ConfigError(f"{path} has to hold sections")
    return given


def load_settings(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings from a JSON or YAML file with sections alignment, synteny, shares and paths; environment variables override them."""
    given = _parsed(Path(path)) if path else {}
    env = dict(os.environ) if env is None else env
    return Settings(*(_section(kind, given.get(name, {}), env) for name, kind in (("alignment", Alignment), ("synteny", Synteny), ("shares", SplitShares), ("paths", Paths))))
