"""Profile files, downloaded files and data pointers on the driver's disk: small files that are checked before a run."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import shutil
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoplane.sources.readers import SourceError

# The endings of a pressed profile's index, of downloaded data, and the keys of a data pointer.
INDEX_ENDINGS = (".h3f", ".h3i", ".h3m", ".h3p")
DATA_ENDINGS = (".fna", ".faa", ".gff", ".jsonl", ".json")
POINTER_KEYS = ("md5", "size", "nfiles", "hash", "path")


def sha256_of(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def unpack_profile(archive: str | Path, target: str | Path, sha256: str | None = None) -> Path:
    """Unpack a .gz file to `target`, in place at once; a digest that is given has to be that of the archive (any letter case)."""
    if sha256 and sha256_of(archive) != sha256.lower():
        raise SourceError(f"{archive} does not have the digest {sha256}")
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    try:
        with gzip.open(archive, "rb") as f, open(part, "wb") as out:
            shutil.copyfileobj(f, out)
        os.replace(part, target)
    except (OSError, EOFError) as e:
        part.unlink(missing_ok=True)
        raise SourceError(f"{archive} cannot be unpacked: {e}") from e
    return target


def index_is_fresh(profile: str | Path) -> bool:
    """Whether all files of a profile's index are there, beside it under its full name or its stem, and none is older than it."""
    profile = Path(profile)
    if not profile.is_file():
        return False
    made = profile.stat().st_mtime
    for ending in INDEX_ENDINGS:
        beside = [p for p in (profile.with_name(profile.name + ending), profile.with_name(profile.stem + ending)) if p.is_file()]
        if not beside or beside[0].stat().st_mtime < made:
            return False
    return True


def profile_manifest(profiles: Mapping[str, Mapping], folder: str | Path) -> Path:
    """Write hmm_manifest.json: per profile name its fields (``filename`` among them) and its absolute path."""
    folder = Path(folder)
    out = folder / "hmm_manifest.json"
    rows = {name: dict(fields) | {"path": str((folder / fields["filename"]).resolve())} for name, fields in profiles.items()}
    out.write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    return out


def downloaded_files(files: DataFrame, accession: Column) -> DataFrame:
    """(accession, n_valid, n_empty, is_complete) per accession of `files` (path, length): data files whose name has the accession.

    Complete is an accession with a file and none that is empty.
    """
    name = F.substring_index("path", "/", -1)
    known = F.lower(name).rlike("(" + "|".join(re.escape(e) for e in DATA_ENDINGS) + ")$")
    rows = files.withColumn("accession", accession).filter(known & name.contains(F.col("accession")))
    out = rows.groupBy("accession").agg(F.count_if(F.col("length") > 0).alias("n_valid"), F.count_if(F.col("length") == 0).alias("n_empty"))
    return out.withColumn("is_complete", (F.col("n_valid") > 0) & (F.col("n_empty") == 0))


def data_pointer(text: str) -> dict:
    """The fields of a data-version pointer: md5, size and nfiles (numbers), hash and path; SourceError where md5 or path lacks."""
    found = dict(re.findall(rf"^[\s-]*({'|'.join(POINTER_KEYS)}):\s*(\S.*?)\s*$", text, flags=re.M))
    if missing := {"md5", "path"} - found.keys():
        raise SourceError(f"a pointer without {sorted(missing)}")
    return {k: int(v) if k in ("size", "nfiles") else v for k, v in found.items()}


def remove_empty_folders(roots: Iterable[str | Path]) -> list[str]:
    """Remove the folders under the roots that hold nothing, from the innermost; the roots stay. Returns what went, sorted."""
    gone = []
    for root in roots:
        for folder, _, _ in os.walk(root, topdown=False):
            if Path(folder) != Path(root) and not any(Path(folder).iterdir()):
                Path(folder).rmdir()
                gone.append(folder)
    return sorted(gone)
