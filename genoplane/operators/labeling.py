"""Contract checks on labels and features, their one-to-one join, and the training mask."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoplane.functions.identifiers import STRICT_ACCESSION, is_iso_date
from genoplane.functions.text import is_blank

# The manifest's columns and vocabularies.
MANIFEST_COLUMNS = ("assembly_accession", "organism_name", "strain", "target_label", "evidence_tier", "evidence_source", "evidence_reference", "taxonomy_group", "source_genome_id", "dataset_role", "label_curator", "label_date", "notes")
OPTIONAL_COLUMNS = ("strain", "evidence_reference", "taxonomy_group", "notes")
VOCABULARIES = {
    "target_label": ("positive", "negative", "uncertain"),
    "evidence_tier": ("A", "B", "C"),
    "evidence_source": ("literature", "curated_database", "experimental_record", "gene_inference"),
    "dataset_role": ("train_candidate", "external_test", "acceptance_test", "edge_case"),
}
TRAINING_TIERS = ("A", "B")
PREVIEW = 10


class LabelingError(ValueError):
    """Inputs that break the contract; `report` has all that was found, `tables` by name the offending values and rows."""

    def __init__(self, report: dict, tables: dict[str, DataFrame] | None = None) -> None:
        super().__init__("; ".join(report["validation_errors"]))
        self.report, self.tables = report, tables or {}


@dataclass(frozen=True)
class LabelingResult:
    full: DataFrame
    training: DataFrame
    report: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)


def trimmed(df: DataFrame) -> DataFrame:
    """String columns without outer white space, null as an empty text."""
    return df.withColumns({f.name: F.regexp_replace(F.coalesce(f.name, F.lit("")), r"(?U)^\s+|\s+$", "") for f in df.schema if isinstance(f.dataType, T.StringType)})


def manifest_row_checks(sources: Iterable[str] = ()) -> dict[str, Column]:
    """Name and condition of each row-wise violation of a trimmed manifest."""
    allowed = VOCABULARIES | {"evidence_source": (*VOCABULARIES["evidence_source"], *sources)}
    required = [c for c in MANIFEST_COLUMNS if c not in OPTIONAL_COLUMNS]
    checks = {f"blank:{c}": F.col(c) == "" for c in required}
    checks["bad_accession"] = (F.col("assembly_accession") != "") & ~F.col("assembly_accession").rlike(f"^{STRICT_ACCESSION}$")
    checks |= {f"vocabulary:{c}": (F.col(c) != "") & ~F.col(c).isin(*words) for c, words in allowed.items()}
    checks["bad_date"] = (F.col("label_date") != "") & ~is_iso_date(F.col("label_date"))
    return checks


def duplicate_excess(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the non-blank keys on several rows."""
    return df.filter(~is_blank(F.col(key))).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_counts(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """(check, n_rows) in long form from one pass, with the excess of repeated keys."""
    one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("n_rows")) for i, name in enumerate(checks)])))
    excess = duplicate_excess(df, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_rows")).select(F.lit(f"duplicate:{key}").alias("check"), "n_rows")
    return long.unionByName(excess)


def check_offenders(df: DataFrame, checks: dict[str, Column], key: str, row: Column) -> DataFrame:
    """(check, value, row_id, n_rows) in long form: all that `check_counts` counts, by name.

    A blank field is named by the row's id (`row`), everything else by the offending value, once with the number
    of rows that have it; for repeated keys that is all their rows, of which the counts have all but one.
    """
    value = {name: F.col(name.partition(":")[2] or {"bad_accession": key, "bad_date": "label_date"}[name]) for name in checks}
    none = F.lit(None).cast("string")
    cells = [F.when(c, F.struct(F.lit(name).alias("check"), *((none.alias("value"), row.cast("string").alias("row_id")) if name.startswith("blank:") else (value[name].cast("string").alias("value"), none.alias("row_id"))))) for name, c in checks.items()]
    found = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("check", "value", "row_id").agg(F.count(F.lit(1)).alias("n_rows"))
    repeated = duplicate_excess(df, key).select(F.lit(f"duplicate:{key}").alias("check"), F.col(key).alias("value"), none.alias("row_id"), F.col("n").alias("n_rows"))
    return found.unionByName(repeated)


def feature_row_checks() -> dict[str, Column]:
    """Name and condition of each row-wise violation of a trimmed feature table."""
    key = F.col("accession_id")
    return {"blank:accession_id": key == "", "bad_accession": (key != "") & ~key.rlike(f"^{STRICT_ACCESSION}$")}


def invalid_values(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """(column_name, value, n_rows) of the values outside a vocabulary."""
    bad = df.filter((F.col(column) != "") & ~F.col(column).isin(*words))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(column).alias("column_name"), "value", "n_rows")


def histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n_rows) of each column, nulls included, in one pass over grouping sets of small vocabularies."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def unmatched_keys(features: DataFrame, labels: DataFrame, feature_key: str, label_key: str) -> DataFrame:
    """(side, accession) of the keys of either table that the other lacks."""
    f = features.select(F.col(feature_key).alias("accession")).filter(~is_blank(F.col("accession"))).distinct()
    g = labels.select(F.col(label_key).alias("accession")).filter(~is_blank(F.col("accession"))).distinct()
    side = lambda a, b, name: a.join(b, "accession", "left_anti").select(F.lit(name).alias("side"), "accession")
    return side(f, g, "feature").unionByName(side(g, f, "label"))


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is valid and not repeated: what is left when the others are put aside."""
    valid = df.filter(F.col(key).rlike(f"^{STRICT_ACCESSION}$"))
    return valid.join(duplicate_excess(valid, key).select(key), key, "left_anti")


def joined(features: DataFrame, labels: DataFrame, feature_key: str = "accession_id", label_key: str = "assembly_accession") -> DataFrame:
    """One-to-one join of tables with unique keys. Feature columns that clash with label columns get the suffix ``_feature``."""
    clash = {c: f"{c}_feature" for c in features.columns if c in labels.columns}
    f = features.withColumnsRenamed(clash)
    return f.join(labels, F.col(clash.get(feature_key, feature_key)) == F.col(label_key))


def training_conditions(tiers: Sequence[str] = TRAINING_TIERS) -> dict[str, Column]:
    """Why a row may not be used for training: name and the condition under which it may (never null)."""
    ok = {
        "target_label_not_binary": F.col("target_label").isin("positive", "negative"),
        "evidence_tier_not_allowed": F.col("evidence_tier").isin(*tiers),
        "dataset_role_not_train_candidate": F.col("dataset_role") == "train_candidate",
        "missing_evidence_reference": ~is_blank(F.col("evidence_reference")),
        "missing_source_genome_id": ~is_blank(F.col("source_genome_id")),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in ok.items()}


def training_rows(df: DataFrame, tiers: Sequence[str] = TRAINING_TIERS) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, training_conditions(tiers).values()))


def reference_warnings(df: DataFrame, tiers: Sequence[str] = TRAINING_TIERS) -> DataFrame:
    """Rows that only lack the evidence reference."""
    ok = training_conditions(tiers)
    missing = ok.pop("missing_evidence_reference")
    return df.filter(reduce(lambda a, b: a & b, ok.values()) & ~missing)


def exclusion_counts(df: DataFrame, tiers: Sequence[str] = TRAINING_TIERS) -> DataFrame:
    """(reason, n_rows); reasons overlap. ``excluded`` and ``training_ready`` count rows."""
    ok = training_conditions(tiers)
    every = reduce(lambda a, b: a & b, ok.values())
    cells = {k: F.count_if(~c) for k, c in ok.items()} | {"excluded": F.count_if(~every), "training_ready": F.count_if(every)}
    one = df.agg(*[c.alias(k) for k, c in cells.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n_rows")) for k in cells])))


def label_dataset(features: DataFrame, labels: DataFrame, strict_mismatches: bool = False, tiers: Sequence[str] = TRAINING_TIERS, extra_sources: Iterable[str] = ()) -> LabelingResult:
    """Validate both tables, join them one to one, and derive the training rows and a report.

    All violations are gathered before LabelingError is raised with the report. Keys without partner are
    warnings, or errors with `strict_mismatches`. The joined table is ordered by accession. Two aggregates check
    the inputs; the report holds counts and previews of at most PREVIEW values. `tables` of the result or of
    LabelingError have the whole lists: keys without partner under their name in the report, and `offenders` (see
    `check_offenders`; rows are named by their content as JSON).
    """
    report: dict = {"validation_errors": [], "validation_warnings": [], "generated_at": datetime.now(timezone.utc).isoformat()}
    errors, warnings = report["validation_errors"], report["validation_warnings"]
    if unknown := sorted(set(tiers) - set(VOCABULARIES["evidence_tier"])):
        errors.append(f"unknown training tiers {unknown}")
    if missing := [c for c in MANIFEST_COLUMNS if c not in labels.columns]:
        errors.append(f"the manifest lacks {missing}")
    if "accession_id" not in features.columns:
        errors.append("features lack accession_id")
    report["input_feature_rows"], report["input_label_rows"] = features.count(), labels.count()
    errors += [f"{name} are empty" for name, n in (("features", report["input_feature_rows"]), ("labels", report["input_label_rows"])) if not n]
    features, labels = trimmed(features), trimmed(labels)
    named: list[DataFrame] = []
    if not missing:
        found = {r["check"]: r["n_rows"] for r in check_counts(labels, manifest_row_checks(extra_sources), "assembly_accession").collect()}
        errors += [f"manifest {k}: {n} rows" for k, n in found.items() if n]
        if any(found.values()):
            named.append(check_offenders(labels, manifest_row_checks(extra_sources), "assembly_accession", F.to_json(F.struct(*MANIFEST_COLUMNS))).select(F.lit("manifest").alias("table_name"), "*"))
        report["duplicate_label_key_count"] = found["duplicate:assembly_accession"]
        for row in histograms(labels, ["target_label", "evidence_tier", "dataset_role"]).collect():
            report.setdefault(f"{row['column_name']}_distribution", {})[row["value"]] = row["n_rows"]
    if "accession_id" in features.columns:
        found = {r["check"]: r["n_rows"] for r in check_counts(features, feature_row_checks(), "accession_id").collect()}
        errors += [f"features {k}: {n} rows" for k, n in found.items() if n]
        if any(found.values()):
            named.append(check_offenders(features, feature_row_checks(), "accession_id", F.to_json(F.struct("*"))).select(F.lit("features").alias("table_name"), "*"))
        report["duplicate_feature_key_count"] = found["duplicate:accession_id"]
    if errors:
        raise LabelingError(report, {"offenders": reduce(DataFrame.unionByName, named)} if named else None)
    lone = unmatched_keys(features, labels, "accession_id", "assembly_accession")
    tables: dict[str, DataFrame] = {}
    for side in ("feature", "label"):
        one = lone.filter(F.col("side") == side)
        tables[f"unmatched_{side}_accessions"] = one.select("accession").orderBy("accession")
        n = one.count()
        report[f"unmatched_{side}_count"] = n
        report[f"unmatched_{side}_accessions"] = [r["accession"] for r in one.orderBy("accession").limit(PREVIEW).collect()]
        if n:
            (errors if strict_mismatches else warnings).append(f"{n} {side} keys without partner")
    if errors:
        raise LabelingError(report, tables)
    full = joined(features, labels)
    counts = {r["reason"]: r["n_rows"] for r in exclusion_counts(full, tiers).collect()}
    report["training_ready_rows"], report["excluded_from_training_count"] = counts.pop("training_ready"), counts.pop("excluded")
    report["matched_rows"] = report["training_ready_rows"] + report["excluded_from_training_count"]
    report["training_exclusion_reasons"] = counts
    if n := reference_warnings(full, tiers).count():
        warnings.append(f"{n} rows are excluded only for a missing evidence reference")
    return LabelingResult(full.orderBy("assembly_accession"), training_rows(full, tiers).orderBy("assembly_accession"), report, tables)
