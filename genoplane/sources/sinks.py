"""Sinks: tables, hit dumps, reports and predictions."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoplane.operators.predict import flat_report
from genoplane.sources.readers import SourceError


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Parquet or CSV files by the suffix of `path`; the commit protocol makes it appear as a whole."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        df.write.mode(mode).parquet(path)
    elif suffix == ".csv":
        df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
    else:
        raise SourceError(f"{path} is neither .csv nor .parquet")


def write_feature_matrix(df: DataFrame, path: str, expected: int | None = None) -> list[str]:
    """Write a feature matrix, id and status first and the rest by name; returns the feature names.

    With `expected`, another number of rows is an error and nothing is written.
    """
    if expected is not None and (n := df.count()) != expected:
        raise SourceError(f"{n} rows instead of {expected}")
    first = [c for c in ("accession_id", "accession", "status") if c in df.columns]
    names = sorted(c for c in df.columns if c not in first)
    write_table(df.select(*first, *[F.col(f"`{c}`") for c in names]), path)
    return names


def write_report(report: Mapping, path: str, rows: Mapping[str, DataFrame] | None = None) -> None:
    """A JSON file with sorted keys on the driver, put in place at once.

    Each frame of `rows` becomes a list of all its rows (bare values if it has one column), in place of an entry
    of that name; it is written as it arrives, so the driver holds one part at a time.
    """
    rows = rows or {}
    kept = {k: v for k, v in report.items() if k not in rows}
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(json.dumps(kept, ensure_ascii=False, indent=2, sort_keys=True, default=str).removesuffix("}").rstrip())
            for i, (name, frame) in enumerate(rows.items()):
                f.write(f"{',' if kept or i else ''}\n  {json.dumps(name)}: [")
                for j, r in enumerate(frame.toLocalIterator()):
                    f.write(f"{',' if j else ''}\n    {json.dumps(r[0] if len(r) == 1 else r.asDict(), ensure_ascii=False, default=str)}")
                f.write("\n  ]")
            f.write("\n}")
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def run_metadata(features: DataFrame, requested: int, failures: DataFrame, path: str) -> dict:
    """Counts, names of the features and time of a feature run, returned and written as JSON with all its failures."""
    names = [c for c in features.columns if c not in ("accession_id", "accession", "status")]
    report = {
        "requested": requested, "rows": features.count(), "columns": len(features.columns), "failed": failures.count(), "num_features": len(names), "feature_names": names,
        "generated_at": datetime.now(timezone.utc).isoformat(),
    }
    write_report(report, path, {"failures": failures.orderBy("accession")})
    return report


def write_hits(hits: DataFrame, path: str) -> None:
    """Tab-separated hits, one folder per genome."""
    hits.write.mode("overwrite").partitionBy("accession").option("sep", "\t").option("header", True).csv(path)


def write_predictions(results: DataFrame, folder: str) -> None:
    """Full results as JSON lines and the flat report as CSV."""
    results.write.mode("overwrite").json(f"{folder}/predictions.json")
    write_table(flat_report(results), f"{folder}/predictions.csv")


def label_and_write(features: DataFrame, labels: DataFrame, full_path: str, training_path: str, report_path: str, **options) -> dict:
    """Label a dataset and write table, training rows and report with all keys without partner.

    A breach writes the report alone, with all offending values, rows and keys, and is raised again.
    """
    from genoplane.operators.labeling import LabelingError, label_dataset

    try:
        result = label_dataset(features, labels, **options)
    except LabelingError as e:
        write_report(e.report, report_path, e.tables)
        raise
    write_table(result.full, full_path)
    write_table(result.training, training_path)
    write_report(result.report, report_path, result.tables)
    return result.report
