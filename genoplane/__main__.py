"""Command line: label a feature table, build a feature matrix, or predict capability from hits and annotations.

Exit codes: 0 all done, 1 some genomes failed, 2 the inputs cannot be used.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from genoplane.config import load_settings
from genoplane.operators.features import GenomeFeaturizer
from genoplane.operators.hits import HIT_SCHEMA
from genoplane.operators.labeling import TRAINING_TIERS
from genoplane.plans.pipelines import annotate, feature_matrix, predictions
from genoplane.session import build_session, cut_lineage
from genoplane.sources.readers import accession_list, annotation_files, distinct_in_order, numbered_lines, table_source
from genoplane.sources.sinks import label_and_write, run_metadata, write_feature_matrix, write_predictions

log = logging.getLogger("genoplane")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genoplane", description=__doc__)
    p.add_argument("--settings", help="JSON file")
    p.add_argument("--master", help="Spark master")
    sub = p.add_subparsers(dest="command", required=True)
    label = sub.add_parser("label")
    for name in ("features", "labels", "output", "training-output", "report"):
        label.add_argument(f"--{name}", required=True)
    label.add_argument("--strict-mismatches", action="store_true")
    label.add_argument("--tiers", nargs="+", default=list(TRAINING_TIERS))
    label.add_argument("--extra-sources", nargs="*", default=[])
    predict = sub.add_parser("predict")
    for name in ("accessions", "hits", "annotations", "output"):
        predict.add_argument(f"--{name}", required=True)
    matrix = sub.add_parser("features")
    for name in ("accessions", "hits", "annotations", "output", "metadata"):
        matrix.add_argument(f"--{name}", required=True)
    matrix.add_argument("--genomes", help="table of genomes (.csv or .parquet) with an accession and taxonomy columns")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    try:
        settings = load_settings(args.settings)
        spark = build_session(master=args.master)
        if args.command == "label":
            report = label_and_write(table_source(spark, args.features), table_source(spark, args.labels), args.output, args.training_output, args.report, strict_mismatches=args.strict_mismatches, tiers=tuple(args.tiers), extra_sources=args.extra_sources)
            log.info("%s rows, %s for training", report["matched_rows"], report["training_ready_rows"])
            return 0
        listed, _ = accession_list(numbered_lines(spark, args.accessions))
        listed = cut_lineage(listed, "listed")
        hits = spark.read.schema(HIT_SCHEMA).option("sep", "\t").option("header", True).csv(args.hits)
        loci, _ = annotation_files(spark, args.annotations)
        genomes = distinct_in_order(listed).select("accession")
        annotated = annotate(genomes, hits, loci, settings)
        if args.command == "features":
            if args.genomes:
                genomes = genomes.join(table_source(spark, args.genomes).dropDuplicates(["accession"]), "accession", "left")
            matrix = feature_matrix(listed, genomes, annotated, GenomeFeaturizer())
            write_feature_matrix(matrix.drop("ordinal"), args.output)
            report = run_metadata(table_source(spark, args.output), listed.count(), annotated.failures, args.metadata)
            log.info("%s rows, %s genomes failed", report["rows"], report["failed"])
            return 1 if report["failed"] else 0
        results = cut_lineage(predictions(genomes, annotated), "predictions")
        write_predictions(results, args.output)
        failed = results.filter(F.col("status") != "SUCCESS").count()
        log.info("%s genomes, %s failed", results.count(), failed)
        return 1 if failed else 0
    except (ValueError, OSError, PySparkException) as e:
        log.error("%s", str(e).splitlines()[0] if str(e) else type(e).__name__)
        return 2


if __name__ == "__main__":
    sys.exit(main())
