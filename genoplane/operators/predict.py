"""Capability scores per genome and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points of the three core families, and the score from which a genome counts as capable.
FAMILY_POINTS = {"PF00142": 35.0, "PF00148": 35.0, "PF02826": 30.0}
CAPABLE_FROM = 70.0


def capability_scores(genomes: DataFrame, clusters: DataFrame, genome: str = "accession") -> DataFrame:
    """Per genome: number of clusters, the best cluster's points, and whether they suffice. Without clusters 0 and false."""
    points = F.lit(0.0)
    for family, p in FAMILY_POINTS.items():
        points = points + F.when(F.array_contains("gene_families", family), p).otherwise(0.0)
    best = clusters.groupBy(genome).agg(F.count(F.lit(1)).alias("clusters_found"), F.max(points).alias("confidence_score_percent"))
    out = genomes.join(best, genome, "left").fillna(0, ["clusters_found"]).fillna(0.0, ["confidence_score_percent"])
    return out.withColumn("bnf_capable", F.col("confidence_score_percent") >= CAPABLE_FROM)


def flat_report(results: DataFrame, genome: str = "accession") -> DataFrame:
    """The columns of the flat report, with defaults for missing ones and nulls; a failed genome keeps its status and error."""
    wanted = {"organism_name": F.lit("N/A"), "status": F.lit(None).cast("string"), "bnf_capable": F.lit(False), "confidence_score_percent": F.lit(0.0), "clusters_found": F.lit(0).cast("bigint"), "error": F.lit("")}
    return results.select(genome, *[(F.coalesce(c, d) if c in results.columns else d).alias(c) for c, d in wanted.items()])


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: genomes, successes and capable genomes."""
    return results.agg(F.count(F.lit(1)).alias("n_genomes"), F.count_if(F.col("status") == "SUCCESS").alias("n_success"), F.count_if("bnf_capable").alias("n_capable"))
