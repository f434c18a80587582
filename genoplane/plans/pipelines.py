"""The stages end to end: search hits and annotations to clusters, features and predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoplane.config import Settings
from genoplane.operators.clusters import find_clusters
from genoplane.operators.features import GenomeFeaturizer
from genoplane.operators.hits import passing_hits, resolve_overlaps
from genoplane.operators.loci import match_statistics, resolve_hits, unmatched_hits
from genoplane.operators.predict import capability_scores
from genoplane.sources.readers import in_list_order

NO_LOCI = "no annotated locus"
UNMATCHED = "no hit leads to a locus"
EXAMPLES = 5


@dataclass(frozen=True)
class Annotated:
    """Hits within the thresholds and without overlaps, the valid clusters, and the genomes that failed (accession, error).

    `warnings` (accession, unmatched_ids, examples) has the genomes of which some hits lead to no locus, with at most
    EXAMPLES protein ids each; the whole list is `match_lists`.
    """

    hits: DataFrame
    clusters: DataFrame
    failures: DataFrame
    warnings: DataFrame


def annotate(genomes: DataFrame, hits: DataFrame, loci: DataFrame, settings: Settings = Settings(), models: DataFrame | None = None, contig_lengths: DataFrame | None = None) -> Annotated:
    """Thresholds, overlap resolution per protein and profile file, resolution to loci, and clustering.

    `genomes` has an accession per genome; `hits` the columns of HIT_SCHEMA; `loci` those of `annotation_loci`. A
    genome fails alone: without any locus, or with hits none of which leads to one. A genome without hits does
    not fail. Overlaps count within a profile file only, so families of different files may share a stretch.
    """
    good = passing_hits(hits, settings.alignment, models)
    order = [("effective_score", True), ("dom_evalue", False), ("query_cov", True), ("env_from", False), ("env_to", False), ("gene_family", False)]
    kept = resolve_overlaps(good, ["accession", "profile_file", "target_protein"], "env_from", "env_to", order, settings.alignment.max_overlap_fraction)
    # what names a hit of a genome: two with all of these equal are one
    row = F.struct("profile_file", "target_protein", "gene_family", "env_from", "env_to", "effective_score")
    kept = kept.withColumn("hit_row", row)
    listed = genomes.select("accession").distinct()
    bare = listed.join(loci.select("accession").distinct(), "accession", "left_anti").select("accession", F.lit(NO_LOCI).alias("error"))
    lost = match_statistics(kept, loci, ["accession"]).filter("hit_rows > 0 AND matched_rows = 0").select("accession", F.lit(UNMATCHED).alias("error"))
    failures = bare.unionByName(lost.join(bare, "accession", "left_anti"))
    usable = listed.join(failures, "accession", "left_anti")
    resolved = resolve_hits(kept.join(usable, "accession", "left_semi"), loci, ["accession"])
    # one row per unmatched id: the first few of a genome are kept as its ids are counted
    ids = unmatched_hits(kept, loci, ["accession"]).select("accession", F.col("protein_id").alias("id")).distinct().join(usable, "accession", "left_semi")
    place = F.row_number().over(Window.partitionBy("accession").orderBy("id"))
    few = ids.withColumn("place", place).filter(F.col("place") <= EXAMPLES).groupBy("accession").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    warnings = ids.groupBy("accession").agg(F.count(F.lit(1)).alias("unmatched_ids")).join(few, "accession")
    return Annotated(kept, find_clusters(resolved, settings.synteny, contig_lengths), failures, warnings)


def feature_matrix(listed: DataFrame, genomes: DataFrame, annotated: Annotated, featurizer: GenomeFeaturizer, fit_on: DataFrame | None = None) -> DataFrame:
    """One row per listed accession (ordinal, accession) that did not fail, in list order, repetitions included.

    `fit_on` limits what the featurizer learns from, such as the training genomes.
    """
    good = genomes.join(annotated.failures, "accession", "left_anti")
    learned = good.join(fit_on.select("accession").distinct(), "accession", "left_semi") if fit_on is not None else good
    matrix = featurizer.fit(learned, annotated.hits).transform(good, annotated.hits, annotated.clusters)
    return in_list_order(listed, matrix)


def predictions(genomes: DataFrame, annotated: Annotated) -> DataFrame:
    """Genomes with status, clusters_found, confidence_score_percent, bnf_capable and error; failed ones are not capable."""
    scored = capability_scores(genomes.drop("status", "error"), annotated.clusters)
    marked = scored.join(annotated.failures, "accession", "left")
    return marked.withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED")).withColumn("error", F.coalesce("error", F.lit("")))
