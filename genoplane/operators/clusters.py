"""Gap clustering of neighbouring loci, and what the clusters are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoplane.config import Synteny
from genoplane.operators.ranking import distributed_rank, fits_one_task
from genoplane.session import cut_lineage

# Gene symbols of protein families, and the families of each kind of cluster.
FAMILY_SYMBOLS = {"PF00142": "nifH", "PF00148": "nifD", "PF02826": "nifK", "PF05910": "anfG", "PF05911": "vnfG", "PF01202": "fixA", "PF02525": "fixB", "PF02526": "fixC", "PF01802": "fixX"}
H_FAMILIES = ("nifH", "vnfH", "anfH", "PF00142")
D_FAMILIES = ("nifD", "vnfD", "anfD", "PF00148")
K_FAMILIES = ("nifK", "vnfK", "anfK", "PF02826")
VNF_FAMILIES = ("vnfG", "vnfEN", "vnfH", "vnfD", "vnfK", "PF05911")
ANF_FAMILIES = ("anfG", "anfH", "anfD", "anfK", "PF05910")

TIES = ("hit_row", "locus_row")


def _begins(reach: Column, before: Column, synteny: Synteny) -> Column:
    """1 where a locus lies beyond the limit after the furthest end so far (null: none) and the strand before it."""
    divergent = (before == "-") & (F.col("strand") == "+")
    limit = F.when(divergent, synteny.max_divergent_gap_bp).otherwise(synteny.max_gap_bp)
    return F.when(reach.isNull() | (F.col("start") - reach - 1 > limit), 1).otherwise(0)


def number_gap_clusters(loci: DataFrame, synteny: Synteny, genome: str = "accession", contig: str = "seqid", ties: Sequence[str] = TIES, one_task: bool | None = None) -> DataFrame:
    """Add ``contig_cluster`` (1, 2, ... per genome and contig): loci of a contig whose gaps are small enough.

    In order of (start, end, *ties) a locus begins a new cluster if the bases between it and the furthest end so
    far exceed the limit: max_divergent_gap_bp where a minus strand is followed by a plus strand, else
    max_gap_bp. The furthest end of the contig equals that of the running cluster, since ends are not before
    starts and limits are not negative.

    A table that fits one task (`one_task`, by default the planner's estimate) takes one window per contig. A larger one is
    range-partitioned by contig and position, so a contig of any size spans many tasks: each part hands on its furthest
    end, its last strand and its number of clusters, one row per part and contig, and the parts after it go on from there.
    """
    keys, order = [genome, contig], ["start", "end", *ties]
    if fits_one_task(loci) if one_task is None else one_task:
        w = Window.partitionBy(*keys).orderBy(*order)
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = loci.withColumn("_begins", _begins(reach, F.lag("strand").over(w), synteny))
        return marked.withColumn("contig_cluster", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")
    ranged = loci.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut_lineage(ranged.withColumn("_part", F.shiftright("_at", 33)), "loci")
    part = ["_part", *keys]
    earlier = Window.partitionBy(*keys).orderBy("_part")
    sofar = earlier.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*part).agg(F.max("end").alias("_end"), F.max_by("strand", "_at").alias("_strand"))
    ends = ends.select(*part, F.max("_end").over(sofar).alias("_reach"), F.lag("_strand").over(earlier).alias("_last"))
    inside = Window.partitionBy(*part).orderBy("_at")
    reach = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    before = F.when(F.row_number().over(inside) == 1, F.col("_last")).otherwise(F.lag("strand").over(inside))
    marked = rows.join(ends, part).withColumn("_begins", _begins(reach, before, synteny))
    marked = cut_lineage(marked.withColumn("_own", F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach", "_last", "_begins"), "marked")
    counts = marked.groupBy(*part).agg(F.max("_own").alias("_n"))
    counts = counts.select(*part, F.coalesce(F.sum("_n").over(sofar), F.lit(0)).alias("_clusters"))
    return marked.join(counts, part).withColumn("contig_cluster", F.col("_own") + F.col("_clusters")).drop("_at", "_part", "_own", "_clusters")


def roll_up(numbered: DataFrame, genome: str = "accession", contig: str = "seqid", ties: Sequence[str] = TIES) -> DataFrame:
    """One row per cluster, numbered per genome in order of contig and position.

    gene_count and strands are of distinct loci; gene_families and protein_ids are distinct in order of
    appearance, with ``unknown`` for a missing family. A cluster's loci are gathered in one array: tens, bounded
    by the neighbourhood on a chromosome. The aggregation follows the partitioning of the window before it.
    """
    protein = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("protein_id", "locus_protein_id", "locus_tag") if c in numbered.columns], F.lit("unknown"))
    item = F.struct("start", "end", *ties, F.coalesce("gene_family", F.lit("unknown")).alias("family"), protein.alias("protein"), "strand")
    grouped = numbered.groupBy(genome, contig, "contig_cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(item)).alias("items"))
    loci = F.array_distinct(F.transform("items", lambda x: F.struct(x[ties[-1]], x["strand"].alias("strand"))))
    out = grouped.select(
        genome, contig, "contig_cluster", "start", "end", (F.col("end") - F.col("start") + 1).alias("span_bp"), F.size(loci).cast("bigint").alias("gene_count"),
        F.array_distinct(F.transform("items", lambda x: x["family"])).alias("gene_families"), F.array_distinct(F.transform("items", lambda x: x["protein"])).alias("protein_ids"), F.transform(loci, lambda x: x["strand"]).alias("strands"),
    )
    n = F.size("strands")
    changes = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & (F.get("strands", i) != F.get("strands", i - 1)))
    out = out.withColumn("strand_switches", F.size(changes))
    if fits_one_task(numbered):
        out = out.withColumn("cluster_no", F.row_number().over(Window.partitionBy(genome).orderBy(contig, "contig_cluster")))
    else:
        out = distributed_rank(out, [genome], [F.col(contig), F.col("contig_cluster")]).withColumn("cluster_no", F.col("rank").cast("int")).drop("rank")
    return out.withColumn("cluster_id", F.format_string("cluster_%04d", "cluster_no")).drop("contig_cluster")


def _shared(families: Column, names: Sequence[str]) -> Column:
    return F.size(F.array_intersect(families, F.array(*map(F.lit, names))))


def with_types(clusters: DataFrame) -> DataFrame:
    """Add cluster_type (vnf, anf, nif, accessory), has_catalytic_core and has_any_core_subunit."""
    symbols = F.create_map(*[F.lit(x) for kv in FAMILY_SYMBOLS.items() for x in kv])
    known = F.filter(F.transform("gene_families", lambda f: F.try_element_at(symbols, f)), lambda x: x.isNotNull())
    names = F.array_union("gene_families", known)
    cores = [(_shared(F.col("_names"), s) > 0).cast("int") for s in (H_FAMILIES, D_FAMILIES, K_FAMILIES)]
    core = cores[0] + cores[1] + cores[2]
    vnf, anf = _shared(F.col("_names"), VNF_FAMILIES), _shared(F.col("_names"), ANF_FAMILIES)
    holds = lambda *x: F.arrays_overlap("_names", F.array(*map(F.lit, x)))
    kind = (
        F.when((vnf > 0) & (vnf >= anf) & holds("vnfG", "PF05911"), "vnf")
        .when((anf > vnf) & holds("anfG", "PF05910"), "anf")
        .when(F.exists("_names", lambda x: x.startswith("nif")) | (core >= 2), "nif")
        .otherwise("accessory")
    )
    return clusters.withColumn("_names", names).withColumns({"cluster_type": kind, "has_catalytic_core": core >= 2, "has_any_core_subunit": core >= 1}).drop("_names")


def with_truncation(clusters: DataFrame, synteny: Synteny, contig_lengths: DataFrame | None = None, genome: str = "accession", contig: str = "seqid") -> DataFrame:
    """Add is_truncated, truncated_side (5prime, 3prime, both or null) and quality_status to typed clusters.

    The 5' side needs no contig length; the 3' side is unknown, hence not truncated, where the length
    (genome, contig, contig_length) is.
    """
    if contig_lengths is not None:
        clusters = clusters.join(contig_lengths, [genome, contig], "left")
    else:
        clusters = clusters.withColumn("contig_length", F.lit(None).cast("bigint"))
    five = F.col("start") <= synteny.edge_margin_bp
    three = F.coalesce(F.col("contig_length") - F.col("end") <= synteny.edge_margin_bp, F.lit(False))
    side = F.when(five & three, "both").when(five, "5prime").when(three, "3prime")
    status = F.when(F.col("has_catalytic_core") & ~(five | three), "complete").when((five | three) & F.col("has_any_core_subunit"), "partial_truncated").otherwise("accessory_only")
    return clusters.withColumns({"is_truncated": five | three, "truncated_side": side, "quality_status": status}).drop("contig_length")


def valid_clusters(clusters: DataFrame, synteny: Synteny) -> DataFrame:
    """Clusters with enough families and a catalytic core, and truncated ones with any core subunit. Numbers keep their gaps."""
    n = F.size("gene_families")
    whole = (n >= synteny.min_core_genes) & F.col("has_catalytic_core")
    return clusters.filter(whole | (F.col("is_truncated") & (n >= 1) & F.col("has_any_core_subunit")))


def find_clusters(loci: DataFrame, synteny: Synteny, contig_lengths: DataFrame | None = None) -> DataFrame:
    """From resolved loci to valid clusters. An empty table gives none."""
    typed = with_types(roll_up(number_gap_clusters(loci, synteny)))
    return valid_clusters(with_truncation(typed, synteny, contig_lengths), synteny)
