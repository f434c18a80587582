"""Queries p1, p3, p4, p5, p7, p8 and p9 on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoplane.functions.text import accession_text, genome_key, group_key, is_blank, text_tokens, tier_key, visible, word_key
from genoplane.llm.mixing import entropy, mix_sources
from genoplane.llm.overlap import split_overlaps
from genoplane.llm.packing import pack_items
from genoplane.llm.sampling import cap_contributors, proportional_sample
from genoplane.llm.splits import assign_splits, component_states, mixed_components, record_components
from genoplane.llm.splitting import split_texts
from genoplane.operators.wording import read_words
from genoplane.plans.tables import table
from genoplane.session import cut_lineage

FEATURES = ("feature_a", "feature_c", "feature_d", "feature_e", "feature_f", "feature_g", "feature_h")
EVALUATION = ("externaltest", "acceptancetest", "edgecase")
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_words(table(spark, sf_dir, "grouped_training_dataset"), {"role": ("dataset_role", word_key)})
    rows = rows.withColumn("part", F.when(F.col("role") == "traincandidate", "train").when(F.col("role").isin(*EVALUATION), "evaluation"))
    rows = rows.withColumn("genome", genome_key(F.col("source_genome_id")))
    return split_overlaps(rows, "record_id", "part", "genome", "feature_b", FEATURES, ("role", "genome"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("record_id")


def p1_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation records per role and source genome (null: no genome named)."""
    n = lambda c: F.count_if(c)
    return _overlaps(spark, sf_dir).groupBy("role", "genome").agg(F.count(F.lit(1)).alias("n_records"), n(F.col("by_genome")).alias("n_same_genome"), n(F.col("by_features")).alias("n_same_features"))


CATEGORY = {"taxonomy_group": group_key, "target_label": word_key, "evidence_tier": tier_key}


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_words(table(spark, sf_dir, "label_manifest"), {c: (c, reading) for c, reading in CATEGORY.items()})
    rows = rows.select("label_id", *CATEGORY, accession_text(F.col("assembly_accession")).alias("accession"))
    targets = table(spark, sf_dir, "sample_target").select(*[reading(F.col(c)).alias(c) for c, reading in CATEGORY.items()], "target_share", "min_rows", "sample_rows")
    return proportional_sample(rows, targets, list(CATEGORY), "accession", "label_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _sample(spark, sf_dir)[1].filter("exhausted").select(F.col("taxonomy_group").alias("g"), F.col("target_label").alias("l"), F.col("evidence_tier").alias("t"))
    spec = table(spark, sf_dir, "sample_target").select("taxonomy_group", "target_label", "evidence_tier")
    same = (group_key(F.col("taxonomy_group")) == F.col("g")) & (word_key(F.col("target_label")) == F.col("l")) & (tier_key(F.col("evidence_tier")) == F.col("t"))
    return spec.join(short, same, "left_semi")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units available, wanted, given as quota and drawn per listed combination."""
    return _sample(spark, sf_dir)[1].drop("held")


def p3_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units available and wanted per listed combination."""
    return _sample(spark, sf_dir)[1].select("taxonomy_group", "target_label", "evidence_tier", "available", "wanted", "exhausted")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[0].withColumnRenamed("row_id", "label_id")


def _capped(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    rows = read_words(table(spark, sf_dir, "label_manifest"), {"taxonomy_group": ("taxonomy_group", group_key), "tier": ("evidence_tier", tier_key)})
    rows = rows.select("label_id", "taxonomy_group", "tier", "recorded_at")
    limits = table(spark, sf_dir, "contributor_limit").select(group_key(F.col("taxonomy_group")).alias("taxonomy_group"), "max_rows")
    if weighted:
        score = F.when(F.col("tier") == "A", 8.0).when(F.col("tier") == "B", 4.0).when(F.col("tier") == "C", 2.0).otherwise(1.0)
        return cap_contributors(rows, limits, "taxonomy_group", "label_id", score)
    grade = F.when(F.col("tier") == "A", 3).when(F.col("tier") == "B", 2).when(F.col("tier") == "C", 1).otherwise(0)
    return cap_contributors(rows, limits, "taxonomy_group", "label_id", None, [(grade, True), (F.col("recorded_at"), True), (F.col("label_id"), False)])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir, False).filter(~F.col("kept")).select("label_id")


def p4_kept_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir, False).groupBy("taxonomy_group").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_left_out"))


def p4_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random form: each group's cap is drawn without replacement in proportion to the tier's score."""
    return _capped(spark, sf_dir, True).filter("kept").select("label_id", "taxonomy_group")


def _connected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    rows = read_words(table(spark, sf_dir, "grouped_training_dataset"), {"label": ("target_label", word_key)})
    text = F.col("source_genome_id")
    # a text that begins with a plain visible character is not blank
    named = F.when(text.rlike("^[!-~]"), text).when(~is_blank(visible(text)), text)
    rows = rows.select("record_id", genome_key(text).alias("a"), genome_key(F.col("assembly_accession")).alias("b"), named.alias("text"), "label")
    return record_components(rows, "record_id", "a", "b", "text", "label")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_components(*_connected(spark, sf_dir)).select("first_record", F.col("record").alias("record_id"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(*_connected(spark, sf_dir), SHARES).select(F.col("record").alias("record_id"), "split")


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per split and label, with their share of the label."""
    counts = assign_splits(*_connected(spark, sf_dir), SHARES).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_records"))
    whole = F.sum("n_records").over(Window.partitionBy("label"))  # one row per split and label
    return counts.select("split", "label", "n_records", (F.col("n_records") / whole).alias("label_share"))


def p5_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many connected sets have which number of records (records without any id are left out)."""
    nodes, _, _ = _connected(spark, sf_dir)
    return component_states(nodes).groupBy(F.col("n").alias("n_records")).agg(F.count(F.lit(1)).alias("n_sets"))


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limit").filter(F.col("limit_name") == name).first()
    return int(row["max_tokens"]), int(row["overlap_tokens"] or 0)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity, _ = _limit(spark, sf_dir, "container")
    return pack_items(table(spark, sf_dir, "documents").select("doc_id", text_tokens(F.col("text")).alias("tokens")), "doc_id", F.col("tokens"), capacity), capacity


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that came out in more than one piece."""
    return _packed(spark, sf_dir)[0].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its pieces and tokens as they lie in the containers, and whether none of these is overfull."""
    packed, capacity = _packed(spark, sf_dir)
    packed = cut_lineage(packed, "packed")
    filled = packed.groupBy("container").agg((F.sum("size") <= capacity).alias("fits"))
    return packed.join(filled, "container").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("n_tokens"), F.bool_and("fits").alias("all_fit"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, the least number of containers that could hold them, and whether the packing is within 2 percent of it without overfull or unused numbers."""
    packed, capacity = _packed(spark, sf_dir)
    filled = packed.groupBy("container").agg(F.sum("size").alias("tokens")).filter("tokens > 0")
    out = filled.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"), F.max("container").alias("last"))
    least = F.ceil(F.col("n_tokens") / capacity)
    return out.select("n_tokens", least.alias("n_least"), (F.col("fullest") <= capacity).alias("none_overfull"), (F.col("n") <= least * 1.02 + 1).alias("well_filled"), (F.col("last") == F.col("n") - 1).alias("numbered_through"))


def _mixed(spark: SparkSession, sf_dir: str, weighting: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text_tokens(F.col("text")).alias("tokens"))
    docs = read_words(docs, {"source": ("source", word_key)})
    spec = table(spark, sf_dir, "source_weight").select(word_key(F.col("source")).alias("source"), "weight", "max_repeats", "total_tokens")
    target = None
    if weighting == "tempered":
        target = entropy({r["source"]: r["weight"] for r in spec.collect()})  # the specification: 20 rows
    return mix_sources(docs, "doc_id", "source", "tokens", spec, weighting, target)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _mixed(spark, sf_dir, "given")[1].filter("short").select(F.col("source").alias("k"))
    spec = table(spark, sf_dir, "source_weight").select("source")
    return spec.join(short, word_key(F.col("source")) == F.col("k"), "left_semi")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source goal, limit, exponent, budget and the share that the realised mix reaches."""
    out = _mixed(spark, sf_dir, "given")[1]
    return out.select("source", "weight", F.round("exponent", 6).alias("exponent"), F.round("goal_tokens", 3).alias("goal_tokens"), "source_tokens", "cap_tokens", F.round("budget_tokens", 3).alias("budget_tokens"), "mix_tokens", F.round("mix_share", 9).alias("mix_share"), "short")


def p8_mix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole blocks of the mix: documents and tokens of each, and documents that come twice in one (none)."""
    mix, report = _mixed(spark, sf_dir, "given")
    blocks = mix.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("n_tokens"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n_repeated"))
    return blocks.join(report.select("source", F.col("source_tokens").alias("n_tokens")), ["source", "n_tokens"]).select("source", "block", "n_documents", "n_tokens", "n_repeated")


def p8_tempered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by temperature: token shares flattened to the entropy of the given weights, or as far as repetition allows."""
    return _mixed(spark, sf_dir, "tempered")[1].select("source", F.round("weight", 6).alias("weight"), "source_tokens", "cap_tokens", F.round("budget_tokens", 3).alias("budget_tokens"), (F.col("mix_tokens") <= F.col("budget_tokens") + 1).alias("within_budget"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", *_limit(spark, sf_dir, "piece"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("piece = 0").select("doc_id", "cut")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the digest of its pieces joined without what they share, and whether sizes and overlaps are as specified."""
    most, overlap = _limit(spark, sf_dir, "piece")
    core = F.decode(F.substring(F.encode("body", "UTF-8"), F.col("overlap").cast("int") + 1, F.col("tokens").cast("int")), "UTF-8")
    before = F.lag("tokens").over(Window.partitionBy("doc_id").orderBy("piece"))  # the pieces of one document
    room = F.least(F.lit(overlap), most - (F.col("tokens") - F.col("overlap")), before)
    shares = (F.col("piece") == 0) & (F.col("overlap") == 0) | (F.col("overlap") <= overlap) & (F.col("overlap") > room - 4)
    pieces = _pieces(spark, sf_dir).select("doc_id", "piece", "cut", (F.col("tokens") <= most).alias("fits"), shares.alias("shares"), core.alias("core"), (F.col("tokens") - F.col("overlap")).alias("own"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece", "core"))), lambda x: x["core"])
    out = pieces.groupBy("doc_id", "cut").agg(F.md5(F.array_join(ordered, "").cast("binary")).alias("text_md5"), F.sum("own").alias("n_tokens"), F.bool_and("fits").alias("all_fit"), F.bool_and("shares").alias("all_share"))
    return out.select("doc_id", "cut", "text_md5", "n_tokens", "all_fit", "all_share")


def p9_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are cut, their tokens without what pieces share, and whether every piece is within the limit, per kind of cut."""
    most, _ = _limit(spark, sf_dir, "piece")
    return _pieces(spark, sf_dir).groupBy("cut").agg(F.count_if(F.col("piece") == 0).alias("n_documents"), F.sum(F.col("tokens") - F.col("overlap")).alias("n_tokens"), (F.max("tokens") <= most).alias("all_fit"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_overlap_report, p3_found, p3_report, p3_shortfalls, p3_sample, p4_found, p4_kept_by_group, p4_weighted_draw, p5_found, p5_splits, p5_split_report, p5_component_sizes,
        p7_found, p7_documents, p7_fill, p8_found, p8_report, p8_mix_blocks, p8_tempered_report, p9_found, p9_pieces, p9_sizes,
    )
}
