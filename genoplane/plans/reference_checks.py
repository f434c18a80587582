"""Queries on references without a target (p2) and on keys that hold most rows (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoplane.functions.text import accession_text, group_key, is_blank, word_key
from genoplane.operators.hotkeys import frequent_keys, per_key_states
from genoplane.operators.orphans import apply_deltas, current_orphans, existence_deltas, orphans_as_of
from genoplane.operators.wording import read_words
from genoplane.plans.tables import table

# table, its id, key and time; the table referred to, its key, start and end
LINKS = (
    ("label_manifest", "label_id", "assembly_accession", "recorded_at", "feature_matrix", "accession_id", "built_at", "dropped_at"),
    ("feature_matrix", "feature_row_id", "accession_id", "built_at", "assembly_metadata", "accession", "loaded_at", "withdrawn_at"),
)
FREQUENT = 0.02


def _references(spark: SparkSession, sf_dir: str, link: tuple) -> tuple[DataFrame, DataFrame]:
    name, row_id, key, at, target, target_key, start, end = link
    refs = table(spark, sf_dir, name).select(accession_text(F.col(key)).alias("key"), F.col(at).alias("at"), F.col(row_id).alias("row_id"))
    return refs, existence_deltas(table(spark, sf_dir, target), accession_text(F.col(target_key)), start, end)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [orphans_as_of(*_references(spark, sf_dir, link)).withColumn("table_name", F.lit(link[0])) for link in LINKS]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id")


def p2_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month (null where the reference has no time) and reason."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return _orphans(spark, sf_dir).groupBy("table_name", month, "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


def p2_current_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are referred to now and exist no more or never did: rows dropped meanwhile refer to nothing."""
    parts = []
    for link in LINKS:
        refs, deltas = _references(spark, sf_dir, link)
        if link[0] == "feature_matrix":  # its rows come and go themselves
            refs = existence_deltas(table(spark, sf_dir, link[0]), accession_text(F.col(link[2])), link[3], "dropped_at")
        else:
            refs = refs.withColumn("delta", F.lit(1))
        parts.append(current_orphans(apply_deltas(None, refs, deltas)).select(F.lit(link[0]).alias("table_name"), "key", F.col("refs").alias("n_refs")))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        frequent_keys(table(spark, sf_dir, name), key, FREQUENT).select(F.lit(name).alias("table_name"), "key_value")
        for name, key in (("grouped_training_dataset", "source_genome_id"), ("label_manifest", "taxonomy_group"))
    ]
    return parts[0].unionByName(parts[1])


def p6_taxonomy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, label words and time span per taxonomy group, however written; null is the rows without group."""
    labels = read_words(table(spark, sf_dir, "label_manifest"), {"group_name": ("taxonomy_group", group_key), "label": ("target_label", word_key)})
    labels = labels.select("group_name", "label", accession_text(F.col("assembly_accession")).alias("accession"), "recorded_at")
    count = lambda word: F.count_if(F.col("label") == word)
    return per_key_states(
        labels,
        ["group_name"],
        [F.count(F.lit(1)).alias("n_labels"), count("positive").alias("n_positive"), count("negative").alias("n_negative"), count("uncertain").alias("n_uncertain"), F.count_distinct("accession").alias("n_accessions"), F.min("recorded_at").alias("first_recorded"), F.max("recorded_at").alias("last_recorded")],
    )


def p6_source_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, present values and extremes of the measured features per source genome id, as stored."""
    rows = table(spark, sf_dir, "grouped_training_dataset").filter(~is_blank(F.col("source_genome_id")))
    return per_key_states(
        rows,
        ["source_genome_id"],
        [F.count(F.lit(1)).alias("n_records"), F.count("feature_a").alias("n_feature_a"), F.min("feature_a").alias("min_feature_a"), F.max("feature_a").alias("max_feature_a"), F.sum(F.col("feature_b").cast("bigint")).alias("sum_feature_b"), F.max("feature_h").alias("max_feature_h"), F.min("ingested_at").alias("first_ingested"), F.count_distinct("assembly_accession").alias("n_assemblies")],
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_orphans_by_month, p2_current_orphans, p6_found, p6_taxonomy_groups, p6_source_genomes)}

_KEY = "nullif(lower(trim({c}, e' \\t\\n')), '')"
_P2_REFS = f"""
refs AS (
  SELECT 'label_manifest' AS table_name, label_id AS row_id, {_KEY.format(c="assembly_accession")} AS k, recorded_at AS at, NULL::TIMESTAMP AS until FROM label_manifest
  UNION ALL SELECT 'feature_matrix', feature_row_id, {_KEY.format(c="accession_id")}, built_at, dropped_at FROM feature_matrix),
held AS (
  SELECT 'label_manifest' AS table_name, {_KEY.format(c="accession_id")} AS k, built_at AS lo, dropped_at AS hi FROM feature_matrix
  UNION ALL SELECT 'feature_matrix', {_KEY.format(c="accession")}, loaded_at, withdrawn_at FROM assembly_metadata),
orphans AS (
  SELECT r.* FROM refs r WHERE r.k IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM held h WHERE h.table_name = r.table_name AND h.k = r.k AND h.lo <= r.at AND (h.hi IS NULL OR h.hi > r.at)))
"""
_WORD = r"regexp_replace(translate(lower({c}), 'аеорсх', 'aeopcx'), '\p{{Cf}}', '', 'g')"
_BARE = r"""CASE WHEN regexp_matches(regexp_replace({w}, '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '[\p{{L}}\p{{N}}]')
  THEN regexp_replace({w}, '[\(\[][^\)\]]*[\)\]]', ' ', 'g') ELSE {w} END"""


def word_sql(c: str) -> str:
    """DuckDB's form of `word_key` for the writings of the test tables (no full-width letters)."""
    bare = _BARE.format(w=_WORD.format(c=c))
    ranks = "superkingdom|domain|kingdom|phylum|class|order|family|genus|tier|rank"
    s = rf"regexp_replace({bare}, '^[^\p{{L}}\p{{N}}]*[dkpcofgs]__', '')"
    s = rf"regexp_replace({s}, '(^|[^\p{{L}}\p{{N}}])({ranks})($|[^\p{{L}}\p{{N}}])', ' ', 'g')"
    return rf"nullif(regexp_replace({s}, '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"


_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("＇", "")
_PLAIN = "".join(chr(0x21 + i) for i in range(94)).replace("'", "")


def visible_sql(c: str) -> str:
    """DuckDB's form of `visible`."""
    return rf"lower(translate(regexp_replace({c}, '\p{{Cf}}', '', 'g'), '{_WIDE}АВСЕНКМОРТХаеорсх', '{_PLAIN}ABCEHKMOPTXaeopcx'))"


def genome_sql(c: str) -> str:
    """DuckDB's form of `genome_key`, for one scalar `c` that is already made visible."""
    number = rf"coalesce(nullif(regexp_extract({c}, '(?:gc[af]|assembly|accession)[^0-9a-z]*((?:[0-9o]{{1,3}}[^0-9a-z.]){{2}}[0-9o]{{3}})(?:$|[^0-9])', 1), ''), regexp_extract({c}, '(?:gc[af]|assembly|accession)[^0-9a-z]*([0-9o]+)', 1))"
    named = rf"regexp_replace(regexp_replace({c}, '(\S)\s*[\(\[].*$', '\1'), '(^|[^a-z])(nr|no|num|number)($|[^a-z])', '\1\3', 'g')"
    unzero = lambda x: f"CASE WHEN ltrim({x}, '0') = '' AND {x} <> '' THEN '0' ELSE ltrim({x}, '0') END"
    digits = unzero(f"translate(regexp_replace({number}, '[^0-9o]', '', 'g'), 'o', '0')")
    name, count = f"regexp_replace({named}, '[^a-z]', '', 'g')", f"regexp_extract({named}, '([0-9]+)', 1)"
    return rf"""CASE WHEN {c} IS NULL OR NOT regexp_matches({c}, '[^\s\p{{Z}}]') THEN NULL
  WHEN {number} <> '' THEN 'acc:' || ({digits})
  WHEN {name} <> '' AND {count} <> '' THEN 'set:' || {name} || ':' || ({unzero(count)})
  ELSE 'raw:' || regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', '', 'g') END"""


SQL = {
    "p2_found": f"WITH {_P2_REFS} SELECT table_name, row_id FROM orphans",
    "p2_orphans_by_month": f"""WITH {_P2_REFS},
born AS (SELECT table_name, k, min(lo) AS first FROM held WHERE hi IS NULL OR hi > lo GROUP BY ALL)
SELECT o.table_name, strftime(o.at, '%Y-%m') AS month,
  CASE WHEN b.first <= o.at THEN 'deleted' WHEN b.first IS NOT NULL THEN 'later' ELSE 'missing' END AS reason, count(*) AS n_orphans
FROM orphans o LEFT JOIN born b USING (table_name, k) GROUP BY ALL""",
    "p2_current_orphans": f"""WITH {_P2_REFS}
SELECT r.table_name, r.k AS key, count(*) AS n_refs FROM refs r
WHERE r.k IS NOT NULL AND r.until IS NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.table_name = r.table_name AND h.k = r.k AND h.hi IS NULL)
GROUP BY ALL""",
    "p6_found": """SELECT 'grouped_training_dataset' AS table_name, source_genome_id AS key_value FROM grouped_training_dataset
WHERE trim(source_genome_id, e' \\t\\n\\r\\u00a0') <> '' GROUP BY ALL HAVING count(*) > 0.02 * (SELECT count(*) FROM grouped_training_dataset)
UNION ALL SELECT 'label_manifest', taxonomy_group FROM label_manifest
WHERE trim(taxonomy_group, e' \\t\\n\\r\\u00a0') <> '' GROUP BY ALL HAVING count(*) > 0.02 * (SELECT count(*) FROM label_manifest)""",
    "p6_taxonomy_groups": f"""WITH l AS (SELECT nullif({word_sql("taxonomy_group")}, 'unclassified') AS group_name, {word_sql("target_label")} AS label, {_KEY.format(c="assembly_accession")} AS accession, recorded_at FROM label_manifest)
SELECT group_name, count(*) AS n_labels, count(*) FILTER (label = 'positive') AS n_positive, count(*) FILTER (label = 'negative') AS n_negative,
  count(*) FILTER (label = 'uncertain') AS n_uncertain, count(DISTINCT accession) AS n_accessions, min(recorded_at) AS first_recorded, max(recorded_at) AS last_recorded
FROM l GROUP BY group_name""",
    "p6_source_genomes": """SELECT source_genome_id, count(*) AS n_records, count(feature_a) AS n_feature_a, min(feature_a) AS min_feature_a, max(feature_a) AS max_feature_a,
  sum(feature_b)::BIGINT AS sum_feature_b, max(feature_h) AS max_feature_h, min(ingested_at) AS first_ingested, count(DISTINCT assembly_accession) AS n_assemblies
FROM grouped_training_dataset WHERE trim(source_genome_id, e' \\t\\n\\r\\u00a0') <> '' GROUP BY source_genome_id""",
}
