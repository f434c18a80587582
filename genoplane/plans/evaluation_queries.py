"""Queries on labelling, folds, metrics, ranking and models."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoplane.functions.text import genome_key, word_key
from genoplane.operators import folds as D
from genoplane.operators import labeling as B
from genoplane.operators import metrics as M
from genoplane.operators.wording import read_words
from genoplane.operators.models import cross_validate, load_model, round_trip_mismatches, save_model, train
from genoplane.plans.reference_checks import genome_sql, visible_sql, word_sql
from genoplane.plans.tables import table
from genoplane.session import cut_lineage, shared_dir

SPLITS, REPEATS = 5, 3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.trimmed(table(spark, sf_dir, "label_manifest"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.trimmed(table(spark, sf_dir, "feature_matrix"))


def v4_manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.check_counts(_labels(spark, sf_dir), B.manifest_row_checks(), "assembly_accession")


def v6_feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.check_counts(_features(spark, sf_dir), B.feature_row_checks(), "accession_id")


def v4_manifest_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What v4_manifest_report counts, by value or label_id."""
    return B.check_offenders(_labels(spark, sf_dir), B.manifest_row_checks(), "assembly_accession", F.col("label_id"))


def v6_feature_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What v6_feature_report counts, by value or feature_row_id."""
    return B.check_offenders(_features(spark, sf_dir), B.feature_row_checks(), "accession_id", F.col("feature_row_id"))


def f9_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    parts = [B.invalid_values(labels, c, words) for c, words in B.VOCABULARIES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def a11_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.histograms(_labels(spark, sf_dir), ["target_label", "evidence_tier", "dataset_role"])


def a14_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.duplicate_excess(_labels(spark, sf_dir), "assembly_accession")


def u5_unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unmatched_keys(_features(spark, sf_dir), _labels(spark, sf_dir), "accession_id", "assembly_accession")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = B.unique_rows(_features(spark, sf_dir).filter("dropped_at IS NULL"), "accession_id").withColumn("notes", F.col("status"))
    return B.joined(features, B.unique_rows(_labels(spark, sf_dir), "assembly_accession"))


def j8_labeled_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select("assembly_accession", "feature_row_id", "label_id", "cluster_score", "notes", "notes_feature").orderBy("assembly_accession")


def f12_training_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.training_rows(_joined(spark, sf_dir)).select("assembly_accession", "target_label", "evidence_tier", "source_genome_id")


def f13_reference_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reference_warnings(_joined(spark, sf_dir)).select("assembly_accession")


def a15_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.exclusion_counts(_joined(spark, sf_dir))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with genome and label in one writing each, null where blank."""
    rows = read_words(table(spark, sf_dir, "grouped_training_dataset"), {"label": ("target_label", word_key)})
    return rows.select(F.col("record_id").cast("string").alias("assembly_accession"), genome_key(F.col("source_genome_id")).alias("source_genome_id"), F.col("label").alias("target_label"))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("target_label").isin("positive", "negative") & F.col("source_genome_id").isNotNull())


def _pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(_read(spark, sf_dir))
    pure = rows.join(D.mixed_groups(rows, "source_genome_id", "target_label").select("source_genome_id"), "source_genome_id", "left_anti")
    return cut_lineage(pure, "pure")


_KEYS = ("assembly_accession", "source_genome_id", "target_label")


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _pure(spark, sf_dir)
    return rows, D.fold_manifest(rows, *_KEYS, SPLITS, REPEATS)


def a16_mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mixed_groups(_labelled(_read(spark, sf_dir)), "source_genome_id", "target_label")


def v11_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled records, and the rows that the folds put aside: without a binary label, labelled without genome, of mixed genomes."""
    rows = cut_lineage(_read(spark, sf_dir), "grouped")
    binary = F.coalesce(F.col("target_label").isin("positive", "negative"), F.lit(False))
    aside = {"all_rows": F.count(F.lit(1)), "unlabelled_rows": F.count_if(~binary), "blank_group_rows": F.count_if(binary & F.col("source_genome_id").isNull())}
    whole = rows.agg(*[c.alias(k) for k, c in aside.items()])
    labelled = _labelled(rows)
    mixed = labelled.join(D.mixed_groups(labelled, "source_genome_id", "target_label"), "source_genome_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    return D.dataset_summary(labelled, *_KEYS).withColumns({k: whole.select(k).scalar() for k in aside} | {"mixed_rows": mixed})


def w8_fold_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)[1]


def v13_manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, manifest = _manifest(spark, sf_dir)
    return D.manifest_violations(rows, manifest, *_KEYS, SPLITS, REPEATS)


def a19_fold_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, manifest = _manifest(spark, sf_dir)
    return D.fold_counts(rows, manifest, "source_genome_id", "target_label")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows as predictions: the status is the model, found nifH the truth, the cluster score the score."""
    rows = table(spark, sf_dir, "feature_matrix").filter("nifh_count IS NOT NULL AND cluster_score IS NOT NULL")
    return rows.select(
        F.coalesce("status", F.lit("none")).alias("model_name"), F.lit(1).alias("repeat"), (F.col("feature_row_id") % 5 + 1).cast("int").alias("fold"), F.col("feature_row_id").alias("assembly_accession"),
        (F.col("nifh_count") > 0).alias("truth"), (F.col("cluster_score") >= 0.5).alias("guess"), F.round("cluster_score", 2).alias("score"),
    )


def _metrics(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    return M.binary_metrics(_predictions(spark, sf_dir), by, F.col("truth"), F.col("guess"), F.col("score"))


def a21_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_threshold_scores(M.confusion(_predictions(spark, sf_dir), ["model_name"], F.col("truth"), F.col("guess")))


def a23_auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.curve_scores(_predictions(spark, sf_dir), ["model_name"], F.col("truth"), F.col("score"))
    return got.select("model_name", F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


def a25_metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.aggregate_folds(_metrics(spark, sf_dir, ["model_name", "repeat", "fold"]), _metrics(spark, sf_dir, ["model_name"]))
    values = ("fold_mean", "fold_std", "fold_min", "fold_max", "pooled_value")
    return got.select("model_name", "metric", *[F.round(c, 7).alias(c) for c in values], "valid_fold_count", "total_fold_count")


def w6_model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.rank_models(M.aggregate_folds(_metrics(spark, sf_dir, ["model_name", "repeat", "fold"])))
    return got.select("rank", "model_name", *[F.round(c, 7).alias(c) for c in ("average_precision", "balanced_accuracy", "f1")], "tied_with_best")


def a20_oof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessions that are predicted more than once per model."""
    rows = table(spark, sf_dir, "feature_matrix").select(F.coalesce("status", F.lit("none")).alias("model_name"), F.lit(1).alias("repeat"), F.col("accession_id").alias("assembly_accession"))
    return M.prediction_coverage(rows).select("model_name", "assembly_accession", "n")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a feature column per element; in a shorter vector the last ones are null, which training refuses."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    elements = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)]
    return rows.select(F.col("vec_id").cast("string").alias("assembly_accession"), F.concat_ws("-", F.lit("g"), "label", F.col("vec_id") % 4).alias("source_genome_id"), F.when(F.col("label") < 5, "positive").otherwise("negative").alias("target_label"), *elements)


def _soundness(rows: DataFrame, aggregate: DataFrame) -> DataFrame:
    """What any sound cross-validation of `rows` has, per metric: counts of folds, values within their bounds, and pooled supports that add up to all rows of each repeat."""
    whole = rows.agg(F.count_if(F.col("target_label") == "positive").alias("p"), F.count_if(F.col("target_label") == "negative").alias("q")).first()
    counts = aggregate.agg(*[F.max(F.when(F.col("metric") == m, F.col("pooled_value"))).alias(m) for m in M.COUNTS]).first()
    adds_up = counts["positive_support"] == REPEATS * whole["p"] == counts["tp"] + counts["fn"] and counts["negative_support"] == REPEATS * whole["q"] == counts["tn"] + counts["fp"]
    within = F.when(F.col("metric").isin(*M.SCORES), (F.col("fold_min") >= 0) & (F.col("fold_max") <= 1) & F.col("fold_mean").between(F.col("fold_min"), F.col("fold_max"))).otherwise((F.col("fold_min") >= 0) & F.lit(bool(adds_up)))
    return aggregate.select("model_name", "metric", "valid_fold_count", "total_fold_count", within.alias("is_sound"))


def _cv(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _soundness(rows, cross_validate(rows, [model]).aggregate)


def m3_logreg_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "logistic_regression")


def m4_forest_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "random_forest")


def m5_svm_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "svc")


def m3_logreg_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the gradient of the weighted, penalised logistic loss vanishes at the fitted model: one row."""
    rows = _vectors(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    model = train(rows, "logistic_regression")
    n, fitted = sum(model.classes.values()), model.pipeline.stages[-1]
    y = F.when(F.col("target_label") == "positive", 1.0).otherwise(0.0)
    weight = F.when(F.col("target_label") == "positive", n / (2.0 * model.classes["positive"])).otherwise(n / (2.0 * model.classes["negative"]))
    scored = model.pipeline.transform(rows).select(vector_to_array("scaled").alias("x"), (weight * (vector_to_array("probability")[1] - y)).alias("e"))
    slopes = [F.sum(F.col("e") * F.get("x", F.lit(i))) / n + float(fitted.getRegParam() * c) for i, c in enumerate(fitted.coefficients)]
    steepest = F.greatest(F.abs(F.sum("e") / n), *[F.abs(s) for s in slopes])
    moments = [F.abs(F.avg(F.get("x", F.lit(i)))) + F.abs(F.stddev_pop(F.get("x", F.lit(i))) - 1) for i in range(len(model.features))]
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(model.features)).alias("n_features"), (steepest < 1e-5).alias("is_optimal"), (F.greatest(*moments) < 1e-9).alias("is_scaled"))


def m10_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose prediction changes when a model of any kind is stored and loaded: none."""
    rows = _vectors(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    parts = []
    for name in ("logistic_regression", "random_forest", "svc"):
        model = train(rows, name)
        path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
        save_model(model, path, "rows", "columns")
        parts.append(round_trip_mismatches(model, load_model(path)[0], rows, "assembly_accession").select(F.lit(name).alias("model_name"), "assembly_accession"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def m7_score_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per status by score channel: one has probabilities, the others scores without bounds, none both."""
    rows = _predictions(spark, sf_dir)
    has = F.col("model_name") == "none"
    rows = rows.withColumns({"positive_probability": F.when(has, F.col("score")), "decision_score": F.when(~has, F.col("score") * 10 - 5)})
    used = M.score_channels(rows)
    channels = spark.createDataFrame(sorted(used.items()), "model_name string, channel string")
    return rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(channels), "model_name")


QUERIES = {
    f.__name__: f
    for f in (
        v4_manifest_report, v4_manifest_offenders, v6_feature_report, v6_feature_offenders, f9_invalid_values, a11_histograms, a14_duplicate_keys, u5_unmatched_keys, j8_labeled_join, f12_training_mask, f13_reference_warnings, a15_exclusion_reasons, a16_mixed_groups, v11_dataset_summary, w8_fold_manifest, v13_manifest_checks,
        a19_fold_metadata, a21_confusion, a23_auc_ap, a25_metric_aggregate, w6_model_ranking, a20_oof_coverage, m3_logreg_cv, m3_logreg_optimum, m4_forest_cv, m5_svm_cv, m7_score_channels, m10_roundtrip,
    )
}

_TRIM = "regexp_replace(coalesce({c}, ''), '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"
_L = f"""l AS (SELECT label_id, {", ".join(f"{_TRIM.format(c=c)} AS {c}" for c in B.MANIFEST_COLUMNS)} FROM label_manifest)"""
_F = f"""f AS (SELECT feature_row_id, {_TRIM.format(c="accession_id")} AS accession_id, {_TRIM.format(c="status")} AS status, cluster_score, dropped_at FROM feature_matrix)"""
_ACC = "regexp_full_match({c}, 'GC[AF]_[0-9]{{9}}\\.[0-9]+')"
_WORDS = {c: ", ".join(f"'{w}'" for w in words) for c, words in B.VOCABULARIES.items()}
_CHECKS = (
    [(f"blank:{c}", f"{c} = ''") for c in B.MANIFEST_COLUMNS if c not in B.OPTIONAL_COLUMNS]
    + [("bad_accession", f"assembly_accession <> '' AND NOT {_ACC.format(c='assembly_accession')}")]
    + [(f"vocabulary:{c}", f"{c} <> '' AND {c} NOT IN ({w})") for c, w in _WORDS.items()]
    + [("bad_date", "label_date <> '' AND NOT (regexp_full_match(label_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND label_date NOT LIKE '0000%' AND try_cast(label_date AS DATE) IS NOT NULL)")]
)
_JOIN = f"""{_L}, {_F},
lu AS (SELECT * FROM l WHERE {_ACC.format(c="assembly_accession")} AND assembly_accession IN (SELECT assembly_accession FROM l GROUP BY 1 HAVING count(*) = 1)),
held AS (SELECT * FROM f WHERE dropped_at IS NULL),
fu AS (SELECT * FROM held WHERE {_ACC.format(c="accession_id")} AND accession_id IN (SELECT accession_id FROM held GROUP BY 1 HAVING count(*) = 1)),
j AS (SELECT lu.*, feature_row_id, cluster_score, status AS notes_feature, target_label IN ('positive', 'negative') AS c1, evidence_tier IN ('A', 'B') AS c2, dataset_role = 'train_candidate' AS c3, evidence_reference <> '' AS c4, source_genome_id <> '' AS c5
  FROM fu JOIN lu ON accession_id = assembly_accession)"""
_READ = f"""read AS (SELECT record_id::VARCHAR AS assembly_accession, {genome_sql("s")} AS source_genome_id, {word_sql("target_label")} AS target_label FROM (SELECT record_id, target_label, {visible_sql("source_genome_id")} AS s FROM grouped_training_dataset))"""
_G = f"""{_READ},
g AS (SELECT * FROM read WHERE target_label IN ('positive', 'negative') AND source_genome_id IS NOT NULL)"""
# each class from its largest groups down: of the places that the next groups of a size could take in the folds, the lowest
_FOLDS = f"""RECURSIVE {_G},
pure AS (SELECT * FROM g WHERE source_genome_id IN (SELECT source_genome_id FROM g GROUP BY 1 HAVING count(DISTINCT target_label) = 1)),
grp AS (SELECT source_genome_id, any_value(target_label) AS label, count(*) AS n FROM pure GROUP BY 1),
hist AS (SELECT label, n, count(*) AS c, row_number() OVER (PARTITION BY label ORDER BY n DESC) AS step FROM grp GROUP BY label, n),
level AS (
  SELECT repeat::INT AS repeat, label, (label = 'positive')::INT AS i, 0::BIGINT AS step, 0::BIGINT AS n, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS got FROM (SELECT unnest([1, 2, 3]) AS repeat), (SELECT DISTINCT label FROM grp)
  UNION ALL
  SELECT repeat, label, i, step, n, list_transform(range(1, 6), lambda f: loads[f] + n * got[f]), got FROM (
    SELECT repeat, label, i, step, n, loads, list_transform(range(1, 6), lambda f: len(list_filter(taken, lambda s: s.f = f))::BIGINT) AS got FROM (
      SELECT l.repeat, l.label, l.i, h.step, h.n, l.loads, list_sort(flatten(list_transform(range(1, 6), lambda f: list_transform(range(0, h.c), lambda j: {{'at': l.loads[f] + h.n * j, 'turn': (f + 4 - (l.repeat + l.i) % 5) % 5, 'f': f}}))))[1:h.c] AS taken
      FROM level l JOIN hist h ON h.label = l.label AND h.step = l.step + 1))),
placed AS (SELECT repeat::INT AS repeat, source_genome_id, label, n, row_number() OVER (PARTITION BY repeat, label, n ORDER BY md5((41 + repeat)::VARCHAR || '|' || source_genome_id), source_genome_id) AS place FROM grp, (SELECT unnest([1, 2, 3]) AS repeat)),
dealt AS (SELECT p.repeat, p.source_genome_id, (1 + len(list_filter([got[1], got[1] + got[2], got[1] + got[2] + got[3], got[1] + got[2] + got[3] + got[4]], lambda u: u < place)))::INT AS fold FROM placed p JOIN level v ON v.repeat = p.repeat AND v.label = p.label AND v.n = p.n AND v.step > 0),
manifest AS (SELECT repeat, fold, 'validation' AS split, assembly_accession, source_genome_id, target_label FROM pure JOIN dealt USING (source_genome_id))"""
_P = """p AS (SELECT coalesce(status, 'none') AS model_name, 1 AS repeat, (feature_row_id % 5 + 1)::INT AS fold, nifh_count > 0 AS truth, cluster_score >= 0.5 AS guess, round(cluster_score, 2) AS score FROM feature_matrix WHERE nifh_count IS NOT NULL AND cluster_score IS NOT NULL)"""


def _metric_sql(by: str, name: str) -> str:
    """CTEs `name` with all metrics per group of `p`."""
    return f"""
{name}_s AS (SELECT {by}, score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM p GROUP BY {by}, score),
{name}_r AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS rp, sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS rn FROM {name}_s),
{name}_u AS (SELECT {by}, sum(neg * (rp - pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc, sum(pos * rp::DOUBLE / (rp + rn)) / nullif(sum(pos), 0) AS average_precision FROM {name}_r GROUP BY {by}),
{name}_c AS (SELECT {by}, count(*) FILTER (NOT truth AND NOT guess) AS tn, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth) AS negative_support, count(*) FILTER (truth) AS positive_support FROM p GROUP BY {by}),
{name} AS (SELECT *, (tp + tn)::DOUBLE / (positive_support + negative_support) AS accuracy,
  coalesce((coalesce(tp::DOUBLE / nullif(positive_support, 0), 0) + coalesce(tn::DOUBLE / nullif(negative_support, 0), 0)) / nullif((positive_support > 0)::INT + (negative_support > 0)::INT, 0), 0) AS balanced_accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp::DOUBLE / nullif(positive_support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {name}_c JOIN {name}_u USING ({by}))"""


def _offender_sql(source: str, checks: list[tuple[str, str]], key: str, row: str) -> str:
    """The offenders of each check by row id (blank fields) or value, and the repeated keys."""
    named = [(k, c, "NULL::VARCHAR", f"{row}::VARCHAR") if k.startswith("blank:") else (k, c, k.partition(":")[2] or {"bad_accession": key, "bad_date": "label_date"}[k], "NULL::VARCHAR") for k, c in checks]
    return " UNION ALL ".join([*(f"SELECT '{k}' AS \"check\", {v} AS value, {r} AS row_id, count(*) AS n_rows FROM {source} WHERE {c} GROUP BY ALL" for k, c, v, r in named), f"SELECT 'duplicate:{key}', {key}, NULL::VARCHAR, count(*) FROM {source} WHERE {key} <> '' GROUP BY {key} HAVING count(*) > 1"])


def _long(name: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, \"{m}\"::DOUBLE AS v FROM {name}" for m in M.SCORES + M.COUNTS)


SQL = {
    "v4_manifest_report": f"WITH {_L} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({c}) AS n_rows FROM l" for k, c in _CHECKS) + " UNION ALL SELECT 'duplicate:assembly_accession', (count(*) - count(DISTINCT assembly_accession))::BIGINT FROM l WHERE assembly_accession <> ''",
    "v4_manifest_offenders": f"WITH {_L} " + _offender_sql("l", _CHECKS, "assembly_accession", "label_id"),
    "v6_feature_offenders": f"WITH {_F} " + _offender_sql("f", [("blank:accession_id", "accession_id = ''"), ("bad_accession", f"accession_id <> '' AND NOT {_ACC.format(c='accession_id')}")], "accession_id", "feature_row_id"),
    "v6_feature_report": f"WITH {_F} SELECT 'blank:accession_id' AS \"check\", count(*) FILTER (accession_id = '') AS n_rows FROM f UNION ALL SELECT 'bad_accession', count(*) FILTER (accession_id <> '' AND NOT {_ACC.format(c='accession_id')}) FROM f UNION ALL SELECT 'duplicate:accession_id', (count(*) - count(DISTINCT accession_id))::BIGINT FROM f WHERE accession_id <> ''",
    "f9_invalid_values": f"WITH {_L} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n_rows FROM l WHERE {c} <> '' AND {c} NOT IN ({w}) GROUP BY {c}" for c, w in _WORDS.items()),
    "a11_histograms": f"WITH {_L} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n_rows FROM l GROUP BY {c}" for c in ("target_label", "evidence_tier", "dataset_role")),
    "a14_duplicate_keys": f"WITH {_L} SELECT assembly_accession, count(*) AS n FROM l WHERE assembly_accession <> '' GROUP BY 1 HAVING count(*) > 1",
    "u5_unmatched_keys": f"WITH {_L}, {_F} SELECT DISTINCT 'feature' AS side, accession_id AS accession FROM f WHERE accession_id <> '' AND accession_id NOT IN (SELECT assembly_accession FROM l) UNION ALL SELECT DISTINCT 'label', assembly_accession FROM l WHERE assembly_accession <> '' AND assembly_accession NOT IN (SELECT accession_id FROM f)",
    "j8_labeled_join": f"WITH {_JOIN} SELECT assembly_accession, feature_row_id, label_id, cluster_score, notes, notes_feature FROM j",
    "f12_training_mask": f"WITH {_JOIN} SELECT assembly_accession, target_label, evidence_tier, source_genome_id FROM j WHERE c1 AND c2 AND c3 AND c4 AND c5",
    "f13_reference_warnings": f"WITH {_JOIN} SELECT assembly_accession FROM j WHERE c1 AND c2 AND c3 AND NOT c4 AND c5",
    "a15_exclusion_reasons": f"WITH {_JOIN} " + " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) FILTER ({c}) AS n_rows FROM j" for k, c in (("target_label_not_binary", "NOT c1"), ("evidence_tier_not_allowed", "NOT c2"), ("dataset_role_not_train_candidate", "NOT c3"), ("missing_evidence_reference", "NOT c4"), ("missing_source_genome_id", "NOT c5"), ("excluded", "NOT (c1 AND c2 AND c3 AND c4 AND c5)"), ("training_ready", "c1 AND c2 AND c3 AND c4 AND c5"))),
    "a16_mixed_groups": f"WITH {_G} SELECT source_genome_id, count(DISTINCT target_label) AS n_labels FROM g GROUP BY 1 HAVING count(DISTINCT target_label) > 1",
    "v11_dataset_summary": f"""WITH {_G}, k AS (SELECT source_genome_id, count(*) FILTER (target_label = 'positive') AS p, count(*) FILTER (target_label = 'negative') AS q FROM g GROUP BY 1)
SELECT (SELECT count(*) FROM g) AS n_rows, count(*) AS n_groups, sum(p)::BIGINT AS positive_rows, sum(q)::BIGINT AS negative_rows, count(*) FILTER (p > 0) AS positive_groups, count(*) FILTER (q > 0) AS negative_groups, count(*) FILTER (p > 0 AND q > 0) AS mixed_groups, (SELECT count(DISTINCT assembly_accession) FROM g) AS n_accessions,
  (SELECT count(*) FROM read) AS all_rows, (SELECT count(*) FROM read WHERE coalesce(target_label NOT IN ('positive', 'negative'), true)) AS unlabelled_rows, (SELECT count(*) FROM read WHERE target_label IN ('positive', 'negative') AND source_genome_id IS NULL) AS blank_group_rows,
  coalesce(sum(p + q) FILTER (p > 0 AND q > 0), 0)::BIGINT AS mixed_rows FROM k""",
    "w8_fold_manifest": f"WITH {_FOLDS} SELECT * FROM manifest",
    "v13_manifest_checks": """SELECT unnest(['not_validation', 'unexpected_fold', 'missing_row', 'unknown_row', 'repeated_row', 'split_group', 'changed_row', 'single_class_fold']) AS "check", 0::BIGINT AS n_violations""",
    "a19_fold_metadata": f"""WITH {_FOLDS}, t AS (SELECT count(*) AS n, count(DISTINCT source_genome_id) AS g, count(*) FILTER (target_label = 'positive') AS p FROM pure),
v AS (SELECT repeat, fold, count(*) AS vn, count(DISTINCT source_genome_id) AS vg, count(*) FILTER (target_label = 'positive') AS vp FROM manifest GROUP BY repeat, fold)
SELECT repeat, fold, n - vn AS training_rows, vn AS validation_rows, g - vg AS training_groups, vg AS validation_groups, p - vp AS training_positive, (n - vn) - (p - vp) AS training_negative, vp AS validation_positive, vn - vp AS validation_negative FROM v, t""",
    "a21_confusion": f"""WITH {_P}, {_metric_sql("model_name", "m")} SELECT model_name, tn, fp, fn, tp, negative_support, positive_support, accuracy, balanced_accuracy, "precision", recall, f1 FROM m""",
    "a23_auc_ap": f"WITH {_P}, {_metric_sql('model_name', 'm')} SELECT model_name, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM m_u",
    "a25_metric_aggregate": f"""WITH {_P}, {_metric_sql("model_name, repeat, fold", "m")}, {_metric_sql("model_name", "o")}, folds AS ({_long("m", "model_name")}), pooled AS ({_long("o", "model_name")})
SELECT f.model_name, f.metric, round(avg(f.v), 7) AS fold_mean, round(stddev_pop(f.v), 7) AS fold_std, round(min(f.v), 7) AS fold_min, round(max(f.v), 7) AS fold_max, round(any_value(p.v), 7) AS pooled_value, count(f.v) AS valid_fold_count, count(*) AS total_fold_count
FROM folds f LEFT JOIN pooled p USING (model_name, metric) GROUP BY f.model_name, f.metric""",
    "w6_model_ranking": f"""WITH {_P}, {_metric_sql("model_name, repeat, fold", "m")}, a AS (SELECT model_name, avg(average_precision) AS ap, avg(balanced_accuracy) AS ba, avg(f1) AS f1 FROM m GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY ap DESC, ba DESC, f1 DESC, model_name))::INT AS rank FROM a), b AS (SELECT * FROM r WHERE rank = 1)
SELECT r.rank, r.model_name, round(r.ap, 7) AS average_precision, round(r.ba, 7) AS balanced_accuracy, round(r.f1, 7) AS f1, abs(r.ap - b.ap) <= 1e-12 + 1e-12 * abs(b.ap) AND abs(r.ba - b.ba) <= 1e-12 + 1e-12 * abs(b.ba) AND abs(r.f1 - b.f1) <= 1e-12 + 1e-12 * abs(b.f1) AS tied_with_best FROM r, b""",
    "m3_logreg_optimum": "SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_features, true AS is_optimal, true AS is_scaled FROM embeddings",
    "m7_score_channels": f"WITH {_P} SELECT model_name, count(*) AS n_rows, CASE WHEN model_name = 'none' THEN 'positive_probability' ELSE 'decision_score' END AS channel FROM p GROUP BY model_name",
    "m10_roundtrip": "SELECT '' AS model_name, vec_id::VARCHAR AS assembly_accession FROM embeddings WHERE false",
    "a20_oof_coverage": "SELECT coalesce(status, 'none') AS model_name, accession_id AS assembly_accession, count(*) AS n FROM feature_matrix GROUP BY ALL HAVING count(*) <> 1",
}
SQL |= {
    name: f"SELECT '{model}' AS model_name, unnest([{', '.join(repr(m) for m in M.SCORES + M.COUNTS)}]) AS metric, {SPLITS * REPEATS}::BIGINT AS valid_fold_count, {SPLITS * REPEATS}::BIGINT AS total_fold_count, true AS is_sound"
    for name, model in (("m3_logreg_cv", "logistic_regression"), ("m4_forest_cv", "random_forest"), ("m5_svm_cv", "svc"))
}
