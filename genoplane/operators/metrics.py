"""Binary classification metrics per group, their aggregation over folds, and model ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoplane.operators.ranking import distributed_rank

SCORES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")
COUNTS = ("tn", "fp", "fn", "tp", "negative_support", "positive_support")


class MetricError(ValueError):
    """Predictions or metric tables that break their contract."""


class SelectionError(ValueError):
    """Aggregate metrics from which no model can be chosen."""


def check_probabilities(predictions: DataFrame, probability: str) -> None:
    """Raise if a probability is missing, not finite, or outside [0, 1]."""
    p = F.col(probability)
    bad = predictions.agg(F.count_if(~F.coalesce(~F.isnan(p) & (p >= 0) & (p <= 1), F.lit(False))).alias("n")).first()["n"]
    if bad:
        raise MetricError(f"{bad} rows without a probability in [0, 1]")


def score_channels(predictions: DataFrame, model: str = "model_name", probability: str = "positive_probability", decision: str = "decision_score") -> dict[str, str]:
    """The score column of each model: its probabilities, else its decision scores, else none of both (an absent key).

    A model that has both raises, as their values cannot be compared, and so does one with a score on some rows only,
    a probability outside [0, 1] or a decision score that is not finite. One aggregate; one row per model comes back.
    """
    p, d = F.col(probability), F.col(decision)
    good = {probability: ~F.isnan(p) & (p >= 0) & (p <= 1), decision: ~F.isnan(d) & (F.abs(d) != float("inf"))}
    seen = predictions.groupBy(model).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"has_{c}") for c in good], *[F.count_if(F.coalesce(ok, F.lit(False))).alias(f"ok_{c}") for c, ok in good.items()])
    out = {}
    for r in seen.collect():
        used = [c for c in good if r[f"has_{c}"]]
        if len(used) > 1:
            raise MetricError(f"{r[model]} mixes probabilities and decision scores")
        if used and r[f"ok_{used[0]}"] < r["n"]:
            raise MetricError(f"{r['n'] - r[f'ok_{used[0]}']} rows of {r[model]} without a valid {used[0]}")
        if used:
            out[r[model]] = used[0]
    return out


def confusion(predictions: DataFrame, by: Sequence[str], truth: Column, predicted: Column) -> DataFrame:
    """tn, fp, fn, tp and supports per group; `truth` and `predicted` are boolean (positive), rows with a null are left out."""
    p = predictions.withColumns({"_t": truth, "_p": predicted}).filter(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    t, q = F.col("_t"), F.col("_p")
    return p.groupBy(*by).agg(F.count_if(~t & ~q).alias("tn"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"), F.count_if(t & q).alias("tp"), F.count_if(~t).alias("negative_support"), F.count_if(t).alias("positive_support"))


def with_threshold_scores(counts: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, precision, recall and F1 from confusion counts; 0 where a denominator is 0.

    Balanced accuracy is the mean recall of the classes that occur.
    """
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tn, fp, fn, tp, neg, pos = (F.col(c) for c in COUNTS)
    classes = (pos > 0).cast("int") + (neg > 0).cast("int")
    return counts.withColumns({
        "accuracy": share(tp + tn, pos + neg), "balanced_accuracy": share(share(tp, pos) + share(tn, neg), classes),
        "precision": share(tp, tp + fp), "recall": share(tp, pos), "f1": share(2 * tp, 2 * tp + fp + fn),
    })


def curve_scores(predictions: DataFrame, by: Sequence[str], truth: Column, score: Column) -> DataFrame:
    """roc_auc and average_precision per group; null where a class is missing (average precision: where no positive is).

    Rows are first counted per distinct score, so ties are one step: AUC counts a tied pair as a half, and
    average precision sums (recall step) x precision over the distinct scores from the top, without
    interpolation. Running counts come from a range-partitioned sort, so one large group spans many tasks.
    Rows without truth or score (null, NaN) are left out.
    """
    p = predictions.withColumns({"_t": truth, "_s": score}).filter(F.col("_t").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    steps = p.groupBy(*by, "_s").agg(F.count_if("_t").alias("_pos"), F.count_if(~F.col("_t")).alias("_neg"))
    ranked = distributed_rank(steps, by, [F.col("_s").desc()], weight=["_pos", "_neg"])
    above = F.col("running__pos") - F.col("_pos") / 2
    gain = F.col("_pos") * F.col("running__pos") / (F.col("running__pos") + F.col("running__neg"))
    sums = ranked.groupBy(*by).agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"), F.sum(F.col("_neg") * above).alias("wins"), F.sum(gain).alias("gain"))
    return sums.select(*by, F.try_divide("wins", F.col("P") * F.col("N")).alias("roc_auc"), F.when(F.col("P") > 0, F.col("gain") / F.col("P")).alias("average_precision"))


def null_safe(by: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def binary_metrics(predictions: DataFrame, by: Sequence[str], truth: Column, predicted: Column, score: Column | None) -> DataFrame:
    """All counts and scores per group. Without score the curve metrics are null."""
    base = with_threshold_scores(confusion(predictions, by, truth, predicted))
    if score is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in SCORES[-2:]})
    curves = curve_scores(predictions, by, truth, score)
    return base.alias("b").join(curves.alias("c"), null_safe(by, "b", "c"), "left").select("b.*", "c.roc_auc", "c.average_precision")


def aggregate_folds(fold_metrics: DataFrame, pooled: DataFrame | None = None, model: str = "model_name", metrics: Sequence[str] = SCORES + COUNTS) -> DataFrame:
    """Mean, population deviation, min, max and valid count per model and metric over folds, in long form, with the pooled value.

    Values that are null, NaN or no numbers do not count. Deviation, like the others, is null without values.
    """
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("value")) for m in metrics]
    long = fold_metrics.select(model, F.inline(F.array(*cells))).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    out = long.groupBy(model, "metric").agg(
        F.avg("value").alias("fold_mean"), F.stddev_pop("value").alias("fold_std"), F.min("value").alias("fold_min"), F.max("value").alias("fold_max"), F.count("value").alias("valid_fold_count"), F.count(F.lit(1)).alias("total_fold_count"),
    )
    if pooled is None:
        return out.withColumns({"pooled_value": F.lit(None).cast("double"), "pooled_scope": F.lit("none")})
    flat = pooled.select(model, F.inline(F.array(*cells))).withColumnRenamed("value", "pooled_value")
    return out.join(flat, [model, "metric"], "left").withColumn("pooled_scope", F.lit("all_repeats_oof"))


def prediction_coverage(predictions: DataFrame, keys: Sequence[str] = ("model_name", "repeat", "assembly_accession")) -> DataFrame:
    """Keys that were not predicted exactly once: (keys, n)."""
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n <> 1")


def rank_models(aggregate: DataFrame, primary: str = "average_precision", tie_breakers: Sequence[str] = ("balanced_accuracy", "f1"), model: str = "model_name", value: str = "fold_mean") -> DataFrame:
    """One row per model: rank by the primary metric, then the tie breakers (all descending), then the name.

    tied_with_best says that every metric is within 1e-12 (absolute plus relative) of the best model's. Models
    number a few. Raises where metrics repeat, a (model, metric) pair occurs twice, or a value is missing.
    """
    metrics = [primary, *tie_breakers]
    if len(set(metrics)) < len(metrics):
        raise SelectionError("ranking metrics have to differ")
    wide = aggregate.groupBy(model).pivot("metric", metrics).agg(F.max(value).alias("v"))
    issue = aggregate.filter(F.col("metric").isin(metrics)).groupBy(model, "metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull() | F.isnan(value)).alias("bad"))
    checked = issue.agg(F.count_if(F.col("n") > 1).alias("twice"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("pairs"), F.count_distinct(model).alias("models")).first()
    if not checked["models"] or checked["twice"] or checked["bad"] or checked["pairs"] < checked["models"] * len(metrics):
        raise SelectionError("each model needs one finite value of each ranking metric")
    order = Window.orderBy(*[F.desc(m) for m in metrics], model)
    near = F.lit(True)
    for m in metrics:
        best = F.first(m).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        near = near & (F.abs(F.col(m) - best) <= 1e-12 + 1e-12 * F.abs(best))
    return wide.select(F.row_number().over(order).alias("rank"), model, *metrics, near.alias("tied_with_best"))


def selection_report(ranking: DataFrame, model: str = "model_name") -> dict:
    """The best model and who ties with it, as a plain dict (one row per model reaches the driver)."""
    rows = [r.asDict() for r in ranking.orderBy("rank").collect()]
    return {"selected": rows[0][model], "tied": [r[model] for r in rows[1:] if r["tied_with_best"]], "ranking": rows}
