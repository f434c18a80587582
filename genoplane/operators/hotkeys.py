"""Results per key where a handful of keys holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoplane.functions.text import is_blank

BUCKETS = 4096
MIN_SLICES, MAX_SLICES = 32, 512
PAIRS_PER_SLICE, PAIRS_PER_TASK = 2_000_000, 16_000_000


def per_key_states(df: DataFrame, keys: Sequence[str], states: Sequence[Column]) -> DataFrame:
    """Algebraic aggregates per key by map-side combining.

    Every partition folds its rows into a bounded hash table of key states (which spills), and only these
    partial states are shuffled: a key that holds a third of all rows reaches its final task as one row per
    map task. `states` have to be built-in aggregates with mergeable buffers (count, sum, avg, min, max,
    stddev, sketches, and count_distinct, which Spark first reduces per key and value). Rows are kept whole:
    null is a key of its own, an empty table gives no rows.
    """
    return df.groupBy(*keys).agg(*states)


def frequent_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Each non-blank value of `key`, as stored, on more than `share` of all rows: (key_value, n_rows, row_share).

    The share is of all rows, blank keys included. Values are compared as stored. At most 1/share rows.
    """
    counted = per_key_states(df.select(F.col(key).alias("key_value")), ["key_value"], [F.count(F.lit(1)).alias("n_rows")])
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counted.filter(~is_blank(F.col("key_value")))
        .withColumn("row_share", F.col("n_rows") / total)
        .filter(F.col("n_rows") > F.lit(share) * total)
        .select("key_value", "n_rows", "row_share")
    )


def key_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def hot_buckets(keys: DataFrame, key: str, share: float = 0.01, buckets: int = BUCKETS) -> list[int]:
    """Hash buckets of `key` that hold more than `share` of the rows: every key that does is in one of them.

    One pass that shuffles at most `buckets` counters per map task; at most 1/share numbers come back. Cold
    keys that share a bucket are treated as hot too, which changes no result.
    """
    counted = keys.filter(F.col(key).isNotNull()).groupBy(key_bucket(F.col(key), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counted)
    return sorted(r["b"] for r in counted if r["n"] > max(share * total, 1))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", hot: Sequence[int] | None = None, share: float = 0.01, slices: int | None = None) -> DataFrame:
    """Equi-join of `left`, which may hold a third of its rows under one key, with `right`.

    Left rows in a hot bucket of the key are dealt to `slices` slices by the hash of column `spread`; right rows
    of those buckets (a few of BUCKETS) are repeated for each slice. By default there are as many slices as shuffle
    partitions, within MIN_SLICES and MAX_SLICES: at most 1/share buckets are hot, so what is repeated stays in
    proportion to `right`. Null keys join nothing and are not moved to one task either. `how`: inner, left,
    left_semi or left_anti. Columns of `right` besides the key must not clash with those of `left`.
    """
    if hot is None:
        hot = hot_buckets(left.select(key), key, share)
    if slices is None:
        slices = min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_SLICES), MAX_SLICES)
    bucket = key_bucket(F.col(key))
    dealt = F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int")
    is_hot = bucket.isin(list(hot)) if hot else F.lit(False)
    salted = left.withColumn("_slice", F.when(F.col(key).isNull() | is_hot, dealt).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_slice", F.explode(every)) if hot else right.withColumn("_slice", F.lit(0))
    return salted.join(repeated, [key, "_slice"], how).drop("_slice")


def many_to_many_join(left: DataFrame, right: DataFrame, key: Sequence[str], spread: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner equi-join in which keys repeat on both sides, dealt by the pairs it makes and not by the bytes it reads.

    A small table of few keys can make billions of pairs, which adaptive execution would leave to a handful of tasks.
    The pairs per key are counted first (in `counted`, where that holds the keys of `left` and is cheaper to read), and
    summed up in BUCKETS. Left rows of buckets with more than PAIRS_PER_SLICE are dealt to slices by the hash of column
    `spread` and the right rows repeated for each, unless these would be more rows than the bucket has pairs. There is a
    task per PAIRS_PER_TASK, and as many as shuffle partitions at least; below one such task it is a plain join.
    Columns of `right` besides the key must not clash with those of `left`.
    """
    bucket = key_bucket(F.struct(*key))
    one = F.count(F.lit(1))
    per_key = (left if counted is None else counted).groupBy(*key).agg(one.alias("n")).join(right.groupBy(*key).agg(one.alias("m")), list(key))
    made = per_key.groupBy(bucket.alias("b")).agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("m").alias("m")).collect()
    total = sum(r["pairs"] for r in made)
    if total <= PAIRS_PER_TASK:
        return left.join(right, list(key))
    slices = min(-(-max(r["pairs"] for r in made) // PAIRS_PER_SLICE), MAX_SLICES)
    is_hot = bucket.isin(sorted(r["b"] for r in made if r["pairs"] > max(PAIRS_PER_SLICE, r["m"] * slices)))
    tasks = max(-(-total // PAIRS_PER_TASK), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # one key column: a key that is a constant would be folded out of the partitioning, and the join would shuffle again into fewer tasks
    at = lambda slice_: F.struct(*key, slice_.alias("_slice"))
    dealt = left.dropna(subset=list(key)).withColumn("_at", at(F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int")).otherwise(0)))
    repeated = right.dropna(subset=list(key)).withColumn("_slice", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))))
    repeated = repeated.withColumn("_at", at(F.col("_slice"))).drop(*key, "_slice")
    return dealt.repartition(tasks, "_at").join(repeated.repartition(tasks, "_at"), "_at").drop("_at")
