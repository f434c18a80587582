"""Ranks and running totals over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoplane.session import cut_lineage


ONE_TASK_BYTES = 256 << 20


def fits_one_task(df: DataFrame, limit: int = ONE_TASK_BYTES) -> bool:
    """Whether the planner's estimate of a table is so small that one task may sort any group of it; an unknown size is large.

    A choice between two plans with the same result.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def distributed_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str | Sequence[str] | None = None) -> DataFrame:
    """Add ``rank`` (1, 2, ...) per group by `order`, and running totals if asked.

    For one `weight` the total so far is the column ``running``; for a list, ``running_<weight>`` each.

    The rows are range-partitioned by group and order, so a group that holds most rows spans many
    partitions. Each partition numbers its own sorted rows; only one row per partition and group (at most
    partitions + groups in all) is added up into offsets. `order` has to be total, else ties fall anyhow.
    The sorted rows are written to the shared folder, which pins the partition bounds for both readers.
    Group columns may be null: null is a group like any other. An empty input gives an empty result.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    part = ["_part", *[f"_g{i}" for i in range(len(group))]]
    # the partition is part of the written row; groups are compared as text so that null joins with null
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumns({f"_g{i}": F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for i, g in enumerate(group)})
    rows = cut_lineage(ranged, "ranked")
    weights = [] if weight is None else [weight] if isinstance(weight, str) else list(weight)
    parts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *[F.sum(w).alias(f"_sum_{w}") for w in weights])
    before = Window.partitionBy(*part[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {"_rows_before": "_n"} | {f"_before_{w}": f"_sum_{w}" for w in weights}
    parts = parts.withColumns({k: F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in earlier.items()})
    out = rows.join(parts.drop(*earlier.values()), part).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_rows_before") + 1)
    inside = Window.partitionBy(*part).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for w in weights:
        out = out.withColumn("running" if isinstance(weight, str) else f"running_{w}", F.sum(w).over(inside) + F.col(f"_before_{w}"))
    return out.drop("_at", "_first", *earlier, *part)
