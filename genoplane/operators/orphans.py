"""References to records that do not exist: now, and at the time they were made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoplane.operators.hotkeys import hot_buckets, key_bucket, salted_join
from genoplane.operators.ranking import distributed_rank


def existence_deltas(rows: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """Signed existence changes (key, at, delta): +1 when a row appears, -1 when it goes.

    A row without start, or that ends no later than it starts, never exists and gives no change. A null end
    is a row still held. Null keys give no change.
    """
    held = rows.select(key.alias("key"), F.col(start).alias("start"), F.col(end).alias("end"))
    held = held.filter(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    change = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("delta")))
    return held.select("key", F.inline(F.filter(change, lambda c: c["at"].isNotNull())))


def signed_changes(references: DataFrame, existences: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Both kinds of signed changes (key, delta, *carry) in one table (key, refs, held, *carry); null keys are left out.

    This is what every state of this module adds up: `refs` counts references to a key, `held` its existences.
    """
    zero = F.lit(0).cast("bigint")
    delta = F.col("delta").cast("bigint")
    of_references = references.select("key", delta.alias("refs"), zero.alias("held"), *carry)
    of_existences = existences.select("key", zero.alias("refs"), delta.alias("held"), *carry)
    return of_references.unionByName(of_existences).filter(F.col("key").isNotNull())


def unresolved(refs: Column, held: Column) -> Column:
    """A state with references and no existence."""
    return (refs > 0) & (held <= 0)


def apply_deltas(state: DataFrame | None, references: DataFrame, existences: DataFrame) -> DataFrame:
    """The state (key, refs, held) after further signed changes (key, delta) of references and of existences.

    States are sums, so they merge in any order and a batch may be folded in as it arrives. Rows without a
    key are no reference. Keys whose counts are both 0 are dropped.
    """
    merged = signed_changes(references, existences)
    if state is not None:
        merged = merged.unionByName(state.select("key", "refs", "held"))
    out = merged.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("held").alias("held"))
    return out.filter((F.col("refs") != 0) | (F.col("held") != 0))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with references and no existence: (key, refs)."""
    return state.filter(unresolved(F.col("refs"), F.col("held"))).select("key", "refs")


def orphans_as_of(references: DataFrame, deltas: DataFrame, hot: Sequence[int] | None = None, share: float = 0.01) -> DataFrame:
    """References (key, at, row_id) whose key had no existence when they were made, with the reason.

    A reference is a signed change of +1 to its key's reference count, and the signed changes of `deltas` (key, at,
    delta) go to its existence count (`signed_changes`). The changes of a key are put in order of time, existences
    first at equal times, and added up to the running state (refs, held); a reference whose state has references
    and no existence is an orphan. Result: row_id, key, at, reason, which is ``deleted`` (the key existed before),
    ``later`` (it appears later) or ``missing`` (it never does).

    Keys outside the `hot` buckets are added up in a window per key. The changes of hot keys are range-partitioned
    by key and time and added up across the parts (`distributed_rank`), so no task holds a hot key or a day of one.
    A reference without time is an orphan; one without key is no case. Repeated rows each count. Empty tables give
    an empty result.
    """
    references = references.filter(F.col("key").isNotNull())
    if hot is None:
        hot = hot_buckets(references.select("key").unionAll(deltas.select("key")), "key", share)
    row_id = F.lit(None).cast(references.schema["row_id"].dataType)
    events = signed_changes(
        references.select("key", "at", "row_id", F.lit(1).alias("delta"), F.lit(1).alias("kind"), F.lit(0).alias("born")),
        deltas.select("key", "at", row_id.alias("row_id"), "delta", F.lit(0).alias("kind"), F.greatest("delta", F.lit(0)).cast("int").alias("born")),
        ("at", "row_id", "kind", "born"),
    )
    order = [F.col("at").asc_nulls_first(), F.col("kind")]
    states = ("refs", "held", "born")
    orphan = (F.col("kind") == 1) & (unresolved(F.col("running_refs"), F.col("running_held")) | F.col("at").isNull())
    columns = ("row_id", "key", "at", "running_born", "ever_born")
    is_hot = key_bucket(F.col("key")).isin(list(hot)) if hot else F.lit(False)
    whole = Window.partitionBy("key")
    so_far = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"running_{c}": F.sum(c).over(so_far) for c in states} | {"ever_born": F.sum("born").over(whole)}
    found = events.filter(~is_hot).withColumns(sums).filter(orphan).select(*columns)
    if hot:
        warm = distributed_rank(events.filter(is_hot), ["key"], order, weight=states).filter(orphan)
        ever = deltas.filter(is_hot).groupBy("key").agg(F.count_if(F.col("delta") > 0).alias("ever_born"))
        warm = salted_join(warm, ever, "key", "row_id", "left", hot).withColumn("ever_born", F.coalesce("ever_born", F.lit(0)))
        found = found.unionByName(warm.select(*columns))
    reason = F.when(F.col("running_born") > 0, "deleted").when(F.col("ever_born") > 0, "later").otherwise("missing")
    return found.select("row_id", "key", "at", reason.alias("reason"))
