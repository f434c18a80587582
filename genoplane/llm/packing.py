"""Filling containers of fixed capacity with items of varying length (problem 7)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoplane.operators.ranking import distributed_rank
from genoplane.session import cut_lineage

PLACED, WAITING, GAP = 0, 1, 2
BINS = 65_536


class LocalSweep:
    """Best fit over rows that come in descending order of size or space, gaps before items of the same value.

    `offers` is a stack of gaps with at least the current value, the smallest on top. An item takes the top; what
    remains of the gap goes back on top if it holds another item of that size, else to `later`, from which it
    returns when the values have come down to it. Where two items want one gap, the one of higher rank, the first in
    the order, gets it. `fresh` containers (numbers from, below) of full capacity lie beneath all gaps.
    """

    def __init__(self, capacity: int = 0, fresh: tuple[int, float] = (0, 0)) -> None:
        self.offers: list[tuple[int, int]] = []  # (space, container)
        self.later: list[tuple[int, int]] = []  # heap of (-space, container)
        self.capacity, (self.next, self.end) = capacity, fresh

    def reach(self, value: int) -> None:
        while self.later and -self.later[0][0] >= value:
            space, container = heapq.heappop(self.later)
            self.offers.append((-space, container))

    def gap(self, space: int, container: int) -> None:
        self.reach(space)
        self.offers.append((space, container))

    def item(self, size: int) -> int | None:
        """The container that takes an item of this size, or None where no gap holds it."""
        self.reach(size)
        if not self.offers:
            if self.next >= self.end:
                return None
            self.offers.append((self.capacity, self.next))
            self.next += 1
        space, container = self.offers.pop()
        if space - size >= size:
            self.offers.append((space - size, container))
        elif space > size:
            heapq.heappush(self.later, (size - space, container))
        return container

    def left(self) -> list[tuple[int, int]]:
        """(space, container) of all gaps, unopened containers with a known end included."""
        unopened = [(self.capacity, c) for c in range(self.next, int(self.end))] if self.end != math.inf else []
        return [*self.offers, *((-s, c) for s, c in self.later), *unopened]


@dataclass(frozen=True)
class Deal:
    """The plan of one superstep: the parts of each size, where gaps go, and which containers a part may open."""

    n_parts: int
    bins: list[tuple[int, int, int]]  # bin, first part, number of parts
    moves: list[tuple[int, float, float, int]]  # home part, share from, share to, part
    fresh: list[tuple[int, float]]  # per part: container numbers from, below


def deal(items: Sequence[tuple[int, int, int, float]], gaps: Sequence[tuple[int, int]], n_bins: int, n_parts: int, first: int, budget: float) -> Deal:
    """Cut the sizes into parts of about equally many items and deal the gaps and new containers to them.

    `items`: (bin, items, tokens, containers that they need at least by themselves) of the open items, `gaps`: (bin,
    space), both with greater bins for greater values. Parts are numbered from the largest items down; a bin with
    more items than a part takes several. A gap belongs to the part of its own size, where it finds its successor; what
    space a part has beyond its tokens goes on to the next parts with tokens not provided for. New containers,
    numbered from `first`, `budget` in all, go to the parts from the largest items down, as many as they need: the
    small items that are left without fill gaps later. With an unlimited budget there has to be one part.
    """
    count = sum(n for _, n, _, _ in items)
    per_part = max(1, -(-count // n_parts))
    bins, need, want, at, filled = {}, [0.0], [0.0], 0, 0
    for b, n, tokens, alone in sorted(items, reverse=True):
        if filled and filled + n > per_part:
            at, filled = at + 1, 0
            need.append(0.0)
            want.append(0.0)
        k = max(1, round(n / per_part))
        bins[b] = (at, k)
        need[at:] = [need[at] + tokens / k] + [tokens / k] * (k - 1)
        want[at:] = [want[at] + alone / k] + [alone / k] * (k - 1)
        at, filled = at + k - 1, filled + n if k == 1 else per_part
    n_parts, every, below = at + 1, [], (at, 1)
    # a gap whose bin has no items goes to the greatest smaller ones
    for b in range(n_bins + 1):
        below = bins.get(b, below)
        every.append((b, *below))
    home = {b: (p, k) for b, p, k in every}
    space = [0.0] * n_parts
    for b, s in gaps:
        p, k = home[b]
        for j in range(p, p + k):
            space[j] += s / k
    room, moves = list(need), []
    for p in range(n_parts):
        left, sent = space[p], []
        for q in range(p, n_parts):
            if left <= 0:
                break
            if (x := min(left, room[q])) > 0:
                sent.append([q, x])
                room[q] -= x
                left -= x
        if left > 0:
            if not sent:
                sent.append([p, 0.0])
            sent[-1][1] += left
        total, done = sum(x for _, x in sent), 0.0
        for q, x in sent:
            moves.append((p, done / total, (done + x) / total, q))
            done += x
    fresh: list[tuple[int, float]] = []
    for p in range(n_parts):
        n = budget if budget == math.inf else min(budget, math.ceil(want[p]))
        n = budget if p == n_parts - 1 else n
        fresh.append((first, first + n))
        if budget != math.inf:
            first, budget = first + int(n), budget - n
    return Deal(n_parts, every, moves, fresh)


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _bin(value: Column, capacity: int, n_bins: int) -> Column:
    return value if n_bins == capacity else F.floor(value.cast("double") * n_bins / capacity).cast("bigint")


def _superstep(items: DataFrame, gaps: DataFrame | None, plan: Deal, capacity: int, n_bins: int, turn: int) -> DataFrame:
    """Send items and gaps to their parts, sort each part from large to small and sweep it; rows with their kind."""
    spark = items.sparkSession
    of_bins = F.broadcast(spark.createDataFrame(plan.bins, "bin bigint, first_part int, n_parts int"))
    long = lambda name: F.lit(None).cast("bigint").alias(name)

    def home(df: DataFrame, value: str, salt: Column) -> DataFrame:
        placed = df.withColumn("bin", _bin(F.col(value), capacity, n_bins)).join(of_bins, "bin")
        return placed.withColumn("part", F.col("first_part") + F.floor(_uniform(F.lit(turn), salt) * F.col("n_parts")).cast("int")).drop("bin", "first_part", "n_parts")

    state = home(items, "size", F.struct("key", "piece")).withColumns({"container": long("container"), "space": long("space")})
    if gaps is not None:
        moves = F.broadcast(spark.createDataFrame(plan.moves, "home int, lo double, hi double, to int"))
        at = home(gaps, "space", F.col("container")).withColumn("u", _uniform(F.lit(~turn), F.col("container")))
        moved = at.join(moves, (F.col("part") == F.col("home")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        state = state.unionByName(moved.select("container", "space", F.col("to").alias("part")), allowMissingColumns=True)
    order = [F.col("part"), F.coalesce("size", "space").desc(), F.col("size").isNotNull(), F.col("container"), F.col("key"), F.col("piece")]
    state = state.repartitionById(plan.n_parts, F.col("part")).sortWithinPartitions(*order)
    schema = T.StructType([*(f for f in state.schema if f.name != "part"), T.StructField("kind", T.IntegerType())])
    fresh = plan.fresh

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local: LocalSweep | None = None
        for batch in batches:
            if local is None and len(batch):
                local = LocalSweep(capacity, fresh[int(batch["part"].iloc[0])])
            is_gap = batch["size"].isna().tolist()
            values = batch["size"].where(batch["size"].notna(), batch["space"]).astype("int64").tolist()
            held = batch["container"].tolist()
            got: list[int | None] = []
            for k, value in enumerate(values):
                if is_gap[k]:
                    local.gap(value, int(held[k]))
                else:
                    got.append(local.item(value))
            out = batch[[not g for g in is_gap]].copy()
            out["container"] = pd.array(got, dtype="Int64")
            out["size"] = out["size"].astype("int64")
            out["kind"] = [WAITING if c is None else PLACED for c in got]
            yield out[schema.names]
        if local is not None and (left := local.left()):
            out = pd.DataFrame({c: pd.array([None] * len(left), dtype="object") for c in schema.names})
            out["space"], out["container"], out["kind"] = [x[0] for x in left], [x[1] for x in left], GAP
            yield out[schema.names]

    return state.mapInPandas(sweep, schema)


def pack_items(items: DataFrame, item: str, size: Column, capacity: int, rows_per_part: int = 10_000, max_parts: int | None = None, reserve: float = 0.04) -> DataFrame:
    """Put every item into a container: (item, piece, size, container, divided).

    Bulk-synchronous best fit. A superstep range-sorts the unplaced items and the gaps (containers with space left)
    by size, each part of the range sweeps its rows from large to small, and an item takes its successor, the
    smallest gap that holds it; items that want the same gap get it by rank. Gaps are updated, those that hold no
    unplaced item are dropped, and the next superstep begins. The plan of a superstep (`deal`) comes from histograms
    of sizes and spaces with at most BINS bins: parts of equally many items, surplus gaps moved on to the parts that
    lack space, and at first as many new containers as all items need at least, given to the larger items. The
    smallest items, `reserve` of all tokens, join when nearly all others are placed, and fill what they left. A
    superstep has a part per `rows_per_part` open items, at most `max_parts` (the session's shuffle partitions); one
    that is down to a single part opens what containers it still needs and places all.

    No item is divided unless it exceeds the capacity: such an item fills containers of its own with pieces of
    exactly `capacity`, and what remains is packed like an item. Items of size 0 or null (size 0) take no space
    and go to container 0. Repeated items are packed each. Negative sizes are an error of the input and are
    read as 0. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("the capacity has to be positive")
    spark = items.sparkSession
    most = max_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bins = min(capacity, BINS)
    sized = items.select(F.col(item).alias("key"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("item_size"))
    sized = cut_lineage(sized.withColumn("whole", F.floor(F.col("item_size") / capacity).cast("bigint")), "sizes")
    columns = ["key", "piece", "size", "divided"]
    todo = sized.select("key", F.col("whole").alias("piece"), (F.col("item_size") - F.col("whole") * capacity).alias("size"), (F.col("item_size") > capacity).alias("divided")).filter("size > 0")

    def histogram(df: DataFrame, value: str, *by: str) -> list[tuple]:
        alone = F.sum(1 / F.floor(F.lit(capacity) / F.col(value)))
        got = df.groupBy(*by, _bin(F.col(value), capacity, n_bins).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("t"), alone.alias("a"), F.min(value).alias("least"))
        return sorted(tuple(r) for r in got.collect())

    open_, small = histogram(todo, "size"), 0
    total, acc = sum(r[2] for r in open_), 0
    while small < len(open_) and acc + open_[small][2] <= reserve * total:
        acc += open_[small][2]
        small += 1
    back, open_ = open_[:small], open_[small:]
    is_back = _bin(F.col("size"), capacity, n_bins) < (open_[0][0] if open_ else 0)
    work, later, gaps, of_gaps = todo.filter(~is_back), todo.filter(is_back), None, []
    at_first, containers, turn, placed = sum(r[1] for r in open_), 0, 0, []
    while open_ or back:
        if back and sum(r[1] for r in open_) <= max(rows_per_part, at_first // 20):
            work, open_, back = work.unionByName(later), sorted(open_ + back), []
        n_open, least = sum(r[1] for r in open_), min(r[4] for r in open_ + back)
        n_parts = min(max(1, -(-n_open // rows_per_part)), most)
        of_gaps = [r for r in of_gaps if r[0] >= open_[0][0]]
        tokens = sum(r[2] for r in open_ + (back if turn == 0 else []))
        # where no gap holds an open item; items above half the capacity need a container each
        budget = max(-(-tokens // capacity), sum(r[1] for r in open_ if r[4] > capacity // 2)) if not of_gaps else 0
        budget = math.inf if n_parts == 1 else budget
        plan = deal([r[:4] for r in open_], [(r[0], r[2]) for r in of_gaps], n_bins, n_parts, containers, budget)
        offered = gaps.filter(F.col("space") >= least) if gaps is not None else None
        swept = cut_lineage(_superstep(work, offered, plan, capacity, n_bins, turn), "swept")
        placed.append(swept.filter(F.col("kind") == PLACED).select(*columns, "container"))
        work, gaps = swept.filter(F.col("kind") == WAITING).select(*columns), swept.filter(F.col("kind") == GAP).select("container", "space")
        after = histogram(swept.filter(F.col("kind") != PLACED).withColumn("value", F.coalesce("size", "space")), "value", "kind")
        open_, of_gaps = [r[1:] for r in after if r[0] == WAITING], [r[1:] for r in after if r[0] == GAP]
        if budget == math.inf:
            containers = max(containers, (placed[-1].agg(F.max("container")).first()[0] or 0) + 1)
        else:
            containers += budget
        if sum(r[1] for r in open_) > 0.8 * n_open:  # the parts do not hold what fits together: take fewer
            most = max(1, n_parts // 2)
        turn += 1
    out = sized.filter("item_size = 0").select("key", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(False).alias("divided"), F.lit(0).cast("bigint").alias("container"))
    for p in placed:
        out = out.unionByName(p)
    # full pieces: containers are numbered after the packed ones by a running total
    large = distributed_rank(sized.filter("whole > 0"), [], [F.col("key"), F.col("whole")], weight="whole")
    full = large.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"), F.lit(capacity).cast("bigint").alias("size"), (F.col("item_size") > capacity).alias("divided"), (F.lit(containers) + F.col("running") - F.col("whole")).alias("before"))
    full = full.select("key", "piece", "size", "divided", (F.col("before") + F.col("piece")).cast("bigint").alias("container"))
    return out.unionByName(full).select(F.col("key").alias(item), "piece", "size", "container", "divided")
