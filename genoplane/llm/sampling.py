"""Samples that match target category shares (problem 3) and caps per contributor (problem 4)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoplane.llm.reservoirs import STATE_ROWS, ascending, partial_reservoirs
from genoplane.operators.ranking import distributed_rank
from genoplane.session import cut_lineage

MAX_TARGETS = 100_000
_MANY = 1 << 62


def hashed_number(digits: int, *parts: Column) -> Column:
    """A number of so many hexadecimal digits (at most 15) that depends on the parts alone: the first of their digest."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (hashed_number(13, *parts).cast("double") + 0.5) / F.lit(float(1 << 52))


def feasible_quotas(targets: list[dict], total: int) -> dict[int, int]:
    """Quota per category: min(available, max(floor, scale x share)), with the scale that makes the sum `total`.

    Where everything available is too little, all of it is taken; where the floors alone exceed the total, the
    floors are kept. Fractions are rounded down and the largest remainders get what is left.
    """
    floor = lambda t: min(t["available"], t["min_rows"])
    take = lambda t, scale: min(t["available"], max(floor(t), scale * t["share"]))
    aim = min(total, sum(t["available"] for t in targets))
    lo, hi = 0.0, 1.0
    while sum(take(t, hi) for t in targets) < aim and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(take(t, mid) for t in targets) < aim else (lo, mid)
    quota = {t["category"]: int(take(t, hi) + 1e-9) for t in targets}
    left = aim - sum(quota.values())
    for t in sorted(targets, key=lambda t: (-(take(t, hi) % 1), t["category"])):
        if left > 0 and quota[t["category"]] < t["available"]:
            quota[t["category"]] += 1
            left -= 1
    return quota


def proportional_sample(rows: DataFrame, targets: DataFrame, category: list[str], unit: str, row_id: str, seed: int = 7, slack: float = 1.5, state_rows: int = STATE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Draw a sample whose category shares follow `targets`; returns (sample, report).

    `targets` has the category columns, target_share, min_rows and sample_rows (the same in each row); it is a
    specification of at most MAX_TARGETS rows, checked. Rows whose category is not listed, or that lack the
    unit, are not drawn. Repeated units count once per category (the row with the smallest id stands for them).

    Every unit of a category has a random key (a hash). One pass fills a reservoir per category and task with the
    units of smallest keys (`partial_reservoirs`); the states are merged per unit and written. A reservoir holds
    `slack` times what its target wants, so one that is not full holds all units of its category: their number is
    then exact, and the category is exhausted if it is below what is wanted. Quotas are made feasible after these
    counts (`feasible_quotas`). Where what exhausted categories leave over asks more of a full reservoir than it
    holds, the pass is repeated for those categories alone with a larger one. The reservoirs are then trimmed to
    the smallest keys up to the quota, a uniform draw; the trim ranks over range partitions, so a category with
    most of the sample spans many tasks.

    Report per target row: available (all distinct units), wanted = max(min_rows, share x sample_rows), held (units
    in the reservoir), quota, drawn, exhausted (held < wanted). Empty rows give quotas of 0. Two target rows of one
    category are an error.
    """
    spark = rows.sparkSession
    spec = [r.asDict() for r in targets.limit(MAX_TARGETS + 1).collect()]
    if len(spec) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    if len({tuple(r[c] for c in category) for r in spec}) < len(spec):
        raise ValueError("a category is listed twice")
    fields = ", ".join(f"{c} string" for c in category)
    size = int(spec[0]["sample_rows"]) if spec else 0
    wanted = {i: float(max(r["min_rows"] or 0, (r["target_share"] or 0.0) * size)) for i, r in enumerate(spec)}
    listed = spark.createDataFrame([(i, *[r[c] for c in category]) for i, r in enumerate(spec)], f"slot int, {fields}")
    found = rows.select(*category, F.col(unit).alias("unit"), F.col(row_id).alias("row_id")).filter(F.col("unit").isNotNull())
    found = found.join(F.broadcast(listed), category).select("slot", hashed_number(15, F.lit(seed), *map(F.col, category), F.col("unit")).alias("key"), "unit", "row_id")
    order = ["key", "unit"]

    def fill(capacity: dict[int, int]) -> DataFrame:
        own = found if len(capacity) == len(spec) else found.filter(F.col("slot").isin(list(capacity)))
        states = partial_reservoirs(own, "slot", [*order, "row_id"], capacity, 2, state_rows)
        return cut_lineage(states.groupBy("slot", *order).agg(F.min("row_id").alias("row_id")), "reservoirs")

    capacity = {i: math.ceil(slack * w) + 1 for i, w in wanted.items()}
    parts = {tuple(capacity): fill(capacity)} if spec else {}
    held: dict[int, int] = {}
    quota: dict[int, int] = {}
    grown = list(capacity)
    while grown:
        for r in parts[tuple(grown)].groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect():
            held[r["slot"]] = r["n"]
        known = [{"category": i, "available": held.get(i, 0) if held.get(i, 0) < capacity[i] else _MANY, "share": (r["target_share"] or 0.0) * size, "min_rows": r["min_rows"] or 0} for i, r in enumerate(spec)]
        quota = feasible_quotas(known, size)
        grown = [i for i in capacity if held.get(i, 0) >= capacity[i] and quota[i] > capacity[i]]
        if grown:
            capacity |= {i: math.ceil(1.1 * quota[i]) for i in grown}
            parts = {tuple(x for x in k if x not in grown): v.filter(~F.col("slot").isin(grown)) for k, v in parts.items()} | {tuple(grown): fill({i: capacity[i] for i in grown})}
    merged = reduce(DataFrame.unionByName, parts.values()) if parts else found.select("slot", *order, "row_id").filter("false")
    plan = spark.createDataFrame([(i, wanted[i], quota[i]) for i in wanted], "slot int, wanted double, quota bigint")
    ranked = distributed_rank(merged.join(F.broadcast(plan.select("slot", "quota")), "slot"), ["slot"], [F.col(c) for c in order])
    drawn = ranked.filter(F.col("rank") <= F.col("quota"))
    sample = drawn.join(F.broadcast(listed), "slot").select("row_id", *category)
    every = found.groupBy("slot").agg(F.count_distinct("unit").alias("available"))
    reached = drawn.groupBy("slot").agg(F.count(F.lit(1)).alias("drawn"))
    full = ranked.groupBy("slot").agg(F.count(F.lit(1)).alias("held"))
    report = plan.join(listed, "slot").join(full, "slot", "left").join(reached, "slot", "left").join(every, "slot", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    report = report.select(*category, n("available").alias("available"), "wanted", n("held").alias("held"), "quota", n("drawn").alias("drawn"), (n("held") < F.col("wanted")).alias("exhausted"))
    return sample, report


def cap_contributors(rows: DataFrame, limits: DataFrame, contributor: str, row_id: str, score: Column | None, levels: list[tuple[Column, bool]] = (), seed: int = 11, state_rows: int = STATE_ROWS) -> DataFrame:
    """Keep the max_rows best rows of each limited contributor: (row_id, contributor, rank, kept).

    Weighted sampling without replacement: a row with score w draws the key w / exponential (in logarithms, ln w +
    gumbel), and the cap-size largest keys of a contributor are kept. `levels` (column, descending; missing values
    last) put a fixed order above the draw: they are the limit of scores so far apart that no draw bridges them,
    and the drawn keys decide among rows of equal levels. A null score, or one of 0 or less, draws behind all others;
    without score all draw alike.

    One pass fills a reservoir per contributor and task (`partial_reservoirs`), whose merged states are ranked over
    range partitions, so a contributor with most rows spans many tasks. The key of the last kept row is the
    contributor's threshold; a second pass leaves out what lies beyond it, with no shuffle of the rows left out.
    Of rows that equal the threshold in key and id, as many are kept as there is room for.

    `limits`: (contributor, max_rows), one row each, at most MAX_TARGETS, checked; null limits keep all. Rows without
    contributor, or of one without limit, are kept. The rank is that of kept rows of limited contributors, else
    null. Repeated rows count each; empty tables give no rows; other columns of `rows`, whatever their names, are
    not used.
    """
    spark = rows.sparkSession
    spec = [(r[0], r[1]) for r in limits.select(contributor, "max_rows").limit(MAX_TARGETS + 1).collect()]
    if len(spec) > MAX_TARGETS or len({who for who, _ in spec}) < len(spec):
        raise ValueError(f"contributors are repeated, or more than {MAX_TARGETS}")
    spec = [(who, max(int(most), 0)) for who, most in spec if who is not None and most is not None]
    kinds = {f"level{i}": c for i, (c, _) in enumerate(levels)}
    w = F.lit(1.0) if score is None else score
    draw = F.coalesce(F.ln(F.when(w > 0, w)), F.lit(float("-inf"))) - F.ln(-F.ln(hashed_uniform(F.lit(seed), F.col(row_id))))
    named = rows.select(F.col(row_id).alias("id"), F.col(contributor).alias("who"), (-draw).alias("draw"), *[c.alias(k) for k, c in kinds.items()])
    kind = dict(named.dtypes)
    steps = [c for i, (_, down) in enumerate(levels) for c in ascending(F.col(f"level{i}"), kind[f"level{i}"], down, f"step{i}")]
    named = named.select("who", *steps, "draw", *ascending(F.col("id"), kind["id"], False, "last"), "id")
    order = [c for c in named.columns if c not in ("who", "id")]
    slots = F.broadcast(spark.createDataFrame([(i, *s) for i, s in enumerate(spec)], f"slot int, who {kind['who']}, most bigint"))
    limited = named.join(slots, "who")
    capacity = {i: most for i, (_, most) in enumerate(spec)}
    # written: the range sort reads its input twice
    states = cut_lineage(partial_reservoirs(limited.drop("most"), "slot", order, capacity, 0, state_rows), "reservoirs")
    ranked = distributed_rank(states.join(slots.select("slot", "most"), "slot"), ["slot"], [F.col(c) for c in order]).filter(F.col("rank") <= F.col("most"))
    kept = ranked.select("id", "who", "rank", F.lit(True).alias("kept"))
    # one row per contributor: the key of its last kept row, and how many kept rows have that very key
    edge = ranked.filter(F.col("rank") == F.col("most")).select("slot", *[F.col(c).alias(f"e_{c}") for c in order])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"e_{c}") for c in order])
    beyond = reduce(lambda tail, c: (F.col(c) > F.col(f"e_{c}")) | ((F.col(c) == F.col(f"e_{c}")) & tail), order[::-1][1:], F.col(order[-1]) > F.col(f"e_{order[-1]}"))
    out = [F.col("id"), F.col("who"), F.lit(None).cast("bigint").alias("rank"), F.lit(False).alias("kept")]
    met = limited.join(F.broadcast(edge), "slot", "left").select("slot", "id", "who", same.alias("is_same"), ((F.col("most") == 0) | beyond).alias("is_beyond"))
    met = cut_lineage(met.filter("is_same OR is_beyond"), "beyond")
    later = met.filter("is_beyond").select(*out)
    taken = ranked.join(F.broadcast(edge), "slot").filter(same).groupBy("slot").agg(F.count(F.lit(1)).alias("taken"))
    copies = met.filter("is_same").groupBy("slot", "id", "who").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(taken), "slot").filter("n > taken")
    copies = copies.select("id", "who", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("taken")))).select(*out)
    free = named.join(slots, "who", "left_anti").select("id", "who", F.lit(None).cast("bigint").alias("rank"), F.lit(True).alias("kept"))
    every = reduce(DataFrame.unionByName, [kept, later, copies, free])
    return every.select(F.col("id").alias(row_id), F.col("who").alias(contributor), "rank", "kept")
