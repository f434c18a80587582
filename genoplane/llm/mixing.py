"""Mixing sources to target weights with capped repetition (problem 8)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoplane.llm.sampling import hashed_number
from genoplane.operators.ranking import distributed_rank
from genoplane.session import cut_lineage

MAX_SOURCES = 100_000


def entropy(weights: Mapping[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(shares: Mapping[str, float], exponent: float) -> dict[str, float]:
    """share ** exponent, normalised; sources without share stay at 0."""
    top = max(shares.values(), default=0.0)
    raw = {k: (v / top) ** exponent if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else raw


def bisect_exponent(too_far: Callable[[float], bool]) -> float:
    """The least exponent in [0, 1] at which `too_far`, which turns from true to false once, is false; 1 where it never is."""
    if not too_far(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    if too_far(hi):
        return 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_far(mid) else (lo, mid)
    return hi


def flattening_exponent(shares: Mapping[str, float], target_entropy: float | None = None, caps: Mapping[str, float] | None = None, total: float = 0.0) -> float:
    """The least exponent whose tempered shares have at most the target entropy and need no more of a source than its cap.

    Entropy falls as the exponent grows, and so does the use of small sources. With caps that even exponent 1
    breaks, 1 is returned; the shortfall is then handled by `limited_weights`.
    """

    def too_flat(a: float) -> bool:
        w = tempered(shares, a)
        if target_entropy is not None and entropy(w) > target_entropy:
            return True
        return caps is not None and any(w[k] * total > caps[k] * (1 + 1e-12) for k in w)

    return bisect_exponent(too_flat)


@dataclass(frozen=True)
class Limited:
    """Exponents, the sources that break their limit at the wanted weights themselves, and tokens per source."""

    exponents: dict[str, float]
    limited: set[str]
    budgets: dict[str, float]


def limited_weights(wanted: Mapping[str, float], shares: Mapping[str, float], caps: Mapping[str, float], total: float) -> Limited:
    """Temper wanted weights w towards the sources' token shares s, w ** (1 - a) x s ** a, as far as repetition limits ask.

    Exponent 0 is the wanted weight, exponent 1 the natural share, which repeats all sources alike. Each source has
    the least exponent, found by bisection, at which its weight times `total` is within its cap; where it is above 0
    the source is limited and its budget is the cap (where even the natural share is above it, the cap holds). The
    weights of the others are normalised to what is left of the total, which may bring further ones to their caps,
    until none changes. Uniform wanted weights give the usual temperature mix of a source that is short.
    """
    use = {k for k, w in wanted.items() if w > 0}
    exponents = dict.fromkeys(wanted, 0.0)
    first: set[str] | None = None
    capped: set[str] = set()
    scale = 1.0
    while True:
        now = set()
        for k in use - capped:
            above = lambda a, k=k: scale * wanted[k] ** (1 - a) * (shares[k] ** a if shares[k] > 0 else float(a == 0)) * total > caps[k]
            exponents[k] = bisect_exponent(above)
            if exponents[k] > 0:
                now.add(k)
        first = now if first is None else first
        capped |= now
        rest = sum(wanted[k] for k in use - capped)
        left = max(total - sum(caps[k] for k in capped), 0.0)
        if not now or not rest:
            break
        scale = left / (rest * total) if total else 0.0
    budgets = {k: caps[k] if k in capped else scale * w * total if k in use else 0.0 for k, w in wanted.items()}
    return Limited(exponents, first or set(), budgets)


def _top_up(rest: DataFrame, room: DataFrame, doc: str) -> DataFrame:
    """Documents of `rest` (doc, source, tokens, ticket) that fill the `room` (source, room) left, largest first.

    The documents that fit are counted per source and size; a source's sizes, of which there are at most as many as
    its room has tokens, are taken from the largest down in one task, and of each size the first tickets are used.
    """
    fit = rest.join(F.broadcast(room), "source").filter((F.col("tokens") > 0) & (F.col("tokens") <= F.col("room")))
    sizes = fit.groupBy("source", "tokens", "room").agg(F.count(F.lit(1)).alias("n"))

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tokens", ascending=False)
        left, used = int(group["room"].iloc[0]), []
        for size, n in zip(group["tokens"].tolist(), group["n"].tolist(), strict=True):
            used.append(min(n, left // size))
            left -= used[-1] * size
        return group.assign(n_taken=used)[["source", "tokens", "n_taken"]].query("n_taken > 0")

    taken = sizes.groupBy("source").applyInPandas(take, "source string, tokens bigint, n_taken bigint")
    some = distributed_rank(rest.join(taken, ["source", "tokens"]), ["source", "tokens"], [F.col("ticket"), F.col(doc)])
    return some.filter(F.col("rank") <= F.col("n_taken")).select(doc, "source", "tokens", "ticket")


def mix_sources(docs: DataFrame, doc: str, source: str, tokens: str, spec: DataFrame, weighting: str = "given", target_entropy: float | None = None, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """Choose how often each document is used so that sources reach their target weights; returns (mix, report).

    `spec`: (source, weight, max_repeats, total_tokens), at most MAX_SOURCES rows of distinct sources, checked;
    total_tokens is the size of the whole mix. `weighting`:

    * ``given``: the weights of the specification.
    * ``tempered``: token shares of the sources raised to an exponent, which is bisected so that the entropy is at
      most `target_entropy` (where given) and no source needs more repetitions than allowed.

    The tokens per source are counted in one map-side combined pass. The weights are tempered towards the token
    shares where repetition limits ask (`limited_weights`), which gives the budgets. A budget is realised as block
    permutations: every block is the source in an order of its own, by hash of the block and the document. Whole
    blocks come first; of the last one the documents are taken in its order as long as they fit, and what room is
    then left is filled with later documents of that block, the largest that fit first, so a source stays below its
    budget by less than its smallest unused document. Documents of other sources, or without source, are not used;
    documents of size 0 come with the whole blocks.

    mix: one row per use (doc, source, tokens, block, ticket); a block is read in order of its tickets. report: one
    row per source of the specification (source, weight, exponent, goal_tokens = weight x total, source_tokens,
    cap_tokens, budget_tokens, mix_tokens, mix_share, short), where short says that the repetition limit binds at the
    goal itself and the realised mix stays below the goal. Repeated document rows are documents of their own. Empty
    documents give an empty mix and sources of 0 tokens.
    """
    spark = docs.sparkSession
    rows = [r.asDict() for r in spec.limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES or len({r["source"] for r in rows}) < len(rows):
        raise ValueError(f"the specification has repeated sources or more than {MAX_SOURCES} rows")
    total = float(rows[0]["total_tokens"]) if rows else 0.0
    names = F.broadcast(spark.createDataFrame([(r["source"],) for r in rows], "source string"))
    used = docs.select(F.col(doc), F.col(source).alias("source"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0).cast("bigint")).alias("tokens")).join(names, "source")
    used = cut_lineage(used, "sizes")
    sums = {r["source"]: r["t"] for r in used.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    size = {r["source"]: float(sums.get(r["source"]) or 0) for r in rows}
    caps = {r["source"]: size[r["source"]] * (r["max_repeats"] or 0) for r in rows}
    shares = {k: v / (sum(size.values()) or 1.0) for k, v in size.items()}
    if weighting == "given":
        weights = {r["source"]: float(r["weight"] or 0) for r in rows}
    elif weighting == "tempered":
        weights = tempered(shares, flattening_exponent(shares, target_entropy, caps, total))
    else:
        raise ValueError(f"unknown weighting {weighting!r}")
    plan_ = limited_weights(weights, shares, caps, total)
    budgets = plan_.budgets
    # a capped source is used up: whole blocks only, free of rounding
    blocks = {k: 0 if not size[k] else round(caps[k] / size[k]) if budgets[k] == caps[k] else int(budgets[k] // size[k]) for k in size}
    last = {k: max(budgets[k] - blocks[k] * size[k], 0.0) for k in size}
    plan = spark.createDataFrame(
        [(k, weights[k], plan_.exponents[k], weights[k] * total, int(size[k]), int(caps[k]), budgets[k], blocks[k], int(last[k]), k in plan_.limited) for k in size],
        "source string, weight double, exponent double, goal_tokens double, source_tokens bigint, cap_tokens bigint, budget_tokens double, blocks int, last bigint, limited boolean",
    )
    spread = F.broadcast(plan.select("source", "blocks", "last"))
    ticket = lambda block: hashed_number(15, F.lit(seed), block, F.col(doc))
    whole = used.join(spread, "source").filter("blocks > 0").select(doc, "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    whole = whole.withColumn("ticket", ticket(F.col("block")))
    order = used.join(spread, "source").filter("last > 0").withColumn("ticket", ticket(F.col("blocks")))
    ranked = cut_lineage(distributed_rank(order, ["source"], [F.col("ticket"), F.col(doc)], weight="tokens"), "last")
    inside = ranked.filter(F.col("running") <= F.col("last"))
    reached = ranked.groupBy("source", "last").agg(F.coalesce(F.max(F.when(F.col("running") <= F.col("last"), F.col("running"))), F.lit(0)).alias("run"))
    room = reached.select("source", (F.col("last") - F.col("run")).alias("room"))
    more = _top_up(ranked.filter(F.col("running") > F.col("last")).select(doc, "source", "tokens", "ticket"), room, doc)
    final = inside.select(doc, "source", "tokens", "ticket").unionByName(more).join(F.broadcast(plan.select("source", F.col("blocks").alias("block"))), "source")
    mix = whole.unionByName(final.select(*whole.columns))
    reached = mix.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"))
    report = plan.join(reached, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0)))
    every = F.sum("mix_tokens").over(Window.partitionBy())  # one row per source of the specification
    report = report.select(
        "source", "weight", "exponent", "goal_tokens", "source_tokens", "cap_tokens", "budget_tokens", "mix_tokens", F.try_divide(F.col("mix_tokens"), every).alias("mix_share"),
        (F.col("limited") & (F.col("mix_tokens") < F.col("goal_tokens"))).alias("short"),
    )
    return mix, report
