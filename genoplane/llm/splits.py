"""Train, validation and test splits that keep connected records together (problem 5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoplane.operators.hotkeys import hot_buckets, salted_join
from genoplane.operators.ranking import distributed_rank
from genoplane.session import cut_lineage, release

MAX_BROADCAST = 100_000


def _heads(vertex: Column, seed: int, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), vertex), F.lit(2)) == 0


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))


def connected_components(edges: DataFrame, seed: int = 3, max_rounds: int = 500, salt_from: int = 200_000) -> DataFrame:
    """(vertex, component) for every vertex of `edges` (u, v); the component is one of its vertices.

    Random-mate contraction. Each round has two joins of the shrinking edge table: pendant vertices fold into
    their only neighbour (a biased coin: a vertex of degree 1 always mates, so a star, however large, goes in
    one round), then every vertex draws a coin and tails with a neighbour of heads collapse into the smallest
    such neighbour. Edges are renamed and made distinct, and the rounds go on until none is left. A hub with many
    neighbours that are not pendant is dealt to slices in the joins (`salted_join`); tables below `salt_from` edges
    fit into one task whatever their keys and are joined as they are, with the same result.

    The merges (child, parent) of each step are written to the shared folder. Labels are unwound by pointer
    doubling over the merges after the first step, of which few are left, so that a vertex is at its root after
    the logarithm of the number of steps; the children of the first step, most of all vertices, look theirs up once.

    Self-loops only name their vertex, repeated edges count once, edges with a null end are no edges. No edges
    give an empty result.
    """
    u, v = F.col("u"), F.col("v")
    named = edges.filter(u.isNotNull() & v.isNotNull())
    loops = named.filter(u == v).select(u.alias("vertex")).distinct()
    live = cut_lineage(named.filter(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges")
    steps: list[DataFrame] = []
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        sides = _both_ways(live).groupBy("x").agg(F.count(F.lit(1)).alias("degree"), F.min("y").alias("y")).filter("degree = 1")
        pairs = sides.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.max("x").alias("child"))
        # where both ends are pendant the greater one folds
        folded = cut_lineage(pairs.select("u", "v", "child", F.when(F.col("child") == u, v).otherwise(u).alias("parent")), "folded")
        core = cut_lineage(live.join(folded.select("u", "v"), ["u", "v"], "left_anti"), "core")
        mates = _both_ways(core).filter(~_heads(F.col("x"), seed, turn) & _heads(F.col("y"), seed, turn))
        mates = cut_lineage(mates.groupBy(F.col("x").alias("child")).agg(F.min("y").alias("parent")), "mates")
        steps += [folded.select("child", "parent"), mates]
        hot = hot_buckets(_both_ways(core).select("x"), "x") if core.count() >= salt_from else []
        renamed = core
        for end, other in (("u", "v"), ("v", "u")):
            renamed = salted_join(renamed, mates.select(F.col("child").alias(end), F.col("parent").alias(f"p{end}")), end, other, "left", hot)
        renamed = renamed.select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b")).filter("a <> b")
        after = cut_lineage(renamed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        release(live, core)
        live = after
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    if not steps:
        return loops.select("vertex", F.col("vertex").alias("component"))
    later = cut_lineage(reduce(DataFrame.unionByName, steps[1:]), "parents")
    n = later.count()
    reach = 1  # a parent is this many merges away, or a root
    while reach < len(steps):
        above = later.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        later = salted_join(later, above, "parent", "child", "left", None if n >= salt_from else [])
        later = cut_lineage(later.select("child", F.coalesce("further", "parent").alias("parent")), "parents")
        reach *= 2
    above = later.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
    first = salted_join(steps[0], above, "parent", "child", "left", None if steps[0].count() >= salt_from else [])
    labels = first.select(F.col("child").alias("vertex"), F.coalesce("further", "parent").alias("component"))
    labels = cut_lineage(labels.unionByName(later.select(F.col("child").alias("vertex"), F.col("parent").alias("component"))), "labels")
    labels = labels.unionByName(labels.select(F.col("component").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component")))
    alone = loops.join(labels, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return labels.unionByName(alone)


def record_components(records: DataFrame, record: str, first: str, second: str, text: str, label: str | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """Connected sets of records that share a key of column `first` or `second`.

    Returns (nodes, rows, hot): `rows` has the records by ``node``, the key they hang on (their first key, else
    their second, else null for a record without keys, which is a set of its own). `nodes` has one row per
    node: component, n (records), first_record, least_text and greatest_text (of the non-null values of
    `text`), and positives (records whose `label` is ``positive``). Node states are aggregated before any join,
    so a hot key costs one row per map task. `hot` names the key buckets that a later join has to salt.
    """
    columns = [F.col(record).alias("record"), F.coalesce(first, second).alias("node"), F.col(first).alias("a"), F.col(second).alias("b"), F.col(text).alias("text")]
    columns.append(F.col(label).alias("label") if label else F.lit(None).cast("string").alias("label"))
    rows = cut_lineage(records.select(*columns), "records")
    components = connected_components(rows.select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("first_record"), F.min("text").alias("least_text"), F.max("text").alias("greatest_text"), F.count_if(F.col("label") == "positive").alias("positives"))
    nodes = nodes.join(components.select(F.col("vertex").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return cut_lineage(nodes, "nodes"), rows, hot_buckets(rows.select("node"), "node")


def component_states(nodes: DataFrame) -> DataFrame:
    """One row per connected set, from the states of its nodes."""
    return nodes.groupBy("component").agg(F.sum("n").alias("n"), F.min("first_record").alias("first_record"), F.min("least_text").alias("least_text"), F.max("greatest_text").alias("greatest_text"), F.sum("positives").alias("positives"))


def mixed_components(nodes: DataFrame, rows: DataFrame, hot: list[int]) -> DataFrame:
    """(first_record, record) for the sets with at least two different texts: the smallest record with each other one."""
    several = component_states(nodes).filter(F.col("least_text") != F.col("greatest_text")).select("component", "first_record")
    by_node = nodes.select("node", "component").join(several, "component").select("node", "first_record")
    out = salted_join(rows.select("record", "node"), by_node, "node", "record", hot=hot)
    return out.filter(F.col("record") != F.col("first_record")).select("first_record", "record")


def deal_sets(sizes: Sequence[tuple[int, int, int]], shares: Mapping[str, float]) -> list[tuple[int, int, list[int]]]:
    """How many of the `count` sets of `n` records of a stratum go to each split: (stratum, n, counts), from (stratum, n, count).

    Largest sets first: sets of one size are divided in proportion to the records that the splits still lack of
    their share of the stratum, the largest remainders rounded up, and a split that has its share gets none unless
    all have. What a stratum gives a split too much or too little is set off in the next one; the strata with
    the largest sets come first, as they leave most to be set off.
    """
    names = list(shares)
    by_stratum: dict[int, list[tuple[int, int]]] = {}
    for stratum, n, count in sizes:
        by_stratum.setdefault(stratum, []).append((n, count))
    owed, out = [0.0] * len(names), []
    for stratum in sorted(by_stratum, key=lambda k: (-max(by_stratum[k])[0], k)):
        groups = sorted(by_stratum[stratum], reverse=True)
        total = sum(n * count for n, count in groups)
        lack = [shares[x] * total + o for x, o in zip(names, owed, strict=True)]
        for n, count in groups:
            room = [max(x, 0.0) for x in lack]
            room = room if sum(room) else [shares[x] for x in names]
            exact = [count * x / sum(room) for x in room]
            got = [int(x) for x in exact]
            for _ in range(count - sum(got)):
                i = max(range(len(names)), key=lambda i: (min(exact[i] - got[i], 1.0) if room[i] > 0 else -1.0, room[i] - n * got[i]))
                got[i] += 1
            lack = [x - n * k for x, k in zip(lack, got, strict=True)]
            out.append((stratum, n, got))
        owed = lack
    return out


def assign_splits(nodes: DataFrame, rows: DataFrame, hot: list[int], shares: Mapping[str, float], seed: int = 5) -> DataFrame:
    """(record, split): connected sets go to the splits of `shares` as a whole.

    Sets are stratified by the share of positive labels (fifths) and dealt by weight, the largest first, by one rule
    for all sizes (`deal_sets`): it needs the number of sets per stratum and size, a histogram with at most the
    root of twice the number of records sizes per stratum. Sets of equal stratum and size are put in hashed order and
    the first ones go to the first split, and so on. A set larger than what every split lacks goes where most is
    lacking, so a share that cannot be met is exceeded by one set at most. Records without any key are sets of one
    record; no records give no rows.
    """
    names = list(shares)
    free = rows.filter(F.col("node").isNull()).select(F.concat(F.lit("record:"), F.col("record").cast("string")).alias("component"), F.col("record").alias("first_record"), F.lit(1).cast("bigint").alias("n"), F.when(F.col("label") == "positive", 1).otherwise(0).cast("bigint").alias("positives"))
    sets = component_states(nodes).select("component", "first_record", "n", "positives").unionByName(free)
    sets = sets.withColumn("stratum", F.floor(F.least(F.col("positives") / F.col("n") * 5, F.lit(4))).cast("int")).withColumn("ticket", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("first_record").cast("string")).cast("binary")))
    sets = cut_lineage(sets.select("component", "first_record", "n", "stratum", "ticket"), "sets")
    sizes = [(r["stratum"], r["n"], r["c"]) for r in sets.groupBy("stratum", "n").agg(F.count(F.lit(1)).alias("c")).collect()]
    plan = sets.sparkSession.createDataFrame([(s, n, *accumulate(got)) for s, n, got in deal_sets(sizes, shares)], "stratum int, n bigint, " + ", ".join(f"upto{i} bigint" for i in range(len(names))))
    ranked = distributed_rank(sets, ["stratum", "n"], [F.col("ticket"), F.col("first_record")]).withColumn("kind", F.col("n") * 8 + F.col("stratum"))
    plan = plan.select((F.col("n") * 8 + F.col("stratum")).alias("kind"), *[f"upto{i}" for i in range(len(names))])
    # most sets have one of the smallest sizes
    ranked = ranked.join(F.broadcast(plan), "kind") if len(sizes) <= MAX_BROADCAST else salted_join(ranked, plan, "kind", "component")
    split = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        split = F.when(F.col("rank") <= F.col(f"upto{i}"), names[i]).otherwise(split)
    placed = ranked.select("component", split.alias("split"))
    by_node = nodes.select("node", "component").join(placed, "component").select("node", "split")
    hung = salted_join(rows.filter(F.col("node").isNotNull()).select("record", "node", "label"), by_node, "node", "record", hot=hot).select("record", "label", "split")
    alone = rows.filter(F.col("node").isNull()).select("record", "label", F.concat(F.lit("record:"), F.col("record").cast("string")).alias("component")).join(placed, "component").select("record", "label", "split")
    return hung.unionByName(alone)
