import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from genoplane.llm import sampling
from genoplane.llm.reservoirs import Reservoirs, partial_reservoirs
from genoplane.llm.sampling import cap_contributors, feasible_quotas, proportional_sample

TARGETS = [("a", 0.5, 2, 40), ("b", 0.3, 5, 40), ("c", 0.15, 0, 40), ("d", 0.05, 6, 40)]


def sample_of(spark, rows, targets=TARGETS):
    df = spark.createDataFrame(rows, "id int, cat string, acc string, key string")
    t = spark.createDataFrame(targets, "cat string, target_share double, min_rows int, sample_rows bigint")
    sample, report = proportional_sample(df, t, ["cat"], "acc", "id")
    return [(r["row_id"], r["cat"]) for r in sample.collect()], {r["cat"]: r for r in report.collect()}


def test_shares_floors_and_shortfalls(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaabbcx"), f"acc{i // 2}", "k") for i in range(2000)] + [(5000, "d", "z1", "k"), (5001, "d", "z1", "k"), (5002, "d", "z2", "k"), (5003, "d", None, "k"), (5004, None, "q", "k")]
    sample, report = sample_of(spark, rows)
    n = Counter(c for _, c in sample)
    assert sum(n.values()) == 40 and n["d"] == 2
    assert (report["d"]["available"], report["d"]["wanted"], report["d"]["exhausted"]) == (2, 6.0, True)
    assert not report["a"]["exhausted"] and all(n[c] == report[c]["drawn"] == report[c]["quota"] for c in "abcd")
    assert abs(n["a"] / 38 - 0.5 / 0.95) < 0.03 and n["b"] >= 5
    by_id = {r[0]: r for r in rows}
    assert len({(by_id[i][1], by_id[i][2]) for i, _ in sample}) == 40
    again, _ = sample_of(spark, rows[::-1])
    assert sorted(again) == sorted(sample)


def test_draw_is_uniform_within_a_category(spark):
    hits = Counter()
    df = spark.createDataFrame([(i, "a", f"u{i}") for i in range(100)], "id int, cat string, acc string")
    t = spark.createDataFrame([("a", 1.0, 0, 30)], "cat string, target_share double, min_rows int, sample_rows bigint")
    for seed in range(6):
        sample, _ = proportional_sample(df, t, ["cat"], "acc", "id", seed=seed, state_rows=7)
        ids = [r["row_id"] for r in sample.collect()]
        assert len(ids) == 30
        hits.update(i // 50 for i in ids)
    assert 60 < hits[0] < 120


def test_empty_and_bad_targets(spark):
    sample, report = sample_of(spark, [])
    assert sample == [] and all(r["quota"] == 0 and r["exhausted"] for r in report.values())
    with pytest.raises(ValueError):
        sample_of(spark, [], [*TARGETS, ("a", 0.1, 1, 40)])


def test_quotas():
    known = lambda *x: [{"category": i, "available": a, "share": s, "min_rows": m} for i, (a, s, m) in enumerate(x)]
    assert feasible_quotas(known((100, 6, 0), (100, 4, 0)), 10) == {0: 6, 1: 4}
    assert feasible_quotas(known((3, 6, 0), (100, 4, 0)), 10) == {0: 3, 1: 7}
    assert feasible_quotas(known((3, 6, 0), (2, 4, 0)), 10) == {0: 3, 1: 2}
    assert feasible_quotas(known((100, 9, 0), (100, 1, 5)), 10) == {0: 5, 1: 5}
    assert feasible_quotas([], 10) == {}


def test_reservoirs_hold_the_smallest_of_each_slot_and_merge():
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), rng.randint(0, 300), f"u{rng.randint(0, 50)}", i) for i in range(2000)]
    df = pd.DataFrame(rows, columns=["slot", "key", "unit", "id"])
    for state_rows in (5, 40, 10_000):
        own = Reservoirs("slot", ["key", "unit", "id"], {0: 5, 2: 20}, 2, state_rows)
        flushed = [f for k in range(0, 2000, 100) if (f := own.add(df[k : k + 100])) is not None]
        merged = Reservoirs("slot", ["key", "unit", "id"], {0: 5, 2: 20}, 2)
        for f in [*flushed, *([] if own.state() is None else [own.state()])]:
            merged.add(f)
        expected = set()
        for slot, n in ((0, 5), (2, 20)):
            first = {}
            for _, k, u, i in sorted(r for r in rows if r[0] == slot):
                first.setdefault((k, u), i)
            expected |= {(slot, k, u, i) for (k, u), i in sorted(first.items())[:n]}
        assert set(merged.state().itertuples(index=False, name=None)) == expected
        assert all(len(f) > state_rows for f in flushed) and (len(flushed) == 0) == (state_rows > 25)


def test_a_task_hands_on_no_more_than_its_capacities(spark):
    df = spark.range(0, 4000, 1, 4).select((F.col("id") % 3).cast("int").alias("slot"), F.xxhash64("id").alias("key"), "id")
    assert partial_reservoirs(df, "slot", ["key"], {0: 10, 1: 100}).groupBy("slot").count().orderBy("slot").collect() == [(0, 40), (1, 400)]


def test_the_report_follows_from_the_reservoirs(spark, monkeypatch):
    rows = [(i, "a", f"u{i}", "k") for i in range(200)]
    assert not sample_of(spark, rows)[1]["a"]["exhausted"]
    whole = sampling.partial_reservoirs
    monkeypatch.setattr(sampling, "partial_reservoirs", lambda *x, **k: whole(*x, **k).filter("key % 20 = 0"))
    assert sample_of(spark, rows)[1]["a"]["exhausted"]


def test_reservoirs_grow_where_exhausted_categories_leave_much(spark):
    rows = [(i, "a", f"u{i}", "k") for i in range(900)] + [(1000, "b", "z", "k")]
    sample, report = sample_of(spark, rows, [("a", 0.1, 0, 400), ("b", 0.9, 0, 400)])
    assert len(sample) == 400 and (report["a"]["drawn"], report["b"]["drawn"]) == (399, 1)
    assert (report["a"]["available"], report["a"]["exhausted"], report["b"]["exhausted"]) == (900, False, True)


def test_cap_keeps_the_best_and_breaks_ties(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "g", "free", None]), rng.choice([3.0, 2.0, 1.0, None, float("nan")]), rng.choice([None, rng.randint(0, 5)]), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, who string, score double, at int, rank string")
    limits = spark.createDataFrame([("hot", 40), ("g", 1000), ("none", 1), (None, 3)], "who string, max_rows bigint")
    got = cap_contributors(df, limits, "who", "id", None, [(F.col("score"), True), (F.col("at"), True), (F.col("id"), False)], state_rows=30).collect()
    assert len(got) == 500
    score = lambda x: -9 if x is None or x != x else x
    hot = sorted((r for r in rows if r[1] == "hot"), key=lambda r: (-score(r[2]), -(r[3] if r[3] is not None else -9), r[0]))
    assert {r["id"] for r in got if not r["kept"]} == {r[0] for r in hot[40:]}
    assert {r["rank"] for r in got if r["who"] in ("free", None)} == {None}
    assert sorted(r["rank"] for r in got if r["who"] == "hot" and r["kept"]) == list(range(1, 41))
    assert cap_contributors(df.filter("false"), limits, "who", "id", F.col("score"), []).collect() == []
    with pytest.raises(ValueError):
        cap_contributors(df, limits.unionAll(limits), "who", "id", None)


def test_what_is_left_out_follows_from_the_reservoirs(spark, monkeypatch):
    df = spark.range(100).select("id", F.lit("w").alias("who"))
    limits = spark.createDataFrame([("w", 60)], "who string, max_rows bigint")
    left = lambda: {r["id"] for r in cap_contributors(df, limits, "who", "id", None, [(F.col("id"), False)]).filter(~F.col("kept")).collect()}
    assert left() == set(range(60, 100))
    whole = sampling.partial_reservoirs
    monkeypatch.setattr(sampling, "partial_reservoirs", lambda *x, **k: whole(*x, **k).filter("id % 2 = 0 OR id < 20"))
    assert left() != set(range(60, 100))


def test_cap_counts_repeated_rows_and_zero_limits(spark):
    df = spark.createDataFrame([(1, "w", 2)] * 7 + [(2, "w", 3), (3, "z", 1), (3, "z", 1)], "id int, who string, at int").repartition(3)
    limits = spark.createDataFrame([("w", 4), ("z", 0)], "who string, max_rows bigint")
    got = Counter((r["id"], r["kept"]) for r in cap_contributors(df, limits, "who", "id", None, [(F.col("at"), True), (F.col("id"), False)]).collect())
    assert got == {(2, True): 1, (1, True): 3, (1, False): 4, (3, False): 2}


def test_random_cap_prefers_high_scores(spark):
    df = spark.range(2000).select("id", F.lit("w").alias("who"), F.when(F.col("id") < 1000, 8.0).otherwise(1.0).alias("score"))
    limits = spark.createDataFrame([("w", 200)], "who string, max_rows bigint")
    kept = [r["id"] for r in cap_contributors(df, limits, "who", "id", F.col("score")).filter("kept").collect()]
    assert len(kept) == 200 and 150 < sum(i < 1000 for i in kept) < 200
