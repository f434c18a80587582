import random
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from genoplane.functions.text import word_key
from genoplane.operators.hotkeys import frequent_keys, hot_buckets, key_bucket, per_key_states, salted_join
from genoplane.operators.orphans import apply_deltas, current_orphans, existence_deltas, orphans_as_of
from genoplane.operators.ranking import distributed_rank
from genoplane.operators.wording import read_words
from genoplane.session import cut_lineage, release, scratch_tables, shared_dir


def test_rank_and_running_totals_match_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randint(0, 9), i, rng.randint(0, 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id int, w int").repartition(7)
    got = distributed_rank(df, ["g"], [F.col("v").desc(), F.col("id")], weight="w").collect()
    expected = {}
    for g in {r[0] for r in rows}:
        total = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            total += r[3]
            expected[r[2]] = (place, total)
    assert {r["id"]: (r["rank"], r["running"]) for r in got} == expected
    assert distributed_rank(df.filter("false"), ["g"], [F.col("id")]).collect() == []
    assert sorted(r["rank"] for r in distributed_rank(df, [], [F.col("id")]).collect()) == list(range(1, 601))


def test_frequent_keys_count_blank_rows_in_the_total(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("y",)] + [("  ",)] * 5 + [(None,)], "k string")
    assert [(r[0], r[1]) for r in frequent_keys(df, "k", 0.2).collect()] == [("x", 3)]
    assert frequent_keys(df.filter("false"), "k", 0.2).collect() == []
    got = {r[0]: r[1] for r in per_key_states(df, ["k"], [F.count(F.lit(1)).alias("n")]).collect()}
    assert got == {"x": 3, "y": 1, "  ": 5, None: 1}


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 999)], "k string, id int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "k string, v int")
    hot = hot_buckets(left.select("k"), "k", 0.1)
    assert [r[0] for r in left.filter("k = 'hot'").select(key_bucket(F.col("k"))).distinct().collect()] == hot
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(r["id"] for r in salted_join(left, right, "k", "id", how).collect())
        assert got == sorted(r["id"] for r in left.join(right, "k", how).collect()), how


T0 = datetime(2024, 1, 1)


def brute_orphans(refs, held):
    out = {}
    for row_id, k, t in refs:
        if k is None:
            continue
        mine = [(a, b) for kk, a, b in held if kk == k and a is not None and (b is None or b > a)]
        if t is not None and any(a <= t and (b is None or b > t) for a, b in mine):
            continue
        out[row_id] = "deleted" if t is not None and any(a <= t for a, _ in mine) else "later" if mine else "missing"
    return out


def test_orphans_match_brute_force_with_hot_keys_spread_over_ranges(spark):
    rng = random.Random(5)
    day = lambda: T0 + timedelta(hours=rng.randint(0, 24 * 20))
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c", None])
    refs = [(i, key(), day() if rng.random() > 0.05 else None) for i in range(300)]
    held = [(key(), day() if rng.random() > 0.05 else None, day() if rng.random() < 0.7 else None) for _ in range(120)]
    rdf = spark.createDataFrame(refs, "row_id bigint, key string, at timestamp_ntz")
    deltas = existence_deltas(spark.createDataFrame(held, "k string, a timestamp_ntz, b timestamp_ntz"), F.col("k"), "a", "b")
    expected = brute_orphans(refs, held)
    for hot in ([], None, [r[0] for r in rdf.select(key_bucket(F.col("key"))).distinct().collect() if r[0] is not None]):
        got = {r["row_id"]: r["reason"] for r in orphans_as_of(rdf, deltas, hot).collect()}
        assert got == expected
    assert orphans_as_of(rdf.filter("false"), deltas).collect() == []
    assert {r["row_id"] for r in orphans_as_of(rdf, deltas.filter("false")).collect()} == {i for i, k, _ in refs if k is not None}


def test_state_of_signed_counts_merges_in_any_order(spark):
    d = lambda *x: spark.createDataFrame(list(x), "key string, delta int")
    none = d().filter("false") if False else spark.createDataFrame([], "key string, delta int")
    one = apply_deltas(None, d(("a", 1), ("a", 1), ("b", 1), (None, 1)), d(("b", 1)))
    two = apply_deltas(one, none, d(("a", 1), ("b", -1)))
    other = apply_deltas(apply_deltas(None, none, d(("a", 1), ("b", -1))), d(("a", 1), ("a", 1), ("b", 1)), d(("b", 1)))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(current_orphans(one)) == {("a", 2)}
    assert rows(current_orphans(two)) == rows(current_orphans(other)) == {("b", 1)}
    gone = apply_deltas(two, d(("b", -1)), none)
    assert rows(current_orphans(gone)) == set()


def test_words_are_read_by_their_writings_or_row_by_row(spark):
    rows = spark.createDataFrame([(i, ["A b", " a-B", "(ab)", None, ""][i % 5], "x") for i in range(50)], "id int, w string, c string").repartition(3)
    for limit in (100, 2):
        got = read_words(rows, {"key": ("w", word_key), "w": ("w", F.upper), "d": ("c", F.upper)}, limit).collect()
        assert {(r["id"], r["key"], r["w"], r["d"]) for r in got} == {(i, ["ab", "ab", "ab", None, None][i % 5], ["A B", " A-B", "(AB)", None, ""][i % 5], "X") for i in range(50)}
    assert read_words(rows.filter("false"), {"key": ("w", word_key)}).collect() == []


def test_a_cluster_has_to_name_its_shared_folder(spark, monkeypatch):
    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    context = SimpleNamespace(master="local-cluster[2,1,1024]", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_cut_tables_can_be_released(spark):
    df = cut_lineage(spark.range(5))
    path = df._genoplane_path.removeprefix("file://")
    assert Path(path).exists() and df.count() == 5
    release(df, None, spark.range(1))
    assert not Path(path).exists()


def test_scratch_tables_go_with_their_block(spark):
    with scratch_tables():
        outer = cut_lineage(spark.range(3))
        with scratch_tables():
            inner = cut_lineage(spark.range(4))
            assert inner.count() == 4
        assert not Path(inner._genoplane_path.removeprefix("file://")).exists() and outer.count() == 3
    assert not Path(outer._genoplane_path.removeprefix("file://")).exists()
