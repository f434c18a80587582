import random

import pytest
from pyspark.sql import functions as F

from genoplane.llm.overlap import near_vectors, split_overlaps

FEATURES = ["f1", "f2", "f3", "f4"]
SCHEMA = "record int, part string, genome string, b int, f1 double, f2 double, f3 double, f4 double"


def near(x, y, tol=0.005):
    if x is None or y is None:
        return x is None and y is None
    return abs(x - y) <= tol * max(abs(x), abs(y))


def brute(rows):
    train = [r for r in rows if r[1] == "train"]
    out = {}
    for e in (r for r in rows if r[1] == "evaluation"):
        g = e[2] is not None and any(t[2] == e[2] for t in train)
        f = any(t[3] == e[3] and all(near(x, y) for x, y in zip(t[4:], e[4:])) for t in train)
        if g or f:
            out[e[0]] = (g, f)
    return out


def random_rows(seed, n=400):
    rng = random.Random(seed)
    base = [[rng.choice([None, 0.0, -1.0, 1.0]) if rng.random() < 0.15 else 10 ** rng.uniform(-3, 6) for _ in FEATURES] for _ in range(25)]
    rows = []
    for i in range(n):
        v = [None if x is None else x * (1 + rng.choice([0, 0, 1, -1]) * rng.choice([0.001, 0.0049, 0.005, 0.00502, 0.02])) for x in rng.choice(base)]
        rows.append((i, rng.choice(["train", "train", "evaluation", None, "other"]), rng.choice([None, f"g{rng.randint(0, 60)}"]), rng.choice([0, 1, None]), *v))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_match_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("token", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["record"]: (r["by_genome"], r["by_features"]) for r in split_overlaps(df, "record", "part", "genome", "b", FEATURES, ("genome",)).collect()}
    assert got == brute(rows)


def test_a_crowd_of_near_copies_is_searched_whole(spark):
    rng = random.Random(9)
    train = [(0, 100 * (1 + rng.uniform(-0.004, 0.004)), 1.0 + rng.uniform(-0.004, 0.004), 5.0, 7.0) for _ in range(300)] + [(0, 100.0, 1.0, 5.0, 7.0)] * 50
    ev = [(0, 100 * (1 + rng.uniform(-0.01, 0.01)), 1.0 + rng.uniform(-0.01, 0.01), 5.0, 7.0) for _ in range(200)]
    schema = "b int, f1 double, f2 double, f3 double, f4 double"
    got = {tuple(r) for r in near_vectors(spark.createDataFrame(train, schema), spark.createDataFrame(ev * 2, schema), "b", FEATURES).collect()}
    assert got == {e for e in ev if any(all(near(x, y) for x, y in zip(t[1:], e[1:])) for t in train)}


def test_edges(spark):
    nan = float("nan")
    rows = [(1, "train", None, None, None, None, None, None), (2, "evaluation", None, None, nan, None, None, None), (3, "evaluation", "", 1, 0.0, 1.0, 1.0, 1.0), (4, "train", "x", 1, -0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda d: sorted(r["record"] for r in split_overlaps(d, "record", "part", "genome", "b", FEATURES).collect())
    assert run(df) == [2, 3]
    assert run(df.filter("part = 'train'")) == run(df.filter("part = 'evaluation'")) == run(df.filter("false")) == []


def test_infinite_values_agree_with_their_like(spark):
    inf = float("inf")
    rows = [(1, "train", None, 1, inf, 1.0, -inf, 1.0), (2, "evaluation", None, 1, inf, 1.001, -inf, 1.0), (3, "evaluation", None, 1, -inf, 1.0, -inf, 1.0), (4, "evaluation", None, 1, 1e300, 1.0, -inf, 1.0), (5, "evaluation", None, 1, 1e-320, 1.0, 1.0, None)]
    got = split_overlaps(spark.createDataFrame(rows, SCHEMA), "record", "part", "genome", "b", FEATURES).collect()
    assert sorted(r["record"] for r in got) == [2]


def test_copies_of_one_vector_on_most_rows(spark):
    rows = [(i, "train" if i % 2 else "evaluation", None, 1, 5.0, 6.0, 7.0, 8.0) for i in range(600)] + [(1000 + i, "evaluation", None, 1, 5.0, 6.0 + i, 7.0, 8.0) for i in range(1, 50)]
    got = split_overlaps(spark.createDataFrame(rows, SCHEMA), "record", "part", "genome", "b", FEATURES).collect()
    assert len(got) == 300 and all(r["by_features"] and not r["by_genome"] for r in got)
