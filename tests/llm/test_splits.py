import random
from collections import Counter, defaultdict

from genoplane.llm.splits import assign_splits, connected_components, deal_sets, mixed_components, record_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    sets = defaultdict(set)
    for x in parent:
        sets[find(x)].add(x)
    return sorted(map(sorted, sets.values()))


def components_of(spark, edges):
    df = spark.createDataFrame(edges, "u string, v string")
    got = defaultdict(set)
    for r in connected_components(df).collect():
        assert r["vertex"] not in got[r["component"]]
        got[r["component"]].add(r["vertex"])
    return sorted(map(sorted, got.values()))


def test_components_of_random_graphs(spark):
    for seed, n, m in ((1, 300, 220), (2, 60, 200)):
        rng = random.Random(seed)
        edges = [(f"v{rng.randint(0, n)}", f"v{rng.randint(0, n)}") for _ in range(m)]
        assert components_of(spark, edges) == union_find(edges)


def test_components_of_stars_chains_cycles_and_pairs(spark):
    edges = [("hub", f"leaf{i}") for i in range(150)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)] + [("p", "q"), ("q", "p"), ("p", "q"), ("self", "self")]
    assert components_of(spark, [*edges, (None, "x"), ("y", None)]) == union_find(edges)
    assert components_of(spark, []) == []


def test_hubs_with_neighbours_that_are_not_pendant(spark):
    rng = random.Random(8)
    edges = [("hub", f"n{i}") for i in range(200)] + [(f"n{i}", f"n{rng.randint(0, 199)}") for i in range(200)] + [(f"m{i}", f"m{rng.randint(0, 150)}") for i in range(80)]
    df = spark.createDataFrame(edges, "u string, v string")
    got = defaultdict(set)
    for r in connected_components(df, salt_from=1).collect():
        got[r["component"]].add(r["vertex"])
    assert sorted(map(sorted, got.values())) == union_find(edges)


SCHEMA = "record bigint, a string, b string, text string, label string"


def records(seed=6, n=600, linked=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.choice([None, "hot", "hot", f"s{rng.randint(0, 80)}"] if linked else [None, "hot", *[f"s{rng.randint(0, 400)}"] * 4])
        b = rng.choice([None, f"x{rng.randint(0, 900)}", f"s{rng.randint(0, 200)}"]) if linked else rng.choice([None, f"y{i}"])
        rows.append((i, a, b, a and rng.choice([a, a, a.upper()]), rng.choice(["positive", "negative", "negative", None])))
    return rows


def sets_of(rows):
    where = {}
    for k, vs in enumerate(union_find([(r[1] or r[2], r[2] or r[1]) for r in rows if r[1] or r[2]])):
        where |= {v: k for v in vs}
    out = defaultdict(list)
    for r in rows:
        out[where[r[1] or r[2]] if r[1] or r[2] else f"alone{r[0]}"].append(r)
    return out


def test_mixed_sets_match_brute_force(spark):
    rows = records()
    got = {tuple(r) for r in mixed_components(*record_components(spark.createDataFrame(rows, SCHEMA), "record", "a", "b", "text", "label")).collect()}
    expected = set()
    for members in sets_of(rows).values():
        if len({r[3] for r in members if r[3] is not None}) > 1:
            first = min(r[0] for r in members)
            expected |= {(first, r[0]) for r in members if r[0] != first}
    assert got == expected


def test_splits_keep_sets_together_near_their_shares(spark):
    rows = records(7, 3000, linked=False)
    parts = record_components(spark.createDataFrame(rows, SCHEMA), "record", "a", "b", "text", "label")
    got = {r["record"]: r["split"] for r in assign_splits(*parts, {"train": 0.7, "validation": 0.2, "test": 0.1}).collect()}
    assert len(got) == len(rows)
    for members in sets_of(rows).values():
        assert len({got[r[0]] for r in members}) == 1
    n = Counter(got.values())
    assert abs(n["train"] / len(rows) - 0.7) < 0.03 and n["validation"] > n["test"] > 0


def test_empty_and_unconnected_records(spark):
    empty = record_components(spark.createDataFrame([], SCHEMA), "record", "a", "b", "text", "label")
    assert mixed_components(*empty).collect() == [] and assign_splits(*empty, {"train": 0.8, "test": 0.2}).collect() == []
    lone = record_components(spark.createDataFrame([(1, None, None, None, None), (2, None, None, " ", "positive")], SCHEMA), "record", "a", "b", "text", "label")
    assert mixed_components(*lone).collect() == [] and assign_splits(*lone, {"train": 0.8, "test": 0.2}).count() == 2


def test_large_sets_are_dealt_like_small_ones():
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    filled = lambda out: [sum(n * got[i] for _, n, got in out) for i in range(3)]
    assert filled(deal_sets([(0, 100, 8), (0, 50, 4)], shares)) == [800, 100, 100]
    assert filled(deal_sets([(0, 300, 1), (0, 1, 700)], shares)) == [800, 100, 100]
    assert filled(deal_sets([(1, 900, 1), (1, 1, 100), (2, 1, 1000)], shares)) == [1600, 200, 200]
    out = deal_sets([(0, 1000, 1)], shares)
    assert filled(out) == [1000, 0, 0] and deal_sets([], shares) == []
    assert all(sum(got) == c for (_, _, got), c in zip(deal_sets([(0, 7, 5), (0, 3, 11)], shares), (5, 11), strict=True))


def test_giants_do_not_spoil_the_shares(spark):
    rows = [(i, f"g{i // 300}" if i < 1500 else f"s{i}", None, None, "positive" if i % 2 else "negative") for i in range(5000)]
    parts = record_components(spark.createDataFrame(rows, SCHEMA), "record", "a", "b", "text", "label")
    got = Counter(r["split"] for r in assign_splits(*parts, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect())
    assert got == {"train": 4000, "validation": 500, "test": 500}
