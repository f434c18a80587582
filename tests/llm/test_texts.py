import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoplane.llm import packing, splitting
from genoplane.llm.mixing import entropy, flattening_exponent, limited_weights, mix_sources, tempered
from genoplane.llm.packing import LocalSweep, deal, pack_items
from genoplane.llm.splitting import inside_stretch, longest_stretch, split_bytes, split_texts


def pack(spark, sizes, capacity, parts=None):
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n int").withColumn("container", F.lit("clash"))
    many = {"rows_per_part": max(1, len(sizes) // parts), "max_parts": parts} if parts else {}
    return pack_items(df, "id", F.col("n"), capacity, **many).collect()


@pytest.mark.parametrize("parts", [None, 6])
def test_every_item_is_packed_and_no_container_overflows(spark, parts):
    rng = random.Random(5)
    sizes = [rng.choice([0, None, rng.randint(1, 30), rng.randint(1, 100), rng.randint(1, 100), rng.randint(101, 450), 100]) for _ in range(400)]
    rows = pack(spark, sizes, 100, parts)
    fill, whole = Counter(), defaultdict(int)
    for r in rows:
        fill[r["container"]] += r["size"]
        whole[r["id"]] += r["size"]
        assert r["divided"] == ((sizes[r["id"]] or 0) > 100)
    assert max(fill.values()) <= 100 and whole == {i: s or 0 for i, s in enumerate(sizes)}
    assert len({(r["id"], r["piece"]) for r in rows}) == len(rows)
    assert all(n == 1 for i, n in Counter(r["id"] for r in rows).items() if (sizes[i] or 0) <= 100)
    total = sum(s or 0 for s in sizes)
    assert len(fill) <= -(-total // 100) * 1.03 + 1
    assert set(range(max(fill) + 1)) == set(fill)


def test_packing_edges(spark):
    assert pack(spark, [], 10) == []
    assert [(r["size"], r["container"]) for r in pack(spark, [None, 0], 10)] == [(0, 0)] * 2
    assert sorted((r["piece"], r["size"], r["container"]) for r in pack(spark, [20], 10)) == [(0, 10, 0), (1, 10, 1)]
    assert sorted(r["container"] for r in pack(spark, [10, 10, 10], 10)) == [0, 1, 2]
    with pytest.raises(ValueError):
        pack(spark, [1], 0)


def test_local_sweep_is_best_fit():
    s = LocalSweep()
    for c, space in enumerate((9, 8, 5)):
        s.gap(space, c)
    assert [s.item(x) for x in (5, 4, 4, 4, 4)] == [2, 1, 1, 0, 0]
    assert s.item(1) == 0 and s.item(1) is None


def test_gaps_stay_with_their_size_or_go_on_to_where_space_is_lacking():
    items = [(9, 10, 90, 10.0), (5, 20, 100, 10.0), (1, 25, 25, 3.0)]
    plan = deal(items, [(9, 90), (6, 150)], 10, 3, 7, 0)
    assert plan.n_parts == 3 and plan.bins[9] == (9, 0, 1) and plan.bins[6] == (6, 1, 1) and plan.bins[10] == (10, 0, 1)
    assert [(p, q) for p, _, _, q in plan.moves] == [(0, 0), (1, 1), (1, 2)] and plan.moves[1][2] == pytest.approx(2 / 3)
    fresh = deal(items, [], 10, 3, 7, 15).fresh
    assert fresh == [(7, 17), (17, 22), (22, 22)]
    assert deal(items, [], 10, 1, 7, float("inf")).fresh == [(7, float("inf"))]
    crowd = deal([(4, 1000, 4000, 500.0), (2, 10, 20, 2.0)], [(7, 60)], 10, 8, 0, 0)
    assert crowd.bins[4] == (4, 0, 8) and crowd.n_parts == 9


def test_many_parts_need_few_supersteps(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [min(8192, max(1, int(rng.lognormvariate(7, 1.2)))) for _ in range(100_000)]
    parts, one = [], packing._superstep
    monkeypatch.setattr(packing, "_superstep", lambda items, gaps, plan, *x: (parts.append(plan.n_parts), one(items, gaps, plan, *x))[1])
    rows = pack(spark, sizes, 8192, 16)
    fill = Counter()
    for r in rows:
        fill[r["container"]] += r["size"]
    assert len(rows) == len(sizes) and max(fill.values()) <= 8192 and sum(fill.values()) == sum(sizes)
    assert parts[0] >= 10 and len(parts) <= 5 and sum(sizes) / (8192 * len(fill)) >= 0.99


def test_one_size_on_most_items_takes_several_parts(spark):
    rows = pack(spark, [7] * 2000 + [3] * 700 + [11] * 30, 20, 8)
    fill = Counter()
    for r in rows:
        fill[r["container"]] += r["size"]
    assert len(rows) == 2730 and max(fill.values()) <= 20 and set(range(max(fill) + 1)) == set(fill)
    assert len(fill) <= 1.02 * 1001 + 8


ALPHABET = st.sampled_from(list("abcde  .\n;é世。\t") + ["\n\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=300), st.integers(12, 60), st.integers(0, 8))
def test_pieces_fit_share_and_join_to_the_text(parts, limit, overlap):
    text = "".join(parts)
    data = text.encode()
    pieces = split_bytes(data, limit, overlap)
    assert b"".join(data[c:e] for _, c, e in pieces) == data
    for (s, c, e), before in zip(pieces, [None, *pieces], strict=False):
        assert e - s <= limit and s <= c
        data[s:e].decode()
        if before:
            assert before[2] == c and s >= before[0]
            room = limit - (e - c)
            assert c - s <= overlap and c - s > min(overlap, room, c - before[0]) - 4
    natural = {m for m in range(1, len(data)) if data[m - 1 : m] in (b" ", b".", b"\n", b"\t", b";") or data[m : m + 1] in (b" ", b".", b"\n", b"\t", b";") or data[max(0, m - 3) : m] == "。".encode() or data[m : m + 3] == "。".encode()}
    if longest_stretch(data) <= limit - overlap:
        assert all(c in natural for _, c, _ in pieces[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=400), st.integers(12, 60), st.integers(0, 8))
def test_forced_pieces_tell_of_a_stretch_above_the_limit(parts, limit, overlap):
    data = "".join(parts).encode()
    pieces = split_bytes(data, limit, overlap)
    assert any(inside_stretch(data, c) for _, c, _ in pieces) == (longest_stretch(data) > limit and len(data) > limit)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=400), st.integers(12, 60), st.integers(0, 8))
def test_parts_that_fit_need_not_be_divided_into_atoms(parts, limit, overlap):
    data = "".join(parts).encode()
    whole = splitting._segments
    try:
        splitting._segments = lambda data, start, end, level, room, hard: whole(data, start, end, level, 0, hard)
        atomic = split_bytes(data, limit, overlap)
    finally:
        splitting._segments = whole
    assert split_bytes(data, limit, overlap) == atomic


def test_strong_boundaries_survive():
    text = ("word " * 30 + "end.\n" + "other " * 20 + "stop.\n\n") * 3
    cuts = [c for _, c, _ in split_bytes(text.encode(), 320, 10)]
    assert all(text[c - 2 : c] == "\n\n" for c in cuts[1:])


def test_split_texts(spark):
    rows = [(1, "a" * 100), (2, "b" * 101), (3, "x y " * 50), (4, None), (5, ""), (3, "x y " * 50), (6, "世" * 34 + " " + "世" * 20), (7, "q" * 200_000)]
    out = split_texts(spark.createDataFrame(rows, "id int, text string").withColumn("piece", F.lit(0)), "id", "text", 100, 10)
    cut = {(r["id"], r["cut"]) for r in out.collect()}
    assert cut == {(2, "forced"), (3, "natural"), (6, "forced"), (7, "forced")}
    assert out.filter("id = 3 AND piece = 0").count() == 2 and out.agg(F.max("tokens")).first()[0] <= 100
    assert out.filter("id = 7").agg(F.sum(F.col("tokens") - F.col("overlap"))).first()[0] == 200_000
    assert split_texts(spark.createDataFrame([], "id int, text string"), "id", "text", 100, 10).collect() == []


SPEC = [("a", 0.6, 2, 1000), ("b", 0.3, 3, 1000), ("c", 0.1, 5, 1000)]


def mixed(spark, docs, spec=SPEC, **options):
    d = spark.createDataFrame(docs, "id int, source string, tokens bigint, weight string")
    s = spark.createDataFrame(spec, "source string, weight double, max_repeats int, total_tokens bigint")
    mix, report = mix_sources(d, "id", "source", "tokens", s, **options)
    return mix.collect(), {r["source"]: r for r in report.collect()}


def test_mix_reaches_weights_within_repeats(spark):
    docs = [(i, "a", 10, "") for i in range(100)] + [(200 + i, "b", 5, "") for i in range(30)] + [(300, "c", 7, ""), (301, "c", None, ""), (302, "z", 9, ""), (303, None, 9, "")]
    mix, report = mixed(spark, docs)
    assert (report["c"]["short"], report["a"]["short"], report["b"]["short"]) == (True, False, False)
    uses, where = Counter(r["id"] for r in mix), {r["id"]: r["source"] for r in mix}
    assert (report["c"]["mix_tokens"], uses[300], uses[301]) == (35, 5, 5)
    assert all(n <= {"a": 2, "b": 3, "c": 5}[where[i]] for i, n in uses.items()) and len({(r["id"], r["block"]) for r in mix}) == len(mix)
    assert sum(r["tokens"] for r in mix) >= 985
    assert report["a"]["mix_tokens"] / report["b"]["mix_tokens"] == pytest.approx(2, rel=0.05)
    assert sum(r["mix_share"] for r in report.values()) == pytest.approx(1)
    # a block is an order of its own
    order = lambda k: [r["id"] for r in sorted((r for r in mix if r["source"] == "b" and r["block"] == k), key=lambda r: r["ticket"])]
    assert sorted(order(0)) == sorted(order(1)) and order(0) != order(1)
    mix, report = mixed(spark, [])
    assert mix == [] and all(r["short"] and r["source_tokens"] == 0 for r in report.values())
    with pytest.raises(ValueError):
        mixed(spark, docs, [*SPEC, SPEC[0]])


def test_the_last_block_goes_on_after_a_document_that_does_not_fit(spark):
    rng = random.Random(4)
    docs = [(i, "a", rng.choice([1, 2, 3, 50, 400, 900]), "") for i in range(300)]
    total = sum(d[2] for d in docs)
    for goal in (total // 3, total // 2 + 7, total + 411):
        mix, report = mixed(spark, docs, [("a", 1.0, 2, goal)])
        assert goal - 1 <= report["a"]["mix_tokens"] == sum(r["tokens"] for r in mix) <= goal
        assert max(Counter(r["id"] for r in mix).values()) <= 2


def test_shares_of_a_realised_mix_decide_what_is_short(spark, monkeypatch):
    from genoplane.llm import mixing

    docs = [(i, "a", 10, "") for i in range(60)] + [(100, "b", 300, ""), (101, "c", 100, "")]
    assert not mixed(spark, docs, [("a", 0.6, 1, 1000), ("b", 0.3, 1, 1000), ("c", 0.1, 1, 1000)])[1]["a"]["short"]
    never = lambda too_far: 0.0
    spec = [("a", 0.7, 1, 1000), ("b", 0.2, 1, 1000), ("c", 0.1, 1, 1000)]
    assert mixed(spark, docs, spec)[1]["a"]["short"]
    monkeypatch.setattr(mixing, "bisect_exponent", never)
    assert not mixed(spark, docs, spec)[1]["a"]["short"]


def test_temperature(spark):
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    a = flattening_exponent(shares, target_entropy=1.0)
    assert entropy(tempered(shares, a)) == pytest.approx(1.0, abs=1e-6) and 0 < a < 1
    caps = {"a": 700.0, "b": 400.0, "c": 200.0}
    w = tempered(shares, flattening_exponent(shares, caps=caps, total=1000.0))
    assert max(w[k] * 1000 / caps[k] for k in w) == pytest.approx(1, abs=1e-6)
    assert flattening_exponent(shares) == 0.0
    docs = [(i, "abc"[i % 7 % 3], 10, "") for i in range(210)]
    _, report = mixed(spark, docs, weighting="tempered", target_entropy=1.05)
    assert sum(r["mix_tokens"] for r in report.values()) == pytest.approx(1000, abs=30)


def test_exponents_of_limited_sources():
    got = limited_weights({"a": 0.5, "b": 0.5}, {"a": 0.05, "b": 0.95}, {"a": 100.0, "b": 1900.0}, 1000.0)
    assert got.limited == {"a"} and got.budgets == {"a": 100.0, "b": pytest.approx(900.0)}
    assert 0.5 ** (1 - got.exponents["a"]) * 0.05 ** got.exponents["a"] * 1000 == pytest.approx(100) and got.exponents["b"] == 0
    # what a leaves brings c to its cap too, which does not make c short of its own goal
    got = limited_weights({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.1, "b": 0.7, "c": 0.2}, {"a": 100.0, "b": 2000.0, "c": 220.0}, 1000.0)
    assert got.limited == {"a"} and got.budgets["c"] == 220.0 and sum(got.budgets.values()) == pytest.approx(1000)
    assert limited_weights({"a": 1.0}, {"a": 0.0}, {"a": 0.0}, 10.0).limited == {"a"} and limited_weights({}, {}, {}, 10.0).budgets == {}
