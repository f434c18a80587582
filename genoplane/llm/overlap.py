"""Evaluation records that are the same, or almost, as a training record (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoplane.operators.hotkeys import key_bucket, salted_join
from genoplane.session import cut_lineage

MIN_SKETCH, MAX_SKETCH = 1 << 12, 1 << 17


_INFINITY = float("inf")


def _cell(x: Column, width: float, shift: float = 0.0) -> Column:
    """Code of the logarithmic cell that holds |x| after a relative shift; sign, zero, infinite and missing have codes of their own."""
    cell = F.floor((F.ln(F.abs(x)) + shift) / width) * 4
    return F.when(x.isNull(), F.lit(0)).when(x == 0, F.lit(1)).when(x == _INFINITY, F.lit(4)).when(x == -_INFINITY, F.lit(5)).when(x > 0, cell + 2).otherwise(cell + 3).cast("bigint")


def _single(x: Column) -> Column:
    """Whether a value agrees only with its like, not with a neighbourhood."""
    return x.isNull() | (x == 0) | (F.abs(x) == _INFINITY)


def _token(position: int, codes: Sequence[Column]) -> Column:
    return F.xxhash64(F.lit(position), *codes)


def _combine(position: int, done: list[Column], left: list[Column]) -> Column:
    """All tokens of a position, over the alternatives in the arrays `left`."""
    if not left:
        return F.array(_token(position, done))
    return F.flatten(F.transform(left[0], lambda code: _combine(position, [*done, code], left[1:])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, not once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ranked(token: Column, rarity: bytes) -> Column:
    """A token with its place in the global order: rare first, by the byte that the sketch has for its bucket."""
    at = F.pmod(token, F.lit(len(rarity))).cast("int") + 1
    return F.struct(F.substring(F.lit(bytearray(rarity)), at, F.lit(1)).alias("r"), token.alias("t"))


def _agree(features: Sequence[str], other: str, tolerance: float) -> Column:
    def one(f: str) -> Column:
        x, y = F.col(f), F.col(f"{other}{f}")
        near = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
        return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).when((F.abs(x) == _INFINITY) | (F.abs(y) == _INFINITY), x == y).otherwise(near)

    return reduce(lambda a, b: a & b, map(one, features))


def cleaned(column: str) -> Column:
    """A feature as double: NaN as null, one zero."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)


def near_vectors(training: DataFrame, evaluation: DataFrame, exact: str, features: Sequence[str], tolerance: float = 0.005, shingle: int = 6, cells: int = 16) -> DataFrame:
    """Distinct evaluation vectors (columns exact, *features) that agree with some training vector.

    Two vectors agree if `exact` is equal and every feature is within `tolerance` of the greater magnitude;
    a missing value (null or NaN) agrees only with a missing value, an infinite one only with the same.

    A prefix-filter join on shingles. Values fall into logarithmic cells `cells` tolerances wide, and a shingle
    is the cells of `shingle` neighbouring columns. A training vector has one shingle per position; an
    evaluation vector has one for each combination of cells that its tolerance touches. Agreeing vectors share
    every position, so in a global order (rare shingles first, by hashed counters over all training shingles, one
    per 64 training rows within MIN_SKETCH and MAX_SKETCH) the training vector's rarest shingle is among the
    evaluation vector's shingles, and no position of the evaluation vector ends before it. Hence the index holds of
    each evaluation vector only the prefix up to the first position that ends, and training probes with a single
    shingle. The number of present values is the length filter. Candidates are verified on the values.

    Crowded shingles: evaluation vectors are first compared with one training vector per shingle, and only those
    that differ from it go on to the other distinct vectors of a shingle with more rows, so copies of one
    vector, however many, cost one comparison each. Both joins are salted: in the first the evaluation vectors of a
    hot shingle are dealt to slices, in the second, where the pairs per shingle are counted before, its training
    vectors.
    """
    columns = [exact, *features]
    clean = lambda df: df.select(F.col(exact), *[cleaned(f).alias(f) for f in features])
    training, evaluation = clean(training), clean(evaluation).distinct()
    sketch = min(max(1 << (training.count() // 64).bit_length(), MIN_SKETCH), MAX_SKETCH)
    reach = -math.log1p(-tolerance) + 1e-9
    width = cells * reach
    positions = range(len(columns) - min(shingle, len(columns)) + 1)
    span = lambda items, p: items[p : p + min(shingle, len(columns))]
    exact_code = F.coalesce(F.xxhash64(exact), F.lit(0)).cast("bigint")
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])

    codes = [exact_code, *[_cell(F.col(f), width) for f in features]]
    coded = training.withColumns({f"_c{i}": c for i, c in enumerate(codes)})
    probe = coded.withColumns({f"_t{p}": _token(p, [F.col(f"_c{i}") for i in span(range(len(columns)), p)]) for p in positions})
    tokens = probe.select(F.explode(F.array(*[F.col(f"_t{p}") for p in positions])).alias("t"))
    counters = tokens.groupBy(F.pmod("t", F.lit(sketch)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    rarity = bytearray(sketch)
    for row in counters:
        rarity[row["b"]] = min(255, int(4 * math.log2(row["n"] + 1)))
    rarity = bytes(rarity)
    best = F.least(*[_ranked(F.col(f"_t{p}"), rarity) for p in positions]) if len(positions) > 1 else _ranked(F.col("_t0"), rarity)
    keyed = lambda token: F.xxhash64(token, present).alias("token")
    # written once for both readers: its expressions are the dearest of all
    probe = cut_lineage(probe.select(keyed(best["t"]), *columns), "probe")

    alternatives = [F.array(exact_code)] + [F.when(_single(F.col(f)), F.array(_cell(F.col(f), width))).otherwise(F.sequence(_cell(F.col(f), width, -reach), _cell(F.col(f), width, reach), F.lit(4).cast("bigint"))) for f in features]
    every = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(alternatives)])

    def prefix(a: Column) -> Column:
        ranked = [F.transform(_combine(p, [], [a[f"a{i}"] for i in span(range(len(columns)), p)]), lambda t: _ranked(t, rarity)) for p in positions]
        return _let(F.struct(*[r.alias(f"p{p}") for p, r in enumerate(ranked)]), cut)

    def cut(r: Column) -> Column:
        ends = [F.array_max(r[f"p{p}"]) for p in positions]
        end = F.least(*ends) if len(ends) > 1 else ends[0]
        return _let(end, lambda last: F.filter(F.concat(*[r[f"p{p}"] for p in positions]), lambda x: x <= last))

    # explode_outer: explode would add a filter on its whole argument, to be run before the rows are made distinct
    index = evaluation.select(F.explode_outer(_let(every, prefix)).alias("x"), *columns).select(keyed(F.col("x.t")), F.xxhash64(*columns).alias("spread"), *columns)
    index = cut_lineage(index, "index")

    others = [F.first(c).alias(f"o_{c}") for c in columns]
    first = probe.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *others)
    same = F.col(exact).eqNullSafe(F.col(f"o_{exact}")) & _agree(features, "o_", tolerance)
    met = salted_join(index, first, "token", "spread").select("token", *columns, "n", same.alias("same"))
    met = cut_lineage(met.filter(F.col("same") | (F.col("n") > 1)), "candidates")
    open_ = met.filter(~F.col("same")).select("token", *columns)
    pairs = {r["b"]: r["n"] for r in met.filter(~F.col("same")).groupBy(key_bucket(F.col("token")).alias("b")).agg(F.sum("n").alias("n")).collect()}
    hot = [b for b, n in pairs.items() if n > max(0.01 * sum(pairs.values()), 1)]
    rest = probe.join(open_.select("token").distinct(), "token", "left_semi").distinct()
    rest = rest.select("token", F.xxhash64(*columns).alias("spread"), *[F.col(c).alias(f"o_{c}") for c in columns])
    found = salted_join(rest, open_, "token", "spread", hot=hot).filter(same).select(*columns)
    return met.filter("same").select(*columns).unionByName(found).distinct()


def split_overlaps(records: DataFrame, record: str, part: str, genome: str, exact: str, features: Sequence[str], carry: Sequence[str] = (), tolerance: float = 0.005) -> DataFrame:
    """Evaluation records that share the genome or the measured values of a training record.

    `part` is ``train`` or ``evaluation``; other values (and null) are neither. `genome` is a genome key or
    null, which names nothing. One row per evaluation record met: record, *carry, by_genome, by_features. A
    record may have no value at all: it agrees with a training record without values. Empty tables, or a side
    without records, give an empty result; repeated rows count as records of their own id.
    """
    columns = [exact, *features]
    kept = [c for c in dict.fromkeys([record, part, genome, *carry]) if c not in columns]
    records = records.filter(F.col(part).isin("train", "evaluation")).select(*kept, exact, *[cleaned(f).alias(f) for f in features])
    records = cut_lineage(records.withColumn("vector", F.xxhash64(*columns)), "vectors")
    training, evaluation = records.filter(F.col(part) == "train"), records.filter(F.col(part) == "evaluation")
    near = near_vectors(training.select(*columns), evaluation.select(*columns), exact, features, tolerance)
    genomes = training.filter(F.col(genome).isNotNull()).select(genome).distinct()
    by_genome = salted_join(evaluation.select(record, genome, *[c for c in carry if c != genome]), genomes, genome, record, "left_semi")
    near = near.select(F.xxhash64(*columns).alias("vector"), *[F.col(c).alias(f"o_{c}") for c in columns])
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in columns])
    by_features = salted_join(evaluation, near, "vector", record).filter(alike)
    flags = lambda df, g, f: df.select(record, *carry, F.lit(g).alias("by_genome"), F.lit(f).alias("by_features"))
    both = flags(by_genome, True, False).unionByName(flags(by_features, False, True))
    return both.groupBy(record, *carry).agg(F.bool_or("by_genome").alias("by_genome"), F.bool_or("by_features").alias("by_features"))
