"""Reading of vocabulary columns by their distinct writings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoplane.session import cut_lineage

MAX_WORDS = 20_000


def read_words(rows: DataFrame, readings: Mapping[str, tuple[str, Callable[[Column], Column]]], limit: int = MAX_WORDS) -> DataFrame:
    """Add to `rows` each column ``name`` of `readings`, {name: (column, reading)}, a reading that maps null to null.

    A vocabulary column has few writings on many rows, and a reading takes several regular expressions. The
    distinct writings are found in one map-side combined pass, read, and written with their readings; the rows look
    theirs up in a broadcast table. That table is broadcast only if it has at most `limit` rows; beyond it the readings
    are applied to every row, with the same result. Rows are neither lost nor repeated; null stays null; an empty
    table stays empty. (Were the readings not written, a later filter on one would be pushed through the join in terms
    of the raw column and run its expressions on every row.)
    """
    raw = [F.struct(F.lit(i).alias("c"), F.col(column).alias("v")) for i, (column, _) in enumerate(readings.values())]
    words = rows.select(F.inline(F.array(*raw))).filter("v IS NOT NULL").distinct()
    words = cut_lineage(words.select("c", "v", *[F.when(F.col("c") == i, reading(F.col("v"))).alias(f"w{i}") for i, (_, reading) in enumerate(readings.values())]), "words")
    if words.count() > limit:
        return rows.withColumns({name: reading(F.col(column)) for name, (column, reading) in readings.items()})
    out = rows
    for i, (column, _) in enumerate(readings.values()):
        one = words.filter(F.col("c") == i).select(F.col("v").alias(f"_v{i}"), F.col(f"w{i}").alias(f"_r{i}"))
        out = out.join(F.broadcast(one), F.col(column) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    return out.withColumns({name: F.col(f"_r{i}") for i, name in enumerate(readings)}).drop(*[f"_r{i}" for i in range(len(readings))])
