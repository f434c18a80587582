"""Mergeable reservoirs: the smallest keys per slot, kept in bounded states by every task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_ROWS = 200_000
_WHOLE = ("tinyint", "smallint", "int", "bigint", "boolean")


def ascending(column: Column, kind: str, down: bool, name: str) -> list[Column]:
    """Columns without nulls whose ascending order is that of `column` (of type `kind`), nulls and NaN last.

    The first is 1 for a missing value. Whole numbers, dates and timestamps become bigint, which is inverted for a
    descending order; other numbers become double. Texts only ascend.
    """
    if kind in _WHOLE or kind == "date" or kind.startswith("timestamp"):
        whole = column.cast("bigint")
        if kind == "date":
            whole = F.unix_date(column).cast("bigint")
        elif kind.startswith("timestamp"):
            start = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) if kind == "timestamp_ntz" else F.timestamp_seconds(F.lit(0))
            whole = F.timestamp_diff("MICROSECOND", start, column)
        value = F.coalesce(F.bitwise_not(whole) if down else whole, F.lit(0).cast("bigint"))
        missing = column.isNull()
    elif kind == "string":
        if down:
            raise ValueError("a descending order of texts is not supported")
        value, missing = F.coalesce(column, F.lit("")), column.isNull()
    else:
        real = F.nanvl(column.cast("double"), F.lit(None).cast("double"))
        value, missing = F.coalesce(-real if down else real, F.lit(0.0)), real.isNull()
    return [missing.cast("int").alias(f"{name}_missing"), value.alias(name)]


class Reservoirs:
    """The `capacity` smallest rows of each slot, by the columns `order` (texts, integers and doubles without nulls).

    `distinct` leading columns of the order name a unit: of the rows of a unit only the first counts and stays.
    Rows are held in frames and cut down when twice as many have come in, so the state has at most two times the
    capacities; a row beyond the last key of a full slot is turned away at once. States merge by `add`.
    """

    def __init__(self, slot: str, order: Sequence[str], capacity: Mapping[int, int], distinct: int = 0, state_rows: int = STATE_ROWS) -> None:
        self.slot, self.order, self.distinct, self.state_rows = slot, list(order), distinct, state_rows
        self.capacity = np.zeros(max(capacity, default=-1) + 1, dtype=np.int64)
        for k, n in capacity.items():
            self.capacity[k] = n
        self.frames: list[pd.DataFrame] = []
        self.held, self.room = 0, min(state_rows, 20_000)
        self.full = np.zeros(len(self.capacity), dtype=bool)
        self.last: dict[str, np.ndarray] = {}  # the last key of each full slot, in the leading columns that are numbers

    def add(self, batch: pd.DataFrame) -> pd.DataFrame | None:
        """Take rows in; where the state has grown beyond `state_rows`, it is given back and a new one begins."""
        batch = batch[batch[self.slot].to_numpy() < len(self.capacity)]
        if self.last and len(batch):
            slots = batch[self.slot].to_numpy()
            beyond, tied = np.zeros(len(batch), dtype=bool), self.full[slots]
            for c, last in self.last.items():
                value, edge = batch[c].to_numpy(), last[slots]
                beyond |= tied & (value > edge)
                tied &= value == edge
            batch = batch[~beyond]
        if len(batch):
            self.frames.append(batch)
            self.held += len(batch)
        if self.held <= self.room:
            return None
        state = self.state()
        if len(state) > self.state_rows:
            self.frames, self.held, self.room = [], 0, self.state_rows
            return state
        self.frames, self.held, self.room = [state], len(state), 2 * len(state) + 1000
        return None

    def state(self) -> pd.DataFrame | None:
        if not self.frames:
            return None
        rows = pd.concat(self.frames, ignore_index=True) if len(self.frames) > 1 else self.frames[0]
        slots = rows[self.slot].to_numpy()
        keys = [np.unique(k, return_inverse=True)[1] if k.dtype == object else k for k in (rows[c].to_numpy() for c in self.order)]
        at = np.lexsort([*keys[::-1], slots])
        slots, keys = slots[at], [k[at] for k in keys]
        if self.distinct and len(at):
            new = np.ones(len(at), dtype=bool)
            new[1:] = slots[1:] != slots[:-1]
            for k in keys[: self.distinct]:
                new[1:] |= k[1:] != k[:-1]
            at, slots, keys = at[new], slots[new], [k[new] for k in keys]
        first = np.searchsorted(slots, slots, side="left")
        place = np.arange(len(slots)) - first
        fits = place < self.capacity[slots]
        edges = np.flatnonzero(place == self.capacity[slots] - 1)
        self.full[slots[edges]] = True
        for c, k in zip(self.order, keys, strict=True):
            if rows[c].dtype == object:
                break
            self.last.setdefault(c, np.zeros(len(self.capacity), dtype=k.dtype))[slots[edges]] = k[edges]
        return rows.iloc[at[fits]]


def partial_reservoirs(rows: DataFrame, slot: str, order: Sequence[str], capacity: Mapping[int, int], distinct: int = 0, state_rows: int = STATE_ROWS) -> DataFrame:
    """The rows that every task keeps in its reservoirs: what is among the smallest of a slot is among them.

    One pass without a shuffle; of each slot a task keeps at most `capacity` rows (units), however many it reads,
    in a state of at most `state_rows` rows, beyond which it hands its state on and begins another. The rows of
    several tasks are states of one reservoir: merging them (by a sort, or per unit) and keeping the smallest again
    gives what one reservoir over all rows would hold. Slots, numbered from 0, without capacity keep nothing.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Reservoirs(slot, order, capacity, distinct, state_rows)
        for batch in batches:
            if (full := own.add(batch)) is not None:
                yield full
        if (rest := own.state()) is not None:
            yield rest

    return rows.mapInPandas(keep, T.StructType(rows.schema.fields))
