"""Splitting oversized texts at natural boundaries (problem 9)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoplane.functions.text import text_tokens

# What a text may be cut after, from the strongest boundary to the weakest. Sizes are bytes.
_BOUNDARIES = (
    re.compile(rb"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)[\s]*"),  # blank line
    re.compile(rb"[\r\n]+"),  # line
    re.compile("(?:[.!?;]|。)+[ \t]*".encode()),  # sentence
    re.compile(rb"[ \t]+"),  # word
)
_DELIMITER = re.compile("[ \t\n\r.!?;]|。".encode())
_FORCED = len(_BOUNDARIES)


def _char_start(data: bytes, at: int) -> int:
    """The greatest character boundary that is not after `at`."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def longest_stretch(data: bytes) -> int:
    """Bytes of the longest stretch without a delimiter."""
    longest, start = 0, 0
    for m in _DELIMITER.finditer(data):
        longest = max(longest, m.start() - start)
        start = m.end()
    return max(longest, len(data) - start)


def inside_stretch(data: bytes, at: int) -> bool:
    """Whether a cut at `at` has no delimiter on either side."""
    return 0 < at < len(data) and _trailing(data, 0, at) is None and _DELIMITER.match(data, at) is None


def _segments(data: bytes, start: int, end: int, level: int, room: int, hard: int) -> Iterator[tuple[int, int]]:
    """(end, strength of the boundary there) of the atomic segments of data[start:end].

    A span above `room` is divided at its strongest boundaries; parts that are still too large at the next weaker
    ones. A part that fits is not divided further: its inner boundaries are weaker than those around it and
    would be merged first anyhow. A part without boundaries is only cut where it exceeds `hard`.
    """
    if level == _FORCED:
        yield from ((cut, _FORCED) for cut in _forced_cuts(data, start, end, hard))
        yield end, _FORCED
        return
    before = start
    for cut in [*(m.end() for m in _BOUNDARIES[level].finditer(data, start, end) if m.end() < end), end]:
        if cut - before > room:
            yield from (x for x in _segments(data, before, cut, level + 1, room, hard) if x[0] < cut)
        yield cut, level
        before = cut


def _forced_cuts(data: bytes, start: int, end: int, hard: int) -> list[int]:
    """Cuts inside a stretch, with the delimiters after it, that make no segment larger than `hard`."""
    body = end
    while body > start and (m := _trailing(data, start, body)) is not None:
        body = m
    cuts, at = [], start
    for stop in (body, end):
        while stop - at > hard:
            at = _char_start(data, at + hard)
            cuts.append(at)
        if stop == body and end - at > hard and body > at:
            at = body
            cuts.append(at)
    return cuts


def _trailing(data: bytes, start: int, end: int) -> int | None:
    """Where the delimiter that ends data[start:end] begins."""
    if data[end - 1] in b" \t\n\r.!?;":
        return end - 1
    return end - 3 if end - 3 >= start and data[end - 3 : end] == "。".encode() else None


def split_bytes(data: bytes, max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """Cut `data` into pieces: (start, core_start, end); consecutive pieces share data[start:core_start].

    Agglomerative merging: the atomic segments stand in a row, a heap holds the boundaries between adjacent
    pairs, the weakest (then the one of the smallest pair) on top. A pair is merged if its size plus the
    overlap fits, else its boundary stays for good, since its sides only grow.

    The shared text is the longest run of whole characters of at most `overlap` bytes before the cut. It is
    shorter where the piece would exceed the limit otherwise (a stretch of more than max_tokens - overlap bytes
    that may be cut nowhere), and not longer than the piece before.
    """
    room = max_tokens - overlap
    if room < 4:
        raise ValueError("max_tokens has to exceed the overlap by a character")
    if len(data) <= max_tokens:
        return [(0, 0, len(data))]
    ends, strengths = zip(*_segments(data, 0, len(data), 0, room, max_tokens), strict=True)
    n = len(ends)
    starts = [0, *ends[:-1]]
    last = list(ends)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    limit = lambda i: max_tokens if starts[i] == 0 else room
    heap = [(-strengths[i], last[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j):
            continue
        now = last[j] - starts[i]
        if now > limit(i):
            continue
        if now != size:
            heapq.heappush(heap, (strength, now, i, j))
            continue
        last[i], alive[j], nxt[i] = last[j], False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            heapq.heappush(heap, (-strengths[_owner(ends, last[i])], last[nxt[i]] - starts[i], i, nxt[i]))
        if prv[i] >= 0:
            heapq.heappush(heap, (-strengths[_owner(ends, starts[i])], last[i] - starts[prv[i]], prv[i], i))
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < n:
        core, end = starts[i], last[i]
        shared = min(overlap, max_tokens - (end - core))
        start = max(core - max(0, shared), out[-1][0]) if out else core
        while start < core and data[start] & 0xC0 == 0x80:
            start += 1
        out.append((start, core, end))
        i = nxt[i]
    return out


def _owner(ends: tuple[int, ...], at: int) -> int:
    """Index of the atomic segment that ends at `at`."""
    lo, hi = 0, len(ends)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if ends[mid] < at else (lo, mid)
    return lo


def split_texts(docs: DataFrame, doc: str, text: str, max_tokens: int, overlap: int) -> DataFrame:
    """Pieces of every text above `max_tokens` (bytes): (doc, piece, n_pieces, tokens, overlap, cut, body).

    Texts within the limit, empty and null ones give no rows. Pieces are numbered from 0, each within the
    limit; `overlap` is the number of bytes shared with the piece before, `body` the text of the piece. `cut` is
    ``forced`` if some piece begins inside a stretch without any blank, tab, line feed, carriage return or one of
    ``. ! ? ; 。``, else ``natural``. The merging never cuts a stretch of at most max_tokens, and one above that fits
    into no piece, so this says whether the text has a stretch above the limit. Whole texts are processed, of any length; documents are
    independent, so repeated ids give the pieces of each row. Only texts above the limit leave the JVM.
    """
    large = docs.select(F.col(doc), F.col(text).alias("body")).filter(text_tokens(F.col("body")) > max_tokens)
    schema = T.StructType([
        T.StructField(doc, docs.schema[doc].dataType), T.StructField("piece", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()),
        T.StructField("tokens", T.LongType()), T.StructField("overlap", T.LongType()), T.StructField("cut", T.StringType()), T.StructField("body", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch[doc], batch["body"], strict=True):
                data = body.encode()
                pieces = split_bytes(data, max_tokens, overlap)
                cut = "forced" if any(inside_stretch(data, c) for _, c, _ in pieces) else "natural"
                rows += [(key, k, len(pieces), e - s, c - s, cut, data[s:e].decode()) for k, (s, c, e) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=schema.names)

    return large.mapInPandas(run, schema)
