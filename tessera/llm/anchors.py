"""Content-chosen anchors: the routing that lets equal windows of L symbols meet without shuffling every window.

In each window the k-gram with the smallest hash (leftmost on ties) is its anchor. Equal windows choose
equal anchors at equal offsets. A maximal run of successive windows with one anchor is a *context*; a
document has about 2 / (L - k + 2) contexts per symbol. Two windows can be equal only if their contexts
share the anchor, so contexts whose anchor occurs once need no more work, and equal contexts
(same text, same place of the anchor) agree in all their windows.

An anchor with very many different contexts is taken apart (`uncrowded`): a window has half of its other symbols on one side of
the anchor at least, and those symbols lengthen the anchor. Windows are dealt to their longer side, so equal windows still meet;
contexts that have become equal are one row again. This is repeated until no anchor is crowded; each time halves what
is beside the anchor, and when nothing is left all windows of an anchor are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PIECE_BYTES, RangeHash, U64, cut, mix, trimmed

_PLACE_BITS = 22
_PLACE = U64((1 << _PLACE_BITS) - 1)
_NONE = U64(0xFFFFFFFFFFFFFFFF)

#: Packed context place: first window, number of windows less one, anchor less first.
FIRST_BITS, COUNT_BITS, ANCHOR_BITS = 32, 8, 8
#: The most different contexts of one anchor that go to one task.
CROWD = 400


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, from running minima over blocks."""
    n = len(x)
    y = np.full(-(-n // w) * w, _NONE)
    y[:n] = x
    blocks = y.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def contexts(symbols: np.ndarray, row: np.ndarray, length: int, k: int) -> list[tuple[np.ndarray, ...]]:
    """Of a concatenation of rows: lists of (anchor hash, context hash, row, first window, windows, anchor's place).

    Places count symbols from the start of the concatenation. Long inputs are taken in overlapping
    segments; a run cut at a segment's edge gives two contexts with the same anchor.
    """
    found, n = [], len(symbols)
    for base in range(0, max(0, n - length + 1), PIECE_BYTES):
        part, own = symbols[base : base + PIECE_BYTES + length - 1], row[base : base + PIECE_BYTES + length - 1]
        starts = np.flatnonzero(own[length - 1 :] == own[: len(own) - length + 1])
        if not len(starts):
            continue
        ranges = RangeHash(part)
        grams = ranges.grams(k)
        choice = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        choice[own[k - 1 :] != own[: len(own) - k + 1]] = _NONE
        anchor = (sliding_min(choice, length - k + 1)[starts] & _PLACE).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[starts[1:]] != own[starts[:-1]])
        at = np.flatnonzero(new)
        first, last, a = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
        shape = ((a - first) * 512 + (last - first)).astype(U64)
        found.append((grams[a], mix(ranges(first, last + length) ^ (shape * U64(0x9FB21C651E98DF25))), own[first], first + base, last - first + 1, a + base))
    return found


def pack(first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first | ((count - 1) << FIRST_BITS) | ((anchor - first) << (FIRST_BITS + COUNT_BITS))


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place)"""
    first = place & ((1 << FIRST_BITS) - 1)
    return first, ((place >> FIRST_BITS) & ((1 << COUNT_BITS) - 1)) + 1, first + ((place >> (FIRST_BITS + COUNT_BITS)) & ((1 << ANCHOR_BITS) - 1))


def halved(lead, tail, window: int) -> list[tuple]:
    """A context whose windows have `window` symbols, the anchor being one: its windows with the longer part before the anchor,
    then the others. (side, windows before the first, symbols that join the anchor, lead, tail, window)"""
    slack, most = window - 1, len(lead)
    half, least, out = (slack + 1) // 2, slack - len(tail), []
    if most >= half:
        out.append((0, 0, lead[most - half :], lead[: most - half], tail[: slack - max(half, least)], slack - half + 1))
    if least < half:
        high, rest = min(most, half - 1), slack - half + 1
        out.append((1, most - high, tail[:rest], lead[most - high :], tail[rest:], half))
    return out


PARTS = "a long, c long, b long, d long, shift long, value long, lead binary, tail binary, window int"


def _halves(words: bool):
    """Batches of (a, c, value, lead, tail, window) to PARTS: b and d are the new anchor and context. words: symbols are words."""

    def signed(data: bytes, seed: int) -> int:
        h = xxhash.xxh64_intdigest(data, seed & 0xFFFFFFFFFFFFFFFF)
        return h - (h >> 63 << 64)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in PARTS.split(", ")]
            for a, c, value, lead, tail, window in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "value", "lead", "tail", "window")), strict=True):
                for side, shift, more, left, right, size in halved(lead.split(), tail.split(), window) if words else halved(lead, tail, window):
                    n = len(left)
                    if words:
                        more, left, right = b" ".join(more), b" ".join(left), b" ".join(right)
                    b = signed(more, a * 2 + side)
                    for to, x in zip(out, (a, c, b, signed(left + b" " + right, b + n), shift, value, left, right, size), strict=True):
                        to.append(x)
            kinds = [pa.int64()] * 6 + [pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    return run


def uncrowded(rows: DataFrame, value: Column, words: bool) -> tuple[DataFrame, DataFrame | None]:
    """rows(a, c, value, lead, tail, window), all of crowded anchors: the contexts that they are taken apart to, and which of these (b, d) has the
    windows of a context (a, c) from its window `shift` on (None without rows). `value` aggregates values of equal contexts."""
    done, maps, live = None, None, rows
    while True:
        crowded = cut(live.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("a"), "crowded")
        if not crowded.limit(1).count():
            return (done.unionByName(live) if done is not None else live), maps
        rest = live.join(crowded, "a", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        parts = cut(live.join(crowded, "a").select("a", "c", "value", "lead", "tail", "window").mapInArrow(_halves(words), PARTS), "parts")
        link = parts.select("a", "c", "b", "d", "shift").distinct()
        if maps is not None:
            again = maps.join(link.select(F.col("a").alias("b"), F.col("c").alias("d"), F.col("b").alias("b2"), F.col("d").alias("d2"), F.col("shift").alias("more")), ["b", "d"])
            link = again.select("a", "c", F.col("b2").alias("b"), F.col("d2").alias("d"), (F.col("shift") + F.col("more")).alias("shift")).union(maps.join(crowded.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "c", "b", "d", "shift"))
        maps = cut(link, "maps")
        live = cut(parts.groupBy("b", "d").agg(value.alias("value"), *(F.first(x).alias(x) for x in ("lead", "tail", "window"))).withColumnsRenamed({"b": "a", "d": "c"}), "live")


def mapped_back(judged: DataFrame, maps: DataFrame) -> DataFrame:
    """judged(a, c, start, ...), runs of windows of contexts that `uncrowded` gave, as runs of the contexts it took apart."""
    parts = judged.withColumnsRenamed({"a": "b", "c": "d"})
    return maps.join(parts, ["b", "d"]).withColumn("start", F.col("start") + F.col("shift")).select(*judged.columns)
