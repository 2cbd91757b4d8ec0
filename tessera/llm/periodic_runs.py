"""Maximal periodic runs of words, by a harmonic grid and binary searches over prefix hashes.

A run of period q holds two neighbouring points of the grid 0, q, 2q, ..., so all pairs (q, point) of all texts of a
block, n ln n for a text of n words, are looked at together in numpy. A pair goes on only if its two words are equal, if
half a period to one side of it is (one comparison of prefix hashes each), and if it is the first of its run. What is left is
extended to both sides by binary searches, all pairs at once. Runs that one stretch of words gives for several periods are
one run, that of the smallest. In the end each run's words and both its edges are compared by number; words of one
number have been compared byte by byte, and a text where a hash has deceived is done again without hashes.

A run is a stretch of words with smallest period q, of max(least, 2q) words or more, that no neighbour extends. A word is dropped if a
run has it after the run's first q words.

Cases: null and empty texts have no words and no runs; the texts have no other limits (pairs come in blocks of PAIRS, and a
text's own arrays take some 60 bytes a word). Rows are judged one by one: repeated rows and ids keep a row each, an empty table
gives none, extra columns are ignored. Of the query: a null doc_id has no number, and such texts stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, load, mix, pieces, powers, trimmed, word_hashes, words

#: Words of the shortest run.
LEAST = 12
#: Pairs of period and grid point that one kernel call looks at (besides those of one period of one text).
PAIRS = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for each i."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def numbers(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only: found by hashes, and every word compared with the first of its number."""
    _, first, ids = np.unique(word_hashes(buf, s, e), return_index=True, return_inverse=True)
    size, like = e - s, first[ids]
    equal = bool((size == size[like]).all())
    step = 1 << 17
    for i in range(0, len(s) if equal else 0, step):
        own = slice(i, i + step)
        equal = equal and bool((buf[spread(s[own], size[own])] == buf[spread(s[like[own]], size[own])]).all())
    if not equal:
        table: dict[bytes, int] = {}
        ids = np.array([table.setdefault(buf[a:b].tobytes(), len(table)) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64)
    return ids


def plain_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of a text's runs without hashes, each period's equal words looked at whole."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // 2 + 1):
        equal = np.concatenate(([0], (ids[:-q] == ids[q:]).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(equal))
        for a, b in zip(edges[::2].tolist(), (edges[1::2] + q).tolist(), strict=True):
            if b - a >= max(least, 2 * q):
                found.setdefault((a, b), q)
    return [(a, b, q) for (a, b), q in found.items()]


def runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of texts whose words have numbers ids[bounds[i]:bounds[i + 1]], by start, then period."""
    n = np.diff(bounds)
    periods = np.where(n >= least, n // 2, 0)
    text = np.repeat(np.arange(len(n)), periods)
    q = spread(np.ones(len(n), np.int64), periods)
    lo, hi = bounds[text], bounds[text + 1]
    points = (hi - lo - 1) // q if len(q) else q
    symbols = mix(ids.astype(U64) + U64(1))
    power = powers(_BASE, len(ids))
    sums = np.zeros(len(ids) + 1, U64)
    np.cumsum(symbols * power[: len(ids)], out=sums[1:])
    done, parts, k = np.cumsum(points), [], 0

    def same(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether words a..b-1 equal those q further on, by hash."""
        return (sums[b] - sums[a]) * power[q] == sums[b + q] - sums[a + q]

    while k < len(q):
        upto = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + PAIRS, side="right")))
        entry = np.repeat(np.arange(k, upto), points[k:upto])
        at = spread(np.zeros(upto - k, np.int64), points[k:upto])
        p = q[entry]
        at = at * p + lo[entry]
        some = ids[at] == ids[at + p]
        at, p, entry = at[some], p[some], entry[some]
        k = upto
        # Enough words to one side at least, and no point of the same run before this one.
        half = (np.maximum(p, least - p) + 1) // 2
        fits = at + p + half <= hi[entry]
        some = np.zeros(len(at), bool)
        some[fits] = same(at[fits], at[fits] + half[fits], p[fits])
        back = at - half >= lo[entry]
        some[back] |= same(at[back] - half[back], at[back], p[back])
        before = at - p >= lo[entry]
        some[before] &= ~same(at[before] - p[before], at[before], p[before])
        at, p, entry = at[some], p[some], entry[some]
        if not len(at):
            continue
        # The most words to the right and to the left, all pairs at once.
        sure, most = np.ones(len(at), np.int64), hi[entry] - at - p
        while (sure < most).any():
            mid = (sure + most + 1) // 2
            good = same(at, at + mid, p)
            sure, most = np.where(good, mid, sure), np.where(good, most, mid - 1)
        right, sure, most = sure, np.zeros(len(at), np.int64), np.minimum(p - 1, at - lo[entry])
        while (sure < most).any():
            mid = (sure + most + 1) // 2
            good = same(at - mid, at, p)
            sure, most = np.where(good, mid, sure), np.where(good, most, mid - 1)
        start, end = at - sure, at + p + right
        some = end - start >= np.maximum(least, 2 * p)
        parts.append([start[some], end[some], p[some], text[entry[some]]])
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, end, p, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((p, end, start))
    start, end, p, text = start[order], end[order], p[order], text[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p, text = start[first], end[first], p[first], text[first]
    wrong = _deceived(ids, bounds, start, end, p, text)
    if len(wrong):
        rest = ~np.isin(text, wrong)
        again = [(a + int(bounds[t]), b + int(bounds[t]), x) for t in wrong.tolist() for a, b, x in plain_runs(ids[bounds[t] : bounds[t + 1]], least)]
        more = np.array(again, np.int64).reshape(-1, 3)
        start, end, p = (np.concatenate((x[rest], more[:, i])) for i, x in enumerate((start, end, p)))
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _deceived(ids: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The texts of which a run's words or edges aren't what the hashes said."""
    lo, hi = bounds[text], bounds[text + 1]
    wrong = (start > lo) & (ids[np.maximum(start - 1, 0)] == ids[np.maximum(start - 1, 0) + p])
    last = np.minimum(end, len(ids) - 1)
    wrong |= (end < hi) & (ids[last] == ids[last - p])
    done, k = np.cumsum(end - start - p), 0
    while k < len(start):
        upto = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + PAIRS, side="right")))
        size = (end - start - p)[k:upto]
        at = spread(start[k:upto], size)
        unlike = ids[at] != ids[at + np.repeat(p[k:upto], size)]
        wrong[k:upto] |= np.add.reduceat(unlike, np.cumsum(size) - size) > 0
        k = upto
    return np.unique(text[wrong])


def tampered(key: int | None, n: int) -> np.ndarray | None:
    """Of a text of n words with this id: which of its words stands at each place if a part is made to repeat, else None."""
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def _judged(change, least: int):
    """Batches of (doc_id, text). change(doc_id, n): the places of the words to judge instead, or None."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in pieces(batch, "text"):
                s, e, row = words(buf, off)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(off) - 1))))
                ids = numbers(buf, s, e)
                for i, key in enumerate(rows.column("doc_id").to_pylist() if change else ()):
                    a, b = bounds[i], bounds[i + 1]
                    if (to := change(key, int(b - a))) is not None:
                        ids[a:b], s[a:b], e[a:b] = ids[a:b][to], s[a:b][to], e[a:b][to]
                start, end, p = runs(ids, bounds, least)
                drop = np.zeros(len(ids) + 1, np.int64)
                np.add.at(drop, start + p, 1)
                np.add.at(drop, end, -1)
                keep = np.cumsum(drop[:-1]) == 0
                yield _rows(rows.column("doc_id"), buf, s, e, bounds, keep, start, end, p)

    return run


def _rows(doc_id: pa.Array, buf: np.ndarray, s: np.ndarray, e: np.ndarray, bounds: np.ndarray, keep: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Each text's runs, numbered from its first word, and its kept words joined by one space."""
    own = np.searchsorted(bounds, start, side="right") - 1
    at = start - bounds[own]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(bounds) - 1)))).astype(np.int32)
    fields = [pa.array(x) for x in (at, end - start, p)]
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    s, e = s[keep], e[keep]
    size = e - s + 1
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(0, len(s), 1 << 16):  # a block of words at a time: the places of their bytes take 8 bytes each
        part = slice(i, i + (1 << 16))
        to = spread((ends - size)[part], size[part] - 1)
        out[to] = buf[spread(s[part], size[part] - 1)]
    out[ends - 1] = 0x20
    count = np.concatenate(([0], np.cumsum(keep)))[bounds]
    edge = np.concatenate(([0], ends))[count]
    data = out.tobytes()
    kept = [data[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([doc_id, listed, pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, change=None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, runs (start, length, period; by start, then period), collapsed (the kept words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judged(change, least), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs' rows: counts, the longest run (the first, then the shortest period, of several) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("brief"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.brief")).alias("period"),
        F.expr("1000 * best.length div -best.brief").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir):
    return digests(periodic_runs(load(spark, sf_dir, "documents"), change=tampered))


def crc32_sql(digits: str) -> str:
    """DuckDB's integer for the checksum of an ASCII string, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({digits}) + 1), lambda i: [ascii(substr({digits}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {bit}), 4294967295)"


#: Places of equal six words, q apart, in rows of which every run has at least one; rows of neighbours are runs.
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, w, len(w) AS n, {crc32_sql("k")} AS h
  FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, doc_id::VARCHAR AS k FROM documents)),
t AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM d)),
grams AS MATERIALIZED (
  SELECT doc_id, n, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(1, n - 4), lambda j: array_to_string(w[j:j + 5], ' '))) AS k FROM t WHERE n >= {LEAST}),
equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams AS x JOIN grams AS y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
found AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island),
run AS MATERIALIZED (SELECT doc_id, s, e, min(q) AS q FROM found WHERE e - s >= greatest({LEAST}, 2 * q) GROUP BY doc_id, s, e),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run),
word AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS x FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || e - s || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period, 1000 * (e - s) // q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
