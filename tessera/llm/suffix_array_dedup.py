"""Removal of repeated byte strings, ordered by linear suffix grouping.

A byte goes if a string of `length` bytes that covers it also starts at any other place, in the same
document too. Strings are judged on the input and never cross documents.

Anchors (anchors.py) route equal strings together with rows of 8-byte hashes, about two per 200 bytes. Equal
contexts are counted before any text moves; one that occurs twice is repeated in all its strings. Where one
anchor has several different contexts, their text goes to the anchor's shard (anchors with very many are taken apart first). There
a suffix array over the contexts' tokens (cut after white space, so that equal strings are cut alike; ranked by their bytes) is built by
`group_order`: suffixes are grouped by Lyndon prefix in descending order with previous-smaller pointers,
then emitted group by group. The order decides: neighbours' common prefixes are measured byte by byte, strings whose rest from their first
token edge on is equal are a range of the order without a shorter common prefix, and in a range those are repeats whose
bytes before that edge are equal too.

Cases: a null text is empty. Null or repeated doc_ids are just documents, and equal rows repeat each
other. Extra columns are ignored. An empty table gives an empty result. `clean` is the kept text as a string: a
character of which only some bytes repeat is kept whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.anchors import CROWD, FIRST_BITS, contexts, mapped_back, pack, uncrowded, unpack
from tessera.llm.common import U64, cut, gathered, load, marked, pieces, trimmed, wanted

LENGTH = 400
ANCHOR = 200
#: Bytes of one suffix array's contexts, beyond which the next anchor starts another.
SHARD_BYTES = 400_000


def group_order(text: list[int]) -> list[int]:
    """The suffix array of ranks; the last is the only 0.

    First suffixes are grouped by their Lyndon prefix. Groups are taken in descending order, when all
    higher ones are complete: each member's previous smaller suffix is found along pointers over complete
    groups, and gets this group's prefix appended, which moves it to a new group just above its own.
    Then the order within groups follows in one pass: when a suffix is emitted, those whose Lyndon prefix
    ends right before it take the next places of their groups.
    """
    n = len(text)
    symbols = max(text) + 1
    members: list[list[int]] = [[] for _ in range(symbols)]
    for i, x in enumerate(text):
        members[x].append(i)
    group = list(text)
    below = list(range(-1, symbols - 1))
    above = [*range(1, symbols), -1]
    complete = [False] * symbols
    smaller = [-1] * n
    finished: list[tuple[int, int]] = []
    g = symbols - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        complete[g] = True
        finished.append((g, len(own)))
        extended: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and complete[group[p]]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        if extended:
            by_times: list[list[int]] = [[] for _ in range(max(extended.values()) + 1)]  # at most a list for each member
            for p, times in extended.items():
                by_times[times].append(p)
            for some in reversed(by_times):
                moved: dict[int, list[int]] = {}
                for p in some:
                    moved.setdefault(group[p], []).append(p)
                for old, those in moved.items():
                    new = len(members)
                    members.append(those)
                    complete.append(False)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                    for p in those:
                        group[p] = new
        g = below[g]

    place = [0] * len(members)
    at = 0
    for g, size in reversed(finished):
        place[g] = at
        at += size
    order, emitted = [0] * n, [False] * n
    order[0], emitted[n - 1] = n - 1, True
    for i in range(n):
        p = order[i] - 1
        while p >= 0 and not emitted[p]:
            emitted[p] = True
            g = group[p]
            order[place[g]] = p
            place[g] += 1
            p = smaller[p]
    return order


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def common_prefixes(symbols: np.ndarray, places: np.ndarray, most: int, rows: int = 4096) -> np.ndarray:
    """Of the strings at successive places: the length, `most` at most, of the common prefix with the one before; 0 for the first."""
    padded, out = np.append(symbols, np.zeros(most, symbols.dtype)), np.zeros(len(places), np.int64)
    for i in range(1, len(places), rows):
        own = padded[places[i - 1 : i + rows, None] + np.arange(most)]
        unlike = own[1:] != own[:-1]
        out[i : i + rows] = np.where(unlike.any(1), unlike.argmax(1), most)
    return out


def least_between(alike: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The common prefix of the strings at successive places of the order."""
    return np.minimum.reduceat(alike[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else np.zeros(0, np.int64)


def repeated_windows(shard: list[tuple[int, bytes, bytes, int]]) -> list[np.ndarray]:
    """For contexts (anchor, bytes before it, bytes after it, symbols of a window, the anchor being one): which windows another
    context has."""
    data = np.frombuffer(b"".join(x for _, lead, tail, _ in shard for x in (lead, b"\0", tail, b"\0")), np.uint8)
    lead = np.array([len(x[1]) for x in shard])
    size = lead + np.array([len(x[2]) for x in shard]) + 2
    begin = np.cumsum(size) - size
    anchor, stop = begin + lead, begin + size - 1
    # Bytes are 1 to 256, an anchor has a number of its own above, the end of a context is 0.
    symbols = data.astype(np.uint32) + np.uint32(1)
    symbols[anchor] = 257 + np.unique(np.array([x[0] for x in shard], np.int64), return_inverse=True)[1]
    symbols[stop] = 0
    edge = np.zeros(len(data), bool)
    edge[1:] = _SPACE[data[:-1]]
    edge[begin] = edge[anchor] = edge[anchor + 1] = edge[stop] = True
    s = np.flatnonzero(edge)
    # Tokens rank by their bytes, so that those with a common beginning are neighbours; the end comes first, anchors last.
    raw = data.tobytes()
    names = [b"\1" + raw[x:y] for x, y in zip(s.tolist(), [*s[1:].tolist(), len(data)], strict=True)]
    for i, x in zip(np.searchsorted(s, anchor).tolist(), symbols[anchor].tolist(), strict=True):
        names[i] = b"\2" + x.to_bytes(4, "big")
    for i in np.searchsorted(s, stop).tolist():
        names[i] = b"\0"
    rank = {x: i for i, x in enumerate(sorted(set(names)), 1)}
    order = np.array(group_order([*(rank[x] for x in names), 0]))[1:]

    of = np.searchsorted(begin, s, side="right") - 1
    # A window is known by the first token edge after its start and the bytes up to that edge (`part`).
    before = np.empty(len(s), np.int64)  # bytes of the token before; 0 at a context's start
    before[1:] = s[1:] - s[:-1]
    before[np.isin(s, begin)] = 0
    order = order[(s[order] <= anchor[of[order]] + 1) & (before[order] > 0)]
    window = np.array([x[3] for x in shard])
    counts = size - 1 - window + 1
    found = np.zeros(len(data), bool)
    if not len(order):
        return [found[b : b + n] for b, n in zip(begin, counts, strict=True)]
    alike = common_prefixes(symbols, s[order], int(window.max()))
    part, left = 1, np.zeros(len(order), np.int64)
    while len(order):
        p, own = s[order], of[order]
        left = np.unique(left * (1 << 32) + symbols[p - part], return_inverse=True)[1]  # numbers the `part` bytes before
        whole = p - part - begin[own] < counts[own]
        for w in np.unique(window):
            at = np.flatnonzero(whole & (window[own] == w))
            if len(at) > 1:  # ranges of the order whose common prefixes reach the ends of the windows
                run = np.cumsum(np.append(True, least_between(alike, at) < w - part))
                _, same, times = np.unique(run * (int(left.max()) + 1) + left[at], return_inverse=True, return_counts=True)
                found[p[at[times[same] > 1]] - part] = True
        part += 1
        at = np.flatnonzero(before[order] >= part)
        alike = np.append(0, least_between(alike, at))
        order, left = order[at], left[at]
    return [found[b : b + n] for b, n in zip(begin, counts, strict=True)]


def _anchor_rows(length: int, k: int):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, buf, off in pieces(batch, "text"):
                key = rows.column("key").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rows.num_rows), np.diff(off))
                for a, c, r, first, count, anchor in contexts(buf.astype(U64) + U64(1), row, length, k):
                    out.append([a, c, key[r], pack(first - off[r], count, anchor - off[r])])
            yield from gathered(out, ["a", "c", "key", "place"])

    return run


def _context_bytes(length: int, k: int):
    names = ["a", "c", "value", "lead", "tail", "window"]

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text, reps in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "reps")), strict=True):
                if key in had:  # equal rows have one key, so one task: their contexts are counted in n
                    continue
                had.add(key)
                b = text.encode()
                for rep in reps:
                    first, count, anchor = unpack(rep["place"])
                    for to, x in zip(out, (rep["a"], rep["c"], rep["n"], b[first:anchor], b[anchor + k : first + count - 1 + length], length - k + 1), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)

    return run


def _judge_shards(limit: int = SHARD_BYTES):
    """Batches sorted by a to runs (a, c, start, n) of repeated windows: all of a context that occurs more than once (value)."""

    def judge(shard: list[tuple]) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        for (a, c, value, *_), found in zip(shard, repeated_windows([(x[0], x[3], x[4], x[5]) for x in shard]), strict=True):
            if value > 1:
                found[:] = True
            if found.any():
                turn = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
                for start, stop in turn.reshape(-1, 2).tolist():
                    for to, x in zip(out, (a, c, start, stop - start), strict=True):
                        to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "c", "start", "n"])

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, current, own = [], 0, None, set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "c", "value", "lead", "tail", "window")), strict=True):
                if row[0] != current:
                    current = row[0]
                    own = set()
                    if size >= limit:
                        yield judge(shard)
                        shard, size = [], 0
                if row[1] not in own:  # a row of docs that comes twice has its contexts twice
                    own.add(row[1])
                    shard.append(row)
                    size += len(row[3]) + len(row[4])
        if shard:
            yield judge(shard)

    return run


def _merged(spans: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs of packed window runs."""
    out: list[list[int]] = []
    for start, n in sorted((x >> 9, x & 511) for x in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n + length - 1)
        else:
            out.append([start, start + n + length - 1])
    return [(a, b) for a, b in out]


def _kept(length: int, clean: bool):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                b = (text or "").encode()
                gone = _merged(spans or [], length)
                cols[0].append(len(b))
                cols[1].append(sum(y - x for x, y in gone))
                cols[2].append(len(gone))
                at, kept = 0, []
                for x, y in gone:
                    if clean:  # whole characters
                        while x < y and b[x] & 0xC0 == 0x80:
                            x += 1
                        while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
                            y -= 1
                    kept.append(b[at:x])
                    at = y
                kept.append(b[at:])
                cols[3].append(b"".join(kept).decode() if clean else b"".join(kept))
            arrays = [pa.array(x, pa.int64()) for x in cols[:3]] + [pa.array(cols[3], pa.string() if clean else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, clean: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): row (its other columns), n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (bytes, or with `clean` a string of whole characters)."""
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns if c != "text"))
    texts = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    found = texts.select("key", "text").mapInArrow(_anchor_rows(length, k), "a long, c long, key long, place long")
    anchors = cut(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors")
    shared = cut(found.join(anchors, "a"), "shared")
    equal = shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("m"))
    equal = cut(equal, "equal")
    mixed = cut(equal.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    schema = "a long, c long, value long, lead binary, tail binary, window int"

    def contexts_of(anchors: DataFrame, texts: DataFrame) -> DataFrame:
        reps = equal.join(anchors.select("a"), "a").groupBy("m.key").agg(F.collect_list(F.struct("a", "c", "n", "m.place")).alias("reps"))
        return texts.join(reps, "key").select("row", "text", "key", "reps").mapInArrow(_context_bytes(length, k), schema)

    def judged_of(kinds: DataFrame) -> DataFrame:
        return kinds.repartition("a").sortWithinPartitions("a").mapInArrow(_judge_shards(), "a long, c long, start long, n long")

    crowded = mixed.where(F.col("kinds") > CROWD)
    if crowded.limit(1).count():
        hot = equal.join(crowded.select("a"), "a").select("m.key")
        apart, maps = uncrowded(cut(contexts_of(crowded, wanted(texts, marked(hot, "key"), "key")), "kinds"), F.sum("value"), words=False)
        judged = judged_of(contexts_of(mixed.where(F.col("kinds") <= CROWD), texts)).unionByName(mapped_back(judged_of(apart), maps))
    else:
        judged = judged_of(contexts_of(mixed, texts))
    whole = equal.where("n > 1").join(mixed.select("a"), "a", "left_anti").select("a", "c", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("n"))
    first = F.col("place").bitwiseAND(F.lit((1 << FIRST_BITS) - 1)) + F.col("start")
    windows = F.when(F.col("n") < 0, F.shiftright("place", FIRST_BITS).bitwiseAND(F.lit(255)) + 1).otherwise(F.col("n"))
    spans = shared.join(judged.union(whole), ["a", "c"]).groupBy("key").agg(F.collect_set(F.shiftleft(first, 9).bitwiseOR(windows)).alias("spans"))
    kept = T.StructType([texts.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if clean else T.BinaryType())])
    return texts.join(spans, "key", "left").select("row", "text", "key", "spans").mapInArrow(_kept(length, clean), kept)


def clean_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with their columns; the text without repeated strings of `length` bytes, and n_chars, if there is one, to match.
    A null text stays null."""
    mark = next(x for x in (f"null_text{i or ''}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    found = suffix_array_dedup(docs.withColumn(mark, F.col("text").isNull()), length, length // 2, clean=True)
    values = {"text": F.when(~F.col(f"row.{mark}"), F.col("kept")), "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long")}
    return found.select(*((values[c] if c in values else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


#: Strings are compared by their MD5 sums; removed runs are the islands of the strings' starts.
SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (
  SELECT doc_id, unnest(range(1, n - {LENGTH} + 2)) AS i,
         unnest(list_transform(range(1, n - {LENGTH} + 2), lambda x: md5_number(array_slice(bytes, x, x + {LENGTH} - 1)))) AS k FROM w),
hits AS (SELECT doc_id, i FROM strings SEMI JOIN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {LENGTH} - 1 AS b FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hits))
  GROUP BY doc_id, run),
edges AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a + 1) AS gone FROM runs GROUP BY doc_id)
SELECT w.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(len(a), 0) AS n_spans,
       CASE WHEN a IS NULL THEN sha256(bytes) ELSE sha256(unhex(array_to_string(list_transform(range(0, len(a) + 1),
         lambda j: hex(array_slice(bytes, CASE WHEN j = 0 THEN 1 ELSE b[j] + 1 END, CASE WHEN j = len(a) THEN n ELSE a[j + 1] - 1 END))), ''))) END AS kept_sha256
FROM w LEFT JOIN edges ON w.doc_id = edges.doc_id
"""


def query(spark, sf_dir):
    return suffix_array_dedup(load(spark, sf_dir, "documents")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
