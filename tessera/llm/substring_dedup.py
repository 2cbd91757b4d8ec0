"""Removal of repeated word passages by suffix automata of reference shards.

A window is `length` successive words of one document. A word goes if a window that covers it also starts
in a document with a smaller doc_id. Windows are judged on the input.

How it scales. Anchors (anchors.py) route equal windows to one place: only rows of 8-byte hashes are
shuffled for the whole corpus, about two per 27 words. Contexts whose anchor no second document has
go no further. Equal contexts are aggregated to the smallest doc_id before any text moves. What is
left, the distinct contexts of each shared anchor, is the reference: it is sharded by anchor, each shard
gets suffix automata of bounded size (the bounded form of "broadcast": an automaton stays in the task that
streams its shard), and every distinct context is streamed through for the smallest doc_id of each window. Anchors with very many different
contexts are taken apart first, so that no task gets more than CROWD contexts of one anchor.

Cases: null or empty texts have no words. Rows with a null doc_id have no order: they are kept whole
and are no reference. Rows are known by a 64-bit hash of doc_id and text: rows that repeat a doc_id are judged one by one, neither
has the smaller id, and rows equal in both get the same result.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import CROWD, FIRST_BITS, contexts, mapped_back, pack, uncrowded, unpack
from tessera.llm.common import as_long, cut, gathered, marked, pieces, trimmed, wanted, word_hashes, words

WINDOW = 50
ANCHOR = 25
#: Symbols of one automaton, beyond which the next anchor starts another.
SHARD_SYMBOLS = 60_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key that tells rows apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def anchor_rows(length: int, k: int):
    """Batches of (doc_id, text, key) to batches of (a, c, doc_id, key, place)."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, buf, off in pieces(batch, "text"):
                s, e, row = words(buf, off)
                ids, key = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
                begin = np.searchsorted(row, np.arange(rows.num_rows))
                for a, c, r, first, count, anchor in contexts(word_hashes(buf, s, e), row, length, k):
                    out.append([a, c, ids[r], key[r], pack(first - begin[r], count, anchor - begin[r])])
            yield from gathered(out, ["a", "c", "doc_id", "key", "place"])

    return run


class SuffixAutomaton:
    """Of several sequences, added in ascending order of owner; each state has its strings' smallest owner."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.owner = [-1]

    def _clone(self, p: int, q: int, symbol: int) -> int:
        step, link = self.step, self.link
        clone = len(step)
        step.append(step[q].copy())
        link.append(link[q])
        self.len.append(self.len[p] + 1)
        self.owner.append(self.owner[q])
        link[q] = clone
        while p >= 0 and step[p].get(symbol) == q:
            step[p][symbol] = clone
            p = link[p]
        return clone

    def add(self, symbols: Iterable[int], owner: int) -> None:
        step, link, length, owners = self.step, self.link, self.len, self.owner
        last = 0
        for symbol in symbols:
            q = step[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, symbol)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            owners.append(owner)
            link.append(0)
            p = last
            while p >= 0 and symbol not in step[p]:
                step[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = step[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            last = new

    def owners(self, symbols: list[int], window: int) -> list[int | None]:
        """Matching statistics of a stream, held at `window` symbols: for each window the smallest owner
        of a sequence that contains it, or None."""
        step, link, length, owner = self.step, self.link, self.len, self.owner
        state, matched, out = 0, 0, []
        for i, symbol in enumerate(symbols):
            while state and symbol not in step[state]:
                state = link[state]
                matched = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                matched += 1
            while matched >= window and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(owner[state] if matched >= window else None)
        return out


def runs(values: list) -> Iterator[tuple[int, int, object]]:
    """(start, length, value) of maximal runs."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i - start, values[start]
            start = i


def _judge(shard: list[tuple]) -> list[tuple]:
    """Rows (a, c, doc_id, lead, tail, window) of whole anchors, by ascending doc_id in each anchor, to runs
    (a, c, first window, windows, smallest doc_id)."""
    ids: dict = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in (*left.split(), a, *right.split())] for a, _, _, left, right, _ in shard]
    automaton = SuffixAutomaton()
    for symbols, row in zip(sequences, shard, strict=True):
        automaton.add(symbols, row[2])
    return [(row[0], row[1], start, n, owner) for symbols, row in zip(sequences, shard, strict=True) for start, n, owner in runs(automaton.owners(symbols, row[5]))]


def judge_shards(limit: int = SHARD_SYMBOLS):
    """Batches sorted by (a, value), value being the doc_id, to runs; whole anchors are gathered up to `limit` symbols."""
    names = ["a", "c", "start", "n", "owner"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, current, own = [], 0, None, set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "c", "value", "lead", "tail", "window")), strict=True):
                if row[0] != current:
                    current = row[0]
                    own = set()
                    if size >= limit:
                        yield batch_of(_judge(shard))
                        shard, size = [], 0
                if row[1] not in own:  # a row of docs that comes twice has its contexts twice
                    own.add(row[1])
                    shard.append(row)
                    size += 1 + row[3].count(b" ") + row[4].count(b" ")
        if shard:
            yield batch_of(_judge(shard))

    return run


def _context_words(length: int, k: int):
    """Batches of (key, text, reps) to one row for each context: its words beside the anchor. Equal rows have one key, so one task, and count once."""
    names = ["a", "c", "value", "lead", "tail", "window"]

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, doc_id, text, reps in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text", "reps")), strict=True):
                if key in had:
                    continue
                had.add(key)
                w = text.encode().split()
                for rep in reps:
                    first, count, anchor = unpack(rep["place"])
                    for to, x in zip(out, (rep["a"], rep["c"], doc_id, b" ".join(w[first:anchor]), b" ".join(w[anchor + k : first + count - 1 + length]), length - k + 1), strict=True):
                        to.append(x)
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)

    return run


def _kept(length: int):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                w = text.encode().split() if text else []
                kept, at = w, 0
                if spans:
                    kept = []
                    for start, n in sorted((x >> 8, x & 255) for x in spans):
                        kept += w[at:start]
                        at = max(at, start + n + length - 1)
                    kept += w[at:]
                n_words.append(len(w))
                n_removed.append(len(w) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, length: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    texts = keyed(docs)
    found = texts.where("doc_id is not null").mapInArrow(anchor_rows(length, k), "a long, c long, doc_id long, key long, place long")
    anchors = cut(found.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a"), "anchors")
    shared = cut(found.join(anchors, "a"), "shared")
    equal = cut(shared.groupBy("a", "c").agg(F.min(F.struct("doc_id", "key", "place")).alias("m")), "equal")
    schema = "a long, c long, value long, lead binary, tail binary, window int"

    def contexts_of(those: DataFrame, texts: DataFrame) -> DataFrame:
        reps = those.groupBy("m.key").agg(F.collect_list(F.struct("a", "c", "m.place")).alias("reps"))
        return texts.join(reps, "key").select("doc_id", "text", "key", "reps").mapInArrow(_context_words(length, k), schema)

    def judged_of(kinds: DataFrame) -> DataFrame:
        return kinds.repartition("a").sortWithinPartitions("a", "value").mapInArrow(judge_shards(), "a long, c long, start long, n long, owner long")

    crowded = cut(equal.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("a"), "crowded")
    if crowded.limit(1).count():
        hot = cut(equal.join(crowded, "a"), "hot")
        apart, maps = uncrowded(cut(contexts_of(hot, wanted(texts, marked(hot.select("m.key"), "key"), "key")), "kinds"), F.min("value"), words=True)
        judged = judged_of(contexts_of(equal.join(crowded, "a", "left_anti"), texts)).unionByName(mapped_back(judged_of(apart), maps))
    else:
        judged = judged_of(contexts_of(equal, texts))
    spans = shared.join(judged, ["a", "c"]).where("owner < doc_id")
    first = F.col("place").bitwiseAND(F.lit((1 << FIRST_BITS) - 1)) + F.col("start")
    spans = spans.groupBy("key").agg(F.collect_set(F.shiftleft(first, 8).bitwiseOR(F.col("n"))).alias("spans"))
    return texts.join(spans, "key", "left").select("doc_id", "text", "key", "spans").mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept string")


#: Windows are compared as strings; runs of removed words are the islands of the windows' starts.
SQL = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - {WINDOW} + 2)) AS i,
         unnest(list_transform(range(1, len(words) - {WINDOW} + 2), lambda x: array_to_string(words[x:x + {WINDOW} - 1], ' '))) AS k FROM w),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM windows) WHERE lo < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {WINDOW} - 1 AS b FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hits))
  GROUP BY doc_id, run),
edges AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, words, CASE WHEN a IS NULL THEN words ELSE flatten(list_transform(range(0, len(a) + 1),
         lambda j: words[CASE WHEN j = 0 THEN 1 ELSE b[j] + 1 END:CASE WHEN j = len(a) THEN len(words) ELSE a[j + 1] - 1 END])) END AS left_over
  FROM w LEFT JOIN edges ON w.doc_id = edges.doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - len(left_over) AS n_removed, sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256
FROM kept
"""


def query(spark, sf_dir):
    from tessera.llm.common import load

    return substring_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["SuffixAutomaton", "as_long", "query", "substring_dedup"]
