"""Best-fit packing of token sequences by exact complements.

Texts become pieces of at most `capacity` tokens. Only the histogram of lengths, at most `capacity`
counts whatever the corpus, is planned on the driver: for each length, longest first, single lengths, pairs and
triples whose sum is exactly the gap are looked up by their sums and consumed as often as the counts allow;
what finds no complement is packed by best fit. Each plan row is a range of equal sequences, so the plan has
at most a few rows a length. Pieces are numbered within their length by task (counts of each task
and length, summed by a window over tasks), and a piece's number and length give its sequence and offset.

Cases: a null or empty text is the end token alone. Repeated rows and null doc_ids are packed like others;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import TABLE_BYTES, WordBpe, WordTable, spread_rows, vocabulary_path
from tessera.llm.common import cut, load, pieces, trimmed

CAPACITY = 2048
END = 0
#: Pre-tokens that one call of the tokenizer encodes.
_JOINED = 2000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


class LibraryBpe(WordBpe):
    """Pre-tokens are made here, and the tokenizers library merges each new one of a batch once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.normalizer = None  # pre-tokens are normalized, and have no white space
        self._library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def encode_units(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(units), _JOINED):
            ids = np.array(self._library.encode_batch_fast([" ".join(units[i : i + _JOINED])], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out


@functools.lru_cache(1)
def _table(path: str) -> WordTable:
    return WordTable(LibraryBpe(path))


def _cut_texts(path: str, capacity: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, task = _table(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for rows, buf, off in pieces(batch, "text", TABLE_BYTES):
                ids, bounds = table.encode(buf, off)
                ids = np.insert(ids, bounds[1:], END).astype("<u4")
                size = np.diff(bounds) + 1
                many = -(-size // capacity)
                of = np.repeat(np.arange(len(size)), many)
                piece = spread_rows(many, np.zeros(len(many), np.int64))
                start = piece * capacity
                length = np.minimum(capacity, size[of] - start)
                raw, at = memoryview(ids.tobytes()), np.concatenate(([0], np.cumsum(4 * length))).tolist()
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(of))
                # A piece's number is how many of its length the task has had before.
                order = np.argsort(length, kind="stable")
                kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
                number = np.empty(len(of), np.int64)
                number[order] = np.arange(len(of)) - np.repeat(first, count) + np.repeat(seen[kinds], count)
                seen[kinds] += count
                own = [piece.astype(np.int32), start, length, crc, np.full(len(of), task, np.int32), number]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(of)), *map(pa.array, own)], names)

    return run


class _Stock:
    """Counts of lengths, with lookups of one, two or three lengths by their exact sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.count[n] = c
        self.has = self.count > 0

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.count[n] -= times
        self.has[lengths] = self.count[lengths] > 0

    def times(self, lengths: list[int]) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.count[n]) // k for n, k in Counter(lengths).items())

    def pair(self, total: int, most: int) -> list[int] | None:
        """The longest a <= most and b <= a with a + b = total, in stock."""
        low, high = (total + 1) // 2, min(total - 1, most)
        if high < low:
            return None
        both = np.flatnonzero(self.has[low : high + 1] & self.has[total - high : total - low + 1][::-1])
        for a in (low + both[::-1]).tolist():
            if 2 * a != total or self.count[a] > 1:
                return [a, total - a]
        return None

    def complement(self, gap: int) -> list[int] | None:
        if gap <= 0:
            return None
        if self.has[gap]:
            return [gap]
        if found := self.pair(gap, gap):
            return found
        for a in np.flatnonzero(self.has[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                break
            self.count[a] -= 1
            self.has[a] = self.count[a] > 0
            found = self.pair(gap - a, a)
            self.count[a] += 1
            self.has[a] = True
            if found:
                return [a, *found]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences), using each length exactly as often as it occurs."""
    stock, done, left = _Stock(counts, capacity), [], []
    for n in sorted(counts, reverse=True):
        while stock.count[n]:
            stock.take([n], 1)
            found = [] if n == capacity else stock.complement(capacity - n)
            stock.take([n], -1)
            if found is None:
                left.append((n, int(stock.count[n])))
                stock.take([n], int(stock.count[n]))
                break
            k = stock.times([n, *found])
            done.append(([n, *found], k))
            stock.take([n, *found], k)

    # Best fit, longest first, over groups of equally filled sequences.
    open_: list[tuple[int, int]] = []  # (gap, index into groups), ascending
    groups: list[list] = []
    for n, count in left:
        while count:
            at = next((i for i, (gap, _) in enumerate(open_) if gap >= n), None)
            if at is None:
                each = capacity // n
                for held in ([each] if count >= each else []) + ([count % each] if count % each else []):
                    k = count // each if held == each and count >= each else 1
                    groups.append([[n] * held, k])
                    insort(open_, (capacity - n * held, len(groups) - 1))
                break
            gap, g = open_.pop(at)
            lengths, k = groups[g]
            used = min(k, count)
            if used < k:
                groups.append([lengths, k - used])
                insort(open_, (gap, len(groups) - 1))
            groups[g] = [[*lengths, n], used]
            insort(open_, (gap - n, g))
            count -= used
    return done + [(x, k) for x, k in groups]


def _placed(counts: dict[int, int], capacity: int):
    """From the plan: batches with length and rank get sequence_id and offset."""
    rows, used, sequence = [], Counter(), 0
    for lengths, k in plan(counts, capacity):
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += k
            offset += n
        sequence += k
    length, rank, first, offset = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    key = (length << 48) | rank

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (n << 48) | r, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(first[at] + r - rank[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(rows.mapInArrow(_cut_texts(path or vocabulary_path(), capacity), PIECES), "pieces")
    by_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = cut(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")), "counts")
    counts = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The counts grow with the number of tasks: a merge join, of rows of numbers only, whose keys are no larger than a task.
    ranked = found.join(by_task.select("task", "length", "earlier").hint("merge"), ["task", "length"]).withColumn("rank", F.col("earlier") + F.col("number"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(counts, capacity), kinds)


def query(spark, sf_dir):
    return best_fit_packing(load(spark, sf_dir, "documents"))
