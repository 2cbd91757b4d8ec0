"""Hashed n-grams of whole texts, learning samples, and Platt's calibration: shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, mix, pieces, widened, word_hashes, words

BITS = 16
#: Buckets: byte trigrams, then words and pairs of unlike words, then runs of one word, 2 to 9 times.
CHARS, WORDS, RUNS, LONGEST_RUN = 0, 1 << BITS, 2 << BITS, 9
SIZE = RUNS + LONGEST_RUN - 1


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((buckets, rows) of byte trigrams, (buckets, rows) of word n-grams), rows ascending in each."""
    if len(buf) >= 3:
        b = buf.astype(np.uint32)
        h = ((b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        inside = row[2:] == row[:-2]
        chars = h[inside].astype(np.int64), row[:-2][inside]
    else:
        chars = np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e, row = words(buf, off)
    h = word_hashes(buf, s, e)
    near = row[1:] == row[:-1]
    same = near & (h[1:] == h[:-1])
    place = np.arange(len(same))
    run = place - np.maximum.accumulate(np.where(same, -1, place)) if len(same) else place
    pair = WORDS + (mix(h[1:] * U64(3) ^ h[:-1]) >> U64(64 - BITS)).astype(np.int64)
    pair[same] = RUNS + np.minimum(run[same], LONGEST_RUN - 1) - 1
    bucket = np.concatenate((WORDS + (h >> U64(64 - BITS)).astype(np.int64), pair[near]))
    rows = np.concatenate((row, row[1:][near]))
    order = np.argsort(rows, kind="stable")
    return chars, (bucket[order], rows[order])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, y, text) to (doc_id, y, buckets, share of its kind of gram)."""
    for batch in batches:
        ids, shares = [], []
        for rows, buf, off in pieces(batch, "text"):
            kinds = grams(buf, off)
            for r in range(rows.num_rows):
                idx, val = [], []
                for bucket, row in kinds:
                    own = bucket[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")]
                    i, n = np.unique(own, return_counts=True)
                    idx.append(i)
                    val.append(n / max(1, len(own)))
                ids.append(np.concatenate(idx).astype("<i4").tobytes())
                shares.append(np.concatenate(val).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "y", "idx", "share"])


class Sample:
    """Learning rows on the driver: buckets and shares in row order."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: int):
        """The `rows` labelled documents that come first by a hash of their id. A doc_id with several labels
        counts as the lowest, one with several texts as that of the least hash, so that `rows` is the most the driver gets;
        null labels, and labels without a document, don't count."""
        labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
        chosen = labels.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m"))  # `rows` ids at most
        texts = widened(texts.select("doc_id", "y", "m.text"))
        found = sorted(tuple(r) for r in texts.mapInArrow(_counted, "doc_id long, y int, idx binary, share binary").collect())
        self.y = np.array([r[1] for r in found], np.int64)
        self.idx = [np.frombuffer(r[2], "<i4") for r in found]
        self.share = [np.frombuffer(r[3], "<f4") for r in found]


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def learning_rows(labels: DataFrame, column: str = "quality") -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null")


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a > 0 and b of P(y = 1) = 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    middle = (margin[y == 1].mean() + margin[y == 0].mean()) / 2
    spread = max(1e-9, float(margin[y == 1].mean() - margin[y == 0].mean()) / 2)
    x = np.stack([(margin - middle) / spread, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-2 * np.eye(2), x @ (p - target) + 1e-2 * (w - [1, 0]))
        step *= min(1.0, 1.0 / max(1e-9, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    a = max(float(w[0]), 1e-2) / spread
    return a, float(w[1]) - a * float(middle)
