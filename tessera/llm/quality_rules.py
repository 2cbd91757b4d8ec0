"""Quality rules: counts with fixed limits, and a calibrated n-gram logistic regression with a fixed threshold.

The regression's features are the shares of hashed byte trigrams and word n-grams among their kind in the
text. It is fitted on at most SAMPLE labelled rows (the documented bound), four fifths for the weights and a fifth to
calibrate probabilities. Every document is counted and scored, in Arrow batches.

Cases: null and empty texts have no words: all counts 0, base_failed, not kept. Null doc_ids and repeated rows
keep a row each. Extra columns are ignored. Without labels of both classes the method keeps whatever passes the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import _WHITE, U64, RangeHash, load, mix, pieces, trimmed, word_hashes, words
from tessera.llm.ngrams import SIZE, Sample, grams, learning_rows, platt, text_rows

SAMPLE = 4000
STEPS = 60
#: Rows of the sample whose n-grams are put together at a time.
BLOCK = 250
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    n = len(off) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[off[1:]] - total[off[:-1]]

    s, e, row = words(buf, off)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": per_text(~_WHITE[buf] & (buf & 0xC0 != 0x80)), "n_symbols": per_text(_SYMBOL[buf])}
    raw, again = buf.tobytes(), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        again.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(again, np.int64)
    covered, k = np.zeros(len(s) + 1, np.int64), REPEAT_WINDOW
    if len(s) >= k:
        at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
        key = mix(RangeHash(word_hashes(buf, s, e)).grams(k)[at] + row[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, same, times = np.unique(key, return_inverse=True, return_counts=True)
        at = at[times[same] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


class Regression:
    """margin = sum of weights over a text's n-grams, each kind averaged, + b; probability by a and c."""

    def __init__(self, sample: Sample):
        self.ready = len(set(sample.y.tolist())) == 2
        if not self.ready:
            return
        y = sample.y
        fit = np.arange(len(y)) % 5 != 0
        if len(set(y[fit].tolist())) < 2:
            fit[:] = True
        held = ~fit if not fit.all() else fit
        blocks = [slice(i, i + BLOCK) for i in range(0, len(y), BLOCK)]

        def entries(block: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row in the block, bucket, share) of a block, made anew each time: the driver holds the sample once."""
            own = sample.idx[block]
            return np.repeat(np.arange(len(own)), [len(i) for i in own]), np.concatenate(own), np.concatenate(sample.share[block])

        # A gram's shares are divided by the root of their mean, so that rare ones weigh more.
        mean = np.zeros(SIZE)
        for block in blocks:
            row, idx, val = entries(block)
            mean += np.bincount(idx, val * fit[block][row], SIZE)
        mean /= fit.sum()
        scale = np.where(mean > 0, 1 / np.sqrt(mean + 1e-6), 0.0)
        w, b, margin = np.zeros(SIZE), 0.0, np.zeros(len(y))
        first, second = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
        for t in range(1, STEPS + 2):
            slope = np.append(1e-5 * w, 0.0)
            for block in blocks:
                row, idx, val = entries(block)
                margin[block] = np.bincount(row, val * (w * scale)[idx], len(y[block])) + b
                error = (1 / (1 + np.exp(-np.clip(margin[block], -35, 35))) - y[block]) * fit[block] / fit.sum()
                slope[:-1] += np.bincount(idx, val * error[row], SIZE) * scale
                slope[-1] += error.sum()
            if t > STEPS:
                break  # margin is that of the last weights
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-5)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w * scale, float(b)
        self.a, self.c = platt(margin[held], y[held])

    def probability(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not self.ready:
            return np.ones(n)
        margin = np.full(n, self.b)
        for bucket, row in grams(buf, off):
            margin += np.bincount(row, self.w[bucket], n) / np.maximum(1, np.bincount(row, minlength=n))
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.c, -35, 35)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _verdict(model: Regression, threshold: float, buf: np.ndarray, off: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, base_failed, probability, kept)"""
    c = counts(buf, off)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    p = model.probability(buf, off)
    return c, failed, p, ~failed & (p >= threshold)


def _judged(model: Regression, threshold: float):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            for rows, buf, off in pieces(batch, "text"):
                c, *verdict = _verdict(model, threshold, buf, off)
                out = [pa.array(c[x].astype(np.int64)) for x in COUNTS] + [pa.array(x) for x in verdict]
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in names), *out], [*names, *COUNTS, "base_failed", "probability", "kept"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, the counts, base_failed, probability (of being good) and kept."""
    rows = text_rows(docs)
    model = Regression(Sample(rows, learning_rows(labels), sample))
    kinds = ", ".join(f"{x} long" for x in ["doc_id", *COUNTS]) + ", base_failed boolean, probability double, kept boolean"
    return rows.mapInArrow(_judged(model, threshold), kinds)


def good_rows(docs: DataFrame, learn: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the rules keep; the regression is fitted on labelled rows of learn(doc_id, text)."""
    model = Regression(Sample(text_rows(learn), learning_rows(labels), sample))

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in pieces(batch, "text"):
                yield rows.filter(pa.array(_verdict(model, threshold, buf, off)[-1]))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    found = quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "probability")
