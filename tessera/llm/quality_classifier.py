"""Quality by naive Bayes support vectors.

Features say which hashed n-grams a text has. Each is scaled by its class log-count ratio, rows are brought to
length 1, and a linear hinge-loss model is fitted by dual coordinate descent. A fifth of the learning rows
is kept from the fit to turn margins into probabilities. At most SAMPLE labelled rows are learnt from
(the documented bound); every document is scored, in Arrow batches.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from. Labels, lang, source and doc_id are no inputs.

Cases: null and empty texts have no n-grams and score as the intercept says. Null doc_ids are scored, and
held out (their remainder is unknown). Repeated rows keep a row each; extra columns are ignored. Without labels of both
classes every score is 1 or 0, the class there is, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import load, pieces, trimmed
from tessera.llm.ngrams import SIZE, Sample, grams, learning_rows, platt, text_rows

SAMPLE = 4000
COST = 1.0
EPOCHS = 15
THRESHOLD = 0.5


def log_count_ratio(idx: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    pos, neg = np.ones(SIZE), np.ones(SIZE)
    for i, label in zip(idx, y, strict=True):
        (pos if label == 1 else neg)[i] += 1
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def dual_descent(idx: list[np.ndarray], val: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, intercept) of min |w|^2 / 2 + cost * hinge losses; the intercept is a feature of value 1."""
    sign = np.where(y == 1, 1.0, -1.0)
    w, b = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in val])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = sign[i] * (float(w[idx[i]] @ val[i]) + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[idx[i]] += step * val[i]
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


class Model:
    """scale: squared ratios; w: weights times ratios; margin = w over a text's n-grams / length + b."""

    def __init__(self, sample: Sample):
        y = sample.y
        self.fixed = None
        if len(set(y.tolist())) < 2:
            self.fixed = float(y[0]) if len(y) else 0.5
            return
        fit = np.arange(len(y)) % 5 != 0
        if len(set(y[fit].tolist())) < 2:
            fit[:] = True
        idx = [i for i, f in zip(sample.idx, fit, strict=True) if f]
        ratio = log_count_ratio(idx, y[fit])
        val = [ratio[i] / max(1e-9, float(np.sqrt(ratio[i] @ ratio[i]))) for i in idx]
        w, self.b = dual_descent(idx, val, y[fit])
        self.w, self.square = (w * ratio).astype(np.float64), ratio * ratio
        held = ~fit if not fit.all() else fit
        self.a, self.c = platt(np.array([self.margin(i) for i, h in zip(sample.idx, held, strict=True) if h]), y[held])

    def margin(self, idx: np.ndarray) -> float:
        return float(self.w[idx].sum()) / max(1e-9, float(np.sqrt(self.square[idx].sum()))) + self.b

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.fixed is not None:
            return np.full(n, self.fixed)
        (cb, cr), (wb, wr) = grams(buf, off)
        ends = np.arange(n + 1)
        c_at, w_at = np.searchsorted(cr, ends), np.searchsorted(wr, ends)
        seen, out = np.zeros(SIZE, bool), np.empty(n)
        for r in range(n):
            seen[cb[c_at[r] : c_at[r + 1]]] = True
            seen[wb[w_at[r] : w_at[r + 1]]] = True
            idx = np.flatnonzero(seen)
            out[r] = self.margin(idx)
            seen[idx] = False
        return 1 / (1 + np.exp(-np.clip(self.a * out + self.c, -35, 35)))


def scorer(model: Model):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(buf, off) for _, buf, off in pieces(batch, "text")]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(score) if score else np.zeros(0))], [*names, "score"])

    return run


def held_out(divisor: int, remainder: int) -> F.Column:
    found = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder
    return F.coalesce(found, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted."""
    rows = text_rows(docs)
    model = Model(Sample(rows, learning_rows(labels).where(~held_out(3, 1)), sample))
    scored = rows.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, learn: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that score THRESHOLD or more; the model is fitted on labelled rows of learn(doc_id, text)."""
    model = Model(Sample(text_rows(learn), learning_rows(labels).where(~held_out(3, 1)), sample))

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in pieces(batch, "text"):
                yield rows.filter(pa.array(model.score(buf, off) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
