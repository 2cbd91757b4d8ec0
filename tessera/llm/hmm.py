"""Sequence likelihood under a hidden Markov language model.

Tokens fall into classes: the most frequent words have one each, other words share one by shape (length,
ending, ASCII or not), and the end of a text has its own. Latent states emit classes; a word's share of its class is
its add-one count there, with one more place for the unseen, so the model spreads exactly 1 over all texts. States are trained
by Baum-Welch: each task sums expected counts over its whole sequences, and tasks' sums are added by a shuffle. The forward vectors
of a batch are kept at every BLOCK-th token only and made again block by block on the way back, so memory is bounded though no
sequence is cut. Every training document is used in every round. Rounds end when the log10 likelihood
per token rises by less than TOLERANCE, ROUNDS at most. They start from states that already differ: pairs of neighbouring
classes, counted over all training texts, are split into states on the driver (Hmm.of_pairs). The likelihood of a
whole text is the scaled forward recursion, exact, over all texts of a batch at once.

Word counts over the whole training corpus are shuffled as (64-bit key, count), combined in each task first.
At most TABLE words, those over a count found from a histogram of counts, go to the tasks; rarer words
of a text are looked up by a join, a row for each occurrence, which no frequent word can make uneven.
A key holds 58 bits of the word's hash and 6 of its shape.

Training rows are those whose crc32(doc_id as text) mod 7 is not 2. Cases: null and empty texts are the end token alone. Null
doc_ids are scored and held out. Repeated rows count as often as they come; extra columns are ignored. With no training
rows all counts are 0 and states stay as they start.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, as_long, cut, load, pieces, trimmed, utf8, word_hashes, words
from tessera.llm.quality_classifier import held_out

STATES = 6
ROUNDS = 14
TOLERANCE = 1e-3
#: Tokens between the forward vectors that are kept.
BLOCK = 32
TABLE = 200_000
#: Classes: shapes first, then single words, then the end.
SHAPES, SINGLE = 64, 190
END = SHAPES + SINGLE
CLASSES = END + 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
#: Bytes of a word up to which a length class reaches.
_LENGTHS = np.array([1, 2, 3, 5, 8])


def keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the lower-cased words."""
    buf = _LOWER[buf]
    s, e, row = words(buf, off)
    last = buf[e - 1]
    ending = np.where(last == ord("."), 1, np.where(last == ord(","), 2, np.where(_LETTER[last], 0, 3)))
    high = np.concatenate(([0], np.cumsum(buf >= 128)))
    shape = (np.searchsorted(_LENGTHS, e - s) * 4 + ending) * 2 + (high[e] > high[s])
    return ((word_hashes(buf, s, e) << U64(6)) | shape.astype(U64)).view(np.int64), row


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def combined() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([as_long(key), as_long(n.astype(np.int64))], ["key", "n"])

    for batch in batches:
        for _, buf, off in pieces(batch, "text"):
            held.append(keys(buf, off)[0])
            if sum(map(len, held)) > 2_000_000:
                yield combined()
    if held:
        yield combined()


class Vocabulary:
    """What tasks need of the counts: the frequent words' keys (sorted), counts and classes, and each class's total."""

    def __init__(self, counts: DataFrame, texts: int, table: int):
        total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        self.tokens, self.types = total[1] + texts, total[0] + (texts > 0)
        size = F.floor(F.log2("c") * 16).cast("int")
        histogram = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("size")).agg(F.count("*")).collect()), reverse=True)
        least, room = None, table
        for s, n in histogram:
            if n > room:
                break
            least, room = s, room - n
        top = counts.where(size >= least).collect() if least is not None else []
        top.sort()
        self.key = np.array([r[0] for r in top], np.int64)
        self.count = np.array([r[1] for r in top], np.int64)
        self.cls = (self.key & 63).astype(np.uint8)
        single = np.lexsort((self.key, -self.count))[:SINGLE]
        weight = np.zeros(CLASSES)
        for r in counts.groupBy(F.col("key").bitwiseAND(F.lit(63)).alias("shape")).agg(F.sum(F.col("c") + 1)).collect():
            weight[r[0]] = r[1]
        np.subtract.at(weight, self.cls[single], self.count[single] + 1)
        weight[:SHAPES] += 1
        self.cls[single] = SHAPES + np.arange(len(single))
        weight[SHAPES : SHAPES + len(single)] = self.count[single] + 1
        self.end = texts
        weight[END] = texts + 1
        self.weight = np.log10(np.maximum(weight, 1))


def _encoded(v: Vocabulary):
    """Batches of (doc_id, held_out, text) to rows with the class sequence and the sums over frequent words;
    `rare` has the keys of the other words, an entry for each occurrence."""
    logs = np.log10(v.count + 1.0)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for rows, buf, off in pieces(batch, "text"):
                key, row = keys(buf, off)
                n = rows.num_rows
                at = np.minimum(np.searchsorted(v.key, key), max(0, len(v.key) - 1))
                known = v.key[at] == key if len(v.key) else np.zeros(len(key), bool)
                cls = (key & 63).astype(np.uint8)
                cls[known] = v.cls[at[known]]
                size = np.bincount(row, minlength=n)
                ends = np.cumsum(size)
                seq = np.insert(cls, ends, END).tobytes()
                stop = (ends + np.arange(1, n + 1)).tolist()
                rare, r_end = key[~known], np.cumsum(np.bincount(row[~known], minlength=n)).tolist()
                cols[0] += range(number, number + n)
                number += n
                cols[1] += (size + 1).tolist()
                cols[2] += (np.bincount(row[known], minlength=n) + (v.end > 0)).tolist()
                cols[3] += (np.bincount(row[known], logs[at[known]], n) + math.log10(v.end + 1)).tolist()
                cols[4] += [seq[a:b] for a, b in zip([0, *stop], stop, strict=False)]
                cols[5] += [rare[a:b] for a, b in zip([0, *r_end], r_end, strict=False)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["doc_id", "held_out", "row", "n_tokens", "known", "logs", "classes", "rare"])

    return run


class Hmm:
    def __init__(self, first: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.first, self.step, self.emit = first, step, emit

    @classmethod
    def start(cls, states: int = STATES) -> Hmm:
        rng = np.random.default_rng(11)
        rows = [rng.uniform(0.5, 1.5, size) for size in ((states,), (states, states), (states, CLASSES))]
        return cls(*(x / x.sum(-1, keepdims=True) for x in rows))

    @classmethod
    def of_pairs(cls, pairs: np.ndarray, states: int = STATES) -> Hmm:
        """pairs[a, b]: how often class b follows a (the end precedes a text's first). P(b | a) is split into
        P(state | a) P(b | state) by expectation maximisation; a state's next is that of the classes it emits."""
        model = cls.start(states)
        rng = np.random.default_rng(12)
        emit, after = rng.dirichlet(np.ones(CLASSES), states), rng.dirichlet(np.ones(states), CLASSES)
        last = -math.inf
        for _ in range(2000):
            p = np.maximum(after @ emit, 1e-300)
            now = float((pairs * np.log(p)).sum()) / max(1.0, pairs.sum())
            if not pairs.any() or now - last < 1e-8:
                break
            last, ratio = now, pairs / p
            after, emit = after * (ratio @ emit.T) + 1e-6, emit * (after.T @ ratio) + 1e-6
            after, emit = after / after.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
        if not pairs.any():
            return model
        emitted = emit * (after.T @ (pairs / np.maximum(after @ emit, 1e-300)))
        step = (emit @ after) * emitted.sum(1)[:, None]
        return cls.of_counts(np.concatenate((after[END] * pairs[END].sum(), step.ravel(), emitted.ravel())), states)

    @classmethod
    def of_counts(cls, flat: np.ndarray, states: int) -> Hmm:
        first, step, emit = flat[:states], flat[states : states + states * states].reshape(states, states), flat[states + states * states :].reshape(states, CLASSES)
        return cls(*((x + 0.1) / (x + 0.1).sum(-1, keepdims=True) for x in (first, step, emit)))

    def counted(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, float]:
        """Baum-Welch counts (first, step, emit, flat) of the class sequences flat[off[i]:off[i + 1]], none of them empty, and their log10 likelihood."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        at, size = off[:-1][order], size[order]
        k, steps = len(self.first), int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), side="left").tolist()
        # Vectors are columns, so that the long rows are of one state each; single precision, sums in double.
        first, back, table = (x.astype(np.float32) for x in (self.first, self.step, self.emit))
        onward = np.ascontiguousarray(back.T)

        def forward(before: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(classes, scaled vectors, scales) at place t."""
            m = live[t]
            seen = flat[at[:m] + t]
            a = table.take(seen, 1)
            a *= first[:, None] if before is None else onward @ before[:, :m]
            z = a.sum(0)
            a /= z
            return seen, a, z

        kept, a, log = [], None, 0.0
        for t in range(steps):
            if t % BLOCK == 0:
                kept.append(a)
            _, a, z = forward(a, t)
            log += float(np.log10(z).sum(dtype=np.float64))
        behind, pairs, emitted = np.ones((k, len(size)), np.float32), np.zeros((k, k)), np.zeros((k, CLASSES))
        while kept:
            start = len(kept) * BLOCK - BLOCK
            held, made, after = [kept.pop()], [], []
            for t in range(start, min(steps, start + BLOCK)):
                made.append(forward(held[-1], t))
                held.append(made[-1][1])
            for t in range(start + len(made) - 1, start - 1, -1):
                seen, a, z = made[t - start]
                m = live[t]
                after.append(a * behind[:, :m])
                if t:
                    b = table.take(seen, 1)
                    b *= behind[:, :m]
                    b /= z
                    pairs += held[t - start][:, :m] @ b.T
                    behind[:, :m] = back @ b
            classes, all_after = np.concatenate([x[0] for x in reversed(made)]), np.concatenate(after, 1)
            emitted += np.stack([np.bincount(classes, x, CLASSES) for x in all_after])
        return np.concatenate((after[-1].sum(1, dtype=np.float64), (pairs * self.step).ravel(), emitted.ravel())), log

    def log10(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each class sequence flat[off[i]:off[i + 1]] by the scaled forward recursion."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        at, size = off[:-1][order], size[order]
        steps = int(size[0]) if len(size) else 0
        onward = np.ascontiguousarray(self.step.T)
        live = np.searchsorted(-size, -np.arange(steps), side="left").tolist()
        total, a = np.zeros(len(size)), None
        for t, m in enumerate(live):
            before = self.first[:, None] if a is None else onward @ a[:, :m]
            a = self.emit.take(flat[at[:m] + t], 1)
            a *= before
            z = a.sum(0)
            a /= z
            total[:m] += np.log10(z)
        out = np.empty(len(size))
        out[order] = total
        return out


def _expected(model: Hmm):
    """Batches of (classes) to one (place, value) for each expected count of the task; then come the log10 likelihood and the tokens."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            flat, off = utf8(batch.column("classes"))
            if len(flat):
                found, log = model.counted(flat, off[np.append(True, off[1:] > off[:-1])])
                total = total + np.concatenate((found, [log, len(flat)]))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    return run


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (classes) to one (place, value) for each pair of neighbouring classes of the task."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        flat, off = utf8(batch.column("classes"))
        before = np.concatenate(([END], flat[:-1])).astype(np.int64)[: len(flat)]
        before[off[:-1][off[1:] > off[:-1]]] = END
        total += np.bincount(before * CLASSES + flat, minlength=len(total))
    place = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place].astype(np.float64))], ["place", "value"])


def _summed(sequences: DataFrame, task) -> tuple[np.ndarray, np.ndarray]:
    sums = sequences.mapInArrow(task, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([r[0] for r in sums], np.int64), np.array([r[1] for r in sums])


def train(sequences: DataFrame, states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE, trace: list | None = None) -> Hmm:
    """sequences(classes); trace gets the log10 likelihood per token at the start of each round."""
    pairs = np.zeros(CLASSES * CLASSES)
    place, value = _summed(sequences, _paired)
    pairs[place] = value
    model, last = Hmm.of_pairs(pairs.reshape(CLASSES, CLASSES), states), -math.inf
    for _ in range(rounds):
        place, value = _summed(sequences, _expected(model))
        if not len(place):
            break
        flat = np.zeros(len(place))
        flat[place] = value
        now = flat[-2] / flat[-1]
        if trace is not None:
            trace.append(now)
        model = Hmm.of_counts(flat[:-2], states)
        if now - last < tolerance:
            break
        last = now
    return model


def _scored(model: Hmm, v: Vocabulary):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = utf8(batch.column("classes"))
            total = np.concatenate(([0.0], np.cumsum(v.weight[flat])))
            names = [c for c in batch.schema.names if c != "classes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model.log10(flat, off) - (total[off[1:]] - total[off[:-1]]))], [*names, "states"])

    return run


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, table: int = TABLE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(7, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    learnt = rows.where("not held_out")
    counts = learnt.select("text").mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))
    counts = cut(counts, "counts")
    vocabulary = Vocabulary(counts, learnt.count(), table)
    kinds = "doc_id long, held_out boolean, row long, n_tokens long, known long, logs double, classes binary, rare array<long>"
    encoded = cut(rows.mapInArrow(_encoded(vocabulary), kinds), "encoded")
    model = train(encoded.where("not held_out").select("classes"), states, rounds)
    rare = encoded.select("row", F.explode("rare").alias("key")).join(counts, "key")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, states double"
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "classes").mapInArrow(_scored(model, vocabulary), kinds)
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    places = math.log10(vocabulary.tokens + vocabulary.types + 1)
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(places)).alias("base_score"), (logs + F.col("states")).alias("score"),
    )


def query(spark, sf_dir):
    return hmm_scores(load(spark, sf_dir, "documents"))
