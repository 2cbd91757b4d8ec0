"""The two classifiers' scores, text by text, from n-grams made in plain Python and the fitted weights."""

import collections
import math

import pytest

from tessera.llm import quality_classifier, quality_rules
from tessera.llm.ngrams import BITS, LONGEST_RUN, RUNS, WORDS, Sample, learning_rows, text_rows

from . import brute

FULL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & FULL
    x ^= x >> 29
    x = x * 0xC2B2AE3D27D4EB4F & FULL
    return x ^ x >> 32


def word_hash(w):
    b = w.encode()
    return mixed((sum((x + 1) * pow(0xA0761D6478BD642F, i, 1 << 64) for i, x in enumerate(b)) + len(b) * 0xE7037ED1A0B428DB) & FULL)


def grams(text):
    """(byte trigrams, word n-grams), buckets with repeats."""
    b, w = (text or "").encode(), brute.words(text)
    chars = [(b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 % (1 << 32) >> (32 - BITS) for i in range(len(b) - 2)]
    h, out, run = [word_hash(x) for x in w], [], 0
    for i, x in enumerate(h):
        out.append(WORDS + (x >> (64 - BITS)))
        if i:
            run = run + 1 if x == h[i - 1] else 0
            out.append(RUNS + min(run, LONGEST_RUN - 1) - 1 if run else WORDS + (mixed((x * 3 & FULL) ^ h[i - 1]) >> (64 - BITS)))
    return chars, out


def probability(model, margin):
    return 1 / (1 + math.exp(-max(-35, min(35, model.a * margin + model.c))))


@pytest.fixture(scope="module")
def given(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_classifier_scores(given):
    docs, labels, texts = given
    model = quality_classifier.Model(Sample(text_rows(docs), learning_rows(labels).where(~quality_classifier.held_out(3, 1)), quality_classifier.SAMPLE))
    for r in quality_classifier.quality_scores(docs, labels).collect():
        some = {b for kind in grams(texts[r.doc_id]) for b in kind}
        margin = sum(model.w[b] for b in some) / max(1e-9, math.sqrt(sum(model.square[b] for b in some))) + model.b
        want = probability(model, margin)
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-12) and r.predicted == (r.score >= 0.5)


def test_classifier_ratios(given):
    """Log-count ratios by a dictionary of sets."""
    docs, labels, texts = given
    y = {r.doc_id: r.y for r in learning_rows(labels).collect()}
    some = sorted(y)[:40]
    found = quality_classifier.log_count_ratio([list({b for kind in grams(texts[i]) for b in kind}) for i in some], [y[i] for i in some])
    counts = [collections.Counter(b for i in some if y[i] == label for b in {b for kind in grams(texts[i]) for b in kind}) for label in (1, 0)]
    totals = [len(found) + sum(c.values()) for c in counts]
    for b in range(0, len(found), 97):
        assert math.isclose(found[b], math.log((1 + counts[0][b]) / totals[0]) - math.log((1 + counts[1][b]) / totals[1]), abs_tol=1e-12)


def test_rule_verdicts(given):
    docs, labels, texts = given
    model = quality_rules.Regression(Sample(text_rows(docs), learning_rows(labels), quality_rules.SAMPLE))
    for r in quality_rules.quality_rules(docs, labels).collect():
        margin = model.b + sum(sum(model.w[b] for b in kind) / max(1, len(kind)) for kind in grams(texts[r.doc_id]))
        want = probability(model, margin)
        assert math.isclose(r.probability, want, rel_tol=1e-6, abs_tol=1e-9)
        n, *_, repeats = brute.rule_counts(texts[r.doc_id])
        assert r.kept == (n >= 20 and 100 * repeats <= 30 * n and want >= quality_rules.THRESHOLD)


def test_hmm_scores(spark, small, monkeypatch):
    """Whole texts' scores by a forward recursion in plain Python, with shares of classes from plain counts."""
    import numpy as np

    from tessera.llm import hmm

    from .test_models import remainder

    caught = {}
    train, vocabulary = hmm.train, hmm.Vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a, **k: caught.setdefault("model", train(*a, **k)))
    monkeypatch.setattr(hmm, "Vocabulary", lambda *a: caught.setdefault("words", vocabulary(*a)))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 4000} | {-1: "", -2: None, -3: "neverseen words Xq"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = hmm.hmm_scores(docs, states=3, rounds=3).collect()
    model, v = caught["model"], caught["words"]
    learnt = {i: t for i, t in texts.items() if remainder(i, 7) != 2}
    count = collections.Counter(w for t in learnt.values() for w in brute.words(brute.lower(t)))
    classes = dict(zip(v.key.tolist(), v.cls.tolist(), strict=True))

    def class_of(w):
        b = np.frombuffer(w.encode(), np.uint8)
        key = int(hmm.keys(b, np.array([0, len(b)]))[0][0])
        return classes.get(key, key & 63)

    place = {w: class_of(w) for w in count}
    weight = collections.Counter({c: 1 for c in range(hmm.SHAPES)})
    for w, n in count.items():
        weight[place[w]] += n + 1
    for r in found:
        words = brute.words(brute.lower(texts[r.doc_id]))
        seen = [*(place.get(w, class_of(w)) for w in words), hmm.END]
        total, a = 0.0, None
        for c in seen:
            before = model.first if a is None else [sum(a[i] * model.step[i, j] for i in range(3)) for j in range(3)]
            a = [x * model.emit[j, c] for j, x in enumerate(before)]
            z = sum(a)
            total, a = total + math.log10(z), [x / z for x in a]
        total += sum(math.log10((count[w] + 1) / weight[c]) for w, c in zip(words, seen, strict=False))
        assert math.isclose(r.score, total, rel_tol=1e-6, abs_tol=1e-6)
