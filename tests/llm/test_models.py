import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from tessera.llm import hmm, quality_classifier, quality_rules
from tessera.llm.ngrams import RUNS, Sample, grams, learning_rows, platt

from . import brute


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_runs_of_a_word():
    buf = np.frombuffer(b"a a a b b c" + b"c c", np.uint8)
    _, (bucket, row) = grams(buf, np.array([0, 11, 14]))
    assert [(int(b) - RUNS, int(r)) for b, r in zip(bucket, row, strict=True) if b >= RUNS] == [(0, 0), (1, 0), (0, 0), (0, 1)]


def test_platt():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    margin = 100 * y + rng.normal(0, 30, 500)
    a, b = platt(margin, y)
    p = 1 / (1 + np.exp(-(a * margin + b)))
    assert ((p >= 0.5) == (y == 1)).mean() > 0.9 and abs(p.mean() - y.mean()) < 0.02
    assert platt(np.ones(3), np.ones(3)) == (1.0, 0.0)


def test_dual_descent_separates():
    idx = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    val = [np.full(2, 0.7)] * 4
    y = np.array([1, 1, 0, 0])
    w, b = quality_classifier.dual_descent(idx, val, y, cost=10.0, epochs=100)
    assert [float(w[i] @ v) + b > 0 for i, v in zip(idx, val, strict=True)] == [True, True, False, False]


def test_sample_of_repeated_ids_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i} of {k}") for i in range(30) for k in (0, 0, 0, i)], "doc_id long, text string")
    labels = learning_rows(spark.createDataFrame([(i, i % 2) for i in range(30)] * 2, "doc_id long, quality int"))
    assert [len(Sample(docs, labels, n).y) for n in (7, 99)] == [7, 30]
    once, again = Sample(docs.distinct(), labels, 7), Sample(docs.union(docs).repartition(5), labels, 7)
    assert once.y.tolist() == again.y.tolist() and [i.tolist() for i in once.idx] == [i.tolist() for i in again.idx]


def test_classifier_on_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.97 and found.score.between(0, 1).all()
    assert (found[found.quality == 0].predicted == 0).mean() > 0.9


def test_classifier_cases(odd, odd_rows, nothing, labels):
    rows = quality_classifier.quality_scores(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or remainder(r.doc_id, 3) == 1) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert quality_classifier.quality_scores(nothing, labels).count() == 0
    kept = quality_classifier.good_rows(odd, odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)


def test_rule_counts(odd, odd_rows, labels):
    got = quality_rules.quality_rules(odd, labels).collect()
    want = [(r[0], *brute.rule_counts(r[1])) for r in odd_rows]
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)


def test_rules_cases(odd, nothing, labels):
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in quality_rules.quality_rules(odd, labels.limit(0)).collect())
    kept = quality_rules.good_rows(odd, odd, labels)
    assert kept.columns == odd.columns and kept.count() == quality_rules.quality_rules(odd, labels).where("kept").count()


def test_rules_on_labelled_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.99 and found[found.quality == 0].kept.mean() < 0.1


def exact(model, obs):
    """Probability of a sequence by all paths, with its Baum-Welch counts."""
    k = len(model.first)
    total, counts = 0.0, np.zeros(k + k * k + k * hmm.CLASSES)
    for path in itertools.product(range(k), repeat=len(obs)):
        p = model.first[path[0]] * model.emit[path[0], obs[0]]
        for i in range(1, len(obs)):
            p *= model.step[path[i - 1], path[i]] * model.emit[path[i], obs[i]]
        total += p
        counts[path[0]] += p
        for i, s in enumerate(path):
            counts[k + k * k + s * hmm.CLASSES + int(obs[i])] += p
            if i:
                counts[k + path[i - 1] * k + s] += p
    return total, counts / total


@pytest.mark.parametrize("block", [1, 2, 3, hmm.BLOCK])
def test_forward_and_expected_counts(monkeypatch, block):
    """Against all paths, over several blocks of a sequence."""
    monkeypatch.setattr(hmm, "BLOCK", block)
    model, rng = hmm.Hmm.start(2), np.random.default_rng(3)
    sizes = [4, 9, 6, 1, 4, 8]
    sequences = [rng.integers(0, hmm.CLASSES, n).astype(np.uint8) for n in sizes]
    flat, off = np.concatenate(sequences), np.cumsum([0, *sizes])
    want = [exact(model, s) for s in sequences]
    assert np.allclose(model.log10(flat, off), [math.log10(p) for p, _ in want])
    counts, log = model.counted(flat, off)
    assert np.allclose(counts, sum(c for _, c in want)) and np.isclose(log, sum(math.log10(p) for p, _ in want))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 4, 300) * 2 + i % 2 for i in range(40)]
    flat, off = np.concatenate(rows).astype(np.uint8), np.arange(41) * 300
    model, logs = hmm.Hmm.start(3), []
    for _ in range(8):
        counts, log = model.counted(flat, off)
        logs.append(log)
        model = hmm.Hmm.of_counts(counts, 3)
    assert logs == sorted(logs) and logs[-1] > logs[0] + 100


@pytest.mark.parametrize("table", [hmm.TABLE, 3])
def test_base_scores(odd, odd_rows, table):
    """With and without most words in the tasks' table."""
    def tokens(t):
        return [*brute.words(brute.lower(t)), None]

    c = collections.Counter(w for i, t, *_ in odd_rows if i is not None and remainder(i, 7) != 2 for w in tokens(t))
    n, places = sum(c.values()), math.log10(sum(c.values()) + len(c) + 1)
    want = []
    for i, t, *_ in odd_rows:
        w = tokens(t)
        want.append((str(i), i is None or remainder(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10(c[x] + 1) for x in w) - len(w) * places, 4)))
    rows = hmm.hmm_scores(odd, states=3, rounds=1, table=table).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == sorted(want)
    assert all(r.score <= 0 for r in rows)


def test_scores_sum_to_one():
    """The class model spreads 1 over all sequences that end, and a class's words and the unseen share its mass."""
    model = hmm.Hmm.start(2)
    model.emit[:] = 1e-12  # three classes besides the end
    model.emit[:, [0, 1, 2]], model.emit[:, hmm.END] = 0.15, 0.55
    total = sum(10.0 ** model.log10(np.array([*x, hmm.END], np.uint8), np.array([0, n + 1]))[0] for n in range(9) for x in itertools.product(range(3), repeat=n))
    assert math.isclose(total, 1 - 0.45**9, rel_tol=1e-6)


def test_class_shares(spark):
    """exp10(score) of a text of one word, over the class model's part, is the word's add-one share of its class."""
    texts = ["a", "a", "b", "cc", "dd", "a", "b b"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.text: r.score for r in hmm.hmm_scores(docs, 2, 2).join(docs, "doc_id").collect()}
    assert all(x < 0 for x in rows.values()) and rows["a"] > rows["dd"] and sum(10**x for x in rows.values()) < 1


def test_empty_table(nothing):
    assert hmm.hmm_scores(nothing).count() == 0
