"""The near-dedup stage on edited copies, against pairs of whole sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import near, simhash

from . import brute
from .conftest import prose


def shingles(text):
    w = brute.words(brute.lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def components(rows):
    """[(id, text)] to the smallest id of each text's component: two bits or a similarity of 0.8."""
    fps, sets = [brute.fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 or similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(rows))]


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = "changed"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Texts of 200 words with copies of 1 to 4 changed words (kept apart by two bits) and of 60 (no copies)."""
    rng = random.Random(8)
    rows = []
    for i in range(30):
        t = prose(rng, 200)
        rows += [(10 * i, t), *((10 * i + n, edited(rng, t, n).upper()) for n in (1, 2, 3, 4)), (10 * i + 9, edited(rng, t, 60))]
    return rows + [(1000, "a b"), (1001, "A  b"), (1002, "")]


@pytest.mark.parametrize("bucket", [near.BUCKET, 2])
def test_stage_joins_edited_copies(spark, copies, monkeypatch, bucket):
    monkeypatch.setattr(near, "BUCKET", bucket)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    want = components(copies)
    assert len(set(want)) < len(set(brute.components([(i, brute.fingerprint(t)) for i, t in copies])))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(set(want))
    narrow = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert narrow == set(brute.components([(i, brute.fingerprint(t)) for i, t in copies]))


def test_stage_on_documents(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(texts)))


def test_shingles():
    texts = [b"A b c d e f", b"", b"a  b", b"a b c d e f"]
    h, bounds, node = near.shingles(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert bounds.tolist() == [0, 2, 2, 3, 5] and node[0] == node[3] != node[2]
    assert h[:2].tolist() == h[3:].tolist() and len(near.bands(h, bounds)) == 3


def test_large_group(spark):
    """More near copies than are compared pair by pair stay one component."""
    rng = random.Random(2)
    t = prose(rng, 300)
    rows = [(0, t)] + [(i, edited(rng, t, 3)) for i in range(1, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()] == [0]


def fresh(rng, text, n, k):
    """n words of the text become words that no other text has."""
    w = text.split()
    for j, i in enumerate(rng.sample(range(len(w)), n)):
        w[i] = f"new{k}x{j}"
    return " ".join(w)


@pytest.mark.parametrize(("n", "block"), [(1000, 512), (300, 20)])
def test_hub(spark, monkeypatch, n, block):
    """Texts that are alike to one text only, not to each other, in one block and in many."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(n)
    t = prose(rng, 200)
    rows = [(0, t)]
    while len(rows) <= n:
        text = fresh(rng, t, 4, len(rows))
        if similarity(shingles(t), shingles(text)) >= 0.81:
            rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()] == [0]


@pytest.mark.parametrize("block", [4, 30, 512])
def test_crowded_bands(spark, monkeypatch, block):
    """Chains of edits, pairs and strangers in the same bands: the components are those of all pairs."""
    monkeypatch.setattr(near, "BUCKET", 3)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for _ in range(2):
        t = prose(rng, 120)
        texts = [t]
        for k in range(90):
            texts.append(fresh(rng, rng.choice(texts[-6:] if k % 3 else [t]), rng.choice((1, 2, 5, 9)), f"{len(rows)}y{k}"))
        rows += [(len(rows) + i, x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = set(components(rows))
    assert 2 < len(want) < len(rows)
    assert {r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()} == want


def test_index_is_not_broadcast(spark, monkeypatch):
    """Its size is guessed as that of the fingerprints it is made from, a 64th."""
    plans, kept = {}, simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or kept(df, label))
    found = simhash.links(spark.createDataFrame([(0,), (1,), (2,), (7,), (1 << 40,)], "fp long"))
    assert "crowded" in plans and "Broadcast" not in plans["crowded"]
    assert {(r.u, r.v) for r in found.collect()} == {(0, 1), (0, 2), (1, 2), (0, 1 << 40), (1, 7), (2, 7), (1, 1 << 40), (2, 1 << 40)}


def test_overlaps(monkeypatch):
    monkeypatch.setattr(near, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    for n in (1, 2, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(n)]
        assert near.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_stage_keeps_columns_with_dots(spark):
    docs = spark.createDataFrame([(1, "a text of some words", "x"), (2, "a text of some words", "y")], "doc_id long, text string, `a.b` string")
    for stage in (corpus_pipeline.near_dedup_stage, corpus_pipeline.suffix_array_dedup_stage):
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "a.b"] and docs.first()["a.b"] == "x"
