"""Periodic runs against a plain search of every period."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import periodic_runs

from . import brute


def plain(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, q, b) for (a, b), q in found.items())


def expected(key, text):
    w = brute.words(text)
    to = periodic_runs.tampered(key, len(w))
    w = w if to is None else [w[i] for i in to.tolist()]
    found = plain(w)
    gone = {i for a, q, b in found for i in range(a + q, b)}
    a, q, b = min(found, key=lambda r: (r[0] - r[2], r[0], r[1]), default=(None,) * 3)
    listed = "".join(f"{x},{z - x},{y}\n" for x, y, z in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    longest = (a, b - a, q, 1000 * (b - a) // q) if found else (None,) * 4
    return (key, len(found), *longest, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def random_words(rng):
    n, k = rng.choice([0, 1, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 40])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        a, p = rng.randrange(n // 2), rng.randint(1, n // 3)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("pairs", [1, 1 << 18])
def test_runs_of_many_texts(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        bounds = np.cumsum([0, *map(len, texts)])
        start, end, p = periodic_runs.runs(np.array(sum(texts, []), np.int64), bounds)
        want = [(a + off, q, b + off) for off, w in zip(bounds.tolist(), texts, strict=False) for a, q, b in plain(w)]
        assert list(zip(start.tolist(), p.tolist(), end.tolist(), strict=True)) == want


def test_hashes_that_deceive():
    """Words of two numbers in the order that a polynomial modulo a power of two can't tell from its complement."""
    w = np.array([i.bit_count() & 1 for i in range(3000)], np.int64)
    w = np.concatenate((w[:7], w, w[:2000]))
    start, end, p = periodic_runs.runs(w, np.array([0, len(w)]))
    assert sorted(zip(start.tolist(), end.tolist(), p.tolist(), strict=True)) == sorted(periodic_runs.plain_runs(w))


def test_equal_hashes_of_words(monkeypatch):
    text = b"aa bb aa cc b"
    s, e = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 13])
    monkeypatch.setattr(periodic_runs, "word_hashes", lambda buf, s, e: np.zeros(len(s), np.uint64))
    ids = periodic_runs.numbers(np.frombuffer(text, np.uint8), s, e)
    assert ids.tolist() == [0, 1, 0, 2, 3]


def test_rows(spark, odd_rows, odd, nothing, texts):
    rng = random.Random(3)
    periodic = [(100 + i, " ".join(f"w{x}" for x in random_words(rng))) for i in range(60)]
    small = [(i, t) for i, t in [*((r[0], r[1]) for r in odd_rows), *periodic, *texts] if len(t or "") < 20_000]
    docs = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    found = periodic_runs.digests(periodic_runs.periodic_runs(docs, change=periodic_runs.tampered))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr(expected(i, t)) for i, t in small)
    assert periodic_runs.periodic_runs(odd).count() == len(odd_rows) and not periodic_runs.periodic_runs(nothing).count()
    plain_row = periodic_runs.periodic_runs(spark.createDataFrame([(1, "a b " * 9 + "c")], "doc_id long, text string")).first()
    assert [tuple(r) for r in plain_row.runs] == [(0, 18, 2)] and plain_row.collapsed == "a b c"
