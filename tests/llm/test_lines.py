"""Repeated lines against a plain search, and the perfect hash by itself."""

import random

import numpy as np
import pytest

from tessera.llm import line_dedup

from .conftest import prose

WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """[(id, text)] to sorted [(id, lines, dropped, kept)]; null ids are one document after all others."""
    at = [2**70 if i is None else i for i, _ in rows]
    keys = [[x.strip(WHITE).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t in rows]
    least = {}
    for i, ks in zip(at, keys, strict=True):
        for k in ks:
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, t), a, ks in zip(rows, at, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if len(k) < 10 or least[k] == a]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 65, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1 << 64, (2, n), np.uint64)
    b[: n // 2] = 7  # one hash alone doesn't tell pairs apart
    a[n // 2 :] = 9
    held = line_dedup.PerfectHash.of(a, b)
    assert sorted(held(a, b).tolist()) == list(range(n))
    assert held(b, a).max(initial=-1) < max(n, 1)


def rows(rng):
    lines = [prose(rng, rng.randint(1, 6)) for _ in range(40)]
    out = []
    for i in range(150):
        own = [rng.choice((str.upper, str, lambda x: f"\t{x} \r", lambda x: x + "."))(rng.choice(lines)) for _ in range(rng.randint(0, 12))]
        own += ["", "  ", "short", "ünïcödé é", "ünïcödé ér"] + ["The line that all have"] * (i % 3)
        rng.shuffle(own)
        out.append((rng.choice((i, i, i // 2, None if i % 50 == 0 else i)), "\n".join(own)))
    return out + out[:5]


def test_rows(spark, odd_rows, odd, nothing, texts):
    given = rows(random.Random(4)) + [(i, t) for i, t, *_ in odd_rows] + [(500 + i, t) for i, t in texts]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in line_dedup.line_dedup(docs).collect()), key=repr) == plain(given)
    assert line_dedup.line_dedup(odd).count() == len(odd_rows) and not line_dedup.line_dedup(nothing).count()


def test_common_line_goes_to_several_groups(spark):
    given = [(i, f"one line in every text\nand the line of number {i // 2}") for i in range(3000)] + [(5, "one line in every text")] * 500
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in line_dedup.line_dedup(docs).collect()), key=repr) == plain(given)


def test_nothing_repeats(spark):
    docs = spark.createDataFrame([(1, "a line alone here\nx"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.line_dedup(docs).collect())) == [(1, 2, 0, "a line alone here\nx"), (2, 1, 0, "")]
