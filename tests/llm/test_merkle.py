"""The manifest against a plain tree over sorted leaves."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest as m
from tessera.llm.common import load

KIND = "doc_id long, text string, lang string, source string, n_chars int, leaf string, tampered string, place string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    """(root, [siblings of each node, from below])"""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = range(a - a % 8, min(len(level), a - a % 8 + 8))
            ways[i].append(("".join(level[j] for j in run if j < a), "".join(level[j] for j in run if j > a)))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], ways


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = own, *grown([leaf(*r) for r in own])
    root, above = grown([trees[x][1] for x in langs])
    for lang, up in zip(langs, above, strict=True):
        own, subroot, ways = trees[lang]
        for r, way in zip(own, ways, strict=True):
            found = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                found = leaf(r[0], None if r[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for b, a in way + up:
                found = h(b + found + a)
            out.append((r[0], leaf(*r), subroot, root, h("".join(b + a for b, a in way + up)), found, found == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in m.merkle_manifest(df, tamper=m.lowered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [8, 9], [600, 1, 64, 65], [5] * 70])
def test_trees(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(10**6), rng.choice(["Abc", "", "é", None]), f"lang{n}" if n else None, rng.choice(["s", None]), rng.choice([3, None])) for n, size in enumerate(sizes) for _ in range(size)]
    rows += rows[:3] + [(None, "X", rows[0][2], "a", 1), (None, "Y", rows[0][2], "a", 1)]
    df = spark.createDataFrame([(*r, "l", "t", "p") for r in rows], KIND).repartition(3)
    assert result(df) == plain(rows)


def test_more_levels_where_there_are_too_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "LEVELS", 1)
    monkeypatch.setattr(m, "TOP", 12)
    rows = [(i, f"Text {i}", "ab"[i % 7 > 0], "s", i) for i in range(900)]
    df = spark.createDataFrame([(*r, "l", "t", "p") for r in rows], KIND).repartition(5)
    assert result(df) == plain(rows)
    with pytest.raises(ValueError, match="languages"):
        m.merkle_manifest(df.withColumn("lang", F.col("text")))


def test_many_equal_rows(spark):
    rows = [(4, "Same", "en", "s", 4)] * 700 + [(5, "Other", "en", "s", 4)]
    df = spark.createDataFrame([(*r, "l", "t", "p") for r in rows], KIND).repartition(3)
    assert result(df) == plain(rows)


def test_cases(spark, nothing, small):
    empty = spark.createDataFrame([], KIND)
    assert m.merkle_manifest(empty, tamper=m.lowered).collect() == []
    docs = load(spark, small, "documents")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    assert result(docs) == plain(rows)
    honest = m.merkle_manifest(docs)
    assert honest.where("verified").count() == len(rows)
