import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import anchors, simhash, substring_dedup, suffix_array_dedup
from tessera.llm.anchors import contexts, pack, sliding_min, unpack
from tessera.llm.common import U64, RangeHash
from tessera.llm.components import components

from . import brute
from .conftest import prose


def keyed(rows):
    return sorted(rows, key=repr)


def test_sliding_min_and_places():
    x = np.array([5, 3, 8, 1, 9, 9, 2, 7], U64)
    for w in range(1, 9):
        assert sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]
    first, count, anchor = (np.array([v], np.int64) for v in (70_000, 201, 70_200))
    assert [int(v[0]) for v in unpack(pack(first, count, anchor))] == [70_000, 201, 70_200]


def test_every_window_has_one_context():
    rng = np.random.default_rng(1)
    symbols, row = rng.integers(1, 4, 500).astype(U64), np.repeat([0, 1, 2], [200, 6, 294])
    windows = []
    for _, _, r, first, count, anchor in contexts(symbols, row, 12, 6):
        for a, b, c, d in zip(r.tolist(), first.tolist(), count.tolist(), anchor.tolist(), strict=True):
            windows += [(a, b + j) for j in range(c)]
            assert b + c - 1 <= d <= b + 12 - 6
    assert windows == [(0, i) for i in range(189)] + [(2, i) for i in range(206, 489)]


def test_range_hash_is_of_content():
    ranges = RangeHash(np.array([1, 2, 3, 1, 2, 3, 2], U64))
    a, b = ranges(np.array([0, 1]), np.array([3, 3])), ranges(np.array([3, 4]), np.array([6, 6]))
    assert (a == b).all() and a[0] != a[1]


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(60):
        sequences = [[rng.randint(0, 2) for _ in range(rng.randint(0, 15))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for owner, s in enumerate(sequences):
            automaton.add(s, owner)
        query = [rng.randint(0, 2) for _ in range(20)]
        for q in [*sequences, query]:
            want = [next((o for o, s in enumerate(sequences) if any(s[j : j + 3] == q[i : i + 3] for j in range(len(s) - 2))), None) for i in range(len(q) - 2)]
            assert automaton.owners(q, 3) == want


def test_group_order():
    rng = random.Random(3)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 30))]
        ranks = {v: k + 1 for k, v in enumerate(sorted(set(text)))}
        text = [*(ranks[v] for v in text), 0]
        assert suffix_array_dedup.group_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_substring_dedup(odd, odd_rows):
    got = [tuple(r) for r in substring_dedup.substring_dedup(odd).collect()]
    assert keyed(got) == keyed(brute.substring_dedup([r[:2] for r in odd_rows]))


def test_substring_dedup_of_documents(spark, small, texts):
    got = substring_dedup.substring_dedup(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert keyed(map(tuple, got)) == keyed(brute.substring_dedup(texts))


def test_sql_against_brute_force(odd_rows, texts):
    """On the driver's texts and on nulls, empty texts and copies (ids told apart, since SQL's rows are by id)."""
    extra = [(10**6 + n, t) for n, (_, t, *_) in enumerate(odd_rows) if len(t or "") < 5000]
    rows = [*texts, *extra]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    digest = lambda kept: hashlib.sha256(kept if isinstance(kept, bytes) else kept.encode()).hexdigest()
    for sql, want in (substring_dedup.SQL, brute.substring_dedup(rows)), (suffix_array_dedup.SQL, brute.byte_dedup(rows)):
        assert sorted(con.sql(sql).fetchall()) == sorted((*r[:-1], digest(r[-1])) for r in want)


def test_suffix_array_dedup(odd, odd_rows):
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array_dedup.suffix_array_dedup(odd).collect()]
    assert keyed(got) == keyed(brute.byte_dedup([r[:2] for r in odd_rows]))


def test_suffix_array_dedup_of_documents(spark, small, texts):
    found = suffix_array_dedup.suffix_array_dedup(spark.read.parquet(f"{small}/documents.parquet"))
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()]
    assert keyed(got) == keyed(brute.byte_dedup(texts))


@pytest.fixture
def crowded():
    """Rows that share passages of 30 to 90 words among unlike words, so that one anchor has very many contexts."""
    rng = random.Random(12)
    passage = prose(rng, 90)
    cuts = [(0, 90), (0, 62), (5, 55), (20, 70), (30, 60), (10, 88)]
    rows = []
    for i in range(260):
        a, b = cuts[i % len(cuts)]
        rows.append((i, f"{prose(rng, rng.randint(0, 40))} {' '.join(passage.split()[a:b])} {prose(rng, rng.randint(0, 40))}"))
    return rows + [(7, rows[3][1]), (400, rows[8][1])]


@pytest.mark.parametrize("crowd", [1, 20])
def test_crowded_anchors(spark, crowded, monkeypatch, crowd):
    for module in (anchors, substring_dedup, suffix_array_dedup):
        monkeypatch.setattr(module, "CROWD", crowd)
    docs = spark.createDataFrame(crowded, "doc_id long, text string").repartition(3)
    assert keyed(map(tuple, substring_dedup.substring_dedup(docs).collect())) == keyed(brute.substring_dedup(crowded))
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array_dedup.suffix_array_dedup(docs, 300, 150).collect()]
    assert keyed(got) == keyed(brute.byte_dedup(crowded, 300))


def test_no_anchor_stays_crowded(spark):
    """One anchor with 20,000 contexts: no task gets more than CROWD of an anchor, and every window is still somewhere."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(50)]
    some = [(" ".join(rng.choices(words, k=25)).encode(), " ".join(rng.choices(words, k=25)).encode()) for _ in range(2000)]
    rows = [(1, 10 * i + j, i, some[i][0], some[(i + j) % 2000][1], 26) for i in range(2000) for j in range(10)]
    schema = "a long, c long, value long, lead binary, tail binary, window int"
    left, maps = anchors.uncrowded(spark.createDataFrame(rows, schema).repartition(4), F.min("value"), words=True)
    left = left.cache()
    assert left.groupBy("a").count().agg(F.max("count")).first()[0] <= anchors.CROWD
    found = {(r.a, r.c): r for r in left.collect()}
    places = {}
    for r in maps.collect():
        x = found[r.b, r.d]
        n = len(x.lead.split()) + len(x.tail.split()) - x.window + 2
        places.setdefault(r.c, []).extend(range(r.shift, r.shift + n))
    assert all(sorted(places[10 * i + j]) == list(range(26)) for i in range(2000) for j in range(10))


def test_rows_of_one_id_are_told_apart(spark):
    """Rows of one doc_id, many of them: hashes of few bits would be alike."""
    rng = random.Random(14)
    passage = prose(rng, 60)
    rows = [(1, passage), (5, passage)] + [(5, prose(rng, 61)) for _ in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert keyed(map(tuple, substring_dedup.substring_dedup(docs).collect())) == keyed(brute.substring_dedup(rows))
    twice = rows[:40] + rows[:3]
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array_dedup.suffix_array_dedup(spark.createDataFrame(twice, "doc_id long, text string"), 200, 100).collect()]
    assert keyed(got) == keyed(brute.byte_dedup(twice, 200))


def test_common_prefixes():
    x = np.array([1, 2, 1, 2, 1, 3, 0], np.uint32)
    assert suffix_array_dedup.common_prefixes(x, np.array([0, 2, 4, 1]), 4).tolist() == [0, 3, 1, 0]


def test_clean_rows_keep_columns_and_characters(odd, odd_rows):
    found = suffix_array_dedup.clean_rows(odd)
    assert found.columns == odd.columns and found.count() == len(odd_rows)
    by_id = {r.doc_id: r.text for r in found.collect()}
    assert by_id[2] is None and by_id[3] == "" and by_id[14] == "" and len(by_id[1]) == 3


def test_simhash(odd, odd_rows):
    fps = [(r[0], brute.fingerprint(r[1])) for r in odd_rows]
    want = [(i, f - (f >> 63 << 64), c) for (i, f), c in zip(fps, brute.components(fps), strict=True)]
    assert keyed(map(tuple, simhash.simhash_components(odd).collect())) == keyed(want)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_links_of_crowded_variants(spark, monkeypatch, bucket):
    """Many fingerprints around a few centres, with the pairwise and with the wide index."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(3)] + [0]
    fps = set(centres)
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [f - (f >> 63 << 64) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    for e in edges.collect():
        assert 0 < ((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 2
    root = {r.node: r.root for r in components(edges).collect()}
    got = [root.get(f, f) for f in signed]
    want = brute.components([(f, f & (2**64 - 1)) for f in signed])
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_one_of_each(odd, odd_rows):
    fps = [(r[0], brute.fingerprint(r[1])) for r in odd_rows]
    groups = {}
    for (i, f), c in zip(fps, brute.components([(k, f) for k, (_, f) in enumerate(fps)]), strict=True):
        groups.setdefault(c, []).append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    found = simhash.one_of_each(odd)
    assert found.columns == odd.columns
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(nothing):
    assert substring_dedup.substring_dedup(nothing).count() == 0
    assert suffix_array_dedup.suffix_array_dedup(nothing).count() == 0
    assert suffix_array_dedup.clean_rows(nothing).count() == 0
    assert simhash.simhash_components(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def test_equal_rows_send_their_contexts_once(spark):
    from tessera.llm import substring_dedup as op1
    from tessera.llm import suffix_array_dedup as op3

    rng = random.Random(31)
    t = prose(rng, 400)
    rows = [(1, t)] * 300 + [(2, t + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in op1.substring_dedup(docs).collect())
    assert got == sorted(brute.substring_dedup(rows))
    got = sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op3.suffix_array_dedup(docs).collect())
    assert got == sorted(brute.byte_dedup(rows))
    batch = op1.keyed(docs).withColumn("reps", op1.F.expr("array(named_struct('a', 1L, 'c', 2L, 'place', 0L))")).repartition("key")
    sent = batch.mapInArrow(op1._context_words(50, 20), "a long, c long, value long, lead binary, tail binary, window int")
    assert sent.count() == 2
