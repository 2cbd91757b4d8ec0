import collections
import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, packing, transport_stream, warc
from tessera.llm.common import fresh_path


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


ODD = ["", "x" * 3000, "the cat's we'll I'VE 'sun'", "a<|endoftext|>b <|startoftext|>", "<|END|>", "\x1ca\x1f b\x00\x7f", "ΣΑΣ İ ﬁ é é", "١2Ⅷ _x_ 你好 😀"]


def odd_texts():
    rng = random.Random(5)
    alphabet = "abc 'sSΣİß<>|é́ÅÉ你好١2Ⅷ_\x1c\x85\xa0 \n\tﬁ😀"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]


def encoded(table, rows):
    data = [t.encode() for t in rows]
    ids, bounds = table.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return ids, bounds


def ids_of(table, rows):
    ids, bounds = encoded(table, rows)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


@pytest.mark.parametrize("model", [bpe.WordBpe, packing.LibraryBpe])
def test_bpe_equals_the_library(library, texts, model):
    table = bpe.WordTable(model(bpe.vocabulary_path()))
    rows = [t for _, t in texts[:80]] + odd_texts()
    want = [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]
    assert ids_of(table, rows) == want
    model = bpe.WordBpe(bpe.vocabulary_path())
    assert [x.decode() for x in model.decode(*encoded(table, rows))] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert ids_of(table, []) == [] and ids_of(table, ["", " "]) == [[], []]


def test_merging_together_is_exact_merging():
    model, rng = bpe.WordBpe(bpe.vocabulary_path()), random.Random(9)
    units = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["a", "the", "aaaa" * 12, "w" * 300]
    assert model.merge_together(units) == [model.merge_exactly(u) for u in units]
    tokens, sizes = model.propose_together(units)
    assert [x.tolist() for x in np.split(tokens, np.cumsum(sizes)[:-1])] == [model._propose(u) for u in units]


def test_another_split_takes_the_general_way(monkeypatch, library):
    monkeypatch.setattr(bpe, "_SPLIT", "another")
    rows = odd_texts()[:200]
    assert ids_of(bpe.WordTable(bpe.WordBpe(bpe.vocabulary_path())), rows) == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


def test_compatible_pairs_are_those_of_exact_merging():
    model = bpe.WordBpe(bpe.vocabulary_path())
    rng = random.Random(1)
    names = {i: n for n, i in model.vocab.items()}
    inner = [i for i, n in names.items() if not n.endswith("</w>")]
    last = [i for i, n in names.items() if n.endswith("</w>")]
    pairs = [(rng.choice(inner), rng.choice(last)) for _ in range(3000)]
    got = model.compatible(*(np.array(x) for x in zip(*pairs, strict=True)))
    assert got.tolist() == [model.merge_exactly(names[a] + names[b].removesuffix("</w>")) == [a, b] for a, b in pairs]


def test_small_tables(monkeypatch, library):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 5)
    monkeypatch.setattr(bpe, "TABLE_BYTES_EACH", 3)
    table = bpe.WordTable(bpe.WordBpe(bpe.vocabulary_path()))
    for _ in range(3):
        assert ids_of(table, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_bpe_rows(odd, odd_rows, nothing, library):
    want = []
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_round(odd, digest=True).collect()), key=repr) == sorted(want, key=repr)
    plain = bpe.bpe_round(odd).where("doc_id = 1").first()
    assert plain.decoded == library.decode(np.frombuffer(plain.ids, "<u4").tolist(), skip_special_tokens=False)
    assert bpe.bpe_round(nothing).count() == 0


def test_plans_use_every_length_once():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 50, 200])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        used, sequences = collections.Counter(), 0
        for lengths, k in packing.plan(dict(counts), capacity):
            assert k > 0 and sum(lengths) <= capacity
            sequences += k
            for n in lengths:
                used[n] += k
        assert used == counts
        total = sum(n * k for n, k in counts.items())
        assert sequences <= 1.25 * total / capacity + 1


def test_exact_complements():
    assert packing.plan({7: 2, 3: 2}, 10) == [([7, 3], 2)]
    assert packing.plan({6: 1, 2: 2}, 10) == [([6, 2, 2], 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [([4, 3, 2, 1], 1)]
    assert packing.plan({10: 5}, 10) == [([10], 5)] and packing.plan({}, 10) == []


def test_packing(odd, odd_rows, nothing, library):
    rows = packing.best_fit_packing(odd).collect()
    want = []
    for i, t, *_ in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(want, key=repr)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= sum(r.length for r in rows) / 2048 * 1.1 + 1
    assert packing.best_fit_packing(nothing).count() == 0


def test_streams_come_back():
    for n in [*range(64, 800, 37), 32_767, 32_768, 32_769, 70_000, *range(150, 200)]:
        payload = os.urandom(n)
        s = transport_stream.demux(transport_stream.mux(payload))
        units = -(-n // transport_stream.UNIT)
        assert s.payload == payload and s.continuity_errors == 0 and len(s.random_access) == units
        assert s.timestamps == [i * transport_stream.TICKS for i in range(units)]


def test_broken_streams():
    media = bytearray(transport_stream.mux(os.urandom(5000)))
    for bad in (media[:-1], b"", bytes(188), media[: 188 * 0] + b"\0" + media[1:], media[:20] + b"\xee" + media[21:]):
        with pytest.raises(ValueError):
            transport_stream.demux(bytes(bad))


def test_lost_repeated_and_reordered_packets():
    payload = os.urandom(70_000)  # three units
    p = np.frombuffer(transport_stream.mux(payload), np.uint8).reshape(-1, 188)
    n = len(p)

    def stream(places):
        return p[places].tobytes()

    twice = [*range(5), 4, *range(5, n), n - 1]
    assert transport_stream.demux(stream(twice)).payload == payload
    for lost in ([*range(5), *range(6, n)], list(range(n - 1)), [*range(300), *range(301, n)], [*range(6), 7, 6, *range(8, n)], [0, 1, *range(18, n)], list(range(n - 16))):
        with pytest.raises(ValueError):
            transport_stream.demux(stream(lost))
    s = transport_stream.demux(stream([*range(5), *range(6, n)]), strict=False)
    assert s.continuity_errors == 1 and s.broken_units == [0] and s.payload == payload[transport_stream.UNIT :]


def test_media_rows(odd, odd_rows, nothing):
    want = []
    for i, t, *_ in odd_rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    rows = transport_stream.stream_features(transport_stream.media_column(odd)).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(want, key=repr)
    assert all("errors=0" in r.feature and len(r.media_sha256) == 64 for r in rows)
    assert transport_stream.stream_features(transport_stream.media_column(nothing)).count() == 0


PAGES = "page_id long, url string, html string, digest string, size long"


def page_rows():
    big = "<p>é</p>" * 300
    return [(i, f"https://x.example/{i}?a=b%20c", h, "d", 0) for i, h in enumerate([big, big, "small", "small", None, "", big + "x", big, "z" * 1000, "z" * 1000, "z" * 999, "z" * 999])] + [(None, None, big, "d", 0), (50, None, big[:-1], "d", 0), (50, "u", "other", "d", 0)]


@pytest.mark.parametrize("split", [150, warc.SPLIT])
def test_warc(spark, split):
    rows = page_rows()
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), fresh_path(spark, "warc"))
    largest = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(largest.get(h, i), i)
    want = []
    for i, url, h, *_ in rows:
        b = (h or "").encode()
        refers = largest.get(h) if i is not None and largest.get(h, i) != i else None
        want.append((i, url, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers, b if refers is None else None))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, files, split=split).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_records_in_any_ranges():
    rng = random.Random(6)
    made = [warc.record(f"urn:x-page:{i}", "u", os.urandom(rng.randint(0, 300)) + warc.MAGIC * rng.randint(0, 3), "00" * 20, None) for i in range(30)]
    data, starts = b"".join(made), np.cumsum([0, *map(len, made)]).tolist()[:-1]
    for _ in range(40):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randint(0, 12)))})
        found = [at for a, b in zip(cuts, cuts[1:], strict=False) for at, _ in warc.records(lambda at, n: data[at : at + n], a, b, len(data))]
        assert found == starts
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(lambda at, n: data[:-9][at : at + n], 0, len(data) - 9, len(data) - 9))


@pytest.mark.parametrize("which", [0, 11, 29])
def test_damaged_members_raise(which):
    """The first, a middle and the last member, damaged in magic, head and body, read in one range and in many."""
    rng = random.Random(7)
    made = [warc.record(f"urn:x-page:{i}", "u", rng.randbytes(rng.randint(200, 300)), "00" * 20, None) for i in range(30)]
    starts = np.cumsum([0, *map(len, made)]).tolist()
    for at in (starts[which], starts[which] + 12, starts[which] + len(made[which]) // 2, starts[which] + len(made[which]) - 6):
        data = bytearray(b"".join(made))
        data[at] ^= 0x55
        for cuts in ([0, len(data)], [0, *starts[1:30], len(data)], sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(9))})):
            with pytest.raises((ValueError, zlib.error)):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    list(warc.records(lambda at, n: bytes(data[at : at + n]), a, b, len(data)))  # noqa: B023


def test_warc_members_are_gzip():
    import gzip

    text = gzip.GzipFile(fileobj=io.BytesIO(warc.record("urn:x-page:1", None, b"abc", "00" * 20, 2))).read()
    assert b"WARC-Type: revisit" in text and b"abc" not in text and b"X-Payload-Length: 3" in text


def test_no_pages(spark):
    files = warc.write_warc(spark.createDataFrame([], PAGES), fresh_path(spark, "warc"))
    assert files == [] and warc.read_warc(spark, files).count() == 0


def test_sql_of_warc(spark, small):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = duckdb.sql(warc.SQL)
    got = warc.query(spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert got.where(F.col("record_type").isNull()).count() == 0
