"""Repeated lines removed by sharded minimal perfect hashes over the keys of lines.

A line's key is the line without white space at its ends and with A-Z in lower case; keys of LEAST code points or more count, by two
64-bit hashes. Keys of several documents are gathered by one grouped count (which Spark combines before it shuffles). They are
dealt to shards; a shard is one row: a minimal perfect hash of its keys (levels of bits, of which a key takes the first
that is its alone; its place is the number of bits before), and beside it, by place, an array of 64-bit fingerprints (the second
hash, so that a key outside the shard is taken for one of it with probability 2**-64), one of counts of documents and one of the
smallest doc_ids. Documents send their keys, once each, to the shards and probe the arrays there; lines are never joined. A shard whose keys
occur often is dealt to several groups of probes, as its counts tell beforehand, so that no line, however common, makes one task longer.
Places of lines to drop come back to their documents, whose texts are read anew.

Cases: null and empty texts are one empty line, which stays. A null doc_id is one document that comes after all others. Rows of one doc_id are one
document: a line that only they have stays in all of them. Repeated rows keep a row each, extra columns are ignored, an
empty table gives an empty result. Lines of any length and number are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, cut, load, marked, mix, trimmed, wanted

#: Code points of the shortest key that counts.
LEAST = 10
#: Keys of a shard, about, and bits of a level for each key that is left.
SHARD, GAMMA = 1 << 16, 2
#: Rows of an output batch.
BATCH = 1 << 14
_KEY = "h1 long, h2 long, doc_id long, key long, at int"
_LAST = (1 << 63) - 1


def line_keys(text: str | None, least: int = LEAST) -> dict[bytes, int]:
    """16 bytes for each distinct key of the text's lines: the number of its first line."""
    found: dict[bytes, int] = {}
    for i, line in enumerate((text or "").encode().split(b"\n")):
        # bytes strip the six white characters and lower A-Z, nothing else.
        key = line.strip().lower()
        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
            found.setdefault(xxhash.xxh3_128_digest(key), i)
    return found


def without(text: str | None, drop: list[int] | None) -> tuple[int, int, str]:
    """(lines, dropped lines, kept text): a line goes if its key is that of a line in drop."""
    lines = (text or "").split("\n")
    if not drop:
        return len(lines), 0, text or ""
    key = [line.encode().strip().lower() for line in lines]
    gone = {key[i] for i in drop}
    kept = [line for line, k in zip(lines, key, strict=True) if k not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit hashes."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @staticmethod
    def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        # An odd factor for each level: pairs that differ part at some level.
        return (mix(a + b * U64(2 * level + 1)) % U64(size)).astype(np.int64)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, bits = [], []
        while len(a):
            size = max(64, -(-GAMMA * len(a) // 64) * 64)
            slot = cls._slots(a, b, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            levels.append(size)
            rest = ~alone[slot]
            a, b = a[rest], b[rest]
        return cls(levels, np.concatenate(bits) if bits else np.zeros(0, np.uint64))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's place, from 0; of pairs that aren't held any place, or -1."""
        out, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.levels):
            slot = base + self._slots(a[open_], b[open_], level, size)
            word, bit = self.bits[slot >> 6], (slot & 63).astype(U64)
            hit = (word >> bit & U64(1)).astype(bool)
            below = word & ((U64(1) << bit) - U64(1))
            out[open_[hit]] = (self.before[slot >> 6] + np.bitwise_count(below))[hit]
            open_, base = open_[~hit], base + size
        return out


def _keys(least: int, path=None):
    """Batches of (doc_id, text, key) to a row for each distinct key of each row."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            columns = [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "key", "at"])

        hashes, ids, keys, places = [], [], [], []
        for batch in batches:
            for i, text, key in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("key").to_pylist(), strict=True):
                found = line_keys(text.as_py(), least)
                hashes += found
                places += found.values()
                ids += [_LAST if i is None else i] * len(found)
                keys += [key] * len(found)
                if len(ids) >= BATCH:
                    yield made()
                    hashes, ids, keys, places = [], [], [], []
        if ids:
            yield made()

    return run


def _shard(table: pa.Table) -> pa.Table:
    """The keys of a shard to its one row."""
    a, b = (table.column(c).to_numpy().view(U64) for c in ("h1", "h2"))
    held = PerfectHash.of(a, b)
    place = held(a, b)
    arrays = [np.empty(len(a), k) for k in (np.uint64, np.uint32, np.int64)]
    for to, values in zip(arrays, (b, np.minimum(table.column("n").to_numpy(), 0xFFFFFFFF), table.column("lo").to_numpy()), strict=True):
        to[place] = values
    row = {"shard": [table.column("shard")[0].as_py()], "levels": [held.levels], "bits": [held.bits.tobytes()]}
    row |= {name: [x.tobytes()] for name, x in zip(("fingerprints", "counts", "least"), arrays, strict=True)}
    return pa.table(row, pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("bits", "fingerprints", "counts", "least"))]))


_SHARD = "shard int, levels array<int>, bits binary, fingerprints binary, counts binary, least binary"


def _probed(probes: pa.Table, shards: pa.Table) -> pa.Table:
    """The probes of one group to those whose lines go: the shard has their key, with another document before theirs."""
    out = probes.select(["key", "at"])
    if not shards.num_rows or not probes.num_rows:
        return out.slice(0, 0)
    row = shards.slice(0, 1).to_pylist()[0]
    held = PerfectHash(row["levels"], np.frombuffer(row["bits"], np.uint64))
    fingerprints, counts, least = (np.frombuffer(row[c], k) for c, k in (("fingerprints", np.uint64), ("counts", np.uint32), ("least", np.int64)))
    a, b = (probes.column(c).to_numpy().view(U64) for c in ("h1", "h2"))
    place = held(a, b)
    go = (place >= 0) & (fingerprints[place] == b) & (counts[place] > 1) & (least[place] < probes.column("doc_id").to_numpy())
    return out.filter(pa.array(go))


def _dropped():
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [without(t.as_py(), d) for t, d in zip(part.column("text"), part.column("drop").to_pylist(), strict=True)]
                columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_lines, n_dropped, kept (the text without the lines that go)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    texts = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = texts.mapInArrow(_keys(least), _KEY)
    several = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    several = cut(several.select("h1", "h2", "n", "lo"), "lines")
    total = several.agg(F.count("*").alias("keys"), F.sum("n").alias("probes")).first()
    if not total["keys"]:
        return texts.select("doc_id", "text", F.lit(None).cast("array<int>").alias("drop")).mapInArrow(_dropped(), "doc_id long, n_lines long, n_dropped long, kept string")
    shards = max(4 * tasks, -(-total["keys"] // SHARD))
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    index = cut(several.select(shard, "h1", "h2", "n", "lo").groupBy("shard").applyInArrow(_shard, _SHARD), "index")
    # Groups of probes: a shard that gets more than an eighth of a task's share is dealt to several, of which there are eight a task at most.
    most = max(1, total["probes"] // (8 * tasks))
    dealt = several.select(shard, "n").groupBy("shard").agg(F.ceil(F.sum("n") / most).cast("int").alias("groups")).where("groups > 1").collect()
    groups = np.ones(shards, np.int32)
    for r in dealt:
        groups[r["shard"]] = r["groups"]
    sent = wanted(keys, marked(several, "h1"), "h1").mapInArrow(_addressed(groups), f"shard int, part int, {_KEY}")
    copies = index.mapInArrow(_copied(groups), f"part int, {_SHARD}")
    answers = sent.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probed, "key long, at int")
    answers = answers.groupBy("key").agg(F.collect_set("at").alias("drop"))
    return texts.join(answers, "key", "left").select("doc_id", "text", "drop").mapInArrow(_dropped(), "doc_id long, n_lines long, n_dropped long, kept string")


def _addressed(groups: np.ndarray):
    """Adds the shard of a key, and which of the shard's groups the row goes to (any will do; equal rows go to all)."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("h1").to_numpy() % len(groups)
            place = np.arange(batch.num_rows, dtype=U64) * U64(0x9E3779B97F4A7C15)
            part = mix(batch.column("key").to_numpy().view(U64) + place) % groups[shard].astype(U64)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(part.astype(np.int32)), *batch.columns], ["shard", "part", *batch.schema.names])

    return run


def _copied(groups: np.ndarray):
    """A shard's row for each of its groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                for part in range(groups[shard]):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(c.slice(i, 1) for c in batch.columns)], ["part", *batch.schema.names])

    return run


#: Keys by text; a document is its doc_id.
SQL = f"""
WITH line AS MATERIALIZED (
  SELECT doc_id, i, x, translate(regexp_replace(regexp_replace(x, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
judged AS (
  SELECT doc_id, i, x, length(k) >= {LEAST} AND min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def query(spark, sf_dir):
    return line_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
