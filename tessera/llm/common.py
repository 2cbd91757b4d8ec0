"""Shared plumbing: reading tables, cutting lineage, viewing Arrow text as numpy arrays."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy kernel call looks at (a longer text is taken alone).
PIECE_BYTES = 1 << 19

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset
    and the master is local (one machine, as in tests) a local folder is made and set; elsewhere executors would miss each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, deleted when the application's file system closes."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df under the shared folder and read it back: later stages survive the loss of any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame) -> DataFrame:
    """df in as many partitions as a shuffle has, for rows that are few bytes before they are multiplied: adaptive
    coalescing goes by those bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def released() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run):
    """A task's function that gives freed memory back at its end: idle workers keep no more than they need."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return held


#: Bits of the tables by which tasks pass over rows before a shuffle; a full table only lets more through.
SLOTS = 1 << 23


def marked(df: DataFrame, column: str) -> np.ndarray:
    """The bytes of a table of SLOTS bits, those of the column's longs set: 1 MB at most reaches the driver."""
    slot = F.col(column).bitwiseAND(F.lit(SLOTS - 1)) + 1
    table = np.zeros(SLOTS // 8, np.uint8)
    for r in df.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect():
        table[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return table


def in_table(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    slot = value & (SLOTS - 1)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def wanted(df: DataFrame, table: np.ndarray, column: str) -> DataFrame:
    """The rows of df whose column is in the table, and some others."""

    @trimmed
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_table(table, batch.column(column).to_numpy())))

    return df.mapInArrow(run, df.schema)


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary column; null reads as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type not in (pa.large_string(), pa.large_binary()):
        arr = arr.cast(pa.large_string() if pa.types.is_string(arr.type) else pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null("" if arr.type == pa.large_string() else b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of text: (rows, bytes, offsets)."""
    buf, off = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words `[^\\x20\\x09-\\x0D]+`; no word crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_WHITE[buf]
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    edge = off[:-1][off[1:] > off[:-1]]
    start[edge] = ink[edge]
    end[edge[1:] - 1] = ink[edge[1:] - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(off, s, side="right") - 1


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1024)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, U64(b))
            x[0] = 1
            made.append(np.cumprod(x))
        _POWERS[base] = made
    return _POWERS[base][0], _POWERS[base][1]


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i <= n."""
    return _powers(base, n)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x


class RangeHash:
    """64-bit polynomial hashes of any ranges of a uint64 sequence, after one prefix sum."""

    def __init__(self, symbols: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(symbols)
        pw, self._inv = _powers(base, n)
        self._sum = np.zeros(n + 1, U64)
        np.cumsum(symbols * pw[:n], out=self._sum[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sum[end] - self._sum[start]) * self._inv[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))

    def grams(self, k: int) -> np.ndarray:
        n = len(self._sum) - k
        return mix((self._sum[k:] - self._sum[:n]) * self._inv[:n])


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    h = RangeHash(buf.astype(U64) + U64(1), 0xA0761D6478BD642F)
    return mix(h.raw(s, e) + (e - s).astype(U64) * U64(0xE7037ED1A0B428DB))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def gathered(parts: list[list], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One record batch of the concatenated numpy columns; none if there are no parts."""
    if parts:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays([as_long(c) if c.dtype in (np.uint64, np.int64) else pa.array(c) for c in columns], names)
