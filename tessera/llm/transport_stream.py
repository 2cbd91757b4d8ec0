"""Media columns: byte payloads as MPEG transport streams, and their reader.

The writer puts a payload on one elementary stream of private data: a program association table and a program map table, then
PES packets of UNIT bytes with timestamps, cut into packets of 188 bytes with continuity counters.
Each PES packet begins with a random-access point and a clock reference. The reader checks sync bytes and the tables'
checksums, finds the stream by the tables, checks continuity counters, reassembles the PES packets and
returns payload, timestamps and random-access points. Packets of one text are handled as one numpy matrix.

Cases: null and empty texts are 64 zero bytes. Null doc_ids and repeated rows keep a row each; extra
columns are ignored. A stream that is not whole packets, has a wrong sync byte or a bad table raises ValueError, and so do lost or
reordered packets (a gap in the counters, or a PES packet of another length than its head says), unless `strict` is false: then the
errors are counted and such units are left out of the payload. A packet sent twice, as the format allows, counts once.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import load

BLOCK = 64
#: Payload bytes of a PES packet, and its ticks of the 90 kHz clock.
UNIT, TICKS = 32_768, 3_600

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
_CLOCK_FIELD = 8  # adaptation field with a clock reference
_PES_HEADER = 14


@functools.lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        x = i << 24
        for _ in range(8):
            x = (x << 1) ^ (0x04C11DB7 if x & 0x80000000 else 0)
        table.append(x & 0xFFFFFFFF)
    return table


@functools.lru_cache(256)
def section_crc(data: bytes) -> int:
    """CRC-32 as of program tables: most significant bit first, no final inversion; 0 over a section with its own."""
    x, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        x = ((x << 8) & 0xFFFFFFFF) ^ table[(x >> 24) ^ b]
    return x


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@functools.lru_cache(1)
def _tables() -> np.ndarray:
    pat = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = [bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(x.ljust(PACKET, b"\xff") for x in out), np.uint8).reshape(2, PACKET)


def _stamp(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | (ticks >> 29 & 0x0E) | 1]) + ((ticks >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((ticks << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | (int.from_bytes(b[1:3], "big") >> 1) << 15 | int.from_bytes(b[3:5], "big") >> 1


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [_tables()], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], i * TICKS & 0x1FFFFFFFF
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
        first = PACKET - 4 - _CLOCK_FIELD
        n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
        p = np.empty((n, PACKET), np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        p[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        field = bytes([_CLOCK_FIELD - 1, 0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big")
        p[0, 4 : 4 + _CLOCK_FIELD] = np.frombuffer(field, np.uint8)
        body = np.frombuffer(pes, np.uint8)
        if n == 1:  # stuffing lengthens the field that is there
            spare = first - len(pes)
            p[0, 4] += spare
            p[0, 4 + _CLOCK_FIELD : PACKET - len(pes)] = 0xFF
            p[0, PACKET - len(pes) :] = body
        else:
            p[0, PACKET - first :] = body[:first]
            whole, rest = divmod(len(pes) - first, PACKET - 4)
            p[1 : 1 + whole, 4:] = body[first : first + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
            if rest:
                spare = PACKET - 4 - rest
                p[-1, 3] |= 0x20
                p[-1, 4] = spare - 1
                p[-1, 5 : 4 + spare] = 0xFF
                if spare > 1:
                    p[-1, 5] = 0
                p[-1, 4 + spare :] = body[-rest:]
        out.append(p)
    return np.concatenate(out).tobytes()


class Stream(NamedTuple):
    payload: bytes
    pid: int
    stream_type: int
    packets: int
    timestamps: list[int]
    random_access: list[int]  # packet numbers
    continuity_errors: int
    broken_units: list[int]  # PES packets that aren't whole


def _table(packet: np.ndarray, table_id: int) -> bytes:
    """The body of the section in a packet."""
    b = packet.tobytes()
    at = 5 + (1 + b[4] if b[3] & 0x20 else 0)
    at += b[at - 1]
    size = int.from_bytes(b[at + 1 : at + 3], "big") & 0xFFF
    section = b[at : at + 3 + size]
    if section[0] != table_id or len(section) != 3 + size or section_crc(section):
        raise ValueError("bad program table")
    return section[8:-4]


def demux(media: bytes, strict: bool = True) -> Stream:
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not len(p) or (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]

    def table(of: int, table_id: int) -> bytes:
        at = np.flatnonzero((pid == of) & (p[:, 1] & 0x40 > 0))
        if not len(at):
            raise ValueError("no program table")
        return _table(p[at[0]], table_id)

    pat = table(PAT_PID, 0x00)
    programs = [int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(pat), 4) if pat[i : i + 2] != b"\0\0"]
    pmt = table(programs[0], 0x02)
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    kind, data_pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    number = np.flatnonzero((pid == data_pid) & (p[:, 3] & 0x10 > 0))
    own = p[number]
    fresh = np.append(True, (own[1:] != own[:-1]).any(1))[: len(own)]
    own, number = own[fresh], number[fresh]
    counter = own[:, 3].astype(np.int64) & 15
    errors = int((counter[1:] != (counter[:-1] + 1) % 16).sum())
    if strict and errors:
        raise ValueError("lost or reordered packets")
    field = np.where(own[:, 3] & 0x20 > 0, own[:, 4].astype(np.int64) + 1, 0)
    access = (field > 1) & (own[:, 5] & 0x40 > 0)
    size = PACKET - 4 - field
    data = own[np.arange(PACKET) >= (4 + field)[:, None]].tobytes()
    end = np.cumsum(size)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    if strict and len(own) and (not len(begins) or begins[0]):
        raise ValueError("the stream begins inside a PES packet")
    starts = (end - size)[begins].tolist()
    parts, stamps, broken = [], [], []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
        if data[a : a + 3] != b"\0\0\1":
            raise ValueError("no PES packet where one begins")
        length, header = int.from_bytes(data[a + 4 : a + 6], "big"), 9 + data[a + 8]
        if data[a + 7] & 0x80:
            stamps.append(_ticks(data[a + 9 : a + 14]))
        if length and b - a != 6 + length:
            if strict:
                raise ValueError(f"PES packet {i} has {b - a - 6} bytes of {length}")
            broken.append(i)
        else:
            parts.append(data[a + header : b])
    return Stream(b"".join(parts), data_pid, kind, len(p), stamps, number[access].tolist(), errors, broken)


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, media = [], []
        for text in batch.column("text"):
            b = (text.as_py() or "").encode()
            size.append(len(b))
            media.append(mux(b.ljust(max(1, -(-len(b) // BLOCK)) * BLOCK, b"\0")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes and media, the transport stream of the padded UTF-8 bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>"


def _read(batches: Iterable[pa.RecordBatch], strict: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, n in zip(batch.column("media"), batch.column("n_bytes").to_pylist(), strict=True):
            media = x.as_py()
            s = demux(media, strict)
            if strict and n is not None and n > len(s.payload):
                raise ValueError(f"{len(s.payload)} bytes of payload, of {n}")
            feature = f"pid={s.pid};type={s.stream_type};packets={s.packets};units={len(s.timestamps)};access={len(s.random_access)};last_pts={max(s.timestamps, default=-1)};errors={s.continuity_errors + len(s.broken_units)}"
            out.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.timestamps, s.random_access))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [c for c in batch.schema.names if c != "media"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [*names, *(x.split()[0] for x in _FEATURES.split(", "))])


def stream_features(media: DataFrame, strict: bool = True) -> DataFrame:
    """Reads the streams of media(doc_id, n_bytes, media) back: payload digests, timestamps, random-access points."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(functools.partial(_read, strict=strict), f"doc_id long, n_bytes long, {_FEATURES}")


def query(spark, sf_dir):
    return stream_features(media_column(load(spark, sf_dir, "documents"))).drop("timestamps", "random_access")
