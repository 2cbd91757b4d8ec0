"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: each record is a gzip member of its own. Of records with equal payloads of at least MIN_REVISIT
bytes the one with the largest id is the response, the others are revisits of it without the payload. The
choice shuffles only digests and ids; the payloads are dealt to archive files by page_id. A task writes its file under a
name of its own and renames it when whole, so a repeated or lost task leaves no half archive.

Reader: files are cut into byte ranges of any size, without an index. A task looks in its range for the
gzip magic, takes a place for a member only if what is there inflates to a WARC record head, decodes members from there on (each
member's checksum is verified), and owns the records that start inside its range, reading on past the range's end as
needed. No damage passes in silence: a file begins with a record, where a record ends another's head must be readable (its
task looks, even beyond its range), and what has a head must be whole; else ValueError or zlib.error. Archives lie under the shared folder, reached by pyarrow's file systems (file, hdfs, s3, gs).

Cases: null html is an empty payload. A null page_id is written without a choice (always a response) and read back as
null; so are null urls. Blanks, control characters and letters beyond ASCII in a url are percent-encoded in the archive. Repeated page_ids keep a record each; with equal payloads the one response is any of them. Extra columns are
ignored. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh_path, load, trimmed

MIN_REVISIT = 1000
#: Bytes of archive that a reading task looks through, of one read, and that are inflated at a time.
SPLIT, READ, CHUNK = 8 << 20, 1 << 20, 1 << 14
LEVEL = 2

MAGIC = b"\x1f\x8b\x08"
_ID = "urn:x-page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. The payload's length and digest are in the head even of a revisit."""
    body = b"" if refers_to is not None else payload
    block = _HTTP + str(len(payload)).encode() + b"\r\n\r\n" + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=string.punctuation)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """A record's fields and payload; ValueError if it isn't whole."""
    top, found, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not head.get("content-length", "").isdigit() or len(rest) < int(head["content-length"]):
        raise ValueError("short record")
    block = rest[: int(head["content-length"])]
    return head | {"payload": block.partition(b"\r\n\r\n")[2]}


def _page(name: str) -> int | None:
    tail = name.strip("<>").removeprefix(_ID)
    return int(tail) if tail.lstrip("-").isdigit() else None


def _writer(folder: str):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, target, temp, out, size = TaskContext.get(), None, None, None, 0
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    files, root = file_system(folder)
                    files.create_dir(root, recursive=True)
                    target, temp = f"{root}/part-{task.partitionId():06d}.warc.gz", f"{root}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(temp)
                name = f"{_ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
                size += out.write(record(name, url, (html or "").encode(), digest, refers))
        if out is not None:
            out.close()
            files.move(temp, target)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task.partitionId():06d}.warc.gz"]), pa.array([size], pa.int64())], ["name", "size"])

    return run


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> list[tuple[str, int]]:
    """Writes pages(page_id, url, html) under folder; (file, bytes) of each archive."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("large", F.length(payload) >= min_revisit)
    large = rows.where("large and page_id is not null").select("digest", "page_id")
    latest = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # The cut lets a join with one very common digest be divided.
    revisits = large.join(cut(latest, "latest"), "digest").where("page_id <> refers_to").distinct()
    dealt = rows.drop("large").join(revisits, ["digest", "page_id"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return [(f"{folder}/{name}", size) for name, size in dealt.mapInArrow(_writer(folder), "name string, size long").collect()]


def records(read, start: int, end: int, size: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in bytes start to end of an archive; read(at, n) gives bytes, fewer at the end."""
    buf, base = bytearray(), start  # buf holds the archive from base on

    def held(at: int, n: int = CHUNK) -> bytes:
        """Up to n bytes at a place at or behind the last one asked for."""
        nonlocal base
        if at - base > READ:
            del buf[: at - base]
            base = at
        while base + len(buf) < min(size, at + n):
            got = read(base + len(buf), READ)
            if not got:
                raise ValueError("archive ends early")
            buf.extend(got)
        return bytes(buf[at - base : at - base + n])

    def at_head(at: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(held(at), 5) == b"WARC/"
        except zlib.error:
            return False

    at, synced = start, start == 0  # synced: a record must start here
    while at < end:
        if not at_head(at):
            if synced:
                raise ValueError(f"no record at {at}")
            found = held(at + 1, READ).find(MAGIC)
            if found < 0 and at + READ >= size:
                return
            at += 1 + found if found >= 0 else READ - len(MAGIC) + 1
            continue
        z, data, fed = zlib.decompressobj(31), [], at
        while not z.eof:
            if not (chunk := held(fed)):
                raise ValueError("archive ends in a member")
            data.append(z.decompress(chunk))
            fed += len(chunk)
        yield at, parse(b"".join(data))
        at, synced = fed - len(z.unused_data), True
    if synced and at < size and not at_head(at):
        raise ValueError(f"no record at {at}")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, payload binary"


def _reader(payloads: bool, split: int):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                files, name = file_system(path)
                with files.open_input_file(name) as f:
                    for at, r in records(lambda at, n, f=f: f.read_at(min(n, size - at), at), start, min(size, start + split), size):  # noqa: B023
                        stored = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        response = r["warc-type"] == "response"
                        if response and (hashlib.sha1(r["payload"]).hexdigest() != stored or len(r["payload"]) != int(r["x-payload-length"])):
                            raise ValueError(f"payload of {path} at {at} differs from its digest")
                        url = r.get("warc-target-uri")
                        yield (_page(r["warc-record-id"]), url, int(r["x-payload-length"]), stored, r["warc-type"], None if response else _page(r["warc-refers-to"]), path, at, r["payload"] if payloads and response else None)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[-1] or b"") + 200
            if size > READ:
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names)

    return run


def read_warc(spark: SparkSession, files: list[tuple[str, int]], payloads: bool = True, split: int = SPLIT) -> DataFrame:
    """A row for each record of the archives, a task for each `split` bytes; payloads only of responses, and only on demand."""
    splits = spark.createDataFrame(files or [("", 0)], "path string, size long").where("size > 0")
    splits = splits.select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")).alias("start"))
    count = max(1, sum(-(-size // split) for _, size in files))
    return splits.repartition(min(count, 10_000)).mapInArrow(_reader(payloads, split), _READ)


def query(spark, sf_dir):
    files = write_warc(load(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_warc(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last_id THEN last_id END AS refers_to, url
FROM q
"""
