"""Audio files as a source that never reads samples: spark.read.format("wav").load(folder), after register(spark).

The driver lists the folder and packs files into partitions by what opening them costs; a task reads of each file only the heads of its RIFF chunks, a few bytes
each, skipping from chunk to chunk by their sizes. A file's length in seconds is that of its data by its format, or, where there
is no such header, its size by KB_PER_SECOND, one second at least. Columns: stem, wav_path, wav_bytes, est_seconds.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.ship import ship

#: Kilobytes a second of 16 kHz mono 16-bit audio; bytes of a partition, about.
KB_PER_SECOND, PARTITION_BYTES = 32.0, 128 << 20
#: What opening a file counts as, in bytes.
OPEN_BYTES = 1 << 20
_SCHEMA = "stem string, wav_path string, wav_bytes long, est_seconds double"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def riff_seconds(file, size: int) -> float | None:
    """Seconds of the data of a RIFF WAVE file that can seek, by chunk heads alone; None without them. A data chunk that claims more than the
    file has, as streams write it, counts as what there is."""
    if size < 12:
        return None
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, rate = 12, 0
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt " and length >= 12 and at + 20 <= size:
            rate = struct.unpack("<HHII", file.read(12))[3]
        elif name == b"data":
            found = min(length, size - at - 8)
            return found / rate if rate and found else None
        at += 8 + length + length % 2
    return None


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class AudioReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _system(self.path)
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.path.endswith(".wav"))
        parts: list[list[tuple[str, int]]] = []
        room = 0
        for file in found:
            if not parts or room < OPEN_BYTES:
                parts.append([])
                room = self.most
            parts[-1].append(file)
            room -= OPEN_BYTES  # only heads are read
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = _system(self.path)
        for path, size in partition.files:
            with system.open_input_file(path) as f:
                seconds = riff_seconds(f, size)
            stem = path.rsplit("/", 1)[-1].removesuffix(".wav")
            yield stem, f"{self.path.rstrip('/')}{path[len(root.rstrip('/')):]}", size, seconds if seconds is not None else max(1.0, size / 1024 / KB_PER_SECOND)


class Audio(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> AudioReader:
        return AudioReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Audio)
