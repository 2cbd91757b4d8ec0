"""The audio source against the standard library's wave module."""

import io
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tessera.plans import evaluate
from tessera.sources import audio, readers


def wav(frames, rate=16000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(b"\0" * frames * channels * width)
    return out.getvalue()


def with_chunk(data, name, body):
    """A chunk before the format, padded to an even size."""
    return data[:12] + name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2) + data[12:]


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_bytes += len(got)
        return got


@pytest.mark.parametrize(("data", "seconds"), [(wav(8000), 0.5), (wav(44100, 44100, 2, 3), 1.0), (with_chunk(wav(16000), b"LIST", b"odd"), 1.0), (wav(0), None), (b"junk" * 9, None), (b"", None), (wav(800)[:30], None), (wav(16000)[:-16000], 0.5)])
def test_seconds(data, seconds):
    assert audio.riff_seconds(io.BytesIO(data), len(data)) == seconds


def test_samples_are_not_read():
    """A file of a gigabyte, claimed: its length takes 40 bytes."""
    head = bytearray(wav(1)[:44])
    head[40:44] = struct.pack("<I", 1 << 30)
    file = Counted(bytes(head))
    assert audio.riff_seconds(file, 44 + (1 << 30)) == (1 << 30) / 32000 and file.read_bytes <= 44


@pytest.mark.parametrize("most", [1, audio.PARTITION_BYTES])
def test_source(spark, tmp_path, most):
    audio.register(spark)
    files = {"b": wav(8000), "a": wav(16000), "c": b"junk" * 20000}
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    (tmp_path / "other.txt").write_text("x")
    found = spark.read.format("wav").option("partitionBytes", most).load(str(tmp_path))
    got = {r.stem: (r.wav_path, r.wav_bytes, r.est_seconds) for r in found.collect()}
    assert got == {n: (f"{tmp_path}/{n}.wav", len(d), {"a": 1.0, "b": 0.5, "c": 80000 / 1024 / 32}[n]) for n, d in files.items()}
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path))
    assert sorted(r[0] for r in whole.select(evaluate.audio_seconds("content")).collect()) == sorted(x for *_, x in got.values())
    assert found.select(F.sum("est_seconds")).first()[0] > 3 and found.rdd.getNumPartitions() == (3 if most == 1 else 1)


def test_dry_run_of_a_folder(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.wav").write_bytes(wav(16000 * 3))
        (tmp_path / f"{name}.txt").write_text(f" {name} b c\n")
    (tmp_path / "alone.wav").write_bytes(wav(1))
    rows = sorted(evaluate.dry_run(readers.timed_pairs(spark, str(tmp_path))).collect())
    assert [(r.stem, r.est_audio_seconds, r.est_prompt_tokens, r.ref_words) for r in rows] == [("a", 3.0, 131, 3), ("b", 3.0, 131, 3)]
