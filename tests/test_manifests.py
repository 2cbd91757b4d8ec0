"""Manifests by byte ranges against json.loads, whatever the ranges."""

import json
import random

import pytest

from tessera.sources import readers
from tessera.sources.manifests import read_manifest


def text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "ა", "\n", " ", "\\{", '{"a":1}', "😀"]) for _ in range(rng.randint(0, 12)))


def entries(rng, n):
    out = []
    for _ in range(n):
        e = {"stt1_text": rng.choice((text(rng), None, 5, text(rng))), "text": text(rng), "extra": rng.choice((text(rng), {"deep": [{"x": text(rng)}]}, [1, {"y": "}"}]))}
        if rng.random() < 0.5:
            e["row"] = rng.choice((rng.randrange(100), "7", "x", None))
        out.append(dict(rng.sample(sorted(e.items(), key=str), len(e))))
    return out


def plain(files):
    out, ordinal = [], 0
    for found in files:
        for at, e in enumerate(found, 1):
            try:
                row = int(e.get("row", at))
            except (TypeError, ValueError):
                row = at
            out.append((ordinal, row, *("" if e[f] is None else str(e[f]).strip() for f in ("stt1_text", "text"))))
            ordinal += 1
    return out


@pytest.mark.parametrize("size", [40, 1000, 1 << 20])
def test_any_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    files = [entries(rng, n) for n in (12, 1, 5)]
    for i, found in enumerate(files):
        held = {"meta": {"a": [1]}, "items": found} if i == 1 else found
        (tmp_path / f"{i}.json").write_text(json.dumps(held, ensure_ascii=i == 0, indent=rng.choice((None, 1))), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = sorted((r.ordinal, r.row_index, r.stt_input, r.reference_text) for r in read_manifest(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain(files)


@pytest.mark.parametrize("bad", ['{"pairs": 1}', '["x"]', "[1, 2]", '[{"text": "a"}]', '[{"stt1_text": "a", "text": "b"}, 7]', "3", ""])
def test_bad_manifests(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(bad)
    if bad == "":
        assert readers.read_pairs(spark, str(tmp_path)).count() == 0  # no bytes, no file for Spark
        return
    with pytest.raises(Exception, match="no list of pairs|no field|not an object"):
        readers.read_pairs(spark, str(tmp_path)).collect()


def test_empty_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ ]\n")
    (tmp_path / "b.json").write_text('[{"stt1_text": "a", "text": "b"}]')
    assert [tuple(r) for r in read_manifest(spark, str(tmp_path)).drop("file").collect()] == [(0, 1, "a", "b")]
