"""Workbooks read back with the standard library."""

import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tessera.sources import workbook, writers

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def rows_of(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and set(workbook._PARTS) < set(z.namelist())
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    out = []
    for row in sheet.iter(f"{NS}row"):
        out.append([])
        for c in row.iter(f"{NS}c"):
            v, t = c.find(f"{NS}v"), c.find(f"{NS}is/{NS}t")
            out[-1].append(t.text or "" if t is not None else None if v is None else bool(int(v.text)) if c.get("t") == "b" else float(v.text))
    return out


def test_rows_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "rows.xlsx")
    data = [(i, f"<ა> & \"{i}\"\n é\x01", i / 3, i % 2 == 0, None) for i in range(500)]
    df = spark.createDataFrame(data, "i int, `the text` string, rate double, ok boolean, none string").repartition(7)
    writers.write_rows(df.orderBy("i"), path, "xlsx")
    want = [["i", "the text", "rate", "ok", "none"]] + [[i, t.replace("\x01", " "), r, ok, None] for i, t, r, ok, _ in data]
    assert rows_of(path) == want
    writers.write_rows(df.where("i < 3").orderBy(F.desc("i")), path, "xlsx")
    assert rows_of(path) == want + [want[3], want[2], want[1]]
    df.where("i = 9").write.format("xlsx").mode("overwrite").save(path)
    assert rows_of(path) == [want[0], want[10]] and os.listdir(tmp_path) == ["rows.xlsx"]
    df.limit(0).write.format("xlsx").mode("overwrite").save(path)
    assert rows_of(path) == want[:1]


def test_failed_writes_leave_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows.xlsx")
    bad = spark.range(20).select(F.when(F.col("id") == 17, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("x")).repartition(4)
    with pytest.raises(Exception, match="stop"):
        writers.write_rows(bad, path, "xlsx")
    assert os.listdir(tmp_path) == []
