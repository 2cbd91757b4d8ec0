"""Texts, segment reports, metric rows, summaries and checkpoints."""

from __future__ import annotations

import json
import sys
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import workbook

REPORT_FIELDS = ["source", "pre_llm", "output", "skipped_llm", "skip_reason", "rejected_model", "reject_reason"]


def write_text(text: str, path: str | None) -> None:
    """A file as it is; standard output with one line end at least."""
    if path in (None, "-"):
        sys.stdout.write(text if not text or text.endswith("\n") else text + "\n")
    else:
        Path(path).write_text(text, encoding="utf-8")


def report_json(model: str) -> Column:
    """Of a row with segments: the report as one JSON string; nulls are kept."""
    segments = F.transform("segments", lambda s: F.struct(*(s[f].alias(f) for f in REPORT_FIELDS)))
    return F.to_json(F.struct(F.lit(model).alias("ollama_model"), segments.alias("segments")), {"ignoreNullFields": "false"})


def trace(segments: DataFrame) -> DataFrame:
    """doc_id, seg_idx, line: SKIP before REJECT before OK, with the reason."""
    tag = F.when(F.col("skipped_llm"), "SKIP").when(F.col("rejected_model"), "REJECT").otherwise("OK")
    reason = F.when(F.col("skip_reason") != "", F.col("skip_reason")).otherwise(F.col("reject_reason"))
    return segments.select("doc_id", "seg_idx", F.concat(F.lit("["), F.col("seg_idx").cast("string"), F.lit("] "), tag, F.lit(" "), reason).alias("line"))


def write_rows(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds metric rows: parquet, csv with a header, or an xlsx workbook of one sheet (workbook.py)."""
    if kind == "xlsx":
        workbook.register(rows.sparkSession)
    rows.write.mode("append").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)


def summary_json(summary: DataFrame) -> str:
    """A one-row summary, nulls left out, letters as they are."""
    row = summary.first().asDict()
    return json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, indent=2)


def save_checkpoint(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds the rows as a batch; a batch that is saved again under its name takes its own place, so a retried save doubles nothing.
    Without a name each save is a batch of its own."""
    rows.write.mode("overwrite").parquet(f"{path}/{batch or uuid.uuid4().hex}")
