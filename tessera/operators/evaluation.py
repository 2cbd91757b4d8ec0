"""Row metrics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.metrics import cer, tokens_per_second, wer
from tessera.functions.text import normalized, word_count
from tessera.operators.exact import Exact, one_row

# The columns of metric rows, in order.
ROW_COLUMNS = ["row_index", "stt_input", "reference_text", "prediction", "wer", "cer", "execution_time_s", "output_tokens", "tokens_per_second"]
SPEECH_COLUMNS = ["stem", "wav_path", "reference_text", "prediction", "wer", "cer", "execution_time_s", "prompt_tokens", "output_tokens", "total_tokens", "error"]


def scored(df: DataFrame, reference: str = "reference_text", prediction: str = "prediction") -> DataFrame:
    """Adds wer, cer and output_tokens, and tokens_per_second where there is a time."""
    r, p = F.col(reference), F.col(prediction)
    df = df.withColumns({"wer": wer(r, p), "cer": cer(r, p), "output_tokens": word_count(p)})
    if "execution_time_s" in df.columns:
        df = df.withColumn("tokens_per_second", tokens_per_second(F.col("output_tokens"), F.col("execution_time_s")))
    return df


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows_processed, means of rows' rates and times, medians of times, all exact. Without rows only the count isn't null.
    The rows are computed once; this runs five jobs at most."""
    means = [c for c in ("wer", "cer", "execution_time_s", "tokens_per_second") if c in rows.columns]
    middle = [c for c in ("execution_time_s", "tokens_per_second") if c in rows.columns]
    found = Exact(rows, {c: F.col(c) for c in means}, middle)
    columns = {"rows_processed": (found.count(), "long")}
    columns |= {f"average_{c}": (found.mean(c), "double") for c in means} | {f"median_{c}": (found.median(c), "double") for c in middle}
    return one_row(rows.sparkSession, columns)


def speech_summary(rows: DataFrame, skipped: int = 0) -> DataFrame:
    """Counts over all rows, everything else over those without an error."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    tokens = ("prompt_tokens", "output_tokens", "total_tokens")
    found = Exact(rows, {c: F.when(ok, F.col(c)) for c in ("wer", "cer", "execution_time_s", *tokens)} | {"scored": F.when(ok, 1)}, ["wer", "cer"])
    scored_rows = found.count("scored")
    columns = {"rows_processed": (found.count(), "long"), "rows_scored": (scored_rows, "long"), "rows_failed": (found.count() - scored_rows, "long"), "rows_skipped_resume": (skipped, "int")}
    for c in ("wer", "cer"):
        columns |= {f"average_{c}": (found.mean(c), "double"), f"median_{c}": (found.median(c), "double")}
    columns["average_execution_time_s"] = (found.mean("execution_time_s"), "double")
    for c in tokens:
        total = found.sum(c)
        columns[f"total_{c.removeprefix('total_')}"] = (None if total is None else int(total), "long")
    columns["total_execution_time_s"] = (found.sum("execution_time_s"), "double")
    return one_row(rows.sparkSession, columns)


def normalize_pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: normalized(F.col(c)) for c in columns})
