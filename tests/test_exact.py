"""Exact sums and medians against math.fsum and statistics."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.operators.exact import Exact


def columns(rng, n):
    wide = [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(n)]
    cancel = [x for i in range(n // 2) for x in (1e16 + i, -1e16 + 0.1 * i)][:n]
    same = [0.0 if rng.random() < 0.9 else rng.random() for _ in range(n)]
    tiny = [rng.choice((5e-324, -1e-310, 3e-308, 0.0, -0.0)) for _ in range(n)]
    holes = [None if rng.random() < 0.3 else rng.randint(-5, 5) / 4 for _ in range(n)]
    return {"wide": wide, "cancel": cancel + [None] * (n - len(cancel)), "same": same, "tiny": tiny, "holes": holes, "none": [None] * n}


@pytest.mark.parametrize(("n", "parts"), [(1, 1), (2, 3), (1001, 7), (1000, 2)])
def test_sums_and_medians(spark, n, parts):
    data = columns(random.Random(n), n)
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(parts)
    found = Exact(df, {c: F.col(c) for c in data})
    assert found.count() == n
    for c, values in data.items():
        held = [v for v in values if v is not None]
        assert found.count(c) == len(held)
        assert found.sum(c) == (math.fsum(held) if held else None)
        assert found.mean(c) == (statistics.fmean(held) if held else None)
        assert found.median(c) == (statistics.median(held) if held else None)


def test_infinities(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("inf"), float("nan")), (2.0, float("inf"))], "a double, b double")
    found = Exact(df, {"a": F.col("a"), "b": F.col("b")})
    assert found.sum("a") == math.inf and found.median("a") == 2.0 and math.isnan(found.sum("b")) and found.median("b") == math.inf


def test_few_jobs_and_no_large_task(spark):
    """The input is read once, and equal values are one row."""
    df = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id") / 7).alias("wer"), F.lit(0.5).alias("cer"), F.lit(0.0).alias("execution_time_s"), (F.col("id") % 3).alias("tokens_per_second"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("exact", "exact")
    row = evaluation.summary(df).first()
    jobs = tracker.getJobIdsForGroup("exact")
    spark.sparkContext.setJobGroup("default", "default")
    assert (row.rows_processed, row.average_cer, row.median_execution_time_s, row.median_tokens_per_second) == (40_000, 0.5, 0.0, 1.0)
    assert row.average_wer == math.fsum(i / 7 for i in range(0, 40_000, 10)) / 40_000
    assert len(jobs) <= 12  # a query may take a job for each exchange


def test_no_rows(spark):
    empty = spark.createDataFrame([], "wer double, cer double, execution_time_s double, tokens_per_second double, prompt_tokens int, output_tokens int, total_tokens int, error string")
    row = evaluation.summary(empty).first()
    assert row.rows_processed == 0 and row.average_wer is None and row.median_tokens_per_second is None
    row = evaluation.speech_summary(empty, 2).first()
    assert (row.rows_scored, row.rows_skipped_resume, row.total_total_tokens if "total_total_tokens" in row else row.total_tokens) == (0, 2, None)
