"""Seeded samples, row limits and resuming from a checkpoint."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded_sample(df: DataFrame, ordinal: str, n: int, size: int, seed: int) -> DataFrame:
    """Rows whose 0-based ordinal a seeded draw of `size` out of n picks; all if size is n or more. The draw is of
    ordinals, on the driver, so it is the same wherever the rows lie."""
    if size >= n:
        return df
    picks = [(i,) for i in random.Random(seed).sample(range(n), size)]
    chosen = df.sparkSession.createDataFrame(picks, f"`{ordinal}` long")
    return df.join(chosen, ordinal, "left_semi")


def first_rows(df: DataFrame, order: list[str], limit: int | None, keep=None) -> DataFrame:
    """The first rows in order among those that keep holds for."""
    df = df if keep is None else df.where(keep)
    return df if limit is None else df.orderBy(*order).limit(limit)


def non_blank(a: str, b: str):
    return ~((F.coalesce(F.col(a), F.lit("")) == "") & (F.coalesce(F.col(b), F.lit("")) == ""))


def pending(rows: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def resumed(rows: DataFrame, done: DataFrame, fresh: DataFrame, key: str = "stem") -> DataFrame:
    """Checkpointed results, failures too, of rows that still exist, and fresh ones."""
    return done.join(rows.select(key).distinct(), key, "left_semi").unionByName(fresh)
