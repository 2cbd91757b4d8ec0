"""Places in a total order without moving a table into one task.

A bounded sample of the order's first key cuts the rows into ranges; ranges are counted, numbered within and offset by the counts
before them. Equal keys stay in one range.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys drawn to cut ranges, and ranges.
SAMPLE, RANGES = 4000, 64


def _range(df: DataFrame, key: Column) -> Column:
    """The number of the row's range, the same in every run over the same rows and bounds."""
    drawn = [r[0] for r in df.select(key.alias("k"), F.xxhash64(key).alias("h")).where("k is not null").distinct().orderBy("h", "k").limit(SAMPLE).collect()]
    drawn.sort()
    bounds = [drawn[i] for i in sorted({i * len(drawn) // RANGES for i in range(1, RANGES)})] if len(drawn) > RANGES else drawn[1:]
    tests = [(key >= F.lit(b)).cast("int") for b in bounds]
    return F.coalesce(functools.reduce(operator.add, tests), F.lit(0)) if tests else F.lit(0)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`, the row's 0-based place (a long) in the order. Ties beyond the order are numbered in any way."""
    ranged = df.withColumn("_range", _range(df, order[0]))
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # RANGES rows at most
    before, offsets = 0, []
    for number, count in counts:
        offsets += [F.lit(number), F.lit(before)]
        before += count
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    place = F.try_element_at(F.create_map(*offsets), F.col("_range")) + own if offsets else F.lit(0)
    return ranged.withColumn(name, place.cast("long")).drop("_range")
