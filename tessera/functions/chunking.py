"""Sentences and chunks as array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WHITE, strip

#: Latin, Armenian and Arabic sentence ends; an ellipsis is none.
SENTENCE_END = r".!?։؟"


def sentences(c: Column) -> Column:
    """Of the stripped text, so no part has white space at its ends; only an empty text has an empty part."""
    return F.filter(F.split(strip(c), f"(?<=[{SENTENCE_END}])[{WHITE}]+"), lambda s: s != "")


def greedy(parts: Column, size: int) -> Column:
    """Joined by a space, in order, while a chunk's length stays within size."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc.open) + 1 + F.length(s) <= size
        return F.struct(
            F.when(acc.open.isNull() | fits, acc.done).otherwise(F.concat(acc.done, F.array(acc.open))).alias("done"),
            F.when(acc.open.isNotNull() & fits, F.concat(acc.open, F.lit(" "), s)).otherwise(s).alias("open"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.open))))


def hard_split(c: Column, size: int) -> Column:
    """Slices of size, each stripped, empty ones dropped."""
    last = F.greatest(F.ceil(F.length(c) / size) - 1, F.lit(0)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(c, i * size + 1, F.lit(size)))), lambda s: s != "")


def chunks(c: Column, size: int = 800) -> Column:
    found = greedy(sentences(c), size)
    return F.flatten(F.transform(found, lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(hard_split(s, size))))
