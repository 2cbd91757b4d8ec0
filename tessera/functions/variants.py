"""Words one edit away, as array Columns: in order of position, without repeats, up to a limit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rules import CONFUSIONS, DROPPED_LETTERS, MAX_DELETIONS, MAX_INSERTIONS, MAX_SUBSTITUTIONS, symmetric


def _at_each(word: Column, last: Column, make, limit: int) -> Column:
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.slice(F.array_distinct(F.flatten(F.transform(places, make))), 1, limit)


def _cut(word: Column, i: Column, drop: int) -> tuple[Column, Column]:
    return F.substring(word, F.lit(1), i - 1), F.substring(word, i + drop, F.length(word))


def substitutions(word: Column, confusions: dict[str, str] = CONFUSIONS, limit: int = MAX_SUBSTITUTIONS) -> Column:
    """Alternatives come in code-point order, which decides what a limit within one position leaves."""
    table = F.create_map(*(x for a, bs in symmetric(confusions).items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))

    def make(i: Column) -> Column:
        head, tail = _cut(word, i, 1)
        found = F.coalesce(F.try_element_at(table, F.substring(word, i, F.lit(1))), F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.concat(head, x, tail))

    return _at_each(word, F.length(word), make, limit)


def insertions(word: Column, letters: str = DROPPED_LETTERS, limit: int = MAX_INSERTIONS) -> Column:
    def make(i: Column) -> Column:
        head, tail = _cut(word, i, 0)
        return F.array(*(F.concat(head, F.lit(x), tail) for x in letters))

    return _at_each(word, F.when(word == "", 0).otherwise(F.length(word) + 1), make, limit)


def deletions(word: Column, limit: int = MAX_DELETIONS) -> Column:
    def make(i: Column) -> Column:
        return F.array(F.concat(*_cut(word, i, 1)))

    return _at_each(word, F.when(F.length(word) < 2, 0).otherwise(F.length(word)), make, limit)
