"""Error rates and their parts as Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import words


def _distance(a: list[str], b: list[str]) -> int:
    """Unit-cost edit distance, a whole column of the table at a time as the bits of two integers (where neighbours in it
    rise and fall); equal ends are set aside first."""
    lo, x, y = 0, len(a), len(b)
    while lo < x and lo < y and a[lo] == b[lo]:
        lo += 1
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    a, b = a[lo:x], b[lo:y]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rise, fall = every, 0
    for w in b:
        equal = places.get(w, 0)
        across = (((equal & rise) + rise) ^ rise) | equal
        up, down = (fall | ~(across | rise)) & every, rise & across
        score += bool(up & last) - bool(down & last)
        up, down, side = up << 1 | 1, down << 1, equal | fall
        rise, fall = (down | ~(side | up)) & every, up & side & every
    return score


@F.pandas_udf(T.IntegerType())
def word_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else _distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: Words that both texts have, at most, for a distance without Python: private-use characters less two.
NATIVE_WORDS = 6398


def word_distance_native(reference: Column, hypothesis: Column) -> Column:
    """Without Python: each word that both texts have becomes a private-use character of its own; the words that only one text has
    become one character, as they equal nothing. Null beyond NATIVE_WORDS common words."""
    r, h = words(reference), words(hypothesis)
    common = F.array_intersect(r, h)

    def coded(ws: Column, alone: int) -> Column:
        place = F.when(F.size(common) > 0, F.transform(ws, lambda w: F.coalesce(F.nullif(F.array_position(common, w), F.lit(0).cast("long")) + 1, F.lit(alone).cast("long")))).otherwise(F.transform(ws, lambda w: F.lit(alone).cast("long")))
        return F.array_join(F.transform(place, lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 0xE000), 4, "0")), "UTF-16BE")), "")

    return F.when(F.size(common) <= NATIVE_WORDS, F.levenshtein(coded(r, 0), coded(h, 1)))


def _rate(distance: Column, size: Column, other: Column) -> Column:
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance / size)


def wer(reference: Column, hypothesis: Column, distance=word_distance) -> Column:
    return _rate(distance(reference, hypothesis), F.size(words(reference)), F.size(words(hypothesis)))


def cer(reference: Column, hypothesis: Column) -> Column:
    return _rate(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis))


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(0.0)
