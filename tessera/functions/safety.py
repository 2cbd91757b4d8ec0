"""Which segments go to a language model, and which of its answers are accepted."""

from __future__ import annotations

import functools
import operator
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rules import AMBIGUOUS_PAIRS
from tessera.functions.text import GATE_LETTERS, once, script_ratio, strip, strip_sentence_end, word_count, words


def gate(c: Column, letters: str = GATE_LETTERS) -> Column:
    """Why a segment is not sent, or "ok"."""
    t = strip(c)
    n = word_count(t)
    return (
        F.when(t == "", "empty")
        .when(n < 2, "too_few_words")
        .when(script_ratio(t, letters) < 0.55, "low_georgian_letter_ratio")
        .when((n == 2) & (F.length(t) < 12), "very_short_two_token")
        .otherwise("ok")
    )


def _ends_alike(a: str, i: int, m: int, b: str, j: int, n: int) -> int:
    """Characters that a from i to m and b from j to n begin with alike."""
    size = min(m - i, n - j)
    if a[i : i + size] == b[j : j + size]:
        return size
    lo, hi = 0, size - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[i + lo : i + mid] == b[j + lo : j + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def matcher_ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio(). Rows of characters that b lacks, or has so often that difflib leaves them out, are passed
    over, and matches grow by halves of what is left, not by characters."""
    if not a and not b:
        return 1.0
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if len(b) >= 200:
        places = {x: js for x, js in places.items() if len(js) <= len(b) // 100 + 1}
    own = [i for i, x in enumerate(a) if x in places]
    back, forth = a[::-1], b[::-1]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size, before, runs = alo, blo, 0, -2, {}
        for at in own[bisect_left(own, alo) : bisect_left(own, ahi)]:
            last, runs = runs if at == before + 1 else {}, {}
            before = at
            for to in places[a[at]]:
                if to >= blo:
                    if to >= bhi:
                        break
                    n = runs[to] = last.get(to - 1, 0) + 1
                    if n > size:
                        i, j, size = at - n + 1, to - n + 1, n
        n = _ends_alike(back, len(a) - i, len(a) - alo, forth, len(b) - j, len(b) - blo)
        i, j, size = i - n, j - n, size + n
        size += _ends_alike(a, i + size, ahi, b, j + size, bhi)
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return 2.0 * total / (len(a) + len(b))


def _ratios(a: pd.Series, b: pd.Series) -> list[float | None]:
    return [None if x is None or y is None else matcher_ratio(x, y) for x, y in zip(a, b, strict=True)]


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """difflib's similarity, its popularity heuristic included: no built-in has it."""
    for a, b in pairs:
        yield pd.Series(_ratios(a, b), dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("shown", T.StringType())]))
def shown_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """sequence_ratio and its %.3f, so that one worker does both."""
    for a, b in pairs:
        found = _ratios(a, b)
        yield pd.DataFrame({"ratio": pd.Series(found, dtype="float64"), "shown": pd.Series([None if r is None else f"{r:.3f}" for r in found], dtype=object)})


@F.pandas_udf(T.StringType())
def three_places(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Python's %.3f: of the double's exact value, ties to even, where Spark's takes the decimal form, half up."""
    for s in values:
        yield s.map(lambda x: None if x != x else f"{x:.3f}").astype(object)


def differences(a: Column, b: Column) -> Column:
    """Pairs of unlike words at equal places, as far as the shorter list goes."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x != y, F.struct(x.alias("a"), y.alias("b"))))
    return F.filter(pairs, lambda p: p.isNotNull())


def ambiguous_swap(a: Column, b: Column, pairs: list[tuple[str, str]] = AMBIGUOUS_PAIRS) -> Column:
    """Whether two texts differ in one word only, and that by a pair of forms which are both right. Texts without any of these forms aren't cut into words."""
    listed = F.array(*(F.array(*(F.lit(w) for w in sorted(p))) for p in pairs)) if pairs else F.array().cast("array<array<string>>")

    def only(d: Column) -> Column:
        one = F.try_element_at(d, F.lit(1))
        return (F.size(d) == 1) & F.array_contains(listed, F.array_sort(F.array(one.a, one.b)))

    def unlike(t: Column) -> Column:
        none = ~functools.reduce(operator.or_, (F.contains(t.a, F.lit(w)) for w in sorted({w for p in pairs for w in p})), F.lit(False))
        return F.when((t.a == t.b) | none, F.lit(False)).otherwise(once(F.struct(words(t.a).alias("x"), words(t.b).alias("y")), lambda w: (F.size(w.x) == F.size(w.y)) & once(differences(w.x, w.y), only)))

    return once(F.struct(a.alias("a"), b.alias("b")), unlike)


def with_verdict(df: DataFrame, original: str, candidate: str, min_ratio: float = 0.75, max_relative: float = 1.30, pairs: list[tuple[str, str]] = AMBIGUOUS_PAIRS, structural: bool = False, ratio: Column | None = None) -> DataFrame:
    """df with accepted, reason and ratio; the first rule that holds decides. The ratio is null where an earlier rule
    decides, and is left out, rule and column, if `structural`; a similarity of the caller's own may take difflib's place. Texts' parts are columns of their own while the
    rules are judged, so that each is made once."""
    parts = {"_o": strip(F.col(original)), "_c": strip(F.col(candidate))}
    df = df.withColumns(parts).withColumns({"_oe": strip_sentence_end(F.col("_o")), "_ce": strip_sentence_end(F.col("_c"))})
    df = df.withColumn("_early", F.when(F.col("_c") == "", "empty_output").when(F.col("_o") == F.col("_c"), "unchanged").when(F.col("_oe") == F.col("_ce"), "trailing_punctuation_only"))
    if not structural:
        late = F.col("_early").isNull()
        if ratio is None:
            df = df.withColumn("_r", shown_ratio(F.when(late, F.col("_oe")), F.when(late, F.col("_ce")))).withColumns({"ratio": F.col("_r.ratio"), "_shown": F.col("_r.shown")}).drop("_r")
        else:
            df = df.withColumn("ratio", F.when(late, ratio)).withColumn("_shown", three_places(F.col("ratio")))
    df = df.withColumns({"_ow": words(F.col("_o")), "_cw": words(F.col("_c"))}).withColumn("_d", differences(F.col("_ow"), F.col("_cw")))
    n, m, d = F.size("_ow"), F.size("_cw"), F.size("_d")
    one = F.try_element_at("_d", F.lit(1))
    expansion = (n == m) & (d == 1) & (F.length(one.a) <= 5) & (F.length(one.b) >= F.length(one.a) + 2)
    reason = F.when(F.col("_early").isNotNull(), F.col("_early"))
    if not structural:
        reason = reason.when(F.col("ratio") < min_ratio, F.concat(F.lit("sequence_ratio_low:"), F.col("_shown")))
    reason = (
        reason.when(F.length("_c") > max_relative * F.length("_o") + 8, "output_much_longer")
        .when((n >= 6) & (m > n + 4), "many_extra_words")
        .when(expansion, "single_token_expansion")
        .when((F.least(n, m) > 0) & ((d + F.abs(n - m)) / F.greatest(n, F.lit(1)) > 0.70), "too_many_tokens_changed")
        .when(ambiguous_swap(F.col("_oe"), F.col("_ce"), pairs), "ambiguous_equivalent_morphology")
        .otherwise("ok")
    )
    df = df.withColumn("reason", reason).drop("_o", "_c", "_oe", "_ce", "_early", "_ow", "_cw", "_d", "_shown")
    return df.withColumn("accepted", F.col("reason").isin("unchanged", "ok"))
