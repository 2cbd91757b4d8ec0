"""Exact sums, means and medians of columns, the same whatever the partitions.

A table's values become (name, bits, n): how often each value occurs in each column, by the value's 64 bits in an order that is
the numbers' order. That is one pass with one shuffle, combined before it, so equal values are one row, however many there are. Everything else
reads that small table:

- Sums: a value is a whole number of at most 53 bits times a power of two. The whole numbers, times n, are added as decimals for each power, which loses
  nothing; the driver adds some thousand such sums as Python's unbounded integers and rounds once. The result is math.fsum's.
- Medians: radix selection on the ordered bits, DIGIT bits a round, for all columns at once; a round's counts are at most 2**DIGIT
  rows for each middle. It ends early where one value is left. The first round's job also brings the sums.

Nulls are left out, -0.0 is 0.0; NaN is larger than all other values, and with NaN or infinities among its values a column's sum is what adding gives.
"""

from __future__ import annotations

import struct
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stage import staged

DIGIT = 16
_LOW = (1 << 63) - 1
#: The name that stands for the rows themselves.
ROWS = ""


def ordered_bits(value: Column) -> Column:
    """A long for each double, ordered as the doubles are."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_LOW)))


def value_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ _LOW))[0]


def counted(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, bits, n) of the columns, staged; under ROWS each row counts once."""
    every = [F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in {ROWS: F.lit(0.0), **columns}.items()]
    values = df.select(F.explode(F.array(*every)).alias("x")).select("x.name", "x.v").where("v is not null")
    return staged(values.select("name", ordered_bits(F.col("v")).alias("bits")).groupBy("name", "bits").agg(F.count("*").alias("n")), "counts")


def _parts(bits: Column) -> tuple[Column, Column]:
    """The power of two (0 for all below the normal range) and the whole number with its sign, of ordered bits."""
    raw = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_LOW)).bitwiseAND(F.lit(_LOW)))
    power = F.shiftright(raw, 52)
    whole = raw.bitwiseAND(F.lit((1 << 52) - 1)) + F.when(power > 0, F.lit(1 << 52)).otherwise(F.lit(0))
    return F.greatest(power, F.lit(1)), F.when(bits >= 0, whole).otherwise(-whole)


class Exact:
    """counts(name), sum(name), mean(name), median(name) of df's columns; five jobs at most, all in the constructor."""

    def __init__(self, df: DataFrame, columns: dict[str, Column], medians: list[str] | None = None):
        counts = counted(df, columns)
        power, whole = _parts(F.col("bits"))
        unsigned = F.col("bits").bitwiseXOR(F.lit(-1 << 63))
        first = counts.groupBy("name", F.shiftrightunsigned(unsigned, 64 - DIGIT).alias("digit"), power.alias("power"))
        found = first.agg(F.sum("n").alias("n"), F.sum(whole.cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).alias("whole"), F.min("bits").alias("lo"), F.max("bits").alias("hi")).collect()
        self._n: dict[str, int] = dict.fromkeys([ROWS, *columns], 0)
        sums: dict[str, Fraction] = dict.fromkeys(columns, Fraction(0))
        odd: dict[str, float] = {}
        for r in found:
            self._n[r["name"]] += r["n"]
            if r["power"] == 0x7FF:  # infinities and NaN
                odd[r["name"]] = odd.get(r["name"], 0.0) + value_of(r["lo"]) + value_of(r["hi"])
            elif r["name"]:
                sums[r["name"]] += int(r["whole"]) * Fraction(2) ** (r["power"] - 1075)
        self._sums = {name: odd.get(name, float(x)) for name, x in sums.items()}
        self._medians = self._select(counts, found, list(columns) if medians is None else medians)

    def _select(self, counts: DataFrame, found: list, names: list[str]) -> dict[str, float | None]:
        # Each middle: (column, which) to the number of values before it in what is left; then its prefix.
        left = {(c, at): at for c in names if self._n[c] for at in {(self._n[c] - 1) // 2, self._n[c] // 2}}
        prefix, bits = dict.fromkeys(left, 0), {}
        rows = [(r["name"], 0, r["digit"], r["n"], r["lo"], r["hi"]) for r in found]
        for rnd in range(64 // DIGIT):
            digits: dict[tuple[str, int], dict[int, list]] = {}
            for name, before, digit, n, lo, hi in rows:
                at = digits.setdefault((name, before), {}).setdefault(digit, [0, lo, hi])
                at[0], at[1], at[2] = at[0] + n, min(at[1], lo), max(at[2], hi)
            for key in [k for k in left if k not in bits]:
                for digit, (n, lo, hi) in sorted(digits[key[0], prefix[key]].items()):
                    if left[key] < n:
                        prefix[key] = prefix[key] << DIGIT | digit
                        if lo == hi:
                            bits[key] = lo
                        break
                    left[key] -= n
            open_ = sorted({(k[0], prefix[k]) for k in left if k not in bits})
            if not open_:
                break
            unsigned = F.col("bits").bitwiseXOR(F.lit(-1 << 63))
            taken = DIGIT * (rnd + 1)
            before, digit = F.shiftrightunsigned(unsigned, 64 - taken), F.shiftrightunsigned(unsigned, 64 - taken - DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1))
            some = F.lit(False)
            for name, p in open_:
                some |= (F.col("name") == name) & (before == F.lit(p))
            more = counts.where(some).groupBy("name", before.alias("before"), digit.alias("digit")).agg(F.sum("n").alias("n"), F.min("bits").alias("lo"), F.max("bits").alias("hi"))
            rows = [tuple(r) for r in more.collect()]
        out: dict[str, float | None] = {}
        for c in names:
            middle = [value_of(bits[k]) for k in bits if k[0] == c]
            out[c] = sum(middle) / len(middle) if middle else None
        return out

    def count(self, name: str = ROWS) -> int:
        return self._n[name]

    def sum(self, name: str) -> float | None:
        return self._sums[name] if self._n[name] else None

    def mean(self, name: str) -> float | None:
        return self._sums[name] / self._n[name] if self._n[name] else None

    def median(self, name: str) -> float | None:
        return self._medians[name]


def one_row(spark, columns: dict[str, tuple[object, str]]) -> DataFrame:
    """A row of values with their kinds."""
    return spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"`{c}` {kind}" for c, (_, kind) in columns.items()))


__all__ = ["Exact", "counted", "one_row", "ordered_bits", "value_of"]
