"""Places and running sums in a total order, by ranges: no window over a whole table, no task with more than its range.

Rows are sorted by ranges of the order and written, each with its part's number and its own in the part, so places are fixed once and for
all. The parts' sums, a row for each, are added up on the driver; a window within each part adds the rest. Equal rows of the order
are cut apart by their input place, so one key with most of the rows fills several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stage import staged

_OWN = (1 << 33) - 1


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], place: str = "place") -> DataFrame:
    """df with `place`, the row's 0-based place in the order, and for each of the sums its value over the rows up to this one; nulls add nothing.
    Ties come in any order, the same in every read. Sums of doubles are rounded at every step, as any running sum's."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    wide = df.select("*", *keys, *(c.alias(f"_s{i}") for i, c in enumerate(sums.values()))).withColumn("_tie", F.monotonically_increasing_id())
    names = [*(f"_o{i}" for i in range(len(order))), "_tie"]
    sorted_ = wide.repartitionByRange(parts, *names).sortWithinPartitions(*names).drop(*names)
    rows = staged(sorted_.withColumn("_id", F.monotonically_increasing_id()), "scan").withColumn("_part", F.shiftright("_id", 33))
    totals = rows.groupBy("_part").agg(F.count("*").alias("n"), *(F.sum(f"_s{i}").alias(f"s{i}") for i in range(len(sums)))).collect()  # a row a part
    before, table = [0] * (1 + len(sums)), []
    for r in sorted(totals, key=lambda r: r["_part"]):
        table.append((r["_part"], *before))
        before = [b + (x or 0) for b, x in zip(before, list(r)[1:], strict=True)]
    kinds = [dict(rows.agg(*(F.sum(f"_s{i}").alias(f"s{i}") for i in range(len(sums)))).dtypes)[f"s{i}"] for i in range(len(sums))] if sums else []
    schema = ", ".join(["_part long", "_n long", *(f"_b{i} {kind}" for i, kind in enumerate(kinds))])
    cast = [(p, n, *(float(x) if kind == "double" else x for x, kind in zip(xs, kinds, strict=True))) for p, n, *xs in table]
    rows = rows.join(F.broadcast(spark.createDataFrame(cast, schema)), "_part")
    upto = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({name: F.col(f"_b{i}") + F.coalesce(F.sum(f"_s{i}").over(upto), F.lit(0)) for i, name in enumerate(sums)})
    out = out.withColumn(place, F.col("_n") + F.col("_id").bitwiseAND(F.lit(_OWN)))
    return out.drop("_part", "_id", "_n", *(f"_{x}{i}" for i in range(len(sums)) for x in "sb"))


def running_means(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """df with running_rows and running_<column>, the mean of the column over the rows up to this one."""
    found = running(df, order, {f"_t_{c}": F.col(c).cast("double") for c in columns} | {f"_c_{c}": F.col(c).isNotNull().cast("long") for c in columns})
    means = {f"running_{c}": F.when(F.col(f"_c_{c}") > 0, F.col(f"_t_{c}") / F.col(f"_c_{c}")) for c in columns}
    return found.withColumns(means | {"running_rows": F.col("place") + 1}).drop("place", *(f"_{x}_{c}" for c in columns for x in "tc"))
