"""Manifests of any size: JSON arrays of objects, read by byte ranges.

Spark's text source cuts a file at every `{`, whatever splits it makes of it, so an array of objects becomes pieces that tasks read on their own. Whether
a piece begins within a string isn't known there: its quotes and brackets are counted both ways, as if it did and as if it
didn't. Within a block (one split) a running sum of quotes tells pieces apart up to the block's own start; the blocks' sums, a row for each,
are added up in order, which settles how each block starts, and so every piece's depth. A piece that begins outside a string
at depth 1 begins an entry; counts of entries, added up the same way, number them in each file and over all files. The pieces of an entry (more than one where it holds a
`{`) are joined again by that number.

Cases: blocks may begin anywhere, within strings, escapes and entries. A file whose text is an object that holds the list is read whole by
one task instead, as is one with a byte order mark; both kinds may lie in one folder. An entry that isn't an object or lacks a field, and a file without a list, raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized
from tessera.operators.stage import staged

#: Keys under which a pairs object may hold its list, in order of preference.
PAIR_KEYS = ("pairs", "data", "items", "rows")
_ENTRY = "map<string,string>"
#: What stands before the first entry of an array, or all of an empty one.
_HEAD = r"^\s*\[\s*(\]\s*)?$"


def _net(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\[{]", "")) - F.length(F.regexp_replace(c, r"[^\]}]", ""))


def _every_second(parts: Column, first: int) -> Column:
    """Net brackets of the parts 0, 2, ... or 1, 3, ... between quotes."""
    nets = F.transform(parts, lambda x, i: F.when(i % 2 == first, _net(x)).otherwise(0))
    return F.aggregate(nets, F.lit(0), lambda a, x: a + x)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split begins), id (in order within a block), text between two `{`, head (nothing is before it in its file); staged."""
    read = spark.read.option("lineSep", "{").text(path)
    meta = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = staged(meta.withColumn("id", F.monotonically_increasing_id()), "pieces")
    first = rows.where("block = 0").groupBy("file").agg(F.min("id").alias("head"))
    return rows.join(F.broadcast(first), "file").select("file", "block", "id", F.col("value").alias("text"), (F.col("id") == F.col("head")).alias("head"))


def _blocks(spark: SparkSession, found: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(found, schema))


def array_entries(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """file, number (from 1 in the file), ordinal (from 0 over all files, by path), entry (its JSON) of files that are arrays."""
    parts = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    lead = F.when(F.col("head"), 0).otherwise(1)
    rows = pieces.withColumn("parts", parts).select("file", "block", "id", "text", "head", (F.size("parts") - 1).alias("quotes"), (lead + _every_second(F.col("parts"), 0)).alias("outside"), _every_second(F.col("parts"), 1).alias("inside"))
    own = Window.partitionBy("file", "block").orderBy("id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    # Either way: what the piece adds to the depth if its block begins outside a string, and if within one.
    rows = rows.withColumn("odd", odd)
    ways = {"depth0": F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")), "depth1": F.when(F.col("odd") == 0, F.col("inside")).otherwise(F.col("outside"))}
    rows = staged(rows.withColumns(ways).select("file", "block", "id", "text", "head", "odd", "quotes", "depth0", "depth1"), "ways")
    sums = rows.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("depth0").alias("depth0"), F.sum("depth1").alias("depth1")).collect()
    starts, file, odd_, depth = [], None, 0, 0
    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, odd_, depth = r["file"], 0, 0
        starts.append((r["file"], r["block"], odd_, depth))
        depth += r["depth1"] if odd_ else r["depth0"]
        odd_ = (odd_ + r["quotes"]) % 2
    if not starts:
        return spark.createDataFrame([], "file string, number long, ordinal long, entry string")
    rows = rows.join(_blocks(spark, starts, "file string, block long, start int, depth long"), ["file", "block"])
    adds = F.when(F.col("start") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    depth_before = F.col("depth") + F.coalesce(F.sum(adds).over(before), F.lit(0))
    begins = ~F.col("head") & ((F.col("start") + F.col("odd")) % 2 == 0) & (depth_before == 1)
    rows = staged(rows.select("file", "block", "id", "text", "head", begins.cast("int").alias("begins")), "begins")
    counts = rows.groupBy("file", "block").agg(F.sum("begins").alias("n")).collect()
    numbers, file, n, total = [], None, 0, 0
    for r in sorted(counts, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, n = r["file"], 0
        numbers.append((r["file"], r["block"], n, total))
        n, total = n + r["n"], total + r["n"]
    rows = rows.join(_blocks(spark, numbers, "file string, block long, had long, had_all long"), ["file", "block"])
    upto = F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("file", "block", "id", "text", "head", (F.col("had") + upto).alias("number"), (F.col("had_all") + upto - 1).alias("ordinal"))
    joined = rows.where("number > 0").groupBy("file", "number").agg(F.max("ordinal").alias("ordinal"), F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("all"))
    whole = F.concat(F.lit("{"), F.array_join(F.transform("all", lambda p: p.text), "{"))
    # An entry, then commas, white space and the array's end.
    entry, rest = F.regexp_extract(whole, r"(?s)^(.*\})[^}]*$", 1), F.regexp_extract(whole, r"(?s)\}([^}]*)$", 1)
    good = F.when(rest.rlike(r"^\s*(,|\])\s*$"), entry)
    return joined.select("file", "number", "ordinal", good.alias("entry"))


def whole_entries(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, number, entries of files that are objects with a list, a file a task."""
    held = ", ".join(f"{k} array<string>" for k in PAIR_KEYS)
    read = spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    wrapped = F.from_json(F.ltrim(F.regexp_replace("value", "^﻿", "")), held)
    bare = F.from_json(F.regexp_replace("value", "^﻿", ""), "array<string>")
    found = F.when(F.regexp_replace("value", "^﻿", "").rlike(r"^\s*\["), bare).otherwise(F.coalesce(*(wrapped[k] for k in PAIR_KEYS)))
    checked = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(" holds no list of pairs"))).cast("array<string>"))
    return read.select("file", F.posexplode(checked).alias("at", "entry")).select("file", (F.col("at") + 1).cast("long").alias("number"), "entry")


def read_manifest(spark: SparkSession, path: str, input_field: str = "stt1_text", reference_field: str = "text", row_field: str = "row") -> DataFrame:
    """ordinal (unique over all files, in order of path and place), file, row_index (of the entry, or its 1-based place in its file), stt_input, reference_text."""
    found = pieces(spark, path)
    kind = F.when(~F.col("text").rlike(r"^\s*\["), "other").when(F.col("text").rlike(_HEAD), "array").otherwise("bad")
    heads = {r["file"]: r["kind"] for r in found.where("head").select("file", kind.alias("kind")).collect()}  # a row a file
    if bad := [f for f, kind in heads.items() if kind == "bad"]:
        raise ValueError(f"{bad[0]} holds no list of pairs: its first entry is not an object")
    arrays, others = [f for f, kind in heads.items() if kind == "array"], [f for f, kind in heads.items() if kind == "other"]
    listed = array_entries(spark, found.join(F.broadcast(spark.createDataFrame([(f,) for f in arrays], "file string")), "file", "left_semi"))
    if others:
        whole = staged(whole_entries(spark, others), "whole")
        counts = {r["file"]: r["n"] for r in whole.groupBy("file").agg(F.count("*").alias("n")).collect()}
        counts |= {r["file"]: r["n"] for r in listed.groupBy("file").agg(F.max("number").alias("n")).collect()}
        offsets, total = [], 0
        for f in sorted(counts):
            offsets.append((f, total))
            total += counts[f]
        both = listed.select("file", "number", "entry").unionByName(whole)
        at = F.col("offset") + F.col("number") - 1
        listed = both.join(F.broadcast(spark.createDataFrame(offsets, "file string, offset long")), "file").select("file", "number", at.alias("ordinal"), "entry")
    where = F.concat(F.lit("entry "), F.col("number").cast("string"), F.lit(" of "), F.col("file"))
    parsed = F.from_json("entry", _ENTRY)
    rows = listed.select("file", "number", "ordinal", F.when(F.col("entry").rlike(r"^\s*\{") & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(where, F.lit(" is not an object"))).cast(_ENTRY)).alias("e"))

    def field(name: str) -> Column:
        missing = F.raise_error(F.concat(where, F.lit(f" has no field '{name}'"))).cast("string")
        return normalized(F.when(F.map_contains_key("e", F.lit(name)), F.coalesce(F.col("e")[name], F.lit(""))).otherwise(missing))

    row = F.coalesce(F.col("e")[row_field].try_cast("int"), F.col("number").cast("int"))
    return rows.select("ordinal", "file", row.alias("row_index"), field(input_field).alias("stt_input"), field(reference_field).alias("reference_text"))
