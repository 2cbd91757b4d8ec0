"""Documents, evaluation pairs, audio pairs, word-index pages and checkpoints as DataFrames."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalized
from tessera.operators.stage import staged
from tessera.sources import audio
from tessera.sources.manifests import PAIR_KEYS, read_manifest

WORD_LINK = r'href="(/word/[^"]+)"'

PAIR_SCHEMA = "row_index int, stt_input string, reference_text string"


def read_document(spark: SparkSession, path: str | None) -> DataFrame:
    """doc_id, text: a file as a whole, or standard input for None and "-"."""
    if path in (None, "-"):
        return spark.createDataFrame([(0, sys.stdin.read())], "doc_id long, text string")
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def load_pairs(spark: SparkSession, path: str, input_field: str = "stt1_text", reference_field: str = "text", row_field: str = "row") -> DataFrame:
    """A manifest of one driver-sized JSON file, checked entry by entry."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if isinstance(data, dict):
        data = next((data[k] for k in PAIR_KEYS if isinstance(data.get(k), list)), None)
    if not isinstance(data, list):
        raise ValueError(f"{path} holds no list of pairs")
    out = []
    for at, entry in enumerate(data, 1):
        if not isinstance(entry, dict):
            raise ValueError(f"entry {at} is not an object")
        for field in (input_field, reference_field):
            if field not in entry:
                raise ValueError(f"entry {at} has no field {field!r}")
        try:
            row = int(entry.get(row_field, at))
        except (TypeError, ValueError):
            row = at
        out.append((row, *("" if entry[f] is None else str(entry[f]).strip() for f in (input_field, reference_field))))
    return spark.createDataFrame(out, PAIR_SCHEMA)


def read_pairs(spark: SparkSession, path: str, input_field: str = "stt1_text", reference_field: str = "text", row_field: str = "row") -> DataFrame:
    """The same for files of any number and size (manifests.py): an entry without a row number has its 1-based place in its file."""
    return read_manifest(spark, path, input_field, reference_field, row_field).select("row_index", "stt_input", "reference_text")


def discover_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """stem, wav_path, wav_bytes (a size), reference_text of each *.wav with a *.txt beside it, by stem."""
    wav = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "length")
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    txt = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    txt = txt.select(stem.alias("stem"), normalized(F.decode("content", "UTF-8")).alias("reference_text"))
    return wav.select(stem.alias("stem"), F.col("path").alias("wav_path"), F.col("length").alias("wav_bytes")).join(txt, "stem").orderBy("stem")


def timed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """stem, wav_path, wav_bytes, seconds, reference_text, as a dry run takes them: of the audio only heads are read (audio.py)."""
    audio.register(spark)
    txt = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    txt = txt.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), normalized(F.decode("content", "UTF-8")).alias("reference_text"))
    return spark.read.format("wav").load(folder).withColumnRenamed("est_seconds", "seconds").join(txt, "stem")


def linked_words(html: Column, pattern: str = WORD_LINK, prefix: str = "/word/") -> Column:
    """Distinct words of a page's links, decoded as RFC 3986 has it: a plus is a plus, a broken escape stays."""
    raw = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x)))
    decoded = F.transform(raw, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    return F.array_distinct(F.filter(decoded, lambda x: x != ""))


def page_words(pages: DataFrame, html: str = "html", **kind) -> DataFrame:
    return pages.select(F.explode(linked_words(F.col(html), **kind)).alias("word")).distinct()


def crawl(fetch, letters, max_pages: int = 1000):
    """Words of an index crawled letter by letter: fetch(letter, page) gives HTML or None. A letter ends at its
    first page that is missing, has no words or none that is new."""
    import re
    from urllib.parse import unquote

    found: set[str] = set()
    for letter in letters:
        own: set[str] = set()
        for page in range(1, max_pages + 1):
            html = fetch(letter, page)
            words = {w for x in re.findall(WORD_LINK, html or "") if (w := unquote(x.removeprefix("/word/")))}
            if html is None or not words or words <= own:
                break
            own |= words
        found |= own
    return found


def crawled_words(pages: DataFrame, words: Column, letter: str = "letter", page: str = "page", max_pages: int = 1000) -> DataFrame:
    """(letter, word), distinct, of stored pages as `crawl` would find them: a letter ends before its first page, counted from 1, that is missing, has no
    words or none that an earlier page of the letter hasn't. A word is new on its first page, so the pages with a new word are those that are
    some word's first; the crawl ends at the least number that isn't one."""
    found = pages.select(F.col(letter).alias("letter"), F.col(page).cast("long").alias("page"), F.explode(words).alias("word")).where(F.col("page").between(1, max_pages))
    first = staged(found.groupBy("letter", "word").agg(F.min("page").alias("page")), "words")
    fresh = first.select("letter", "page").distinct()
    after = fresh.select("letter", (F.col("page") + 1).alias("page")).union(fresh.select("letter", F.lit(1).cast("long").alias("page")))
    ends = after.join(fresh, ["letter", "page"], "left_anti").groupBy("letter").agg(F.min("page").alias("end"))
    return first.join(ends, "letter").where(F.col("page") < F.col("end")).select("letter", "word")


def read_checkpoint(spark: SparkSession, path: str, schema, key: str | None = None) -> DataFrame:
    """The rows saved so far, of all batches; none if there is no checkpoint yet. key: one row for each of its values."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.dropDuplicates([key]) if key else rows
