"""Lexicons as one-column DataFrames, and rescoring of unknown words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import variants
from tessera.functions.rules import CONFUSIONS, DROPPED_LETTERS, MAX_DELETIONS, MAX_INSERTIONS, MAX_SUBSTITUTIONS, symmetric
from tessera.functions.text import cores_pattern, long_cores, nfc, replaced_cores, strip
from tessera.operators.spread import widened
from tessera.operators.stage import staged

#: Cores of fewer letters are never replaced.
MIN_LETTERS = 5


def lexicon_of_lines(lines: DataFrame) -> DataFrame:
    """lines(value): stripped, without blanks and # comments, NFC, distinct."""
    line = lines.select(strip(F.col("value")).alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return line.distinct().select(nfc(F.col("line")).alias("word")).distinct()


def read_lexicon(spark, path: str | None) -> DataFrame | None:
    return None if path is None else lexicon_of_lines(spark.read.text(path))


def merge(*lexicons: DataFrame) -> DataFrame:
    out = lexicons[0].select("word")
    for x in lexicons[1:]:
        out = out.union(x.select("word"))
    return out.distinct()


def write_lexicon(lexicon: DataFrame, path: str, header: str = "# words") -> None:
    """One text file: a header line, then words by (lower case, word)."""
    line = lexicon.select(F.lit(1).alias("part"), F.col("word").alias("value"))
    head = lexicon.sparkSession.createDataFrame([(0, header)], "part int, value string")
    out = head.union(line).orderBy("part", F.lower("value"), "value").select("value")
    out.coalesce(1).write.mode("overwrite").text(path)


def unknown(cores: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct cores that the lexicon lacks."""
    return cores.select("core").distinct().join(lexicon.select(F.col("word").alias("core")), "core", "left_anti")


def _without_each(word: Column, make) -> Column:
    """make(place, letter, rest) for each letter of a word; the rest is the word without it."""

    def at(i: Column) -> Column:
        return make(i, F.substring(word, i, F.lit(1)), F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))

    return F.transform(F.sequence(F.lit(1), F.length(word)), at)


def _key(kind: str, place, rest: Column, letter=None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(0) if place is None else place).alias("place"), rest.alias("rest"), (F.lit("") if letter is None else letter).alias("letter"))


def _unlimited(length: int, confusions: dict[str, list[str]], letters: str) -> bool:
    """Whether no generator's limit can bind for words of this length."""
    most = max(map(len, confusions.values()), default=0)
    return most * length <= MAX_SUBSTITUTIONS and len(letters) * (length + 1) <= MAX_INSERTIONS and length <= MAX_DELETIONS


def replacements(cores: DataFrame, lexicon: DataFrame, confusions: dict[str, str] = CONFUSIONS, letters: str = DROPPED_LETTERS) -> DataFrame:
    """(core, best) for unknown cores of at least MIN_LETTERS. Each candidate is one edit away, so the
    nearest is the smallest candidate in the lexicon.

    Words meet without one letter: a core without a letter that is a word (deletion), a word without a letter
    that is a core (insertion), or both without a letter at the same place (substitution). That is two rows a
    letter and one join, not a row a variant. Only cores so long that a generator's limit can bind are generated."""
    c, w, both = F.col("core"), F.col("word"), symmetric(confusions)
    odd = widened(unknown(cores.where(F.length(c) >= MIN_LETTERS), lexicon), "core")
    longest = next(n for n in range(1000) if not _unlimited(n + 1, both, letters))
    near = F.array_union(F.array_union(variants.substitutions(c, confusions), variants.insertions(c, letters)), variants.deletions(c))
    short = F.concat(_without_each(c, lambda i, x, rest: _key("word", None, rest)), _without_each(c, lambda i, x, rest: _key("swap", i, rest, x)), F.array(_key("added", None, c)))
    sought = odd.select("core", F.explode(F.when(F.length(c) <= longest, short).otherwise(F.transform(near, lambda v: _key("word", None, v)))).alias("k")).select("core", "k.*")
    added = F.filter(_without_each(w, lambda i, x, rest: _key("added", None, rest, x)), lambda k: k.letter.isin(*letters))
    offered = lexicon.where(w != "").select("word", F.explode(F.concat(F.array(_key("word", None, w)), _without_each(w, lambda i, x, rest: _key("swap", i, rest, x)), added)).alias("k"))
    offered = offered.select("word", "k.kind", "k.place", "k.rest", F.col("k.letter").alias("other"))
    table = F.create_map(*(x for a, bs in both.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    allowed = (F.col("kind") != "swap") | F.coalesce(F.array_contains(F.try_element_at(table, F.col("letter")), F.col("other")), F.lit(False))
    return sought.join(offered, ["kind", "place", "rest"]).where(allowed).groupBy("core").agg(F.min("word").alias("best"))


def rescored(segments: DataFrame, lexicon: DataFrame | None, key: list[str], text: str = "working", preserve: str | None = "preserve", **tables) -> DataFrame:
    """segments with `text` rescored; cores listed in `preserve` stay. key: columns that tell rows apart. Only segments' unknown cores are shuffled,
    once to distinct words and once back, never the texts' other tokens. The lexicon, and the unknown words with what replaces them, are
    staged: each is read more than once. segments are read three times, so whoever makes them at some cost stages them."""
    if lexicon is None:
        return segments
    lexicon = staged(lexicon.select("word"), "lexicon")
    cores = F.array_distinct(long_cores(F.col(text), MIN_LETTERS))
    if preserve:
        cores = F.array_except(cores, F.col(preserve))
    exploded = segments.select(*key, F.explode(cores).alias("core"))
    best = exploded.join(staged(replacements(exploded, lexicon, **tables), "replacements"), "core")
    table = best.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("core", "best"))).alias("best"))

    found = replaced_cores(F.col(text), cores_pattern(F.map_keys("best")), F.col("best"))
    out = F.when(F.col("best").isNull(), F.col(text)).otherwise(found)
    return segments.join(table, key, "left").withColumn(text, out).drop("best")
