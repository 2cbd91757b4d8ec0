"""Text functions as Columns. White space is Unicode's plus U+001C to U+001F, as str.isspace has it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"\p{IsWhite_Space}\x1c-\x1f"
WHITE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Mkhedruli, Asomtavruli and Mtavruli blocks, by letter gate and by retrieval.
GATE_LETTERS, RETRIEVAL_LETTERS = r"Ⴀ-ჿᲐ-Ჿ", r"Ⴀ-ჿ"
TRAILING, SENTENCE_FINAL = ".,!?…", ".!?…"


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; Spark has no such built-in."""
    for s in texts:
        yield s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def normalized(c: Column) -> Column:
    """Null to empty, then stripped."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{WHITE}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Runs of white space and of other characters, in order; joined they are the text."""
    return F.regexp_extract_all(c, F.lit(f"([^{WHITE}]+|[{WHITE}]+)"), F.lit(1))


def is_space(token: Column) -> Column:
    return token.rlike(f"^[{WHITE}]")


def core(token: Column) -> Column:
    return F.rtrim(token, F.lit(TRAILING))


def trail(token: Column) -> Column:
    return F.substring(token, F.length(core(token)) + 1, F.length(token))


def strip_sentence_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_CHARS + SENTENCE_FINAL))


def count_chars(c: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{cls}]+", ""))


def script_ratio(c: Column, letters: str = GATE_LETTERS) -> Column:
    """Characters of a script over letters; 0 without letters."""
    all_letters = count_chars(c, r"\p{L}")
    return F.when(all_letters == 0, 0.0).otherwise(count_chars(c, letters) / all_letters)


def letter_ratio(c: Column, letters: str = RETRIEVAL_LETTERS) -> Column:
    """Letters of a script over letters; 1 without letters."""
    all_letters = count_chars(c, r"\p{L}")
    return F.when(all_letters == 0, 1.0).otherwise(F.length(F.regexp_replace(c, rf"[^\p{{L}}]|[^{letters}]", "")) / all_letters)


def long_cores(c: Column, least: int) -> Column:
    """Cores of at least `least` (2 or more) characters, in order."""
    return F.regexp_extract_all(c, F.lit(f"(?<![^{WHITE}])([^{WHITE}]{{{least - 1},}}[^{WHITE}{TRAILING}])[{TRAILING}]*+(?![^{WHITE}])"), F.lit(1))


def cores_pattern(keys: Column) -> Column:
    """A pattern of the tokens' cores that an array of strings lists."""
    quoted = F.transform(keys, lambda k: F.concat(F.lit(r"\Q"), F.replace(k, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(f"(?<![^{WHITE}])(?:"), F.array_join(quoted, "|"), F.lit(f")(?=[{TRAILING}]*+(?![^{WHITE}]))"))


def once(value: Column, make) -> Column:
    """make(value), with the value made once, however often make uses it."""
    return F.try_element_at(F.transform(F.array(value), make), F.lit(1))


def replaced_cores(c: Column, pattern: Column, table: Column) -> Column:
    """The text with the cores that the pattern finds replaced by table, a map; only these are looked at one by one."""

    def joined(found: Column) -> Column:
        pairs = F.zip_with(F.split(c, pattern), found, lambda part, k: F.concat(part, F.coalesce(F.try_element_at(table, k), k, F.lit(""))))
        return F.when(F.size(found) == 0, c).otherwise(F.array_join(pairs, ""))

    return once(F.regexp_extract_all(c, pattern, F.lit(0)), joined)


def fix_tokens(c: Column, fixes: dict[str, str]) -> Column:
    """Whole cores by table; trailing punctuation and white space stay."""
    if not fixes:
        return c
    table = F.create_map(*(F.lit(x) for pair in fixes.items() for x in pair))
    if any(not k or any(x in WHITE_CHARS for x in k) for k in fixes):  # cores of tokens without letters, and white space
        return F.array_join(F.transform(tokens(c), lambda p: F.concat(F.coalesce(F.try_element_at(table, core(p)), core(p)), trail(p))), "")
    # A core has no trailing punctuation, so keys that have some are never found.
    keys = [k for k in fixes if k[-1] not in TRAILING]
    return replaced_cores(c, cores_pattern(F.array(*map(F.lit, keys))), table) if keys else c


def changed_cores(before: Column, after: Column) -> Column:
    """Distinct new cores at places where a token's core differs; none if the numbers of tokens differ."""
    b, a = F.transform(tokens(before), core), F.transform(tokens(after), core)
    pairs = F.zip_with(b, a, lambda x, y: F.when((x != y) & ~is_space(x) & ~is_space(y), y))
    none = F.array().cast("array<string>")
    return F.when(before == after, none).when(F.size(a) == F.size(b), F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))).otherwise(none)


def contains_all(c: Column, needles: Column) -> Column:
    return F.forall(needles, lambda s: F.contains(F.lower(c), F.lower(s)))


def preview(c: Column, size: int = 280) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def prompt(template: str, **parts: Column | str) -> Column:
    """The template with {name} replaced by columns, each stripped."""
    import re

    out = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece[:1] == "{" and piece[-1:] == "}" else None
        part = parts.get(name) if name else None
        out.append(F.lit(piece) if part is None else strip(part if isinstance(part, Column) else F.lit(part)))
    return F.concat(*out)
