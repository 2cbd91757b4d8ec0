import difflib
import random
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import chunking, metrics, rules, safety, text, variants

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def test_white_space_is_that_of_isspace(values):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert values([f"{s}a{s}b{s}" for s in spaces], text.strip) == [f"a{s}b" for s in spaces]
    assert values([f"a{s}b" for s in spaces], text.word_count) == [2] * len(spaces)


def test_nfc(values):
    rows = ["é", "é", "", "საქართველო"]
    assert values(rows, text.nfc) == [unicodedata.normalize("NFC", x) for x in rows]


def test_tokens_lose_nothing(values):
    rows = ["", "  a  b.\n", " x\u001cy", "ა… ბ!?"]
    assert values(rows, lambda a: F.array_join(text.tokens(a), "")) == rows


def test_core_and_trail(values):
    rows = ["ველ!?", "a,b.", "...", "a…,", "x"]
    assert values(rows, text.core) == ["ველ", "a,b", "", "a", "x"]
    assert values(rows, text.trail) == ["!?", ".", "...", "…,", ""]
    assert values(["a.!  …", "a,", " . "], text.strip_sentence_end) == ["a", "a,", ""]


def test_script_ratios(values):
    rows = ["123", "", "დედა", "დედ abc", "ა჻"]
    assert values(rows, text.script_ratio) == [0.0, 0.0, 1.0, 0.5, 2.0]
    assert values(rows, text.letter_ratio) == [1.0, 1.0, 1.0, 0.5, 1.0]


def test_token_fixes(values):
    rows = ["დედა საწმელს დიდი ხანია ამზადებს", "ჩიტი ჯგუფი სულ მაგლა დაფლინავს", "ველ!?", "ველი", "  ველ\n", "..."]
    want = ["დედა საჭმელს დიდი ხანია ამზადებს", "ჩიტი ჯგუფი სულ მაღლა დაფრინავს", "ვერ!?", "ველი", "  ვერ\n", "..."]
    assert values(rows, lambda a: text.fix_tokens(a, rules.TOKEN_FIXES)) == want
    assert values([("ველ ა.", "ვერ ა.")], text.changed_cores) == [["ვერ"]]
    assert values([("a b", "a")], text.changed_cores) == [[]]


def test_containment_preview_prompt(values):
    assert values(["Tbilisi LARI"], lambda a: text.contains_all(a, F.array(F.lit("lari"), F.lit("tb")))) == [True]
    assert values(["x"], lambda a: text.contains_all(a, F.array().cast("array<string>"))) == [True]
    assert values(["a" * 281, "b"], text.preview) == ["a" * 280 + "…", "b"]
    assert values([" q "], lambda a: text.prompt("<{chunk}|{examples}>", chunk=a, examples="e")) == ["<q|e>"]


def test_chunks(values):
    assert values(["", "  \n"], chunking.chunks) == [[], []]
    assert values(["aaa. bb. cccc. d"], lambda a: chunking.chunks(a, 8)) == [["aaa. bb.", "cccc. d"]]
    assert values(["ა… ბ"], chunking.sentences) == [["ა… ბ"]]
    assert values(["a։ b؟ c"], chunking.sentences) == [["a։", "b؟", "c"]]
    assert values(["abcdefghij"], lambda a: chunking.hard_split(a, 4)) == [["abcd", "efgh", "ij"]]
    assert values(["", "ab   cd"], lambda a: chunking.hard_split(a, 3)) == [[], ["ab", "c", "d"]]


@QUICK
@given(st.lists(st.text(alphabet="ab. !\n", max_size=40), min_size=1, max_size=20))
def test_chunks_keep_order_and_size(values, rows):
    for row, found in zip(rows, values(rows, lambda a: chunking.chunks(a, 7)), strict=True):
        assert all(0 < len(c) <= 7 for c in found)
        assert "".join("".join(found).split()) == "".join(row.split())


def test_symmetric_confusions():
    table = rules.symmetric(rules.CONFUSIONS)
    assert sum(map(len, table.values())) == 86 and len(table) == 28 and max(map(len, table.values())) == 7
    assert all(a in table[b] for a in table for b in table[a])


def one_edit(word, letters, table):
    n = len(word)
    sub = [word[:i] + x + word[i + 1 :] for i in range(n) for x in table.get(word[i], [])]
    ins = [word[:i] + x + word[i:] for i in range(n + 1) for x in letters] if word else []
    cut = [word[:i] + word[i + 1 :] for i in range(n)] if n > 1 else []
    return [list(dict.fromkeys(x)) for x in (sub, ins, cut)]


def test_variants(values):
    rows = ["", "ა", "ლლ", "კარგი", "გ" * 30]
    table = rules.symmetric(rules.CONFUSIONS)
    want = [one_edit(w, rules.DROPPED_LETTERS, table) for w in rows]
    for k, (make, limit) in enumerate([(variants.substitutions, 96), (variants.insertions, 220), (variants.deletions, 64)]):
        assert values(rows, make) == [w[k][:limit] for w in want]


def edit_distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@QUICK
@given(st.lists(st.tuples(st.text(alphabet="ab ", max_size=25), st.text(alphabet="abc ", max_size=25)), min_size=1, max_size=20))
def test_error_rates(values, rows):
    def rate(r, h):
        return edit_distance(r, h) / len(r) if r else float(bool(h))

    assert values(rows, metrics.cer) == [rate(a, b) for a, b in rows]
    want = [rate(a.split(), b.split()) for a, b in rows]
    assert values(rows, metrics.wer) == want
    assert values(rows, lambda a, b: metrics.wer(a, b, metrics.word_distance_native)) == want


def test_error_rate_cases(values):
    assert values([("a b c d", "a x c"), ("", ""), ("", "x")], metrics.wer) == [0.5, 0.0, 1.0]
    assert values([("ბავშვს", "ბავშვებს"), ("", "")], metrics.cer) == [2 / 6, 0.0]


def test_gate(values):
    rows = ["", "დედა", "hello world foo", "დედა ლრვ", "დედა საჭმელს ამზადებს"]
    assert values(rows, safety.gate) == ["empty", "too_few_words", "low_georgian_letter_ratio", "very_short_two_token", "ok"]


VERDICTS = [
    ("x", "  ", "empty_output"),
    ("x", "x", "unchanged"),
    ("დედა მოვიდა", "დედა მოვიდა.", "trailing_punctuation_only"),
    ("aaaaaaaaaa", "bbbbbbbbbb", "sequence_ratio_low:0.000"),
    ("abc def", "abc def ghijklmnopq", "sequence_ratio_low:0.538"),
    ("a" * 40, "a" * 61, "output_much_longer"),
    ("aa bb cc dd ee ff gg hh ii jj", "aa bb cc dd ee ff gg hh ii jj k l m n o", "many_extra_words"),
    ("one two cat four five", "one two cattle four five", "single_token_expansion"),
    ("ab cd ef", "abx cdx efx", "too_many_tokens_changed"),
    ("ერთი ორი სამი ბავშვს", "ერთი ორი სამი ბავშვებს", "ambiguous_equivalent_morphology"),
    ("ერთი ორი სამი ოთხი", "ერთი ორი სამი ოთხე", "ok"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, o, c) for i, (o, c, _) in enumerate(VERDICTS)], "i int, o string, c string")
    found = sorted(safety.with_verdict(df, "o", "c").collect())
    assert [r["reason"] for r in found] == [w for *_, w in VERDICTS]
    assert [r["accepted"] for r in found] == [w in ("unchanged", "ok") for *_, w in VERDICTS]


def test_sequence_ratio_keeps_the_popularity_heuristic(values):
    a, b = "ab " * 120, "ab " * 110 + "zz " * 10
    assert values([("tide", "diet"), (a, b)], safety.sequence_ratio) == [difflib.SequenceMatcher(None, *x).ratio() for x in (("tide", "diet"), (a, b))]


def test_matcher_ratio_is_difflibs():
    """Over 200 characters too, where difflib leaves out common ones, and cheaper: it looked at each character of a for each match."""
    rng = random.Random(3)
    for size in (0, 1, 30, 199, 200, 900):
        for letters in ("ab ", "abcdefghijklmnopqrstuvwxyz  "):
            for _ in range(12):
                a = "".join(rng.choice(letters) for _ in range(size))
                b = list(a)
                for _ in range(rng.randrange(6)):
                    i = rng.randrange(len(b) + 1)
                    b[i : i + rng.randrange(6)] = rng.choice(["xyz", "q", "", "ab"])
                b = "".join(b)
                assert safety.matcher_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_many_swaps_without_a_pair(values):
    """Only cores of the table are looked at, and regular expressions' characters in them are themselves."""
    fixes = {"a.b": "x", "a": "b", "b": "a", "q\\E(": "ok", "c.": "never"}
    assert values(["a b, a.b! aa\ta. c. q\\E(?", "a", "", " "], lambda c: text.fix_tokens(c, fixes)) == ["b a, x! aa\tb. c. ok?", "b", "", " "]
    assert values(["abcde, abcd ab.cd.. (x)yz!"], lambda c: text.long_cores(c, 5)) == [["abcde", "ab.cd", "(x)yz"]]
