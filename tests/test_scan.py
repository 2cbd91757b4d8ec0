"""Running sums, calls' start times, stored crawls and retrieval against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import calendar, retrieval, scan
from tessera.plans import evaluate
from tessera.sources import readers


@pytest.mark.parametrize("keys", [1, 5, 10_000])
def test_running(spark, keys):
    """One key with all rows, a few, and many."""
    rng = random.Random(keys)
    rows = [(rng.randrange(keys), i, rng.choice((None, rng.randint(-9, 9)))) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(5)
    found = scan.running(df, [F.col("k"), F.col("i")], {"total": F.col("v")}).collect()
    got, total = sorted((r.place, r.k, r.i, r.total) for r in found), 0
    for at, (place, row) in enumerate(zip(got, sorted(rows, key=lambda r: r[:2]), strict=True)):
        total += row[2] or 0
        assert place == (at, row[0], row[1], total)
    parts = scan.running(df, [F.col("k")], {}).groupBy(F.spark_partition_id()).count()
    assert parts.count() > 1 or keys  # ties fill several parts, too


def test_running_means(spark):
    rows = [(i, None if i % 3 == 0 else i / 8) for i in range(200)]
    found = scan.running_means(spark.createDataFrame(rows, "i int, wer double").repartition(4), [F.col("i")], ["wer"])
    so_far = []
    for r in sorted(found.collect()):
        so_far += [] if r.wer is None else [r.wer]
        assert r.running_rows == r.i + 1 and (r.running_wer is None if not so_far else math.isclose(r.running_wer, sum(so_far) / len(so_far)))
    assert scan.running_means(spark.createDataFrame([], "i int, wer double"), [F.col("i")], ["wer"]).count() == 0


@pytest.mark.parametrize(("requests", "tokens"), [(10, 3000), (7, None), (1000, 900)])
def test_no_minute_over_budget(spark, requests, tokens):
    rng = random.Random(requests)
    rows = [(i, rng.randint(0, 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, tokens int").repartition(4)
    found = sorted((r.start_s, r.tokens) for r in calendar.with_start(df, [F.col("i")], requests, tokens, F.col("tokens")).collect())
    assert found[0][0] == 0.0
    for at, (start, _) in enumerate(found):
        window = [t for s, t in found[at:] if s < start + 60 - 1e-3]
        assert len(window) <= requests and (tokens is None or sum(window) <= tokens)


def test_one_call_over_the_budget(spark):
    with pytest.raises(ValueError, match="one call"):
        calendar.with_start(spark.createDataFrame([(1, 50)], "i int, tokens int"), [F.col("i")], None, 40, F.col("tokens"))


def test_one_call_over_the_budget_leaves_the_requests(spark):
    """Not strict: the calendar of a dry run has every call, kept apart by requests."""
    df = spark.createDataFrame([(1, 50), (2, 3), (3, None)], "i int, tokens int")
    found = calendar.with_start(df, [F.col("i")], 10, 40, F.col("tokens"), strict=False).orderBy("i").collect()
    assert [r.start_s for r in found] == [0.0, 6.1, 12.2]


def test_tasks_wait_for_their_own_calls(spark):
    """Six calls in three tasks, two a second: no second has three starts. A call whose time is over isn't made."""
    import time

    rows = [(f"s{i}", f"/{i}.wav", b"", "a") for i in range(6)]
    df = spark.createDataFrame(rows, "stem string, wav_path string, content binary, reference_text string").repartition(3)
    found = evaluate.transcribed_within(df, lambda stem, content: (str(time.time()), 1, 1, 2), requests=120, lead_s=8).collect()
    at = sorted(float(r.prediction) for r in found)
    assert len(at) == 6 and all(c - a > 0.9 for a, c in zip(at, at[2:], strict=False))
    timed = calendar.with_start(df, [F.col("stem")], requests=6)
    late = evaluate.transcribed(timed, lambda stem, content: ("said", 1, 1, 2), "start_s", began=time.time() - 25).collect()
    assert {r.stem for r in late if r.error == evaluate.MISSED} >= {"s0", "s1"} and any(r.prediction == "said" for r in late)


def test_stored_crawl_equals_the_loop(spark):
    rng = random.Random(9)
    for _ in range(4):
        pages = {}
        for letter in "abc":
            for page in range(1, 9):
                if rng.random() < 0.85:
                    pages[letter, page] = "".join(f'<a href="/word/{letter}{rng.randrange(4 * page)}">' for _ in range(rng.choice((0, 3, 6, 6))))
        df = spark.createDataFrame([(*k, h) for k, h in pages.items()] + [("z", 2, '<a href="/word/z">'), ("a", 0, '<a href="/word/zero">'), ("y", 1, None)], "letter string, page int, html string")
        found = readers.crawled_words(df, readers.linked_words(F.col("html")), max_pages=7)
        assert {r.word for r in found.collect()} == readers.crawl(lambda a, p: pages.get((a, p)), "abcyz", max_pages=7)


def vectors(texts):
    import collections
    import re

    counts = [collections.Counter(re.findall(r"\w\w+", t.lower())) for t in texts]
    df = collections.Counter(w for c in counts for w in c)
    return counts, {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}


def unit(counts, idf):
    v = {w: n * idf[w] for w, n in counts.items() if w in idf}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()}


@pytest.mark.parametrize("share", [0.0, 0.5, 0.99])
def test_blocks_give_the_best_of_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(retrieval, "SHARE", share)
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(120)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    texts += texts[:40]  # ties: the first counts
    asked = [" ".join(rng.choice(common + rare[:40]) for _ in range(rng.randint(1, 8))) for _ in range(40)] + ["nothing here", ""]
    counts, idf = vectors(texts)
    chunks = [unit(c, idf) for c in counts]
    want = []
    for i, a in enumerate(asked):
        q = unit(vectors([a])[0][0], idf) if vectors([a])[0][0].keys() & idf.keys() else {}
        best = max(((round(sum(x * v.get(w, 0.0) for w, x in q.items()), 9), -c) for c, v in enumerate(chunks)))
        want.append((i, -best[1], best[0]))
    q = spark.createDataFrame(list(enumerate(asked)), "q long, text string")
    c = spark.createDataFrame(list(enumerate(texts)), "c long, text string").repartition(3)
    got = sorted(tuple(r) for r in retrieval.top1(q, c, "q", "c").collect())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and all(math.isclose(x[2], y[2], abs_tol=2e-9) for x, y in zip(got, want, strict=True))


def test_common_terms_add_few_postings(spark):
    """A term in every chunk is cut off where its weights are low; what is read doesn't grow with the chunks that have it."""
    read = []
    for n in (500, 2000):
        chunks = spark.createDataFrame([(i, f"common words w{i} v{i % 97} u{i % 89} t{i % 83}") for i in range(n)], "c long, text string")
        index = retrieval.BlockIndex(chunks, "c")
        q = spark.createDataFrame([(0, "common words w7 v7 u7 t7")], "q long, text string")
        asked = retrieval.staged(retrieval.weights(retrieval.term_counts(q, "q", "text"), index.idf, "q").withColumnRenamed("weight", "qw"), "q")
        postings = retrieval.staged(index.postings(asked.select("term")), "p")
        blocks = retrieval.staged(retrieval.blocks_of(postings), "b")
        cut = retrieval.cuts(asked, blocks, postings)
        read.append(blocks.join(cut, "term").where("level >= above").agg(F.sum(F.size("held"))).first()[0])
    assert read[1] < 100 and read[1] < read[0] * 8


def test_failed_call_is_a_row(spark):
    corpus = spark.createDataFrame([(0, "red fox"), (1, "blue whale")], "chunk_idx int, text string")
    tasks = spark.createDataFrame([(0, "fox", ["fox"]), (1, "whale", ["whale"])], "task_id int, question string, must_contain array<string>")

    def client(p):
        if "fox" in p:
            raise OSError
        return p

    rows = {r.task_id: r for r in evaluate.evaluate_retrieval(tasks, corpus, client).collect()}
    assert (rows[0].must_contain_ok, rows[0].georgian_letter_ratio, rows[0].answer_preview) == (False, None, None) and rows[1].must_contain_ok
