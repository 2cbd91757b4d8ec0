"""Calls through the journal, counted by files that each call leaves."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators.journal import Journal, prompt_key
from tessera.plans import correct


def caller(folder, fail_once=None):
    """Leaves a file for each call; its task dies at the prompt `fail_once`, the first time."""

    def client(prompt):
        mark = f"{folder}/died"
        if prompt == fail_once and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(prompt)
        if prompt.startswith("bad"):
            raise RuntimeError("down")
        return prompt.upper()

    return client


def calls(folder):
    return sorted(p.read_text() for p in folder.glob("*.call"))


def test_equal_prompts_are_asked_once(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "journal"), every=2)
    prompts = spark.createDataFrame([(f"p{i % 7}",) for i in range(60)] + [("bad",), (None,)], "prompt string").repartition(5)
    found = journal.ask(prompts, caller(tmp_path), at_once=2)
    assert sorted((r.answer or "", r.error or "") for r in found.collect()) == sorted([("", "down")] + [(f"P{i}", "") for i in range(7)])
    assert calls(tmp_path) == sorted(["bad", *(f"p{i}" for i in range(7))])
    # Another run asks for what is new alone, and for failures if told so.
    more = prompts.union(spark.createDataFrame([("p8",)], "prompt string"))
    assert journal.ask(more, caller(tmp_path)).count() == 9 and calls(tmp_path).count("p8") == 1 and len(calls(tmp_path)) == 9
    journal.ask(more, caller(tmp_path), retry_failures=True)
    assert calls(tmp_path).count("bad") == 2 and len(calls(tmp_path)) == 10


def test_a_task_that_dies_goes_on_where_it_was(tmp_path):
    """In a session of its own, whose tasks are tried again. The worker that makes the call dies with its answers written."""
    import subprocess
    import sys
    import textwrap

    script = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        from tessera.operators.journal import Journal
        from tests.test_journal import caller
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        prompts = spark.createDataFrame([(f"p{{i:02}}",) for i in range(40)], "prompt string").coalesce(1)
        print("FOUND", Journal(spark, {str(tmp_path / "journal")!r}, every=1).ask(prompts, caller({str(tmp_path)!r}, "p17")).where("answer is not null").count())
    """)
    said = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=240, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert "FOUND 40" in said.stdout, said.stderr[-2000:]
    assert (tmp_path / "died").exists() and calls(tmp_path) == [f"p{i:02}" for i in range(40)]


def test_correction_with_a_journal(spark, tmp_path):
    on = Settings(use_lexicon=False, max_chunk_chars=40)
    text = "ერთი ორი სამი ოთხი ხუთი."
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(None, text + " სხვა ორი სამი ოთხი.")], "doc_id long, text string").repartition(4)
    journal = Journal(spark, str(tmp_path / "journal"))
    found = [correct.correct_documents(docs, on, client=caller(tmp_path), template="{chunk}", journal=journal).collect() for _ in range(2)]
    assert sorted(map(repr, found[0])) == sorted(map(repr, found[1])) and len(found[0]) == 31
    assert len(calls(tmp_path)) == 2
    plain = correct.correct_documents(docs, on, client=lambda p: p.upper(), template="{chunk}").collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, found[0]))


def test_speculation_is_refused(spark, tmp_path):
    key = spark.createDataFrame([("a",)], "p string").select(prompt_key(F.col("p"))).first()[0]
    assert len(key) == 64
    with pytest.raises(ValueError, match="speculation"):

        class Conf:
            def get(self, *_):
                return "true"

        class Session:
            conf = Conf()

        Journal(Session(), str(tmp_path))
