import json
import urllib.parse
import wave
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import cli, registry, service
from tessera.config import Settings, load_settings
from tessera.functions import metrics, rules, text
from tessera.operators import evaluation, lexicon, ranking, retrieval, selection
from tessera.plans import correct, evaluate
from tessera.sources import readers, writers
from tessera.streaming import correct as streaming

OFF = Settings(use_llm=False)


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_settings(tmp_path):
    s = load_settings({}, tmp_path)
    assert (s.llm_model, s.min_sequence_ratio, s.max_relative_length, s.lexicon_path) == ("gemma3:4b", 0.75, 1.30, None)
    (tmp_path / "data").mkdir()
    (tmp_path / "data/words.txt").write_text("ა")
    assert load_settings({}, tmp_path).lexicon_path and load_settings({"TESSERA_LEXICON": "None"}, tmp_path).lexicon_path is None
    s = load_settings({"TESSERA_LLM": "0", "MAX_CHUNK_CHARS": "9"}, tmp_path)
    assert not s.use_llm and s.max_chunk_chars == 9 and s.use_heuristics


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# head\n ბ \n\nა\nა\né\n", encoding="utf-8")
    found = lexicon.read_lexicon(spark, str(path))
    assert sorted(r.word for r in found.collect()) == ["é", "ა", "ბ"]
    lexicon.write_lexicon(lexicon.merge(found, spark.createDataFrame([("B",), ("a",), ("A",)], "word string")), str(tmp_path / "out"), "# words")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# words", "A", "a", "B", "é", "ა", "ბ"]
    assert lexicon.read_lexicon(spark, None) is None


def test_rescoring_equals_the_nearest_candidate(spark):
    import random

    rng = random.Random(3)
    letters = "ლღრნაე"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    lex = set(words[:150])
    table = rules.symmetric(rules.CONFUSIONS)

    def nearest(w):
        if w in lex or len(w) <= 4:
            return w
        near = {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in table.get(w[i], [])}
        near |= {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in rules.DROPPED_LETTERS} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        return min(near & lex, default=w)

    df = spark.createDataFrame([(i, f"{w}, {w}!", [words[200]]) for i, w in enumerate(words)], "i int, working string, preserve array<string>")
    found = lexicon.rescored(df, spark.createDataFrame([(w,) for w in lex], "word string"), ["i"])
    for r in found.collect():
        w = words[r.i]
        best = w if w == words[200] else nearest(w)
        assert r.working == f"{best}, {best}!"


def test_selection(spark):
    rows = spark.range(50).withColumnRenamed("id", "n")
    import random

    assert sorted(r.n for r in selection.seeded_sample(rows, "n", 50, 5, 1).collect()) == sorted(random.Random(1).sample(range(50), 5))
    assert selection.seeded_sample(rows, "n", 50, 50, 1).count() == 50
    df = spark.createDataFrame([(1, "", None), (2, "a", ""), (3, "", "b"), (4, "c", "c")], "i int, a string, b string")
    assert [r.i for r in selection.first_rows(df, ["i"], 2, selection.non_blank("a", "b")).collect()] == [2, 3]
    done = spark.createDataFrame([("x", "old"), ("gone", "old")], "stem string, v string")
    all_ = spark.createDataFrame([("x",), ("y",)], "stem string")
    assert [r.stem for r in selection.pending(all_, done).collect()] == ["y"]
    assert sorted(map(tuple, selection.resumed(all_, done, spark.createDataFrame([("y", "new")], done.schema)).collect())) == [("x", "old"), ("y", "new")]


def test_summaries(spark):
    rows = spark.createDataFrame([(0.5, 0.1, 2.0, 3, 4, 7, ""), (1.0, 1.0, 9.0, 0, 0, 0, "down")], "wer double, cer double, execution_time_s double, prompt_tokens int, output_tokens int, total_tokens int, error string")
    s = evaluation.speech_summary(rows).first()
    assert (s.rows_processed, s.rows_scored, s.rows_failed, s.average_wer, s.total_tokens, s.total_execution_time_s) == (2, 1, 1, 0.5, 7, 2.0)
    none = evaluation.speech_summary(rows.limit(0))
    assert json.loads(writers.summary_json(none)) == {"rows_processed": 0, "rows_scored": 0, "rows_failed": 0, "rows_skipped_resume": 0}


def test_pairs_manifest(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"meta": 1, "data": [{"row": "7", "stt1_text": " a ", "text": None}, {"row": "x", "stt1_text": 5, "text": "b"}]}))
    assert [tuple(r) for r in readers.load_pairs(spark, str(path)).collect()] == [(7, "a", ""), (2, "5", "b")]
    for bad in ({"pairs": 1}, ["x"], [{"text": "a"}]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            readers.load_pairs(spark, str(path))
    path.write_text(json.dumps([{"row": 1, "stt1_text": "a", "text": " b"}]))
    assert [tuple(r) for r in readers.read_pairs(spark, str(path)).collect()] == [(1, "a", "b")]


def test_pairs_at_scale(spark, tmp_path):
    def read(data):
        (tmp_path / "q.json").write_text(json.dumps(data))
        return sorted(tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "q.json")).collect())

    entries = [{"row": "7", "stt1_text": " a ", "text": None}, {"row": "x", "stt1_text": 5, "text": "b"}, {"stt1_text": "c", "text": "d"}]
    want = [(2, "5", "b"), (3, "c", "d"), (7, "a", "")]
    assert read(entries) == want and read({"meta": 1, "data": entries}) == want and read({"rows": [], "items": entries}) == want
    for bad in ({"pairs": 1}, [{"text": "a"}]):
        with pytest.raises(Exception, match="no list of pairs|no field|not an object"):
            read(bad)


def test_numbered(spark):
    import random

    rng = random.Random(4)
    values = [rng.randint(-50, 50) / 4 for _ in range(901)] + [None] * 7
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").repartition(5)
    got = sorted((r.place, r.v, r.i) for r in ranking.numbered(df.where("v is not null"), "place", F.col("v"), F.col("i")).collect())
    assert [(v, i) for _, v, i in got] == sorted((v, i) for i, v in enumerate(values) if v is not None) and [p for p, *_ in got] == list(range(901))
    assert ranking.numbered(df.limit(0), "place", F.col("v")).count() == 0


def test_answers_side_by_side(spark):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, prompt string").coalesce(1)

    def client(x):
        if x == "p3":
            raise RuntimeError
        return x.upper()

    rows = correct.answered(asked, client, at_once=4).collect()
    assert [(r.candidate, r.failed) for r in rows] == [(None, True) if i == 3 else (f"P{i}", False) for i in range(20)]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TESSERA_LLM", "0")
    (tmp_path / "in.txt").write_text("ველ მივედი. მაგლა დაფლინავს")
    assert cli.main([str(tmp_path / "in.txt"), "-o", str(tmp_path / "out.txt"), "--json-report", str(tmp_path / "r.json"), "--verbose"], spark) == 0
    assert (tmp_path / "out.txt").read_text() == "ვერ მივედი. მაღლა დაფრინავს"
    report = json.loads((tmp_path / "r.json").read_text())
    assert list(report) == ["ollama_model", "segments"] and report["segments"][0]["skip_reason"] == "ollama_disabled"
    assert "[0] SKIP ollama_disabled\n  IN : ველ" in capsys.readouterr().err


def test_service(spark, monkeypatch):
    import threading
    import urllib.error
    import urllib.request

    monkeypatch.setenv("TESSERA_LLM", "0")
    with service.server(spark, port=0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()

        def post(path, body):
            request = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", json.dumps(body).encode(), method="POST")
            try:
                with urllib.request.urlopen(request, timeout=60) as r:
                    return r.status, json.load(r)
            except urllib.error.HTTPError as e:
                return e.code, None

        assert post("/v1/correct/prellm", {"text": "ველ"}) == (200, {"text": "ვერ", "llm_applied": False, "llm_attempted": False})
        assert post("/v1/correct/final", {})[0] == 200 and post("/v1/other", {})[0] == 404 and post("/v1/correct/final", {"text": 1})[0] == 422
        s.shutdown()


def test_linked_words(spark):
    links = ["%E1%83%90", "a+b", "%zz", ""]
    html = "".join(f'<a href="/word/{x}">' for x in links) + '<a href="/other/x">'
    found = spark.createDataFrame([(html,)], "html string").select(readers.linked_words(F.col("html"))).first()[0]
    assert found == [urllib.parse.unquote(x) for x in links if x]
    assert readers.crawl({("ა", 1): html, ("ა", 2): html}.get and (lambda a, p: html if p < 3 else None), "ა") == set(found)


def test_audio(spark, tmp_path):
    for name, frames in (("b", 8000), ("a", 16000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(b"\0\0" * frames)
        (tmp_path / f"{name}.txt").write_text(f" {name} b c\n")
    (tmp_path / "alone.wav").write_bytes(b"junk" * 20000)
    found = readers.discover_pairs(spark, str(tmp_path))
    assert [(r.stem, r.reference_text) for r in found.collect()] == [("a", "a b c"), ("b", "b b c")]
    audio = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path))
    seconds = {r[0].rsplit("/", 1)[1]: r[1] for r in audio.select("path", evaluate.audio_seconds("content")).collect()}
    assert seconds == {"a.wav": 1.0, "b.wav": 0.5, "alone.wav": 80000 / 1024 / 32}
    plan = evaluate.dry_run(found.withColumn("seconds", F.lit(2.5))).first()
    assert (plan.est_prompt_tokens, plan.est_output_tokens, plan.ref_words) == (35 + 80, 40, 3)

    def transcriber(stem, content):
        if stem == "b":
            raise RuntimeError("down")
        return "a b", 3, 2, 5

    rows = found.join(audio.select(F.col("path").alias("wav_path"), "content"), "wav_path")
    a, b = sorted(evaluate.transcribed(rows, transcriber).collect(), key=lambda r: r.stem)
    assert (a.wer, a.output_tokens, a.error) == (1 / 3, 2, "") and (b.wer, b.cer, b.error) == (1.0, 1.0, "down")


def test_correction_without_model(spark):
    docs = docs_of(spark, " ველ მივედი.  მაგლა დაფლინავს ", "", None)
    rows = {r.doc_id: r for r in correct.correct_documents(docs, OFF).collect()}
    assert rows[0].text == "ვერ მივედი. მაღლა დაფრინავს" and rows[0].segments[0].skip_reason == "ollama_disabled"
    assert rows[0].segments[0].pre_llm == rows[0].text and rows[0].segments[0].source == "ველ მივედი. მაგლა დაფლინავს"
    assert rows[1].text == rows[2].text == "" and rows[1].segments == []
    lex = spark.createDataFrame([("მაღლი",), ("მივედო",)], "word string")
    assert correct.correct_before_llm(spark, "ველ მივედე", OFF, lexicon=lex)["text"] == "ვერ მივედო"


def test_correction_with_model(spark):
    def client(prompt):
        last = prompt.rsplit("\n", 1)[-1]
        if "ჩავარდა" in last:
            raise OSError("down")
        return "x" if "უარი" in last else last.replace("ოთხი", "ოთხე")

    on = replace(OFF, use_llm=True, max_chunk_chars=30)
    docs = docs_of(spark, "ერთი ორი სამი ოთხი ხუთი. უარი ორი სამი ოთხი. ჩავარდა ეს ორი სამი. abc.", "ჩავარდა ორი სამი")
    rows = {r.doc_id: r for r in correct.flags(correct.correct_documents(docs, on, client=client)).collect()}
    got = [(s.skipped_llm, s.skip_reason, s.rejected_model, s.reject_reason[:18], s.output) for s in rows[0].segments]
    assert got == [
        (False, "", False, "", "ერთი ორი სამი ოთხე ხუთი."),
        (False, "", True, "sequence_ratio_low", "უარი ორი სამი ოთხი."),
        (False, "", True, "ollama_error", "ჩავარდა ეს ორი სამი. abc."),
    ]
    assert (rows[0].llm_attempted, rows[0].llm_applied) == (True, True) and (rows[1].llm_attempted, rows[1].llm_applied) == (True, False)
    report = json.loads(correct.correct_documents(docs, on, client=client).select(writers.report_json("m")).first()[0])
    assert report["ollama_model"] == "m" and list(report["segments"][0]) == writers.REPORT_FIELDS and report["segments"][0]["pre_llm"] is None
    lines = [r.line for r in writers.trace(correct.corrected_segments(docs, on, client=client)).where("doc_id = 1").collect()]
    assert lines == ["[0] REJECT ollama_error"]


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "ველ", "ვერ"), (2, "", ""), (3, "", "x"), (4, "a", "a b")], "row_index int, stt_input string, reference_text string")
    rows = sorted(evaluate.evaluate_pairs(pairs, OFF, max_rows=2).collect())
    assert [(r.row_index, r.prediction, r.wer, r.cer) for r in rows] == [(1, "ვერ", 0.0, 0.0), (3, "", 1.0, 1.0)]
    assert list(rows[0].asDict()) == evaluation.ROW_COLUMNS


def test_retrieval(spark):
    corpus = spark.createDataFrame([(0, "red fox runs"), (1, "blue whale swims"), (2, "red whale")], "chunk_idx int, text string")
    tasks = spark.createDataFrame([(0, "which whale is blue", ["BLUE"]), (1, "zzz", ["q"])], "task_id int, question string, must_contain array<string>")
    found = {r.task_id: r for r in retrieval.top1(tasks, corpus, "task_id", "chunk_idx", "question").collect()}
    assert found[0].chunk_idx == 1 and (found[1].chunk_idx, found[1].similarity) == (0, 0.0)
    rows = evaluate.evaluate_retrieval(tasks, corpus, lambda p: p.upper(), "m")
    s = evaluate.retrieval_summary(rows).first()
    assert (s.n_tasks, s.must_contain_accuracy, s.avg_georgian_letter_ratio) == (2, 0.5, 0.0)


def test_checkpoint_and_files(spark, tmp_path, capsys):
    schema = "stem string, wer double"
    path = str(tmp_path / "c")
    assert readers.read_checkpoint(spark, path, schema).count() == 0
    writers.save_checkpoint(spark.createDataFrame([("a", 0.5)], schema), path)
    writers.save_checkpoint(spark.createDataFrame([("b", 1.0)], schema), path)
    assert sorted(map(tuple, readers.read_checkpoint(spark, path, schema).collect())) == [("a", 0.5), ("b", 1.0)]
    for _ in range(2):  # a save that is tried again
        writers.save_checkpoint(spark.createDataFrame([("c", 2.0)], schema), path, "third")
    writers.save_checkpoint(spark.createDataFrame([("a", 0.5)], schema), path)
    assert readers.read_checkpoint(spark, path, schema).where("stem = 'c'").count() == 1
    assert sorted(r.stem for r in readers.read_checkpoint(spark, path, schema, "stem").collect()) == ["a", "b", "c"]
    writers.write_rows(spark.createDataFrame([("a", 0.5)], schema), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["stem"] == "a"
    (tmp_path / "d.txt").write_text("a\nb", encoding="utf-8")
    assert readers.read_document(spark, str(tmp_path / "d.txt")).first().text == "a\nb"
    writers.write_text("x", "-")
    assert capsys.readouterr().out == "x\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"doc_id": 1, "text": "ველ"}\n{"doc_id": 2, "text": null}\n', encoding="utf-8")
    stream = streaming.document_stream(spark, str(tmp_path / "in"))
    streaming.correct_stream(stream, OFF, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "ვერ"), (2, "")]


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(names)

    def plain(x):
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, sql, small, name):
    df = registry.queries()[name](spark, small)
    found = rows_of(df.columns, map(tuple, df.collect()))
    if name in registry.oracle_sql():
        got = sql.execute(registry.oracle_sql()[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns) and rows_of(names, got.fetchall()) == found
    assert found


def test_rates_of_turns(spark, small):
    """Both word distances on whole turns."""
    pairs = registry._turn_pairs(spark, small).limit(20)
    r, p = F.col("reference_text"), F.col("prediction")
    rows = pairs.select(metrics.wer(r, p).alias("a"), metrics.wer(r, p, metrics.word_distance_native).alias("b")).collect()
    assert rows and all(x.a == x.b for x in rows)


def test_text_helpers(spark):
    assert spark.createDataFrame([(None,)], "a string").select(text.normalized(F.col("a"))).first()[0] == ""


def test_rows_of_one_id_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame([(None, "ველ a null id here."), (1, "ველ მივედე."), (1, "second მივედე text. And მაგლა more."), (1, "second მივედე text. And მაგლა more."), (None, None)], "doc_id long, text string")
    lex = spark.createDataFrame([("მივედო",)], "word string")
    got = sorted((r.doc_id or 0, r.text, len(r.segments)) for r in correct.correct_documents(docs.repartition(3), replace(OFF, max_chunk_chars=25), lexicon=lex).collect())
    second = "second მივედო text. And მაღლა more."
    assert got == [(0, "", 0), (0, "ვერ a null id here.", 1), (1, second, 2), (1, second, 2), (1, "ვერ მივედო.", 1)]
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps([{"stt1_text": f"ერთი {name}", "text": f"ერთი {name}"}] * 2))
    rows = evaluate.evaluate_pairs(readers.read_pairs(spark, str(tmp_path)), OFF).collect()
    assert [r.wer for r in rows] == [0.0] * 4 and sorted(r.prediction[-1] for r in rows) == list("aabb")


def test_a_word_kept_in_one_row_is_replaced_in_another(spark):
    """The replacements of a row don't depend on another row of the same id."""
    docs = spark.createDataFrame([(1, "wrongg word"), (1, "rightt word")], "doc_id long, text string")
    lex = spark.createDataFrame([("wrong",), ("right",)], "word string")
    got = correct.correct_documents(docs, OFF, fixes={"wrongg": "rightt"}, lexicon=lex).collect()
    assert sorted(r.text for r in got) == ["right word", "rightt word"]


def test_service_takes_the_settings_lexicon(spark, tmp_path, monkeypatch):
    (tmp_path / "words.txt").write_text("# words\nმივედო\n", encoding="utf-8")
    monkeypatch.setenv("TESSERA_LEXICON", str(tmp_path / "words.txt"))
    monkeypatch.setenv("TESSERA_LLM", "0")
    assert correct.correct_before_llm(spark, "ველ მივედე")["text"] == "ვერ მივედო" == correct.correct_final(spark, "ველ მივედე")["text"]
    monkeypatch.setenv("TESSERA_LEXICON_ENABLE", "0")
    assert correct.correct_before_llm(spark, "ველ მივედე")["text"] == "ვერ მივედე"


def test_skipped_segments_pass_by_the_client(spark, monkeypatch):
    """One read of the staged table, which holds what is worked on only where it isn't the source; only asked prompts reach the client, and none come back."""
    held, kept = {}, correct.staged
    monkeypatch.setattr(correct, "staged", lambda df, label: held.update({label: kept(df, label)}) or held[label])
    docs = spark.createDataFrame([(1, "ველ მივედი სახლში გუშინ."), (2, "one two three"), (3, ""), (4, None)], "doc_id long, text string")

    def client(x):
        if "two" in x:
            raise AssertionError
        return x.strip() + " é"

    found = correct._processed(docs, Settings(min_sequence_ratio=0.0), client=client, template="{chunk}")
    assert "working" not in held["segments"].columns and found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 4 and rows[1].output == "ვერ მივედი სახლში გუშინ. é" and rows[1].pre_llm == "ვერ მივედი სახლში გუშინ." and not rows[1].skipped_llm
    assert (rows[2].output, rows[2].pre_llm, rows[2].skip_reason, rows[2].rejected_model, rows[2].reject_reason) == ("one two three", None, "low_georgian_letter_ratio", False, "")
    assert rows[3].seg_idx is None and rows[4].seg_idx is None
    asked = spark.createDataFrame([("p", True), ("q", False), ("r", None)], "prompt string, asked boolean")
    rows = correct.answered(asked, lambda x: x + "é", asked="asked")
    assert rows.columns == ["asked", "candidate", "failed", "normal"]
    assert [(r.candidate, r.failed, r.normal) for r in rows.collect()] == [("pé", False, "pé"), (None, False, None), (None, False, None)]


def test_rescored_documents_without_tokens(spark, small, tmp_path):
    """Null and empty texts have no row, as in the SQL; white space has one."""
    import duckdb

    import __spark_entry__

    docs = [(1, None), (2, ""), (3, " \n"), (4, "the onentx, thatt. the"), (5, "...")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("benchmark", "pages"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["lexicon_rescored_documents"]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()["lexicon_rescored_documents"](spark, str(tmp_path)).collect())
    assert got == want and [i for i, _ in got] == [3, 4, 5]
