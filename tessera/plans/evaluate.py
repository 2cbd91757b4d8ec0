"""Evaluation of corrections against references, of speech recognition, and of retrieval with a model."""

from __future__ import annotations

import io
import time
import wave
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Settings
from tessera.functions.text import contains_all, letter_ratio, normalized, preview, prompt, word_count
from tessera.operators.calendar import GRACE, MINUTE, with_start
from tessera.operators.evaluation import ROW_COLUMNS, SPEECH_COLUMNS, scored
from tessera.operators.retrieval import top1
from tessera.operators.selection import first_rows, non_blank
from tessera.operators.stage import staged, with_row_id
from tessera.plans.correct import Client, correct_documents

# Tokens of the instruction, least tokens of an answer, tokens a second of audio.
PROMPT_TOKENS, OUTPUT_TOKENS, TOKENS_PER_SECOND = 35, 40, 32
#: Kilobytes a second of 16 kHz mono 16-bit audio.
KB_PER_SECOND = 32.0


def evaluate_pairs(pairs: DataFrame, settings: Settings, max_rows: int | None = None, seconds: Column | None = None, **how) -> DataFrame:
    """Row metrics of corrections of pairs(row_index, stt_input, reference_text), one row for each pair, whatever its row_index. Pairs with neither
    text don't count; the first max_rows others are those of the least ordinal, if there is one (sources/manifests.py), else row_index. Rows are corrected together, so a row has no time of its own unless `seconds` gives one."""
    order = ["ordinal"] if "ordinal" in pairs.columns else ["row_index"]
    rows = with_row_id(first_rows(pairs, order, max_rows, non_blank("stt_input", "reference_text")), "pairs")
    found = correct_documents(rows.select(F.col("row_id").alias("doc_id"), F.col("stt_input").alias("text")), settings, **how)
    joined = rows.join(found.select(F.col("doc_id").alias("row_id"), normalized(F.col("text")).alias("prediction")), "row_id")
    return scored(joined.withColumn("execution_time_s", seconds if seconds is not None else F.lit(0.0))).select(*ROW_COLUMNS)


@F.pandas_udf(T.DoubleType())
def audio_seconds(content: pd.Series) -> pd.Series:
    """From the wave header; without one by size, one second at least."""

    def one(data: bytes) -> float:
        try:
            with wave.open(io.BytesIO(data)) as w:
                if w.getnframes() > 0:
                    return w.getnframes() / (w.getframerate() or 16000)
        except (wave.Error, EOFError):
            pass
        return max(1.0, len(data) / 1024 / KB_PER_SECOND)

    return content.map(one, na_action="ignore")


def token_estimate(seconds: Column, reference: Column) -> tuple[Column, Column]:
    """(prompt tokens, output tokens)"""
    return F.lit(PROMPT_TOKENS) + (seconds * TOKENS_PER_SECOND).cast("int"), F.greatest(F.lit(OUTPUT_TOKENS), word_count(reference) + 5)


def dry_run(pairs: DataFrame) -> DataFrame:
    """pairs(stem, seconds, wav_bytes, reference_text): what a run would take, a row each."""
    asked, said = token_estimate(F.col("seconds"), F.col("reference_text"))
    return pairs.select(
        "stem",
        F.round(F.col("wav_bytes") / 1024, 1).alias("wav_kb"),
        F.round("seconds", 2).alias("est_audio_seconds"),
        word_count(F.col("reference_text")).alias("ref_words"),
        asked.alias("est_prompt_tokens"),
        said.alias("est_output_tokens"),
        (asked + said).alias("est_total_tokens"),
    )


def dry_run_totals(rows: DataFrame, pairs_found: int | None = None) -> DataFrame:
    """Of dry_run's rows: one row with the number of pairs and requests and the tokens they would take."""
    return rows.agg(
        F.lit(True).alias("dry_run"),
        (F.lit(pairs_found).cast("long") if pairs_found is not None else F.count("*")).alias("pairs_found"),
        F.count("*").alias("pairs_selected"),
        F.coalesce(F.sum("est_total_tokens"), F.lit(0)).alias("est_total_tokens"),
        F.count("*").alias("est_requests"),
    )


#: The error of a call that wasn't made because its time was over.
MISSED = "missed its start"

#: stem and audio to (text, prompt tokens, output tokens, total tokens); may raise.
Transcriber = Callable[[str, bytes], tuple[str, int, int, int]]


def transcribed(audio: DataFrame, transcriber: Transcriber, start_s: str | None = None, began: float | None = None) -> DataFrame:
    """audio(stem, wav_path, content, reference_text) to speech rows; a failure is a row with its error and rates of 1.
    start_s: a column with the second, from the Unix time `began` on (now, unless given), at which a call starts (operators/calendar.py):
    tasks wait each for their own calls, in that order, and together keep the service's budgets. A call whose time is over by more than GRACE
    isn't made: its error is MISSED."""
    zero = time.time() if began is None else began

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stem, path, content, reference, start in zip(batch.stem, batch.wav_path, batch.content, batch.reference_text, batch.start, strict=True):
                time.sleep(max(0.0, zero + start - time.time()))
                began = time.perf_counter()
                try:
                    if start_s and time.time() > zero + start + GRACE:
                        raise TimeoutError(MISSED)
                    text, *used, error = *transcriber(stem, content), ""
                except Exception as e:  # noqa: BLE001  one file never fails the run
                    text, used, error = "", [0, 0, 0], str(e) or type(e).__name__
                out.append((stem, path, reference, text, time.perf_counter() - began, *used, error))
            yield pd.DataFrame(out, columns=["stem", "wav_path", "reference_text", "prediction", "execution_time_s", "prompt_tokens", "output_tokens", "total_tokens", "error"])

    kinds = "stem string, wav_path string, reference_text string, prediction string, execution_time_s double, prompt_tokens int, output_tokens int, total_tokens int, error string"
    asked = audio.select("stem", "wav_path", "content", "reference_text", (F.col(start_s) if start_s else F.lit(0.0)).cast("double").alias("start"))
    if start_s:
        asked = asked.sortWithinPartitions("start")
    rates = scored(asked.mapInPandas(run, kinds).withColumnsRenamed({"output_tokens": "said"}))
    failed = F.col("error") != ""
    return rates.withColumns({c: F.when(failed, 1.0).otherwise(F.col(c)) for c in ("wer", "cer")}).withColumn("output_tokens", F.col("said")).select(*SPEECH_COLUMNS)


def transcribed_within(audio: DataFrame, transcriber: Transcriber, requests: int | None = None, tokens: int | None = None, tokens_of: Column | None = None, lead_s: float = 10.0) -> DataFrame:
    """transcribed, within budgets a minute, in the order of wav_path (which tells rows apart), by as many tasks as audio has. Calls that missed their time get
    another calendar, a minute later, until all are made. lead_s: how long tasks may take to come to their first call."""
    done, left = None, audio
    while True:
        calls = with_start(left.select("wav_path", *([tokens_of.alias("asked")] if tokens_of is not None else [])), [F.col("wav_path")], requests, tokens, F.col("asked") if tokens_of is not None else None)
        timed = left.join(calls.select("wav_path", "start_s"), "wav_path")
        rows = staged(transcribed(timed, transcriber, "start_s", time.time() + lead_s), "transcribed")
        made = rows.where(F.col("error") != MISSED)
        done = made if done is None else done.unionByName(made)
        missed = rows.where(F.col("error") == MISSED).select("wav_path")
        if not missed.limit(1).count():
            return done
        if not made.limit(1).count():
            raise RuntimeError(f"no call could start in time; give tasks more than {lead_s} seconds to start")
        left, lead_s = left.join(missed, "wav_path", "left_semi"), lead_s + MINUTE


RETRIEVAL_TEMPLATE = "{context}\n\n{question}"


def evaluate_retrieval(tasks: DataFrame, corpus: DataFrame, client: Client, model: str = "", template: str = RETRIEVAL_TEMPLATE) -> DataFrame:
    """tasks(task_id, question, must_contain), corpus(chunk_idx, text): a row for each task. A call that fails has no ratio and no preview, and isn't ok."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch.prompt:
                began = time.perf_counter()
                try:
                    answer = client(x)
                except Exception:  # noqa: BLE001  one task never fails the run
                    answer = None
                out.append((answer, time.perf_counter() - began))
            yield batch.assign(answer=pd.Series([a for a, _ in out], index=batch.index, dtype=object), latency_s=[s for _, s in out])

    found = top1(tasks, corpus, "task_id", "chunk_idx", query_text="question")
    asked = tasks.join(found, "task_id").join(corpus.withColumnRenamed("text", "context"), "chunk_idx")
    asked = asked.withColumn("prompt", prompt(template, context=F.col("context"), question=F.col("question"))).select("task_id", "question", "must_contain", "chunk_idx", "similarity", "prompt")
    kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
    rows = asked.mapInPandas(run, f"{kinds}, answer string, latency_s double")
    return rows.select(
        F.lit(model).alias("model"), "task_id", "question",
        F.col("chunk_idx").alias("retrieved_idx"),
        F.round("similarity", 4).alias("retrieval_score"),
        F.round("latency_s", 3).alias("latency_s"),
        F.round(letter_ratio(F.col("answer")), 3).alias("georgian_letter_ratio"),
        F.coalesce(F.col("answer").isNotNull() & contains_all(F.col("answer"), F.col("must_contain")), F.lit(False)).alias("must_contain_ok"),
        preview(F.col("answer")).alias("answer_preview"),
    )


def retrieval_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(
        F.count("*").alias("n_tasks"),
        F.avg(F.col("must_contain_ok").cast("int")).alias("must_contain_accuracy"),
        F.avg("latency_s").alias("avg_latency_s"),
        F.avg("georgian_letter_ratio").alias("avg_georgian_letter_ratio"),
    )
