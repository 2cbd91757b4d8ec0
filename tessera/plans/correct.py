"""Document correction: chunks, token fixes, lexicon, gate, language model, verdict, text again.

Rows are told apart by a number of their own (row_id), made before a text is split and carried through; doc_id is only
carried, so it may be null or repeat, and every input row has one output row.
"""

from __future__ import annotations

import json
import unicodedata
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings, load_settings
from tessera.functions.chunking import chunks
from tessera.functions.rules import TOKEN_FIXES
from tessera.functions.safety import gate, with_verdict
from tessera.functions.text import GATE_LETTERS, changed_cores, fix_tokens, nfc, prompt, strip
from tessera.operators.journal import Journal, prompt_key
from tessera.operators.lexicon import read_lexicon, rescored
from tessera.operators.stage import staged

#: A prompt to answer. Must be picklable; may raise, which rejects that segment alone.
Client = Callable[[str], str]

# The prompt is ours; a caller with one of their own passes template and examples, or a client with another system text.
SYSTEM = (
    "You correct Georgian text that a speech recogniser wrote. Mend words that were clearly misheard and leave everything else: word order, "
    "endings, punctuation, names and numbers. Both forms of a word that has two are right. Add nothing, explain nothing, and "
    "answer with the corrected text alone. If nothing is wrong, answer with the text as it is."
)
EXAMPLES = "\n\n".join(
    f"Text: {a}\nCorrected: {b}"
    for a, b in (
        ("დღეს საწმელს ვამზადებ", "დღეს საჭმელს ვამზადებ"),
        ("ჩიტი მაგლა დაფლინავს", "ჩიტი მაღლა დაფრინავს"),
        ("ხვალ სკოლაში მივდივარ", "ხვალ სკოლაში მივდივარ"),
    )
)
TEMPLATE = "Examples:\n\n{examples}\n\nThe text to correct:\n{chunk}"

#: Rows whose prompts and answers are Python strings at a time.
SLICE = 512

SEGMENT = ["doc_id", "seg_idx", "source", "output", "skipped_llm", "skip_reason", "rejected_model", "reject_reason", "pre_llm"]


class HttpClient:
    """The generate call of a local model server: one JSON request, one JSON answer that holds `response`."""

    def __init__(self, settings: Settings, system: str = SYSTEM):
        self.settings, self.system = settings, system

    def request(self, text: str) -> urllib.request.Request:
        asked = {"model": self.settings.llm_model, "prompt": text, "system": self.system, "stream": False, "options": {"temperature": self.settings.llm_temperature}}
        return urllib.request.Request(self.settings.llm_host + "/api/generate", data=json.dumps(asked).encode(), headers={"Content-Type": "application/json"}, method="POST")

    def __call__(self, text: str) -> str:
        with urllib.request.urlopen(self.request(text), timeout=self.settings.llm_timeout_s) as answer:
            found = json.load(answer)
        if not isinstance(found, dict) or "error" in found:
            raise RuntimeError(f"the model server answered {found!r:.200}")
        return str(found.get("response") or "").strip()


def segments(docs: DataFrame, settings: Settings, fixes: dict[str, str] = TOKEN_FIXES, lexicon: DataFrame | None = None, gate_letters: str | None = None, **tables) -> DataFrame:
    """row_id, doc_id, seg_idx, source, pre_llm, working and, if gate_letters are given, gate: all that comes before the model, staged. What is worked
    on is written only where it isn't the source, and the gate judges it once. A text without chunks is a row without seg_idx."""
    text = strip(nfc(F.coalesce(F.col("text"), F.lit(""))))
    # The number is made in a step of its own: beside an explode it would number what comes out.
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    df = rows.select("row_id", "doc_id", F.posexplode_outer(chunks(text, settings.max_chunk_chars)).alias("seg_idx", "source"))
    df = df.withColumn("working", fix_tokens(F.col("source"), fixes) if settings.use_heuristics else F.col("source"))
    if settings.use_lexicon and lexicon is not None:
        # Rescoring reads its segments several times.
        df = staged(df.withColumn("preserve", changed_cores(F.col("source"), F.col("working"))), "chunks")
        df = rescored(df, lexicon, ["row_id", "seg_idx"], **tables).drop("preserve")
    df = df.withColumn("pre_llm", F.when(F.col("working") != F.col("source"), F.col("working")))
    if gate_letters is not None:
        df = df.withColumn("gate", gate(F.col("working"), gate_letters))
    return staged(df.drop("working"), "segments").withColumn("working", F.coalesce("pre_llm", "source"))


def answered(df: DataFrame, client: Client, text: str = "prompt", at_once: int = 1, asked: str | None = None) -> DataFrame:
    """df with candidate and failed; rows go through the client in slices of Arrow batches, whose other columns are passed on as they are, `at_once` calls of a task side by side (a
    client called so must bear threads). asked: a boolean column; rows where it isn't true pass by the client, and df comes back without the text, with normal, the candidate's
    NFC where that is another text."""

    def ask(x: str) -> tuple[str | None, bool]:
        try:
            return client(x), False
        except Exception:  # noqa: BLE001  one segment never fails the batch
            return None, True

    def normal(x: str | None) -> str | None:
        return None if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x)

    names = [c for c in df.columns if asked is None or c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                some = [True] * part.num_rows if asked is None else part.column(asked).to_pylist()
                prompts = [x for x, wanted in zip(part.column(text).to_pylist(), some, strict=True) if wanted]
                if at_once > 1:
                    with ThreadPoolExecutor(at_once) as pool:
                        answers = list(pool.map(ask, prompts))
                else:
                    answers = [ask(x) for x in prompts]
                had = iter(answers)
                answers = [next(had) if wanted else (None, False) for wanted in some]
                candidate, failed = [a for a, _ in answers], [f for _, f in answers]
                columns = {c: part.column(c) for c in names} | {"candidate": pa.array(candidate, pa.string()), "failed": pa.array(failed, pa.bool_())}
                if asked is not None:
                    columns["normal"] = pa.array(map(normal, candidate), pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*(f"`{c}`" for c in names)).dtypes)
    return df.mapInArrow(run, f"{kinds}, candidate string, failed boolean" + (", normal string" if asked is not None else ""))


def _processed(docs: DataFrame, settings: Settings, client: Client | None = None, gate_letters: str = GATE_LETTERS, template: str = TEMPLATE, examples: str = EXAMPLES, at_once: int = 1, journal: Journal | None = None, **rules) -> DataFrame:
    """The segment report, with a row of nulls for a text without segments. Segments that the gate skips go the same way as the asked ones, past the model: the
    staged table is read once. journal: equal prompts are asked once, those of earlier runs not again."""
    none = F.lit("")
    if not settings.use_llm:
        df = segments(docs, settings, **rules)
        return df.select("row_id", "doc_id", "seg_idx", "source", F.col("working").alias("output"), F.lit(True).alias("skipped_llm"), F.lit("ollama_disabled").alias("skip_reason"), F.lit(False).alias("rejected_model"), none.alias("reject_reason"), "pre_llm")
    client = client or HttpClient(settings)
    df = segments(docs, settings, gate_letters=gate_letters, **rules)
    df = df.withColumn("asked", F.col("seg_idx").isNotNull() & (F.col("gate") == "ok"))
    df = df.withColumn("prompt", F.when(F.col("asked"), prompt(template, chunk=F.col("working"), examples=examples)))
    if journal is None:
        # Only what isn't derived from the other columns goes to Python and back.
        df = answered(df.drop("working"), client, at_once=at_once, asked="asked").withColumn("working", F.coalesce("pre_llm", "source"))
        df = df.withColumn("proposed", F.coalesce("normal", "candidate"))
    else:
        df = staged(df.withColumn("key", prompt_key(F.col("prompt"))), "asked")
        had = journal.ask(df, client, at_once=at_once).select("key", F.col("answer").alias("candidate"), F.col("error").isNotNull().alias("failed"))
        df = df.join(had, "key", "left").withColumn("failed", F.coalesce("failed", F.lit(False))).drop("key").withColumn("proposed", nfc(F.col("candidate")))
    df = with_verdict(df, "working", "proposed", min_ratio=settings.min_sequence_ratio, max_relative=settings.max_relative_length)
    asked = F.col("asked")
    accepted = asked & ~F.col("failed") & F.coalesce("accepted", F.lit(False))
    why = F.when(~asked | accepted, none).when(F.col("failed"), "ollama_error").otherwise(F.col("reason"))
    output = F.when(accepted, F.col("candidate")).otherwise(F.col("working"))
    skip_reason = F.when(asked, none).otherwise(F.col("gate"))
    return df.select("row_id", "doc_id", "seg_idx", "source", output.alias("output"), (~asked).alias("skipped_llm"), skip_reason.alias("skip_reason"), (asked & ~accepted).alias("rejected_model"), why.alias("reject_reason"), "pre_llm")


def corrected_segments(docs: DataFrame, settings: Settings, **how) -> DataFrame:
    """row_id (a number for each input row) and SEGMENT's columns, a row for each segment."""
    return _processed(docs, settings, **how).where("seg_idx is not null")


def assembled(found: DataFrame) -> DataFrame:
    """row_id, doc_id, text, segments of every document, one without segments included."""
    fields = F.struct("seg_idx", *(c for c in SEGMENT if c not in ("doc_id", "seg_idx")))
    parts = found.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("seg_idx").isNotNull(), fields))).alias("segments"))
    return parts.select("row_id", "doc_id", strip(F.array_join(F.transform("segments", lambda s: s.output), " ")).alias("text"), "segments")


def correct_documents(docs: DataFrame, settings: Settings | None = None, **how) -> DataFrame:
    """doc_id, text, segments of every row of docs(doc_id, text)."""
    return assembled(_processed(docs, settings or load_settings(), **how)).drop("row_id")


def flags(document: DataFrame) -> DataFrame:
    """Adds llm_attempted and llm_applied, as the service reports them."""
    attempted = F.exists("segments", lambda s: ~s.skipped_llm)
    applied = F.exists("segments", lambda s: ~s.skipped_llm & (s.output != F.coalesce(s.pre_llm, s.source)))
    return document.withColumns({"llm_attempted": attempted, "llm_applied": applied})


def _corrected(spark: SparkSession, text: str, settings: Settings, how: dict):
    """One text, with the lexicon that the settings name unless one is given."""
    if settings.use_lexicon and "lexicon" not in how:
        how = how | {"lexicon": read_lexicon(spark, settings.lexicon_path)}
    return flags(correct_documents(spark.createDataFrame([(0, text)], "doc_id long, text string"), settings, **how)).first()


def correct_before_llm(spark: SparkSession, text: str, settings: Settings | None = None, **how) -> dict:
    """The service's first route: everything but the model."""
    row = _corrected(spark, text, replace(settings or load_settings(), use_llm=False), how)
    return {"text": row["text"], "llm_applied": False, "llm_attempted": False}


def correct_final(spark: SparkSession, text: str, settings: Settings | None = None, **how) -> dict:
    """The service's second route."""
    row = _corrected(spark, text, settings or load_settings(), how)
    return {"text": row["text"], "llm_applied": row["llm_applied"], "llm_attempted": row["llm_attempted"]}
