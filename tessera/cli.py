"""Corrects one text: python -m tessera.cli [file] [-o file] [--json-report file] [--verbose]. Without a file, or for "-", standard input and output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.config import load_settings
from tessera.operators.lexicon import read_lexicon
from tessera.plans.correct import correct_documents
from tessera.ship import ship
from tessera.sources.readers import read_document
from tessera.sources.writers import report_json, trace, write_text


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **how) -> int:
    args = argparse.ArgumentParser(prog="tessera", description=__doc__)
    args.add_argument("input", nargs="?", default="-")
    args.add_argument("-o", "--output", default="-")
    args.add_argument("--json-report")
    args.add_argument("--verbose", action="store_true", help="what was decided on each segment, to standard error")
    given = args.parse_args(argv)
    spark, settings = spark or SparkSession.builder.appName("tessera").getOrCreate(), load_settings()
    ship(spark)
    docs = read_document(spark, given.input)
    lexicon = read_lexicon(spark, settings.lexicon_path) if settings.use_lexicon else None
    found = correct_documents(docs, settings, lexicon=lexicon, **how)
    row = found.withColumn("report", report_json(settings.llm_model)).first()
    write_text(row["text"], given.output)
    if given.json_report:
        write_text(row["report"], given.json_report)
    if given.verbose:
        segments = spark.createDataFrame([(row["doc_id"], row["segments"])], found.select("doc_id", "segments").schema)
        told = trace(segments.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*"))
        for line, s in zip((r["line"] for r in told.orderBy("seg_idx").collect()), row["segments"], strict=True):
            parts = [line, f"  IN : {s['source']}", *([f"  PRE: {s['pre_llm']}"] if s["pre_llm"] else []), f"  OUT: {s['output']}"]
            sys.stderr.write("\n".join(parts) + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
