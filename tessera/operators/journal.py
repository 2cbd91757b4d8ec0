"""A journal of outside calls: equal prompts are asked once, and an answer that was had is never asked for again.

The journal is a folder that driver and executors share. A run stages the distinct prompts that the journal lacks (an anti join
by the SHA-256 of the prompt) and lets tasks call. A task writes its answers every few calls, each time as one new file, under its run
and partition; the name is only given to a whole file. A task that fails and is tried again, on whatever machine, first reads
what its partition has already written and goes on from there; a run that dies is resumed by the next one's anti join. So a
prompt costs a second call only if an executor is lost between the call and its file, which at most `every` calls can meet, or if two attempts of one task
run at a time (spark.speculation, refused here).

Calls that fail are answers too (null, with the error), unless they are to be tried again. Null prompts aren't asked.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.stage import staged

SCHEMA = "key string, answer string, error string, run string, part int"


def prompt_key(prompt):
    return F.sha2(prompt.cast("binary"), 256)


class Journal:
    """path: of any file system that both Spark and pyarrow reach by the same address, such as file, hdfs or s3."""

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        if spark.conf.get("spark.speculation", "false") == "true" or spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
            raise ValueError("two attempts of one task would make the same calls: turn spark.speculation off")
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def answers(self) -> DataFrame:
        """key, answer, error of all calls so far, one row for each key."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], "key string, answer string, error string")
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.path)
        # An answer comes before an error, then the earlier run.
        first = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "run", "part", "answer", "error"))
        return rows.groupBy("key").agg(first.alias("x")).select("key", "x.answer", "x.error")

    def ask(self, prompts: DataFrame, client: Callable[[str], str], prompt: str = "prompt", at_once: int = 1, retry_failures: bool = False) -> DataFrame:
        """key, answer, error of every prompt of prompts, those of earlier runs included. The calls are made here."""
        wanted = staged(prompts.select(F.col(prompt).alias("prompt")).where("prompt is not null").distinct().withColumn("key", prompt_key(F.col("prompt"))), "prompts")
        had = self.answers().where("error is null") if retry_failures else self.answers()
        # Staged before the calls: what is pending doesn't change while they are made.
        pending = staged(wanted.join(had, "key", "left_anti"), "pending")
        calls = pending.mapInPandas(_calls(self.path, uuid.uuid4().hex, client, self.every, at_once), "calls long")
        calls.agg(F.sum("calls")).collect()
        return self.answers().join(wanted.select("key"), "key", "left_semi")


def _calls(path: str, run: str, client: Callable[[str], str], every: int, at_once: int):
    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            return client(prompt), None
        except Exception as e:  # noqa: BLE001  one call never fails the task
            return None, str(e) or type(e).__name__

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "hdfs:", "s3:")) else (fs.LocalFileSystem(), path)
        folder = f"{root}/{run}/{part}"
        had = set()
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.path.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    had |= {json.loads(line)["key"] for line in f.read().decode().splitlines()}
        system.create_dir(folder, recursive=True)
        files = 0
        for batch in batches:
            left = [(k, p) for k, p in zip(batch["key"], batch["prompt"], strict=True) if k not in had]
            for i in range(0, len(left), every):
                some = left[i : i + every]
                if at_once > 1:
                    with ThreadPoolExecutor(at_once) as pool:
                        answers = list(pool.map(ask, [p for _, p in some]))
                else:
                    answers = [ask(p) for _, p in some]
                lines = [json.dumps({"key": k, "answer": a, "error": e, "run": run, "part": part}) for (k, _), (a, e) in zip(some, answers, strict=True)]
                name = f"{folder}/{attempt}-{files}"
                files += 1
                with system.open_output_stream(f"{name}.part") as f:
                    f.write("\n".join(lines).encode())
                system.move(f"{name}.part", f"{name}.json")
            yield pd.DataFrame({"calls": [len(left)]})

    return task
