"""Correction of documents that arrive as files. Each document is corrected on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.config import Settings
from tessera.plans.correct import correct_documents
from tessera.ship import ship

SCHEMA = "doc_id long, text string"


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def correct_stream(docs: DataFrame, settings: Settings, output: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends corrected documents to output as Parquet, a folder for each batch; a batch that runs again replaces its own."""
    ship(docs.sparkSession)

    def one_batch(batch: DataFrame, number: int) -> None:
        correct_documents(batch, settings, **how).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return docs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
