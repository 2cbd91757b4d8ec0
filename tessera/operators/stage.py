"""Tables written between two parts of a plan, so that both branches of a split read them instead of running what comes before twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share, deleted when the application ends. Only where that is
    unset (one machine, as in tests) a local folder is made and set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to a shared path and read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, label: str = "rows", name: str = "row_id") -> DataFrame:
    """df with a number that no other row has. It is written with the rows, so that every reader finds the same numbers, whatever is lost or
    run again; ids of the data themselves may be null or repeat."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()), label)
