"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomread-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, so that later jobs do not depend on its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int = 200_000) -> int:
    """How many tasks take about ``rows`` of ``df`` each: a stated number of parts is not put together again by their size before rows multiply or meet."""
    return min(4096, 16 + df.count() // rows)


def distinct_in_tasks(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The distinct rows of ``df``, dealt by their hash to tasks of about ``rows`` rows before any are held.

    distinct() would hold those of a whole input split in a task, and then of as many shuffled bytes as Spark puts together.
    """
    return df.repartition(tasks_for(df, rows), *df.columns).distinct()
