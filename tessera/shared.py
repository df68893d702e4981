"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a default is used only where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or "/tmp/checkpoints/tessera").rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of that folder, for what is read more than once: lost executors cost none of it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files of fewer bytes may be a single row group, which is one task however many cores there are.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt out to all cores, so that work on long texts doesn't stand in one task; a large one, whose files have many
    row groups, as it is. Filters and column choices still reach the scan."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < SMALL else df
