"""Sources and sinks: Markdown folders, JSON labels, Parquet collections, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sessions import last_write


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Source (file name) and markdown of every *.md file of a folder."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source"), F.col("value").alias("markdown"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Label files that hold one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


class Collection:
    """A named store of rows (key, text, ..., embedding) as versioned Parquet; each write makes a new version, and the
    pointer file moves after it is whole, so a failed write leaves the last version."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _pointer(self) -> str | None:
        try:
            return self.spark.read.text(f"{self.path}/current").agg(F.max("value")).first()[0]
        except Exception as e:  # a store that has no version yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def exists(self) -> bool:
        return self._pointer() is not None

    def all(self) -> DataFrame:
        """S6, in no order: ids are keys."""
        return self.spark.read.parquet(f"{self.path}/{self._pointer()}")

    def _write(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Rows replace those with their keys; of rows with one key the last by order counts."""
        fresh = last_write(rows, [self.key], order) if order else rows.dropDuplicates([self.key])
        self._write(self.all().join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh, allowMissingColumns=True) if self.exists() else fresh)

    def update(self, rows: DataFrame, *columns: str) -> None:
        """New values of some columns for keys that are there."""
        new = rows.select(self.key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("new_"))
        old = self.all().join(new, self.key, "left")
        self._write(old.withColumns({c: F.when(F.col("new_"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}).drop("new_", *[f"new_{c}" for c in columns]))

    def delete(self, keys: DataFrame) -> None:
        """S11."""
        self._write(self.all().join(keys.select(self.key), self.key, "left_anti"))

    def get(self, key) -> DataFrame:
        """The filter reaches the Parquet scan."""
        return self.all().where(F.col(self.key) == key)

    def count(self) -> int:
        """S12."""
        return self.all().count() if self.exists() else 0


def write_metrics(metrics: DataFrame, path: str) -> None:
    """S14."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(metrics: DataFrame, title: str) -> str:
    """A table of all rows of metrics, as Markdown; rows come to the driver a partition at a time."""
    rows = metrics.toLocalIterator()
    head = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]) + "\n"
