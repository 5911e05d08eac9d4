"""Tables that grow by batches: a folder for each, and a manifest of those that are complete.

A batch writes its own folders and enters the manifest last, so a batch that ended half-way is never read, and one that
is run again replaces itself. Everything goes through Spark's readers and writers; the store can lie wherever they reach.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T


def folder(path: str, what: str, batch: int) -> str:
    return f"{path}/{what}/batch={batch:09d}"


def enter(entries: DataFrame, path: str, batch: int) -> None:
    """Complete the batch: ``entries`` says what it holds."""
    entries.coalesce(1).write.mode("overwrite").parquet(folder(path, "manifest", batch))


def manifest(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """What the complete batches hold, with ``batch``; optionally only those before a batch."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        found = spark.read.schema(full).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)  # nothing was ever written
    return found if before is None else found.where(found["batch"] < before)


def read(spark: SparkSession, path: str, what: str, schema: T.StructType, batches: list[int]) -> DataFrame:
    """The rows of the given batches, with their partition columns and ``batch``."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not batches:
        return spark.createDataFrame([], full)
    paths = [folder(path, what, b) for b in batches]
    return spark.read.schema(full).option("basePath", f"{path}/{what}").parquet(*paths)
