"""The conformed long table on disk, in buckets of files, and run reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from almanac.operators.quality import require_columns
from almanac.session import written
from almanac.sources import batches

BUCKETS = 64
_FILE = T.StructType([T.StructField("file_id", T.IntegerType()), T.StructField("columns", T.StringType())])


def _bucket(file_id: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(BUCKETS)).cast("int")


def write_silver(df: DataFrame, path: str) -> None:
    """Replace the rows of the files in ``df``, and of no others.

    Files share a fixed number of folders. A write is a batch of its own; of a file the last batch that has it
    counts. The rows are rebalanced by bucket: AQE joins the parts of small ones and splits those of a large one.
    """
    require_columns(df)
    spark = df.sparkSession
    last = batches.manifest(spark, path, _FILE).agg(F.max("batch")).first()[0]
    batch = 0 if last is None else last + 1
    rows = df.withColumn("bucket", _bucket(F.col("file_id"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "file_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(batches.folder(path, "rows", batch))
    stored = spark.read.schema(rows.schema).parquet(batches.folder(path, "rows", batch))
    files = stored.select("file_id").distinct().withColumn("columns", F.lit(df.schema.json()))
    batches.enter(written(files.select(*(F.col(f.name).cast(f.dataType) for f in _FILE)), "files"), path, batch)


def reject_empty(df: DataFrame, files: DataFrame) -> DataFrame:
    """Files that yielded no row, with the reason they fail."""
    return files.join(df.select("file_id").distinct(), "file_id", "left_anti").select(
        "file_id", F.lit("DataFrame vazio após clean_dataframe").alias("error")
    )


def scan_silver(spark: SparkSession, path: str, file_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``file_ids`` only those files' buckets are read."""
    files = batches.manifest(spark, path, _FILE)
    latest = files.groupBy("file_id").agg(F.max("batch").alias("batch"))
    known = files.groupBy("batch").agg(F.first("columns").alias("columns")).orderBy("batch").collect()  # a row for each write
    if not known:
        raise ValueError(f"nothing was stored in {path}")
    schema = T.StructType.fromJson(json.loads(known[-1]["columns"]))
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = batches.read(spark, path, "rows", full, [r["batch"] for r in known])
    if file_ids is not None:
        buckets = spark.createDataFrame([(i,) for i in file_ids], "file_id int").select(_bucket(F.col("file_id")).alias("b")).distinct()
        rows = rows.where(F.col("bucket").isin([r["b"] for r in buckets.collect()]) & F.col("file_id").isin(file_ids))
    return rows.join(latest, ["file_id", "batch"], "left_semi").select(*schema.names)


def write_run_report(funnel: DataFrame, path: str, body: DataFrame | None = None) -> None:
    """One text line per step of a run, and below them the lines of ``body`` (see ``runlog.run_report``), in order."""
    line = F.format_string(
        "[%d] %s  Total: %d  OK: %d  Erro: %d", "step_no", "step", "n_total", "n_ok", "n_error"
    )
    lines = funnel.select(F.lit(0).alias("section"), F.col("step_no").alias("file_id"), F.lit(0).alias("place"), line.alias("line"))
    if body is not None:
        lines = lines.unionByName(body)
    ordered = lines.orderBy("section", "file_id", "place").select(F.col("line").alias("value"))
    ordered.write.mode("overwrite").text(path)
