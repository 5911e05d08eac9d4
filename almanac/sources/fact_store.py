"""Facts on disk: partitioned by date, bucketed by a hash of their key, added batch by batch, first write wins.

Beside the facts stand Bloom filters of their keys, as bitmaps for each date and bucket. A batch asks the filters first:
a key that they don't know is new without a look at any fact, and of the facts only the dates and buckets are read in
which keys of the batch may stand already. Each filter holds all keys of its bucket up to its batch, so the newest
one is enough, however many batches there were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from almanac.operators.ordering import first_per_key
from almanac.schemas import FACT_KEY
from almanac.session import written
from almanac.sources import batches

BUCKETS = 16
BITS = 1 << 22  # of the filter of a date and bucket; only parts of it that hold a key are stored
HASHES = 4
LISTED = 2_000  # dates and buckets that a partition filter names one by one

_PART = T.StructType([T.StructField("date_id", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
_FACT = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in FACT_KEY if c != "date_id"] + [T.StructField("value", T.DoubleType()), *_PART.fields]
)
_FILTER = T.StructType([T.StructField("no", T.LongType()), T.StructField("bits", T.BinaryType()), *_PART.fields])
_ENTRY = T.StructType([*_PART.fields, T.StructField("n_rows", T.LongType())])


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*FACT_KEY), F.lit(buckets)).cast("int")


def _places(bits: int) -> Column:
    """The places of a key in its filter, from 1."""
    return F.array(*(F.pmod(F.xxhash64(*FACT_KEY, F.lit(i + 1)), F.lit(bits)) + 1 for i in range(HASHES)))


def entries(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(date_id, bucket, n_rows, batch): what the complete batches hold."""
    return batches.manifest(spark, path, _ENTRY, before)


def read_facts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All facts of complete batches, with ``bucket`` and ``batch``. Filters on ``date_id`` prune folders."""
    known = [r["batch"] for r in entries(spark, path, before).select("batch").distinct().orderBy("batch").collect()]
    return batches.read(spark, path, "facts", _FACT, known)


def _only(df: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """Rows of the given dates and buckets, by a filter on the partition columns."""
    if not parts:
        return df.limit(0)
    dates = sorted({d for d, _ in parts})
    if len(parts) > LISTED:  # a superset; the join behind it decides by key anyway
        return df.where(F.col("date_id").isin(dates) & F.col("bucket").isin(sorted({b for _, b in parts})))
    each = [(F.col("date_id") == d) & F.col("bucket").isin([b for e, b in parts if e == d]) for d in dates]
    return df.where(reduce(lambda a, b: a | b, each))


def _pairs(df: DataFrame) -> list[tuple[int, int]]:
    """The distinct dates and buckets of ``df``; at most as many as the store has folders."""
    return sorted((r[0], r[1]) for r in df.select("date_id", "bucket").distinct().collect())


def newest_filters(spark: SparkSession, path: str, parts: list[tuple[int, int]], before: int | None) -> DataFrame | None:
    """The filters of some dates and buckets, each from the last batch that wrote it; None if no batch did."""
    latest = _only(entries(spark, path, before), parts).groupBy("date_id", "bucket").agg(F.max("batch").alias("batch"))
    latest = [tuple(r) for r in latest.collect()]  # at most a row for each folder
    if not latest:
        return None
    stored = _only(batches.read(spark, path, "filters", _FILTER, sorted({b for _, _, b in latest})), parts)
    newest = spark.createDataFrame(latest, "date_id int, bucket int, batch long")
    return stored.join(newest, ["date_id", "bucket", "batch"], "left_semi").drop("batch")


def maybe_stored(keys: DataFrame, filters: DataFrame, bits: int = BITS) -> DataFrame:
    """The keys of which the filters know all places; no stored key is missing, few others are there."""
    asked = keys.select(*FACT_KEY, "bucket", F.explode(F.array_distinct(_places(bits))).alias("_p"))
    asked = asked.withColumn("no", F.bitmap_bucket_number("_p")).withColumn("_b", F.bitmap_bit_position("_p"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("_b") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (F.col("_b") % 8 + 1).cast("int"))) != 0
    met = asked.join(filters, ["date_id", "bucket", "no"], "left").groupBy(*FACT_KEY, "bucket")
    return met.agg(F.min(F.coalesce(known, F.lit(False)).cast("int")).alias("_all")).where("_all = 1").drop("_all")


def _new_filters(fresh: DataFrame, old: DataFrame | None, bits: int) -> DataFrame:
    """Filters of the dates and buckets of ``fresh``: its keys beside those that the old filters hold."""
    placed = fresh.select("date_id", "bucket", F.explode(_places(bits)).alias("_p"))
    grouped = placed.groupBy("date_id", "bucket", F.bitmap_bucket_number("_p").alias("no"))
    new = grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("bits"))
    if old is not None:
        new = new.unionByName(old).groupBy("date_id", "bucket", "no").agg(F.bitmap_or_agg("bits").alias("bits"))
    return new.select(*_FILTER.names)


def load_facts(rows: DataFrame, path: str, order: list[str], batch: int | None = None, buckets: int = BUCKETS, bits: int = BITS) -> int:
    """Append the facts of ``rows`` whose keys aren't stored yet, as one batch; returns how many there were.

    ``rows`` has the fact key, ``value`` and the columns of ``order``; of rows with one key the first stays. Rows without a
    whole key are no facts. ``batch`` numbers the batch (by default the next one): run again, it sees only the batches
    before it and replaces what it wrote, so nothing is lost or doubled. ``buckets`` and ``bits`` belong to the store and
    stay as they were.
    """
    spark = rows.sparkSession
    if batch is None:
        last = entries(spark, path).agg(F.max("batch")).first()[0]
        batch = 0 if last is None else last + 1
    whole = rows.dropna(subset=FACT_KEY)
    first = first_per_key(whole, FACT_KEY, [F.col(c) for c in order], ["value"]).withColumn("bucket", bucket_of(buckets))
    fresh = first = written(first.select(*(F.col(f.name).cast(f.dataType) for f in _FACT)), "offered")
    old = newest_filters(spark, path, _pairs(first), batch)
    if old is not None:
        maybe = written(maybe_stored(first.select(*FACT_KEY, "bucket"), old, bits), "maybe")
        suspect = _pairs(maybe)
        if suspect:
            stored = _only(read_facts(spark, path, batch), suspect).join(maybe, [*FACT_KEY, "bucket"], "left_semi")
            fresh = first.join(stored.select(*FACT_KEY), FACT_KEY, "left_anti")
    placed = fresh.repartition("date_id", "bucket").sortWithinPartitions("date_id", "bucket", *FACT_KEY[:3])
    placed.select(*_FACT.names).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date_id", "bucket").parquet(batches.folder(path, "facts", batch))
    added = batches.read(spark, path, "facts", _FACT, [batch]).drop("batch")
    held = [tuple(r) for r in added.groupBy("date_id", "bucket").agg(F.count("*")).collect()]  # at most a row for each folder
    if held:
        kept = None if old is None else _only(old, [(d, b) for d, b, _ in held])
        filters = _new_filters(added, kept, bits).repartition("date_id", "bucket").sortWithinPartitions("date_id", "bucket")
        filters.write.mode("overwrite").parquet(batches.folder(path, "filters", batch))
    batches.enter(spark.createDataFrame(held, _ENTRY), path, batch)
    return sum(n for _, _, n in held)
