"""First rows, ranks and keys that do not depend on how rows are spread.

A window over one group sends the whole group to one task. The operators
here use aggregates (which combine before the shuffle) or split a group into
value ranges, so a group holding a third of the table is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.session import cpu_slots, written


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, as one aggregate."""
    if len(order) == 1 and len(keep) == 1:
        # one number per side keeps Spark on hash aggregation
        return df.groupBy(*keys).agg(F.min_by(keep[0], order[0]).alias(keep[0]))
    packed = F.struct(
        *[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in keep]
    )
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in keep])
    )


def last_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as one aggregate."""
    packed = F.struct(*order, *[c for c in keep if c not in order])
    return (
        df.groupBy(*keys)
        .agg(F.max(packed).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in keep])
    )


# Spark drops rows beyond the n-th before the shuffle only up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, position: str) -> DataFrame:
    """At most ``n`` rows per key; each partition is limited before the shuffle."""
    if n > GROUP_LIMIT:
        numbered = number_rows(df, keys, order, position).where(F.col(position) <= n)
        return numbered.withColumn(position, F.col(position).cast("int"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).where(F.col(position) <= n)


def rank_top(df: DataFrame, keys: list[str], value: str, n: int, position: str, descending: bool = True) -> DataFrame:
    """Rows with ``RANK() <= n`` per key, ties included.

    The n best rows per key already tell the rank of every value among them;
    rows tied with one of them are found by joining on the value. However many
    ties there are, no task has to hold them.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    best = top_n_per_key(df.select(*keys, value), keys, [order], n, "_n")
    ranks = best.groupBy(*keys, value).agg(F.min("_n").cast("int").alias(position))
    ranks = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), position)
    return df.join(ranks, _same(keys, F.col(value).eqNullSafe(F.col("_v")))).select(*df.columns, position)


ONE_TASK_ROWS = 100_000


def assign_keys(
    df: DataFrame, natural: list[str], key: str, start: int = 0, n_rows: int | None = None, hex_digits: int = 3
) -> DataFrame:
    """Dense integer keys for distinct natural keys, in md5 order.

    A table counted as small is numbered in one sort. Otherwise rows are numbered inside 16**hex_digits equal hash ranges and shifted by
    the sizes of the ranges before, so no task sees more than one range. The
    range sizes are at most 4096 rows, which bounds what is broadcast.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", *natural))).withColumn(
        "_range", F.substring("_h", 1, hex_digits)
    )
    if n_rows is not None and n_rows <= ONE_TASK_ROWS:
        place = F.row_number().over(Window.orderBy("_h", *natural))
        return hashed.withColumn(key, (F.lit(start) + place).cast("int")).drop("_h", "_range")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        hashed.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("_range").orderBy("_h", *natural)
    return (
        hashed.join(F.broadcast(shifts), "_range")
        .withColumn(key, (F.lit(start) + F.col("_shift") + F.row_number().over(inside)).cast("int"))
        .drop("_h", "_range", "_shift")
    )


def _in_ranges(df: DataFrame, keys: list[str], order: list[Column], weight: Column) -> DataFrame:
    """Adds ``_slot``, a range of (keys, order), and ``_shift``, the weight of a key's ranges before it.

    Spark samples the rows to cut ranges of equal size, whatever the values
    look like, so a group of any size is spread over many ranges. The ranged
    rows are written once: sums and rows then agree on the ranges even if
    tasks are run again.
    """
    parts = cpu_slots(df.sparkSession)
    ranged = written(
        df.repartitionByRange(parts, *keys, *order).withColumn("_slot", F.spark_partition_id()), "ranges"
    )
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per key and range
    sums = ranged.groupBy(*keys, "_slot").agg(F.sum(weight).alias("_w"))
    shifts = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slot").alias("_s"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_shift"),
    )
    return ranged.join(shifts, _same(keys, F.col("_slot") == F.col("_s"))).select(*ranged.columns, "_shift")


def _same(keys: list[str], match: Column) -> Column:
    """``match`` and equal keys, nulls included, against the columns ``_k0, _k1, ...``."""
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return match


def number_rows(df: DataFrame, keys: list[str], order: list[Column], position: str) -> DataFrame:
    """Row numbers per key in ``order``, for groups of any size."""
    ranged = _in_ranges(df, keys, order, F.lit(1))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    return ranged.withColumn(position, F.col("_shift") + F.row_number().over(inside)).drop("_slot", "_shift")


def rank_values(df: DataFrame, keys: list[str], value: str, position: str, descending: bool = True) -> DataFrame:
    """SQL ``RANK()`` per key, nulls last, for groups of any size.

    The rank of a value is one plus the rows with a better value. Rows are
    counted per distinct value first, so copies of one value are one row.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranged = _in_ranges(counted, keys, [order], F.col("_n"))
    better = Window.partitionBy(*keys, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(value).alias("_v"),
        (F.lit(1) + F.col("_shift") + F.coalesce(F.sum("_n").over(better), F.lit(0))).alias(position),
    )
    return df.join(ranks, _same(keys, F.col(value).eqNullSafe(F.col("_v")))).select(*df.columns, position)
