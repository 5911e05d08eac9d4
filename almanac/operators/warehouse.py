"""The star schema: dimensions, keys, conflict-ignoring load, flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.operators.ordering import ONE_TASK_ROWS, assign_keys, first_per_key
from almanac.schemas import FACT_KEY
from almanac.session import written


def seed_dim_date(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(
        (F.col("id") - (first - 1)).cast("int").alias("date_id"), F.col("id").cast("int").alias("year")
    )


def seed_dim_location(reference: DataFrame) -> DataFrame:
    """Country reference rows; the region text ``not found`` means no region."""
    for column in ("region", "sub_region"):
        reference = reference.withColumn(column, F.nullif(column, F.lit("not found")))
    return reference


def distinct_pairs(silver: DataFrame) -> DataFrame:
    """Distinct (source, code, name) over all files."""
    return silver.select(
        F.col("source_code").alias("source_system"), "indicator_code", "indicator_name"
    ).distinct()


def new_indicators(silver: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Indicator rows for codes not seen before, with keys after the last one.

    A code with several names keeps the smallest name. The distinct codes are
    written out: the source rows are then read only once, and joins against
    the dimension see its true size.
    """
    natural = ["source_system", "indicator_code"]
    fresh = silver.groupBy(F.col("source_code").alias("source_system"), "indicator_code").agg(
        F.min("indicator_name").alias("indicator_name")
    )
    start = 0
    if existing is not None:
        fresh = fresh.join(existing, natural, "left_anti")
        start = existing.agg(F.coalesce(F.max("indicator_sk"), F.lit(0))).first()[0]
    fresh = written(fresh, "new-codes")
    n_rows = fresh.count()
    keyed = assign_keys(fresh, natural, "indicator_sk", start, n_rows)
    keyed = keyed.select("indicator_sk", *natural, "indicator_name")
    return keyed if n_rows <= ONE_TASK_ROWS else written(keyed, "new-indicators")


def with_surrogates(
    silver: DataFrame, locations: DataFrame, indicators: DataFrame, dates: DataFrame
) -> DataFrame:
    """Natural codes to keys; a code without a key gets null."""
    return (
        silver.join(locations.select("location_code", "location_sk"), "location_code", "left")
        .join(
            indicators.select(F.col("source_system").alias("source_code"), "indicator_code", "indicator_sk"),
            ["source_code", "indicator_code"],
            "left",
        )
        .join(dates.select("year", "date_id"), "year", "left")
    )


def surrogate_lookup(
    silver: DataFrame, locations: DataFrame, indicators: DataFrame, dates: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Rows with all three keys, and the quarantined rest."""
    keyed = with_surrogates(silver, locations, indicators, dates)
    complete = (
        F.col("location_sk").isNotNull() & F.col("indicator_sk").isNotNull() & F.col("date_id").isNotNull()
    )
    return keyed.where(complete), keyed.where(~complete)


def first_write_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """One fact per key; the row written first stays."""
    return first_per_key(rows, FACT_KEY, [F.col(c) for c in order], ["value"])


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: first per key, and only keys not present yet."""
    payload = [c for c in new.columns if c not in keys]
    first = first_per_key(new, keys, [F.col(c) for c in order], payload)
    return first.select(*new.columns).join(existing.select(*keys), keys, "left_anti")


def replace_report(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The other load mode: facts of a reloaded report give way to the new ones."""
    kept = existing.join(new.select("report_id").distinct(), "report_id", "left_anti")
    return kept.select(*FACT_KEY, "value").unionByName(new.select(*FACT_KEY, "value"))


def upsert_update(existing: DataFrame, new: DataFrame, key: str, keep_old_when_null: tuple[str, ...] = ()) -> DataFrame:
    """Insert or overwrite per key; the named columns keep the old value when the new one is null."""
    old = existing.alias("old")
    fresh = new.alias("new").withColumn("_fresh", F.lit(True)).alias("new")
    columns: list[Column] = [F.coalesce(f"new.{key}", f"old.{key}").alias(key)]
    for c in existing.columns:
        if c == key:
            continue
        if c not in new.columns:
            columns.append(F.col(f"old.{c}").alias(c))
        elif c in keep_old_when_null:
            columns.append(F.coalesce(f"new.{c}", f"old.{c}").alias(c))
        else:
            columns.append(F.when(F.col("new._fresh"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return old.join(fresh, F.col(f"old.{key}") == F.col(f"new.{key}"), "full").select(*columns)


def patch_coalesce(
    table: DataFrame, patches: DataFrame, key: str, overwrite: tuple[str, ...] = (), status: str = "pipeline_status"
) -> DataFrame:
    """Partial update: given values replace, missing ones stay, the status starts over.

    Columns in ``overwrite`` take the patch even where it is null.
    """
    fresh = patches.withColumn("_hit", F.lit(True)).alias("p")
    columns: list[Column] = []
    for c in table.columns:
        old = F.col(f"t.{c}")
        if c == status:
            columns.append(F.when(F.col("p._hit"), F.lit("pending")).otherwise(old).alias(c))
        elif c == key or c not in patches.columns:
            columns.append(old.alias(c))
        elif c in overwrite:
            columns.append(F.when(F.col("p._hit"), F.col(f"p.{c}")).otherwise(old).alias(c))
        else:
            columns.append(F.coalesce(F.col(f"p.{c}"), old).alias(c))
    return table.alias("t").join(fresh, F.col(f"t.{key}") == F.col(f"p.{key}"), "left").select(*columns)


def distinct_join_load(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Report dimension: reports with a file in silver or done."""
    loaded = files.where(F.col("pipeline_status").isin("silver", "done")).select("report_id")
    return reports.join(loaded, "report_id", "left_semi").select(
        "report_id",
        "source_code",
        F.col("source_code").alias("source_name"),
        "report_url",
        "publication_date",
    )


def star_rows(facts: DataFrame, indicators: DataFrame, locations: DataFrame, dates: DataFrame) -> DataFrame:
    """Facts with every dimension attribute the queries use."""
    return (
        facts.join(indicators, "indicator_sk")
        .join(locations, "location_sk")
        .join(dates, "date_id")
        .select(
            "report_id",
            "indicator_sk",
            "source_system",
            "indicator_code",
            "indicator_name",
            "location_code",
            F.col("name").alias("location_name"),
            "region",
            "sub_region",
            "year",
            "value",
        )
    )


def star_join(facts: DataFrame, indicators: DataFrame, locations: DataFrame, dates: DataFrame) -> DataFrame:
    """The flat view: indicator name, location name, value, year."""
    return star_rows(facts, indicators, locations, dates).select(
        "indicator_name", "location_name", "value", "year"
    )


def load_result_message(keyed: DataFrame) -> DataFrame:
    """Per file: rows, rows with all keys, and the message when none has."""
    gaps = [F.sum(F.col(c).isNull().cast("long")).alias(f"no_{c}") for c in ("location_sk", "indicator_sk", "date_id")]
    complete = (
        F.col("location_sk").isNotNull() & F.col("indicator_sk").isNotNull() & F.col("date_id").isNotNull()
    )
    counted = keyed.groupBy("file_id").agg(
        F.count("*").alias("n_rows"), F.sum(complete.cast("long")).alias("n_valid"), *gaps
    )
    # Fixed value: the text of the load error.
    text = F.format_string(
        "0 linhas válidas de %d — location_sk em falta: %d, indicator_sk em falta: %d, date_id em falta: %d",
        "n_rows",
        "no_location_sk",
        "no_indicator_sk",
        "no_date_id",
    )
    return counted.select(
        "file_id", "n_rows", "n_valid", F.when(F.col("n_valid") == 0, text).alias("message")
    )
