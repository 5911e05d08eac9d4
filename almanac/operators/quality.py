"""Cleaning and the per-file gates, each in one pass over all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.casts import is_iso3, to_number
from almanac.operators.ordering import top_n_per_key
from almanac.schemas import LONG_COLUMNS, REQUIRED_NOT_NULL


def require_columns(df: DataFrame, required: list[str] | None = None) -> None:
    """Fail before any job when a column is missing."""
    missing = sorted(set(required or LONG_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")


def clean_long(df: DataFrame) -> DataFrame:
    """Full copies go first, then incomplete rows, then names are filled from codes."""
    require_columns(df)
    return (
        df.dropDuplicates()
        .dropna(subset=REQUIRED_NOT_NULL)
        .withColumn("indicator_name", F.coalesce("indicator_name", "indicator_code"))
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per file and column."""
    return df.groupBy("file_id").agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def sample_head(df: DataFrame, column: str, order: list[str], n: int = 30) -> DataFrame:
    """The first n non-null values per file, in a stated order."""
    filled = df.where(F.col(column).isNotNull())
    return top_n_per_key(filled, ["file_id"], [F.col(c) for c in order], n, "position")


def _code_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Per file: how many sampled location codes there are, how many are ISO3, the first five that are not."""
    sample = sample_head(df, "location_code", order, n)
    good = is_iso3(F.col("location_code"))
    # at most n entries per file
    bad = F.array_sort(F.collect_list(F.when(~good, F.struct("position", "location_code"))))
    return sample.groupBy("file_id").agg(
        F.count("*").alias("n_sampled"),
        F.count_if(good).alias("n_iso3"),
        F.transform(F.slice(bad, 1, 5), lambda x: x["location_code"]).alias("bad_codes"),
    )


def _list_text(codes: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(codes, "', '"), F.lit("']"))


def dq_gate(
    df: DataFrame, order: list[str], files: DataFrame | None = None, min_ratio: float = 0.8, sample: int = 30
) -> DataFrame:
    """One row per file: whether it may be loaded, and every reason why not.

    ``files`` lists the files that must be present; one without rows is empty.
    """
    require_columns(df)
    counted = df.groupBy("file_id").agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("location_code", "indicator_code", "year")],
        F.count_if(to_number(F.col("year").cast("string")).isNull()).alias("bad_years"),
        F.count_if(to_number(F.col("value").cast("string")).isNotNull()).alias("good_values"),
    )
    joined = counted.join(_code_sample(df, order, sample), "file_id", "left")
    if files is not None:
        joined = files.select("file_id").join(joined, "file_id", "left")
    # The texts of the gate, as logged.
    nulls = [
        F.when(F.col(f"null_{c}") > 0, F.format_string(f"'{c}' tem %d valor(es) nulo(s)", f"null_{c}"))
        for c in ("location_code", "indicator_code", "year")
    ]
    codes = F.when(
        F.col("n_iso3") < F.greatest(F.lit(1.0), F.col("n_sampled") * min_ratio),
        F.concat(
            F.lit("'location_code' não contém códigos ISO3 válidos (ex: 'AFG','PRT'). Encontrado: "),
            _list_text(F.col("bad_codes")),
        ),
    )
    years = F.when(F.col("bad_years") > 0, F.format_string("'year' tem %d valor(es) não numérico(s)", "bad_years"))
    values = F.when(F.col("good_values") == 0, F.lit("'value' não tem nenhum valor numérico válido"))
    empty = F.when(F.col("n_rows").isNull(), F.lit("Ficheiro Parquet está vazio"))
    reasons = F.array_compact(F.array(empty, *nulls, codes, years, values))
    return joined.select(
        "file_id", (F.size(reasons) == 0).alias("ok"), F.array_join(reasons, "; ").alias("message")
    )


def extractor_contract(df: DataFrame, order: list[str], min_ratio: float = 0.4, sample: int = 30) -> DataFrame:
    """What a new extractor must deliver: rows, and location codes that look like ISO3."""
    require_columns(df)
    codes = _code_sample(df, order, sample)
    counted = df.groupBy("file_id").agg(F.count("*").alias("n_rows")).join(codes, "file_id", "left")
    failed = F.col("n_iso3") < F.greatest(F.lit(1.0), F.col("n_sampled") * min_ratio)
    # Fixed value: the text returned for a failed contract.
    error = F.when(
        failed,
        F.concat(
            F.lit("location_code must be ISO3 codes (3 uppercase letters, e.g. 'AFG', 'USA', 'PRT'). Got: "),
            _list_text(F.col("bad_codes")),
            F.lit(
                ". Identify the column whose values are exactly 3 uppercase letters and use it as location_code."
            ),
        ),
    )
    return counted.select("file_id", F.coalesce(~failed, F.lit(True)).alias("valid"), error.alias("error"))


def contract_preview(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first rows per file, shown with a contract result."""
    return top_n_per_key(df, ["file_id"], [F.col(c) for c in order], n, "position")
