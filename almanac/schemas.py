"""The table contracts that the jobs share."""

from pyspark.sql import types as T

LONG_COLUMNS = ["location_code", "indicator_code", "indicator_name", "year", "value"]
REQUIRED_NOT_NULL = ["location_code", "indicator_code", "year", "value"]

LONG_SCHEMA = T.StructType(
    [
        T.StructField("location_code", T.StringType()),
        T.StructField("indicator_code", T.StringType()),
        T.StructField("indicator_name", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

GRID_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.IntegerType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("r", T.IntegerType()),
        T.StructField("c", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

FACT_KEY = ["report_id", "location_sk", "indicator_sk", "date_id"]

FIRST_YEAR = 1750
LAST_YEAR = 2040
