"""Small helpers shared by the operators of this subpackage."""

import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _word_table() -> bytes:
    """Bytes A-Z become a-z; of ASCII only 0-9 and a-z stay, the rest becomes a blank."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isdigit() or c in LOWER else 0x20
    return bytes(table)


WORD_TABLE = _word_table()
#: Bytes that stand for ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on the JVM side, where A-Z is lower-cased before.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def word_bytes(text: str | None) -> list[bytes]:
    """Words of digits, small letters and non-ASCII characters, after lower-casing A-Z; none for null."""
    return utf8(text).translate(WORD_TABLE).split()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def values(column: pa.Array, step: int = 256):
    """The Python values of an Arrow column, a few at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def missing(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with a null column ``name`` where it has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fraction(key: Column, wanted: int, there: int, seed: int) -> Column:
    """True for a share of the keys that leaves about ``wanted`` of ``there`` rows; the same keys in every run."""
    share = 1.0 if there <= wanted else wanted / there
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < math.ceil(share * (1 << 30))


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """What is written inside sends texts to Python in batches of about ``size`` instead of 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def worker_kept() -> dict:
    """What a Python worker keeps from one task to the next; empty in a new worker."""
    return sys.modules.setdefault("_almanac_worker", ModuleType("_almanac_worker")).__dict__.setdefault("kept", {})
