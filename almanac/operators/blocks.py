"""Scoring every left row against every right row in bounded blocks.

Neither side is collected and no row pair is emitted: both sides are cut into
blocks by a hash of their key, every pair of blocks is one task-sized group,
and the scoring function returns only the best rows of its pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_rows: int,
    right_rows: int,
    score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """``score(left_block, right_block)`` over all pairs of blocks of at most about the given rows."""
    n_left = max(1, math.ceil(left.count() / left_rows))
    n_right = max(1, math.ceil(right.count() / right_rows))
    mine = left.withColumn("_l", F.pmod(F.xxhash64(left_key), F.lit(n_left)).cast("int")).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    theirs = right.withColumn("_r", F.pmod(F.xxhash64(right_key), F.lit(n_right)).cast("int")).withColumn(
        "_l", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    )
    return mine.groupBy("_l", "_r").cogroup(theirs.groupBy("_l", "_r")).applyInPandas(score, schema)
