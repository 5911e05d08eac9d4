"""Names that are written differently, found by an equality join on what is left when letters are deleted.

Two strings that at most k insertions, deletions and replacements tell apart become equal when at most k letters are
deleted from each. Both sides list what remains of their names after up to k deletions; where two lists meet the pair is
compared. No name meets a name that isn't near it, so both sides may be long.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Letters that may differ, by the length of the shorter name.
ONE, TWO = 5, 9


def _fold(name: str | None) -> str | None:
    if name is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(unicodedata.normalize("NFKC", plain).casefold().split())


def folded(name: Column) -> Column:
    """Names without case, accents, compatibility forms and repeated blanks, in any script."""

    @F.arrow_udf("string")
    def fold(names: pa.Array) -> pa.Array:
        return pa.array([_fold(n) for n in names.to_pylist()], pa.string())

    return fold(name)


def allowed(length: Column) -> Column:
    """How many letters of names of this length may differ: none below ``ONE`` letters, one, then two from ``TWO`` on."""
    return F.when(length < ONE, 0).when(length < TWO, 1).otherwise(2)


def remains(key: Column, most: Column) -> Column:
    """What is left of a text after up to ``most`` (0, 1 or 2) of its letters are deleted, each once."""

    def without_one(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.overlay(x, F.lit(""), i, F.lit(1)))

    once = F.when(most >= 1, without_one(key)).otherwise(F.array().cast("array<string>"))
    twice = F.when(most >= 2, F.flatten(F.transform(once, without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(key), once, twice))


def nearest_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, code, distance) for the names of ``asked`` that one code of ``known`` (name, code) is nearest to.

    Equal names (after ``folded``) come first, whatever else is near. Otherwise the fewest letters of difference decide,
    up to ``allowed`` for the shorter name. A name that is as near to two codes as to one is nobody's; of equal names with several codes the
    smallest code counts. Null and blank names match nothing.
    """
    ours = asked.select("name").distinct().withColumn("key", folded(F.col("name"))).where("key != ''")
    theirs = known.select(folded(F.col("name")).alias("known_key"), "code").where("known_key != '' AND code IS NOT NULL")
    theirs = theirs.groupBy("known_key").agg(F.min("code").alias("code"))
    left = ours.select("name", "key", F.explode(remains(F.col("key"), allowed(F.length("key")))).alias("_r"))
    # the shorter name allows what both may lose, so a longer one needn't list more than its own length allows
    right = theirs.select("known_key", "code", F.explode(remains(F.col("known_key"), allowed(F.length("known_key")))).alias("_r"))
    met = left.join(right, "_r").select("name", "key", "known_key", "code").distinct()
    distance = F.levenshtein("key", "known_key")
    near = met.withColumn("distance", distance).where(F.col("distance") <= allowed(F.least(F.length("key"), F.length("known_key"))))
    best = near.groupBy("name", "distance").agg(F.min("code").alias("code"), F.count_distinct("code").alias("_n"))
    first = best.groupBy("name").agg(F.min(F.struct("distance", "code", "_n")).alias("b"))
    return first.where("b._n = 1").select("name", "b.code", "b.distance")
