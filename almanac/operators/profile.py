"""What unknown inputs look like: JSON skeletons and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def profile_json_shape(docs: DataFrame, depth: int = 3, head: int = 4, tail: int = 2) -> DataFrame:
    """One row per JSON object down to ``depth``: its first and last keys and how many there are.

    Keys are listed in text order. A document is read once: the objects of each level come from the object texts of the level
    above, inside its row, and only the skeleton leaves it.
    """
    node = "struct<depth:int,path:string,body:string>"
    is_object = lambda n: n["body"].startswith("{")

    def below(level: Column, n: int) -> Column:
        def children(parent: Column) -> Column:
            entries = F.map_entries(F.from_json(parent["body"], "map<string, string>"))
            return F.transform(
                entries,
                lambda e: F.struct(F.lit(n).alias("depth"), F.concat_ws(".", parent["path"], e["key"]).alias("path"), e["value"].alias("body")),
            )

        return F.filter(F.flatten(F.transform(level, children)), is_object)

    levels = [F.filter(F.array(F.struct(F.lit(0).alias("depth"), F.lit("$").alias("path"), F.col("content").alias("body"))), is_object)]
    for n in range(1, depth):
        levels.append(below(levels[-1], n))
    nodes = docs.select("file_id", F.inline(F.concat(*(x.cast(f"array<{node}>") for x in levels))))
    keyed = nodes.select("file_id", "depth", "path", F.array_sort(F.json_object_keys("body")).alias("keys"))
    first = F.slice("keys", 1, head)
    last = F.when(
        F.size("keys") > head,
        F.slice("keys", F.greatest(F.size("keys") - (tail - 1), F.lit(head + 1)), tail),
    ).otherwise(F.array().cast("array<string>"))
    hidden = F.size("keys") - F.size(first) - F.size(last)
    more = F.when(hidden > 0, F.concat(F.lit("... ("), hidden.cast("string"), F.lit(" more keys) ...")))
    return keyed.select("file_id", "depth", "path", F.size("keys").alias("n_keys"), F.concat_ws(", ", first, more, last).alias("keys"))


def profile_tabular(df: DataFrame) -> DataFrame:
    """Rows, nulls, smallest and largest text per column, in one pass."""
    stats = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        stats += [
            F.count_if(text.isNull()).alias(f"{c}|n"),
            F.min(text).alias(f"{c}|lo"),
            F.max(text).alias(f"{c}|hi"),
        ]
    one = df.agg(F.count("*").alias("n_rows"), *stats)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.col("n_rows"),
                F.col(f"`{c}|n`").alias("n_null"),
                F.col(f"`{c}|lo`").alias("min_text"),
                F.col(f"`{c}|hi`").alias("max_text"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return one.select(F.inline(entries))
