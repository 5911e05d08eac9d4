"""License scans by diagonal voting: word k-grams meet template positions, and diagonals that agree are spans."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.llm.common import WORD_SEPARATORS, ascii_lower

GRAM = 4
#: (name, label, text): short phrases that count wherever their words stand.
PHRASES = [
    ("mit license", "mit", "mit license"),
    ("apache license", "apache", "apache license"),
    ("general public license", "gpl", "general public license"),
]
#: Passages of well-known license texts and notices; a part of one is enough.
TEMPLATES = [
    ("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-notice", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-notice", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-line", "gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-line", "cc", "licensed under cc by nc 4 0"),
    ("cc-notice", "cc", "this work is licensed under a creative commons attribution"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Words of digits, small letters and non-ASCII characters, after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_SEPARATORS), "")


def _rows(spark, entries: list[tuple[str, str, str]], exact: bool, gram: int) -> DataFrame:
    """(template, label, exact, k, grams, at, gram): every gram of every template, with its place."""
    listed = ", ".join(f"('{n}', '{label}', '{text}')" for n, label, text in entries)
    table = spark.sql(f"SELECT * FROM VALUES {listed} AS t(template, label, text)")
    table = table.withColumn("w", F.split("text", " ")).withColumn("exact", F.lit(exact))
    table = table.withColumn("k", F.lit(2) if exact else F.least(F.lit(gram), F.size("w")))
    table = table.withColumn("grams", F.size("w") - F.col("k") + 1)
    at = table.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    gram_text = F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ")
    return at.select("template", "label", "exact", "k", "grams", "at", gram_text.alias("gram"))


def scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, gram: int = GRAM, slack: int = 3, least: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Add ``n_words`` and ``spans``: each with template, label, exact, first_word, last_word (words from 0) and score.

    Every word k-gram of every text (k = 2 for phrases, ``gram`` for templates) is joined by its hash with the grams of
    the templates, and the gram itself confirms. Hits vote for the diagonal, place in the text less place in the template.
    A phrase is found where all its grams are on one diagonal. For templates, diagonals within ``slack`` of each other
    whose hits overlap are merged, so a word put in or left out doesn't part a span; a span counts if at least
    ``least`` of the template's grams are hit, in at most as many words as the template has and that share allows. ``score`` is the share of grams.

    Only hits are shuffled, by row; a passage in many documents is many small groups. Templates are a small
    parameter. Null texts are empty; texts without words have no spans. Rows are told apart by id and text, so equal rows
    have equal results, as have rows without id. Columns with a name of the result are replaced.
    """
    spark = docs.sparkSession
    known = _rows(spark, phrases, True, gram).union(_rows(spark, templates, False, gram))
    known = known.withColumn("_hash", F.xxhash64("gram")).withColumnRenamed("gram", "_gram")
    key = [F.col(id_col).alias("_id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("_text")]
    w = docs.select(*key, words(F.col(text_col)).alias("w"))
    n = F.size("w")

    def grams(k: int) -> Column:
        def joined(first: Column, i: Column) -> Column:
            rest = [x for j in range(1, k) for x in (F.lit(" "), F.get(F.col("w"), i + j))]
            return F.concat(first, *rest)

        return F.when(n >= k, F.transform(F.slice("w", 1, n - (k - 1)), joined))

    def hits(k: int) -> DataFrame:
        places = w.select("_id", "_text", F.posexplode(grams(k)).alias("place", "gram"))
        places = places.withColumn("_hash", F.xxhash64("gram"))
        mine = known.where(F.col("k") == k)
        return places.join(mine, (places["_hash"] == mine["_hash"]) & (places["gram"] == mine["_gram"])).select(
            "_id", "_text", "template", "label", "exact", "k", "grams", "at", "place", (F.col("place") - F.col("at")).alias("diagonal")
        )

    sizes = [r[0] for r in known.select("k").distinct().orderBy("k").collect()]
    found = hits(sizes[0])
    for k in sizes[1:]:
        found = found.union(hits(k))
    row = ["_id", "_text", "template", "label", "exact", "k", "grams"]
    # the sets of places make the votes of equal rows one vote
    votes = found.groupBy(*row, "diagonal").agg(
        F.min("place").alias("a"), F.max(F.col("place") + F.col("k") - 1).alias("b"),
        F.collect_set("at").alias("ats"),  # at most the template's grams
    )
    one = votes.where("exact and size(ats) = grams").select(
        *row, F.col("diagonal").alias("a"), (F.col("diagonal") + F.col("grams") + F.col("k") - 2).alias("b"), F.lit(1.0).alias("score")
    )
    order = Window.partitionBy(*row).orderBy("a", "diagonal")
    near = votes.where("not exact").withColumns({
        "_end": F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "_last": F.lag("diagonal").over(order),
    })
    joined = F.coalesce((F.abs(F.col("diagonal") - F.col("_last")) <= slack) & (F.col("a") <= F.col("_end") + F.col("k") + slack), F.lit(False))
    near = near.withColumn("_part", F.sum((~joined).cast("int")).over(order))
    merged = near.groupBy(*row, "_part").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hit")
    )
    merged = merged.withColumn("score", F.col("hit") / F.col("grams"))
    length = F.col("grams") + F.col("k") - 1
    verified = merged.where((F.col("score") >= least) & (F.col("b") - F.col("a") + 1 <= length / least))
    spans = one.unionByName(verified.select(*row, "a", "b", "score")).groupBy("_id", "_text").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("a").cast("long").alias("first_word"), F.col("b").cast("long").alias("last_word"), "template", "label", "exact", "score"
        ))).alias("spans")
    )
    spans = spans.select(F.col("_id").alias("_i"), F.col("_text").alias("_t"), "spans")
    out = docs.drop("n_words", "spans").withColumn("n_words", F.size(words(F.col(text_col))).cast("long"))
    out = out.withColumn("_text", key[1])
    return out.join(spans, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left").drop("_i", "_t", "_text")
