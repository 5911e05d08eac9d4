"""Routing of free-text questions, for whole tables of them.

``questions`` has ``q_id, question``. Every step adds typed columns; nothing
is assembled as SQL text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import wordlists as W
from almanac.functions.fuzzy import NameIndex
from almanac.operators.blocks import block_pairs
from almanac.session import cpu_slots, written

THRESHOLD = 72.0  # fixed value: least similarity of an indicator match


def _says(text: Column, pattern: str) -> Column:
    """Regular expression with Unicode word boundaries."""
    return text.rlike("(?U)" + pattern)


def q_strip_context(question: Column) -> Column:
    """The question without the repeated earlier exchange."""
    return F.regexp_replace(question, "(?U)^(?s:.*?)" + W.CONTEXT_PREFIX, "")


def q_years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + W.YEAR), F.lit(0))


def with_parts(questions: DataFrame) -> DataFrame:
    """Adds the new text, its lower-case form, and the years of the new and the whole text."""
    return (
        questions.withColumn("new_text", q_strip_context(F.col("question")))
        .withColumn("low", F.lower("new_text"))
        .withColumn("has_context", _says(F.col("question"), W.CONTEXT_PREFIX))
        .withColumn("years", q_years(F.col("new_text")))
        .withColumn("all_years", q_years(F.col("question")))
    )


def q_classify(questions: DataFrame) -> DataFrame:
    """Adds ``tier`` and ``why``; the first rule that holds decides."""
    q = questions if "low" in questions.columns else with_parts(questions)
    low, years = F.col("low"), F.col("years")
    one_year = F.size(years) == 1

    def verdict(tier: Column | str, why: Column | str) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_col(tier).alias("tier"), as_col(why).alias("why"))

    rules: list[tuple[Column, Column]] = []
    for pattern, what in W.META_SIGNALS:
        rules.append((_says(low, pattern), verdict(f"meta:{what}", f"meta: {pattern}")))
    for pattern in W.COMPARISON_SIGNALS:
        rules.append((_says(low, pattern), verdict("comparison", f"comparison: {pattern}")))
    asks_existence = reduce(lambda a, b: a | b, [_says(low, p) for p in W.EXISTENCE_SIGNALS])
    dated = F.concat(F.lit("existence, year="), F.get(years, F.lit(0)))
    rules.append((asks_existence & one_year, verdict("existence", dated)))
    rules.append((asks_existence, verdict("existence_inferred", "existence, year inferred")))
    for pattern in W.COMPLEX_SIGNALS:
        rules.append((_says(low, pattern), verdict("complex", f"complex: {pattern}")))
    two_years = _says(F.col("new_text"), W.YEAR + ".*" + W.YEAR)
    rules.append((two_years, verdict("complex", "multiple years")))
    rules.append((one_year, verdict("simple", F.concat(F.lit("simple, year="), F.get(years, F.lit(0))))))
    rules.append((F.size(years) == 0, verdict("simple_inferred", "no year — use MAX")))

    chain = F.when(*rules[0])
    for condition, result in rules[1:]:
        chain = chain.when(condition, result)
    chosen = chain.otherwise(verdict("uncertain", "uncertain — fallback"))
    return q.withColumn("_verdict", chosen).select(*q.columns, "_verdict.tier", "_verdict.why")


def q_year_resolve(latest_year: int | Column | None) -> Column:
    """First year of the new text, else of the context, else the latest one; null where an empty star has none."""
    latest = latest_year if isinstance(latest_year, Column) else F.lit(latest_year)
    in_context = F.when(F.col("has_context"), F.get("all_years", F.lit(0)))
    return F.coalesce(F.get("years", F.lit(0)).cast("int"), in_context.cast("int"), latest.cast("int"))


def q_topn(question: Column) -> Column:
    """N of ``top N``, else null."""
    return F.nullif(F.regexp_extract(F.lower(question), "(?U)" + W.TOP_N, 1), F.lit("")).try_cast("int")


def q_ascending(question: Column) -> Column:
    return _says(F.lower(question), W.WORST_WORDS)


def q_template(tier: Column, question: Column) -> Column:
    """The query shape that answers a tier."""
    low = F.lower(question)
    ranking = reduce(lambda a, b: a | b, [low.contains(w) for w in W.RANKING_WORDS])
    return (
        F.when(tier.isin("existence", "existence_inferred"), "existence")
        .when(tier == "comparison", "comparison")
        .when(tier.isin("complex", "uncertain"), "complex")
        .when(ranking, "ranking")
        .otherwise("value")
    )


# --- countries -------------------------------------------------------------------------------

SMALL_ALIASES = 1_000
ALIAS_BLOCK = 100_000  # aliases that are sent to every task at once


def country_aliases(spark) -> DataFrame:
    """The fixed alias list as a table ``(alias, name, place)``."""
    rows = [(a, n, i) for i, (a, n) in enumerate(W.COUNTRY_ALIASES.items())]
    return spark.createDataFrame(rows, "alias string, name string, place int")


def alias_hits(texts: DataFrame, key: str, text: str, aliases: DataFrame, small: int = SMALL_ALIASES) -> DataFrame:
    """Every alias ``(alias, name, place)`` contained in a lower-cased text, with its first position.

    Few aliases are tested one by one inside the row. Many are found by an
    equality join: the text is cut into its substrings of the lengths that
    aliases have, so no text is compared with every alias. The aliases are sent to the substrings, in blocks of
    ``ALIAS_BLOCK`` with a pass over the texts for each; what is shuffled are the hits.
    """
    aliases = aliases.where(F.col("alias").isNotNull())
    rows = aliases.select("alias", "name", "place").limit(small + 1).collect()
    low = F.lower(F.col(text))
    if not rows:
        empty = F.array().cast("array<struct<alias:string,name:string,place:int>>")
        return texts.select(key, F.lit(1).alias("pos"), F.inline(empty)).select(key, "alias", "name", "place", "pos")
    if len(rows) <= small:
        entries = F.array(
            *[F.struct(F.lit(r["alias"]).alias("alias"), F.lit(r["name"]).alias("name"), F.lit(r["place"]).alias("place")) for r in rows]
        )
        found = F.filter(entries, lambda e: F.instr(low, e["alias"]) > 0)
        return texts.select(key, low.alias("_low"), F.inline(found)).select(
            key, "alias", "name", "place", F.instr("_low", F.col("alias")).alias("pos")
        )
    blocks = -(-aliases.count() // ALIAS_BLOCK)
    found = [_hits_of(texts, key, low, aliases.where(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == i)) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _hits_of(texts: DataFrame, key: str, low: Column, aliases: DataFrame) -> DataFrame:
    """The hits of a block of aliases that every task can hold."""
    lengths = sorted(r["n"] for r in aliases.select(F.length("alias").alias("n")).distinct().collect())
    pieces = texts.select(key, low.alias("_low"), F.explode(F.array(*(F.lit(n) for n in lengths or [1]))).alias("_n"))
    starts = F.sequence(F.lit(1), F.length("_low") - F.col("_n") + 1)
    cut = pieces.where(F.length("_low") >= F.col("_n")).select(key, "_low", "_n", F.explode(starts).alias("pos"))
    substrings = cut.select(key, "pos", F.substring(F.col("_low"), F.col("pos"), F.col("_n")).alias("alias"))
    met = substrings.join(F.broadcast(aliases.select("alias", "name", "place")), "alias")
    return met.groupBy(key, "alias", "name", "place").agg(F.min("pos").alias("pos"))


def q_country_first(hits: DataFrame, key: str = "q_id") -> DataFrame:
    """The longest alias wins, the earlier one in the list among equals."""
    best = F.min(F.struct((-F.length("alias")).alias("n"), "place", "name")).alias("b")
    return hits.groupBy(key).agg(best).select(key, F.col("b.name").alias("country"))


def q_countries(hits: DataFrame, key: str = "q_id") -> DataFrame:
    """All countries of a text, by where they first occur; each once, as its first alias in the list found it."""
    firsts = hits.groupBy(key, "name").agg(F.min(F.struct("place", "pos")).alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("f.pos").alias("pos"), F.col("f.place").alias("place"), "name")))
    return firsts.groupBy(key).agg(F.transform(ordered, lambda x: x["name"]).alias("countries"))


# --- indicators -------------------------------------------------------------------------------

# An indicator list is sent to every task only up to this many names.
SMALL_NAMES = 5_000
_MATCH = "text string, score double, place string, name string"


def fuzzy_indicator_join(
    texts: DataFrame, names: DataFrame, threshold: float = THRESHOLD, small: int = SMALL_NAMES
) -> DataFrame:
    """The most similar name per distinct text, if similar enough.

    ``texts`` has ``text``; ``names`` has ``name, place`` (both text) and the
    smaller place wins among equals. Distinct texts are compared once, in pieces, with an index of the names:
    a pair is scored only if it shares the characters and pairs of characters that the threshold asks for.
    A long name list meets the texts block by block.
    """
    if not 0 < threshold <= 100:
        raise ValueError("a threshold lies above 0 and at most at 100")
    spark = texts.sparkSession
    distinct = texts.select("text").where(F.col("text").isNotNull()).distinct().repartition(cpu_slots(spark), "text")
    first = names.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("place").alias("place"))
    listed = first.limit(small + 1).collect()

    def score(found: pd.Series, ordered: list[tuple[str, str]], index: NameIndex) -> pd.DataFrame:
        best, at = index.best(found.tolist())
        keep = np.flatnonzero(at >= 0)
        return pd.DataFrame(
            {
                "text": pd.Series([found.iloc[i] for i in keep], dtype=object),
                "score": best[keep],
                "place": pd.Series([ordered[at[i]][0] for i in keep], dtype=object),
                "name": pd.Series([ordered[at[i]][1] for i in keep], dtype=object),
            }
        )

    if len(listed) <= small:
        ordered = sorted((r["place"] or "", r["name"]) for r in listed)

        def scan(batches):
            index = NameIndex([n for _, n in ordered], threshold)
            for batch in batches:
                yield score(batch["text"], ordered, index)

        matches = distinct.mapInPandas(scan, _MATCH)
    else:

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            ordered = sorted(zip(right["place"].fillna(""), right["name"]))
            return score(left["text"], ordered, NameIndex([n for _, n in ordered], threshold))

        matches = block_pairs(distinct, first, "text", "name", 50_000, small, meet, _MATCH)
    best = F.min(F.struct((-F.col("score")).alias("s"), "place", "name")).alias("b")
    return matches.groupBy("text").agg(best).select(
        "text", F.col("b.name").alias("name"), (-F.col("b.s")).alias("score")
    )


def q_indicator(questions: DataFrame, indicators: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``indicator_name`` and ``indicator_code``, null where nothing is similar.

    Names are tried first, then codes on the upper-cased text. The new text is
    searched, unless it refers back to the same indicator; a text without a
    match falls back to the whole question. ``indicators`` has
    ``indicator_code, indicator_name``, one row per code.
    """
    q = questions if "low" in questions.columns else with_parts(questions)
    refers_back = F.col("has_context") & _says(F.lower("new_text"), W.SAME_INDICATOR)
    searched = q.withColumn("_first", F.when(refers_back, F.col("question")).otherwise(F.col("new_text"))).withColumn(
        "_second", F.when(F.col("has_context") & ~refers_back, F.col("question"))
    )
    # questions without a second text match nothing; a key of their own keeps them apart
    own_key = F.coalesce("_second", F.concat(F.lit("\0"), F.col("q_id").cast("string")))
    texts = searched.select(F.explode(F.array("_first", "_second")).alias("text")).where(F.col("text").isNotNull())
    texts = written(texts.distinct(), "question-texts")
    names = indicators.select(F.col("indicator_name").alias("name"), F.col("indicator_code").alias("place"))
    codes = indicators.select(F.col("indicator_code").alias("name"), F.col("indicator_code").alias("place"))
    by_name = fuzzy_indicator_join(texts, names, threshold).select("text", F.col("name").alias("indicator_name"))
    first_code = indicators.groupBy("indicator_name").agg(F.min("indicator_code").alias("indicator_code"))
    by_name = written(by_name.join(first_code, "indicator_name"), "named-texts")
    shouted = texts.join(by_name, "text", "left_anti").select("text", F.upper("text").alias("_up"))
    by_code = fuzzy_indicator_join(shouted.select(F.col("_up").alias("text")), codes, threshold)
    by_code = (
        shouted.join(by_code.select(F.col("text").alias("_up"), F.col("name").alias("indicator_code")), "_up")
        .join(indicators.select("indicator_code", "indicator_name"), "indicator_code")
        .select("indicator_name", "text", "indicator_code")
    )
    matched = by_name.select("indicator_name", "text", "indicator_code").unionByName(by_code)
    one = matched.select(
        F.col("text").alias("_first"), F.col("indicator_name").alias("_n1"), F.col("indicator_code").alias("_c1")
    )
    two = matched.select(
        F.col("text").alias("_key"), F.col("indicator_name").alias("_n2"), F.col("indicator_code").alias("_c2")
    )
    return (
        searched.join(one, "_first", "left")
        .withColumn("_key", own_key)
        .join(two, "_key", "left")
        .withColumn("indicator_name", F.coalesce("_n1", "_n2"))
        .withColumn("indicator_code", F.coalesce("_c1", "_c2"))
        .select(*q.columns, "indicator_name", "indicator_code")
    )


# --- guards ------------------------------------------------------------------------------------


def sql_guard(statement: Column, ranking: Column) -> Column:
    """Why a candidate statement is refused, else null."""
    up = F.upper(statement)
    # The texts of the three refusals.
    return (
        F.when(
            ~F.btrim(up, F.lit(" \t\n\r")).startswith("SELECT"),
            F.concat(F.lit("Não é um SELECT: "), F.substring(statement, 1, 80)),
        )
        .when(
            statement.rlike(r"\[[^\n]+?\]"),
            F.concat(F.lit("Placeholders por preencher: "), F.substring(statement, 1, 80)),
        )
        .when(ranking & ~(up.contains("ORDER BY") & up.contains("LIMIT")), F.lit("Ranking query sem ORDER BY / LIMIT"))
    )
