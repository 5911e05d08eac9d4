"""Deterministic answers to routed questions, and their sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import wordlists as W
from almanac.functions.text import format_value
from almanac.operators import questions as Q
from almanac.operators.ordering import first_per_key, rank_top, top_n_per_key
from almanac.session import written

# Result limits of the query shapes, and the refusals.
SNAPSHOT_ROWS = 20
SHOWN_LINES = 25
REFUSALS = {
    "no_indicator": "Não foi possível identificar o indicador.",
    "no_pair": "Não foi possível identificar os dois países para comparação.",
    "no_country": "Não foi possível identificar o país.",
}


def plan_answers(questions: DataFrame, aliases: DataFrame, indicators: DataFrame, latest_year: int | None) -> DataFrame:
    """Every question with its tier, entities and the kind of lookup that answers it.

    The result is written out, as every kind of lookup reads it.
    """
    parts = Q.with_parts(questions)
    routed = Q.q_classify(Q.q_indicator(parts, indicators))
    texts = parts.select(F.explode(F.array("new_text", "question")).alias("text")).distinct()
    hits = written(Q.alias_hits(texts, "text", "text", aliases), "country-hits")
    country = Q.q_country_first(hits, "text").withColumnRenamed("text", "new_text")
    several = Q.q_countries(hits, "text")
    new_pair = several.select(F.col("text").alias("new_text"), F.col("countries").alias("_new"))
    all_pair = several.select(F.col("text").alias("question"), F.col("countries").alias("_all"))
    joined = (
        routed.join(country, "new_text", "left").join(new_pair, "new_text", "left").join(all_pair, "question", "left")
    )
    none = F.array().cast("array<string>")
    pair = F.when((F.size(F.coalesce("_new", none)) < 2) & F.col("has_context"), F.coalesce("_all", none)).otherwise(
        F.coalesce("_new", none)
    )
    tier, low = F.col("tier"), F.lower("question")
    ranks = reduce(lambda a, b: a | b, [low.contains(w) for w in W.RANKING_WORDS]) | F.col("top_n").isNotNull()
    kind = (
        F.when(tier.startswith("meta:"), "meta")
        .when(F.col("indicator_name").isNull(), "no_indicator")
        .when(tier == "comparison", F.when(F.size("pair") < 2, "no_pair").otherwise("comparison"))
        .when(tier.startswith("existence"), F.when(F.col("country").isNull(), "no_country").otherwise("existence"))
        .when(
            ranks,
            F.when(
                F.col("country").isNotNull() & (F.size("years") == 0) & F.col("top_n").isNull(), "best_year"
            ).otherwise("ranking"),
        )
        .when(F.col("country").isNull(), "snapshot")
        .otherwise("value")
    )
    planned = (
        joined.withColumn("pair", pair)
        .withColumn("top_n", Q.q_topn(F.col("question")))
        .withColumn("ascending", Q.q_ascending(F.col("question")))
        .withColumn("year", Q.q_year_resolve(latest_year))
        .withColumn("kind", kind)
        .select(
            "q_id",
            "question",
            "tier",
            "kind",
            "indicator_name",
            "country",
            F.get("pair", F.lit(0)).alias("first_country"),
            F.get("pair", F.lit(1)).alias("second_country"),
            "year",
            F.coalesce("top_n", F.lit(1)).alias("n"),
            "ascending",
        )
    )
    return written(planned.withColumn("request", _request_key()), "planned-questions")


_REQUEST = ["kind", "indicator_name", "country", "first_country", "second_country", "year", "n", "ascending"]


def _request_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _REQUEST])


def _containing(names: DataFrame, needles: DataFrame, name: str, needle: str) -> DataFrame:
    """Pairs of a dimension name and a needle it contains, ignoring case."""
    aliases = needles.select(F.lower("needle").alias("alias"), F.col("needle").alias("name"), F.lit(0).alias("place"))
    hits = Q.alias_hits(names.select("entry").distinct(), "entry", "entry", aliases)
    return hits.select(F.col("entry").alias(name), F.col("name").alias(needle))


Lookups = tuple[DataFrame, DataFrame, DataFrame]


def lookups(planned: DataFrame, star: DataFrame) -> Lookups:
    """Distinct requests, and the indicator and location names that contain what they ask for.

    Small tables that every kind of lookup joins, so they are written out.
    """
    requests = written(planned.select("request", *_REQUEST).distinct(), "requests")
    names = star.select(F.col("indicator_name").alias("entry")).distinct()
    wanted = requests.select(F.col("indicator_name").alias("needle")).where("needle IS NOT NULL").distinct()
    like = written(_containing(names, wanted, "fact_name", "indicator_name"), "names-like")
    places = star.select(F.col("location_name").alias("entry")).distinct()
    countries = requests.select(F.col("country").alias("needle")).where("needle IS NOT NULL").distinct()
    near = written(_containing(places, countries, "fact_place", "country"), "places-like")
    return requests, like, near


def q_answer_batch(planned: DataFrame, star: DataFrame, meta: DataFrame, found: Lookups) -> DataFrame:
    """Rows, best value and second value per question.

    Equal requests are answered once. Facts are first summed up per indicator,
    location and year, so what requests meet is bounded by the dimensions.
    ``meta`` has ``tier, n`` for the questions about the warehouse itself,
    ``found`` is what :func:`lookups` returned.
    """
    requests, like, near = found
    cells = star.groupBy("indicator_name", "location_name", "year").agg(
        F.count("*").alias("n_facts"), F.max("value").alias("hi"), F.min("value").alias("lo")
    )
    cell = cells.select(
        F.col("indicator_name").alias("fact_name"),
        F.col("location_name").alias("fact_place"),
        F.col("year").alias("fact_year"),
        "n_facts",
        "hi",
        "lo",
    )
    best = F.when(F.first("ascending"), F.min("lo")).otherwise(F.max("hi"))

    def of_kind(*kinds: str) -> DataFrame:
        return requests.where(F.col("kind").isin(*kinds)).join(like, "indicator_name")

    one_place = (
        of_kind("value", "existence", "best_year")
        .join(near, "country")
        .join(cell, ["fact_name", "fact_place"])
        .where((F.col("kind") == "best_year") | (F.col("fact_year") == F.col("year")))
        .groupBy("request", "kind")
        .agg(F.sum("n_facts").alias("rows"), F.max("hi").alias("top"), best.alias("best"))
        .select(
            "request",
            F.when(F.col("kind") == "value", F.col("rows")).otherwise(F.lit(1)).alias("n_rows"),
            F.when(F.col("kind") == "value", F.col("top"))
            .when(F.col("kind") == "existence", F.col("rows").cast("double"))
            .otherwise(F.col("best"))
            .alias("answer"),
            F.lit(None).cast("double").alias("other"),
        )
    )
    by_year = of_kind("snapshot", "comparison").join(
        cell, (cell["fact_name"] == like["fact_name"]) & (F.col("fact_year") == F.col("year"))
    )
    snapshots = (
        by_year.where(F.col("kind") == "snapshot")
        .groupBy("request")
        .agg(F.sum("n_facts").alias("rows"), F.max("hi").alias("answer"))
        .select(
            "request", F.least("rows", F.lit(SNAPSHOT_ROWS)).alias("n_rows"), "answer", F.lit(None).cast("double").alias("other")
        )
    )
    first = F.col("fact_place") == F.col("first_country")
    second = F.col("fact_place") == F.col("second_country")
    comparisons = (
        by_year.where((F.col("kind") == "comparison") & (first | second))
        .groupBy("request")
        .agg(
            F.sum("n_facts").alias("n_rows"),
            F.max(F.when(first, F.col("hi"))).alias("answer"),
            F.max(F.when(second, F.col("hi"))).alias("other"),
        )
    )
    answered = one_place.unionByName(snapshots).unionByName(comparisons).unionByName(
        _ranking_answers(requests, star, like, near)
    )
    count_meta = meta.select("tier", F.col("n").cast("double").alias("_meta"))
    joined = planned.join(answered, "request", "left").join(count_meta, "tier", "left")
    refused = F.col("kind").isin(*REFUSALS)
    n_rows = F.when(F.col("kind") == "meta", F.lit(1)).when(~refused, F.coalesce("n_rows", F.lit(0)))
    zero_count = F.when(F.col("kind") == "existence", F.lit(0.0))
    return joined.select(
        *planned.columns,
        F.when((F.col("kind") == "existence"), F.lit(1)).otherwise(n_rows).cast("long").alias("n_rows"),
        F.coalesce("_meta", "answer", zero_count).alias("answer"),
        "other",
    )


def _ranked_rows(requests: DataFrame, star: DataFrame, like: DataFrame, near: DataFrame) -> DataFrame:
    """Rows ranked n or better among all indicators whose name contains the text, per year."""
    ranking = requests.where(F.col("kind") == "ranking")
    deepest = ranking.agg(F.max("n").alias("n")).first()["n"] or 1
    rows = star.join(like, star["indicator_name"] == like["fact_name"]).select(
        like["indicator_name"], F.col("year"), F.col("location_name").alias("fact_place"), "value", "report_id", "indicator_sk"
    )

    def leaders(ascending: bool) -> DataFrame:
        top = rank_top(rows, ["indicator_name", "year"], "value", deepest, "ranking", descending=not ascending)
        return top.withColumn("ascending", F.lit(ascending))

    led = leaders(False).unionByName(leaders(True))
    met = ranking.join(led, ["indicator_name", "year", "ascending"]).where(F.col("ranking") <= F.col("n"))
    anywhere = met.where(F.col("country").isNull())
    somewhere = met.where(F.col("country").isNotNull()).join(near, ["country", "fact_place"], "left_semi")
    return anywhere.unionByName(somewhere)


def _ranking_answers(requests: DataFrame, star: DataFrame, like: DataFrame, near: DataFrame) -> DataFrame:
    best = F.when(F.first("ascending"), F.min("value")).otherwise(F.max("value"))
    return (
        _ranked_rows(requests, star, like, near)
        .groupBy("request")
        .agg(F.least(F.count("*"), F.first("n").cast("long")).alias("n_rows"), best.alias("answer"))
        .withColumn("other", F.lit(None).cast("double"))
    )


def answer_rows(star: DataFrame, found: Lookups) -> DataFrame:
    """``request, position, location_name, row_year, value, ranking``: the first rows of every request.

    As many rows as an answer spells out. Facts are cut to that many per
    indicator, location and year before they meet the requests.
    """
    requests, like, near = found
    facts = star.select(
        F.col("indicator_name").alias("fact_name"),
        F.col("location_name").alias("fact_place"),
        F.col("year").alias("fact_year"),
        "value",
        "report_id",
        "indicator_sk",
    )
    best_first = [F.desc("value"), F.col("report_id"), F.col("indicator_sk")]
    cell = top_n_per_key(facts, ["fact_name", "fact_place", "fact_year"], best_first, SHOWN_LINES, "_n").drop("_n")
    by_place = [F.desc("value"), F.col("fact_place"), F.col("report_id"), F.col("indicator_sk")]
    year_top = top_n_per_key(facts, ["fact_name", "fact_year"], by_place, SNAPSHOT_ROWS, "_n").drop("_n")

    def of_kind(kind: str) -> DataFrame:
        return requests.where(F.col("kind") == kind).join(like, "indicator_name")

    same_year = F.col("fact_year") == F.col("year")
    none = F.lit(None).cast("int").alias("ranking")

    def shaped(df: DataFrame, first: Column, then: Column, ranking: Column = none, year: str = "fact_year") -> DataFrame:
        return df.select(
            "request",
            "kind",
            "n",
            F.col("fact_place").alias("location_name"),
            F.col(year).alias("row_year"),
            "value",
            ranking.cast("int").alias("ranking"),
            "report_id",
            "indicator_sk",
            first.alias("_first"),
            then.cast("double").alias("_then"),
        )

    falling, plain = -F.col("value"), F.lit("")
    values = of_kind("value").join(near, "country").join(cell, ["fact_name", "fact_place"]).where(same_year)
    pairs = of_kind("comparison").join(cell, "fact_name").where(
        same_year & F.col("fact_place").isin(F.col("first_country"), F.col("second_country"))
    )
    snapshots = of_kind("snapshot").join(year_top, "fact_name").where(same_year)
    signed = facts.select(
        "*", F.explode(F.array(F.lit(True), F.lit(False))).alias("ascending")
    ).withColumn("_s", F.when(F.col("ascending"), F.col("value")).otherwise(-F.col("value")))
    extremes = first_per_key(
        signed,
        ["fact_name", "fact_place", "ascending"],
        [F.col("_s"), F.col("fact_year"), F.col("report_id"), F.col("indicator_sk")],
        ["fact_year", "value", "report_id", "indicator_sk"],
    )
    best = of_kind("best_year").join(near, "country").join(extremes, ["fact_name", "fact_place", "ascending"])
    best_sign = F.when(F.col("ascending"), F.col("value")).otherwise(-F.col("value"))
    ranked = _ranked_rows(requests, star, like, near)
    every = (
        shaped(values, plain, falling)
        .unionByName(shaped(pairs, F.col("fact_place"), falling))
        .unionByName(shaped(snapshots, plain, falling))
        .unionByName(shaped(best, plain, best_sign))
        .unionByName(shaped(ranked, plain, F.col("ranking"), F.col("ranking"), "year"))
    )
    order = [F.col(c) for c in ("_first", "_then", "location_name", "row_year", "report_id", "indicator_sk")]
    cut = top_n_per_key(every, ["request"], order, SHOWN_LINES, "position")
    limit = (
        F.when(F.col("kind") == "ranking", F.col("n"))
        .when(F.col("kind") == "best_year", F.lit(1))
        .otherwise(F.lit(SHOWN_LINES))
    )
    return cut.where(F.col("position") <= limit).select(
        "request", "kind", "position", "location_name", "row_year", "value", "ranking"
    )


def _spelled(rows: DataFrame) -> DataFrame:
    """Per request the first row, and all rows as lines."""
    shown = format_value(F.col("value"))
    dated = F.concat(F.col("location_name"), F.lit(" ("), F.col("row_year").cast("string"), F.lit(")"))
    line = (
        F.when(F.col("kind") == "ranking", F.concat(F.col("ranking").cast("string"), F.lit(". "), dated, F.lit(" — "), shown))
        .when(F.col("kind") == "snapshot", F.concat(F.col("location_name"), F.lit(": "), shown))
        .otherwise(F.concat(dated, F.lit(": "), shown))
    )
    first = F.min(F.struct("position", "location_name", "row_year", "value", "ranking")).alias("row")
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines")
    return rows.groupBy("request").agg(first, lines).select(
        "request", "row", F.transform("lines", lambda x: x["line"]).alias("lines")
    )


# --- sentences -------------------------------------------------------------------------------------


def _fill(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _variant(seed: Column, templates: list[str], **parts: Column) -> Column:
    """One of the templates, the same one for the same seed text."""
    n = F.conv(F.substring(F.md5(seed), 1, 4), 16, 10).cast("int") % len(templates)
    chain = F.when(n == 0, _fill(templates[0], **parts))
    for i, t in enumerate(templates[1:], 1):
        chain = chain.when(n == i, _fill(t, **parts))
    return chain


LISTED_COUNTRIES, LISTED_INDICATORS = 30, 20  # fixed values


NO_LIST = "Não há dados disponíveis."  # fixed value: the answer where there is nothing to list


def list_sentences(locations: DataFrame, indicators: DataFrame) -> DataFrame:
    """``tier, listing``: the first countries and indicators by name, and how many there are."""
    names = locations.select(F.col("name").alias("entry"))
    codes = (
        indicators.select("indicator_code", "indicator_name")
        .distinct()
        .select(F.concat_ws(" – ", "indicator_code", "indicator_name").alias("entry"))
    )

    def first(entries: DataFrame, n: int) -> DataFrame:
        shown = entries.orderBy("entry").limit(n)
        total = entries.agg(F.count("*").alias("n"))
        both = shown.unionByName(total, allowMissingColumns=True)
        return both.agg(F.array_sort(F.collect_list("entry")).alias("shown"), F.max("n").alias("n"))

    many = F.col("n").cast("string")
    countries = F.concat(
        F.lit("Os "),
        many,
        F.lit(" países disponíveis são: "),
        F.array_join("shown", ", "),
        F.when(F.col("n") > LISTED_COUNTRIES, F.format_string(", e mais %d", F.col("n") - LISTED_COUNTRIES)).otherwise(""),
        F.lit("."),
    )
    bullets = F.array_join(F.transform("shown", lambda x: F.concat(F.lit("• "), x)), "\n")
    few = F.concat(F.lit("Os indicadores disponíveis são:\n"), bullets)
    more = F.concat(
        F.lit("Existem "),
        many,
        F.lit(" indicadores. Os primeiros são:\n"),
        bullets,
        F.format_string("\n... e mais %d.", F.col("n") - LISTED_INDICATORS),
    )
    listed = F.when(F.col("n") == 0, NO_LIST).when(F.col("n") <= LISTED_INDICATORS, few).otherwise(more)
    return (
        first(names, LISTED_COUNTRIES)
        .select(F.lit("meta:list_countries").alias("tier"), F.when(F.col("n") == 0, NO_LIST).otherwise(countries).alias("listing"))
        .unionByName(
            first(codes, LISTED_INDICATORS).select(F.lit("meta:list_indicators").alias("tier"), listed.alias("listing"))
        )
    )


def answer_text(answers: DataFrame, rows: DataFrame, listings: DataFrame) -> DataFrame:
    """``q_id, text``: a sentence for one row, a list of lines for several.

    ``rows`` are those of :func:`answer_rows`, ``listings`` the texts of
    :func:`list_sentences`.
    """
    answers = answers.join(_spelled(rows), "request", "left").join(listings, "tier", "left")
    whole = F.col("answer").cast("long").cast("string")
    text = F.coalesce("indicator_name", F.lit("indicador"))
    year = F.col("year").cast("string")
    value, other = format_value(F.col("answer")), format_value(F.col("other"))
    country = F.coalesce("country", F.lit("o local indicado"))
    q = F.col("question")
    refusal = F.create_map(*[F.lit(x) for item in REFUSALS.items() for x in item])[F.col("kind")]
    nothing = _variant(q, W.NOTHING_SENTENCES)
    hints = F.concat_ws(
        ", ",
        F.concat(F.lit('indicador "'), F.col("indicator_name"), F.lit('"')),
        F.concat(F.lit('país "'), F.col("country"), F.lit('"')),
        F.concat(F.lit("ano "), year),
    )
    meta = (
        F.when(F.col("tier") == "meta:count_records", _fill("A base de dados contém {v} registos de valores.", v=value))
        .when(F.col("tier") == "meta:count_countries", _fill("Existem {v} países na base de dados.", v=whole))
        .when(F.col("tier") == "meta:count_indicators", _fill("Existem {v} indicadores disponíveis.", v=whole))
        .when(F.col("tier") == "meta:count_reports", _fill("Existem {v} relatórios com dados processados.", v=whole))
        .otherwise(F.col("listing"))
    )
    row = {
        "country": F.coalesce("country", "row.location_name"),
        "year": F.col("row.row_year").cast("string"),
        "value": format_value(F.col("row.value")),
        "indicator": text,
    }
    ranking = F.col("row.ranking").cast("string")
    header = F.concat(
        F.lit('Resultados para "'),
        F.col("indicator_name"),
        F.lit('"'),
        F.when(F.col("n_rows") > SHOWN_LINES, F.format_string(f" (mostrando {SHOWN_LINES} de %d)", "n_rows")).otherwise(""),
        F.lit(":\n"),
    )
    above = F.when(F.col("answer") > F.col("other"), "acima").otherwise("abaixo")
    compared = _fill(
        "{a} ficou {w} de {b} em {i} ({y}), com {v} vs {o}.",
        a=F.col("first_country"),
        w=above,
        b=F.col("second_country"),
        i=text,
        y=year,
        v=value,
        o=other,
    )
    sentence = (
        F.when(refusal.isNotNull(), refusal)
        .when(F.col("kind") == "meta", meta)
        .when(
            F.col("kind") == "existence",
            _variant(q, W.EXISTENCE_SENTENCES, count=whole, indicator=text, country=country, year=year),
        )
        .when(
            F.col("n_rows") == 0,
            F.concat(nothing, F.lit(" (Pesquisa: "), hints, F.lit(".)")),
        )
        .when(
            (F.col("kind") == "comparison") & F.col("answer").isNotNull() & F.col("other").isNotNull(), compared
        )
        .when(F.col("n_rows") > 1, F.concat(header, F.array_join("lines", "\n")))
        .when(F.col("kind") == "ranking", _variant(q, W.RANKING_SENTENCES, ranking=ranking, **row))
        .otherwise(_variant(q, W.VALUE_SENTENCES, **row))
    )
    return answers.select("q_id", "kind", sentence.alias("text"))


def answer_lines(rows: DataFrame, key: list[str], shown: int = SHOWN_LINES) -> DataFrame:
    """A numbered list per key: ``rows`` has ``position, location_name, year, ranking, value``.

    All rows are counted; only the first ``shown`` are spelled out, as the
    text itself says.
    """
    label = F.coalesce("indicator_name", F.lit(""))
    place = F.concat(F.col("location_name"), F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    line = F.when(
        F.col("ranking").isNotNull(),
        F.concat(F.col("ranking").cast("string"), F.lit(". "), place, F.lit(" — "), format_value(F.col("value"))),
    ).otherwise(F.concat(place, F.lit(": "), format_value(F.col("value"))))
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(label).alias("label"))
    lines = (
        rows.where(F.col("position") <= shown)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    )
    suffix = F.when(
        F.col("n") > shown, F.format_string(f" (mostrando {shown} de %d)", "n")
    ).otherwise("")
    header = F.when(
        F.col("label") != "", F.concat(F.lit('Resultados para "'), F.col("label"), F.lit('"'), suffix, F.lit(":"))
    ).otherwise(F.concat(F.lit("Resultados"), suffix, F.lit(":")))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return counts.join(lines, key).select(*key, F.concat(header, F.lit("\n"), body).alias("text"))
