"""Questions: routing, entities, answers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from almanac.functions import wordlists as W
from almanac.operators import analytics, answers as N, questions as Q
from almanac.plans.catalog import query
from almanac.plans.fixtures import Tables

_STRIP = r"regexp_replace(question, '^(?s:.*?)Contexto anterior:.*\"\.\s+', '')".replace('\\"', '"')
_YEARS = r"regexp_extract_all({0}, '\b(?:19|20)\d{{2}}\b')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _says(pattern: str) -> str:
    if "(?!" in pattern:
        # the one lookahead: any listed word will do that starts neither way
        return (
            r"len([x FOR x IN regexp_extract_all(low, '\bou\s+(\w{3,})', 1) "
            r"IF NOT starts_with(x, 'acima') AND NOT starts_with(x, 'abaixo')]) > 0"
        )
    return f"regexp_matches(low, {_quote(pattern)})"


def _verdict_sql() -> str:
    arms = [f"WHEN {_says(p)} THEN 'meta:{s}|meta: ' || {_quote(p)}" for p, s in W.META_SIGNALS]
    arms += [f"WHEN {_says(p)} THEN 'comparison|comparison: ' || {_quote(p)}" for p in W.COMPARISON_SIGNALS]
    asks = " OR ".join(_says(p) for p in W.EXISTENCE_SIGNALS)
    arms.append(f"WHEN ({asks}) AND len(years) = 1 THEN 'existence|existence, year=' || years[1]")
    arms.append(f"WHEN {asks} THEN 'existence_inferred|existence, year inferred'")
    arms += [f"WHEN {_says(p)} THEN 'complex|complex: ' || {_quote(p)}" for p in W.COMPLEX_SIGNALS]
    arms.append(f"WHEN regexp_matches(new_text, {_quote(W.YEAR + '.*' + W.YEAR)}) THEN 'complex|multiple years'")
    arms.append("WHEN len(years) = 1 THEN 'simple|simple, year=' || years[1]")
    arms.append("WHEN len(years) = 0 THEN 'simple_inferred|no year — use MAX'")
    return "CASE " + "\n".join(arms) + " ELSE 'uncertain|uncertain — fallback' END"


_PARTS = {
    "parts": f"""SELECT *, lower(new_text) AS low, {_YEARS.format('new_text')} AS years, {_YEARS.format('question')} AS all_years,
        new_text <> question AS has_context FROM (SELECT q_id, question, {_STRIP} AS new_text FROM questions)""",
}
_CLASSIFIED = {
    **_PARTS,
    "classified": f"""SELECT *, v[1:instr(v, '|') - 1] AS tier, v[instr(v, '|') + 1:] AS why
        FROM (SELECT *, {_verdict_sql()} AS v FROM parts)""",
}
_RANKS = "(" + " OR ".join(f"contains(lower(question), {_quote(w)})" for w in W.RANKING_WORDS) + ")"


@query("q_strip_context", f"SELECT q_id, {_STRIP} AS new_text FROM questions", ["questions"])
def q_strip_context(t: Tables):
    return t.questions.select("q_id", Q.q_strip_context(F.col("question")).alias("new_text"))


@query("q_classify", "SELECT q_id, tier, why FROM classified", ["questions"], _CLASSIFIED)
def q_classify(t: Tables):
    return Q.q_classify(t.questions).select("q_id", "tier", "why")


@query(
    "q_classify_turns",
)
def q_classify_turns(t: Tables):
    """The router over free conversation turns, in any script."""
    turns = t.raw("conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("q_id"),
        F.col("text").alias("question"),
    )
    return Q.q_classify(turns).groupBy("tier").agg(F.count("*").alias("n"))


@query("q_years", "SELECT q_id, array_to_string(all_years, ',') AS years FROM parts", ["questions"], _PARTS)
def q_years(t: Tables):
    return t.questions.select("q_id", F.array_join(Q.q_years(F.col("question")), ",").alias("years"))


_YEAR_SQL = """CAST(coalesce(years[1], CASE WHEN has_context THEN all_years[1] END,
  CAST((SELECT max(year) FROM star) AS VARCHAR)) AS INTEGER)"""


@query("q_year_resolve", f"SELECT q_id, {_YEAR_SQL} AS year FROM parts", ["questions", "star"], _PARTS)
def q_year_resolve(t: Tables):
    latest = analytics.max_year(t.star).first()["max_year"]
    return Q.with_parts(t.questions).select("q_id", Q.q_year_resolve(latest).alias("year"))


def _aliases(t: Tables):
    return t.dim_location.select(
        F.lower("name").alias("alias"), "name", F.col("location_sk").cast("int").alias("place")
    )


_COUNTRY = {
    "first_country": """SELECT q_id, arg_min(name, (-length(name), location_sk)) AS country
        FROM parts, dim_location WHERE contains(low, lower(name)) GROUP BY ALL""",
    "countries": """SELECT q_id, list(name ORDER BY pos, location_sk) AS countries FROM (
        SELECT q_id, name, location_sk, instr(low, lower(name)) AS pos FROM parts, dim_location
        WHERE contains(low, lower(name))) GROUP BY ALL""",
    "all_countries": """SELECT q_id, list(name ORDER BY pos, location_sk) AS countries FROM (
        SELECT q_id, name, location_sk, instr(lower(question), lower(name)) AS pos FROM parts, dim_location
        WHERE contains(lower(question), lower(name))) GROUP BY ALL""",
}


def _new_texts(t: Tables):
    return t.questions.select("q_id", Q.q_strip_context(F.col("question")).alias("text"))


@query("q_country_first", "SELECT * FROM first_country", ["questions"], {**_PARTS, **_COUNTRY})
def q_country_first(t: Tables):
    return Q.q_country_first(Q.alias_hits(_new_texts(t), "q_id", "text", _aliases(t)))


@query(
    "q_countries",
    "SELECT q_id, array_to_string(countries, ',') AS countries FROM countries",
    ["questions"],
    {**_PARTS, **_COUNTRY},
)
def q_countries(t: Tables):
    found = Q.q_countries(Q.alias_hits(_new_texts(t), "q_id", "text", _aliases(t)))
    return found.select("q_id", F.array_join("countries", ",").alias("countries"))


@query(
    "alias_contains_join",
    """SELECT q_id, lower(name) AS alias, name, CAST(instr(low, lower(name)) AS INTEGER) AS pos FROM parts, dim_location
       WHERE contains(low, lower(name))""",
    ["questions"],
    _PARTS,
)
def alias_contains_join(t: Tables):
    """The path for alias tables too large to test one by one."""
    hits = Q.alias_hits(_new_texts(t), "q_id", "text", _aliases(t), small=0)
    return hits.select("q_id", "alias", "name", F.col("pos").cast("int").alias("pos"))


@query(
    "q_topn_direction",
    r"""SELECT q_id, TRY_CAST(regexp_extract(lower(question), '\btop\s*(\d+)\b', 1) AS INTEGER) AS top_n,
          regexp_matches(lower(question), '\bpiores?\b|\bmenor\b|\binferior\b|\babaixo\b') AS ascending FROM questions""",
    ["questions"],
)
def q_topn_direction(t: Tables):
    return t.questions.select(
        "q_id", Q.q_topn(F.col("question")).alias("top_n"), Q.q_ascending(F.col("question")).alias("ascending")
    )


@query(
    "q_template",
    f"""SELECT q_id, CASE WHEN tier LIKE 'existence%' THEN 'existence' WHEN tier = 'comparison' THEN 'comparison'
          WHEN tier IN ('complex', 'uncertain') THEN 'complex' WHEN {_RANKS} THEN 'ranking' ELSE 'value' END AS template
        FROM classified""",
    ["questions"],
    _CLASSIFIED,
)
def q_template(t: Tables):
    return Q.q_classify(t.questions).select(
        "q_id", Q.q_template(F.col("tier"), F.col("question")).alias("template")
    )


def _names(t: Tables):
    return analytics.distinct_on_code(t.dim_indicator).select("indicator_code", "indicator_name")


# In these questions a name is either spelled out or absent, so contains() decides as the similarity does.
_INDICATOR = {
    "named": """SELECT q_id, coalesce(min(CASE WHEN contains(new_text, indicator_name) THEN indicator_name END),
          min(CASE WHEN has_context AND contains(question, indicator_name) THEN indicator_name END)) AS indicator_name
        FROM parts, (SELECT DISTINCT indicator_name FROM dim_indicator) GROUP BY q_id"""
}


@query("q_indicator", "SELECT q_id, indicator_name FROM named", ["questions", "dim_indicator"], {**_PARTS, **_INDICATOR})
def q_indicator(t: Tables):
    return Q.q_indicator(t.questions, _names(t)).select("q_id", "indicator_name")


# Names with letters lost, moved in or reversed; the same text in both dialects.
_WORN = """CASE WHEN o_orderkey % 8 = 7 THEN reverse(lower(o_orderpriority))
  WHEN o_orderkey % 2 = 0 THEN substr(lower(o_orderpriority), 1, CAST(o_orderkey % 8 AS INT) + 1) || substr(lower(o_orderpriority), CAST(o_orderkey % 8 AS INT) + 3)
  ELSE substr(lower(o_orderpriority), 1, 3) || 'x' || substr(lower(o_orderpriority), 4, CAST(o_orderkey % 8 AS INT) + 1)
    || substr(lower(o_orderpriority), CAST(o_orderkey % 8 AS INT) + 6) END"""
# A third of the texts is in capitals, where only codes can be similar.
_WORN_TEXT = f"""CASE WHEN o_orderkey % 3 = 0 THEN upper('valor de ' || {_WORN}) ELSE 'Valor de ' || {_WORN} END
  || ' em ' || CAST(year(o_orderdate) AS STRING)"""


def _similar_sql(pairs: str, name: str) -> dict[str, str]:
    """CTEs that score ``pairs`` (text, name, place) by the definition and keep the best name of each text from 72."""
    return {
        f"{name}_sides": f"""SELECT *, name AS s, text AS l FROM ({pairs}) WHERE length(name) <= length(text)
            UNION ALL SELECT *, text AS s, name AS l FROM ({pairs}) WHERE length(text) <= length(name)""",
        f"{name}_windows": f"""SELECT text, name, place, s, CAST(length(s) AS BIGINT) AS m, (CAST(1 AS BIGINT) << length(s)) - 1 AS all_bits,
            substr(l, greatest(b, 1), least(b + length(s), length(l) + 1) - greatest(b, 1)) AS w
            FROM (SELECT *, unnest(range(2 - length(s), length(l) + 1)) AS b FROM {name}_sides)""",
        f"{name}_scored": f"""SELECT text, name, place, max(200.0 * (m - bit_count(list_reduce(list_prepend(all_bits, list_transform(range(1, length(w) + 1),
              lambda i: CAST(list_sum(list_transform(range(m), lambda j: CASE WHEN substr(s, j + 1, 1) = substr(w, i, 1) THEN CAST(1 AS BIGINT) << j ELSE 0 END)) AS BIGINT))),
              lambda state, k: ((state + (state & k)) | (state - (state & k))) & all_bits))) / (m + length(w))) AS score
            FROM {name}_windows GROUP BY ALL""",
        name: f"""SELECT text, name, place, score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, place, name) AS n
            FROM {name}_scored WHERE score >= 72) WHERE n = 1""",
    }


_CODED = {
    "coded": "SELECT indicator_code, min(indicator_name) AS indicator_name FROM dim_indicator GROUP BY 1",
    "worn": f"SELECT DISTINCT {_WORN_TEXT.replace('STRING', 'VARCHAR')} AS text FROM orders",
    **_similar_sql("SELECT text, indicator_name AS name, indicator_code AS place FROM worn, coded", "by_name"),
}


def _worn(t: Tables):
    return t.raw("orders").select("o_orderkey", F.expr(_WORN_TEXT).alias("text"))


@query("fuzzy_indicator_join", "SELECT text, name, round(score, 4) AS score FROM by_name", ["dim_indicator"], _CODED)
def fuzzy_indicator_join(t: Tables):
    """Names with letters lost or moved in, some of them too far from any name."""
    names = _names(t).select(F.col("indicator_name").alias("name"), F.col("indicator_code").alias("place"))
    return Q.fuzzy_indicator_join(_worn(t), names).select("text", "name", F.round("score", 4).alias("score"))


@query(
    "q_indicator_worn",
    f"""SELECT o_orderkey AS q_id, coalesce(x.name, c.indicator_name) AS indicator_name, coalesce(f.indicator_code, y.place) AS indicator_code
        FROM (SELECT o_orderkey, {_WORN_TEXT.replace('STRING', 'VARCHAR')} AS text FROM orders) o
        LEFT JOIN by_name x ON x.text = o.text
        LEFT JOIN (SELECT indicator_name, min(indicator_code) AS indicator_code FROM coded GROUP BY 1) f ON f.indicator_name = x.name
        LEFT JOIN by_code y ON y.text = upper(o.text) AND x.name IS NULL
        LEFT JOIN coded c ON c.indicator_code = y.place""",
    ["dim_indicator"],
    {
        **_CODED,
        **_similar_sql(
            "SELECT DISTINCT upper(text) AS text, indicator_code AS name, indicator_code AS place FROM worn, coded "
            "WHERE text NOT IN (SELECT text FROM by_name)",
            "by_code",
        ),
    },
)
def q_indicator_worn(t: Tables):
    """Near misses of names, then of codes, for every order."""
    asked = _worn(t).select(F.col("o_orderkey").alias("q_id"), F.col("text").alias("question"))
    return Q.q_indicator(asked, _names(t)).select("q_id", "indicator_name", "indicator_code")


@query(
    "sql_guard",
    r"""SELECT q_id, CASE WHEN q_id % 5 = 0 THEN 'Não é um SELECT: ' || ('DELETE ' || question)[1:80]
          WHEN q_id % 5 = 1 THEN 'Placeholders por preencher: ' || (' select [YEAR] ' || question)[1:80]
          WHEN q_id % 5 = 2 THEN 'Ranking query sem ORDER BY / LIMIT' END AS refusal FROM questions""",
    ["questions"],
)
def sql_guard(t: Tables):
    kind = F.col("q_id") % 5
    statement = (
        F.when(kind == 0, F.concat(F.lit("DELETE "), "question"))
        .when(kind == 1, F.concat(F.lit(" select [YEAR] "), "question"))
        .when(kind == 2, F.concat(F.lit("SELECT 1 ORDER BY -- "), "question"))
        .otherwise(F.concat(F.lit("select 1 order by 1 limit 3 -- "), "question"))
    )
    return t.questions.select("q_id", Q.sql_guard(statement, kind != 4).alias("refusal"))


# --- answers ------------------------------------------------------------------------------------------

_ANSWERS = {
    **_CLASSIFIED,
    **_COUNTRY,
    **_INDICATOR,
    "planned": f"""SELECT *, CASE WHEN tier LIKE 'meta:%' THEN 'meta' WHEN indicator_name IS NULL THEN 'no_indicator'
          WHEN tier = 'comparison' THEN CASE WHEN len(pair) < 2 THEN 'no_pair' ELSE 'comparison' END
          WHEN tier LIKE 'existence%' THEN CASE WHEN country IS NULL THEN 'no_country' ELSE 'existence' END
          WHEN ranks OR top_n IS NOT NULL THEN CASE WHEN country IS NOT NULL AND len(years) = 0 AND top_n IS NULL
            THEN 'best_year' ELSE 'ranking' END
          WHEN country IS NULL THEN 'snapshot' ELSE 'value' END AS kind, coalesce(top_n, 1) AS n
        FROM (SELECT c.q_id, question, tier, years, indicator_name, country, {_YEAR_SQL} AS year, {_RANKS} AS ranks,
            TRY_CAST(regexp_extract(lower(question), '\\btop\\s*(\\d+)\\b', 1) AS INTEGER) AS top_n,
            regexp_matches(lower(question), '\\bpiores?\\b|\\bmenor\\b|\\binferior\\b|\\babaixo\\b') AS ascending,
            CASE WHEN len(coalesce(p.countries, [])) < 2 AND has_context THEN coalesce(a.countries, [])
              ELSE coalesce(p.countries, []) END AS pair
          FROM classified c LEFT JOIN first_country f ON f.q_id = c.q_id LEFT JOIN countries p ON p.q_id = c.q_id
            LEFT JOIN all_countries a ON a.q_id = c.q_id LEFT JOIN named m ON m.q_id = c.q_id)""",
    "cells": """SELECT indicator_name AS i, location_name AS l, year AS y, count(*) AS c, max(value) AS hi, min(value) AS lo
        FROM star GROUP BY ALL""",
    "meta": """SELECT 'meta:count_records' AS tier, count(*) AS v FROM star
        UNION ALL SELECT 'meta:count_indicators', count(DISTINCT indicator_code) FROM dim_indicator
        UNION ALL SELECT 'meta:list_countries', count(*) FROM dim_location
        UNION ALL SELECT 'meta:list_indicators', count(*) FROM (SELECT DISTINCT indicator_code, indicator_name FROM dim_indicator)""",
    "led": """SELECT *, rank() OVER (PARTITION BY indicator_name, year ORDER BY value DESC) AS down,
        rank() OVER (PARTITION BY indicator_name, year ORDER BY value ASC) AS up FROM star""",
    "answered": """SELECT q_id, sum(c) AS n_rows, max(hi) AS answer, NULL AS other FROM planned, cells
          WHERE kind = 'value' AND i = indicator_name AND contains(l, country) AND y = year GROUP BY q_id
        UNION ALL SELECT q_id, 1, sum(c), NULL FROM planned, cells
          WHERE kind = 'existence' AND i = indicator_name AND contains(l, country) AND y = year GROUP BY q_id
        UNION ALL SELECT q_id, 1, CASE WHEN bool_or(ascending) THEN min(lo) ELSE max(hi) END, NULL FROM planned, cells
          WHERE kind = 'best_year' AND i = indicator_name AND contains(l, country) GROUP BY q_id
        UNION ALL SELECT q_id, least(sum(c), 20), max(hi), NULL FROM planned, cells
          WHERE kind = 'snapshot' AND i = indicator_name AND y = year GROUP BY q_id
        UNION ALL SELECT q_id, sum(c), max(CASE WHEN l = pair[1] THEN hi END), max(CASE WHEN l = pair[2] THEN hi END)
          FROM planned, cells WHERE kind = 'comparison' AND i = indicator_name AND y = year AND l IN (pair[1], pair[2]) GROUP BY q_id
        UNION ALL SELECT q_id, least(count(*), max(n)), CASE WHEN bool_or(ascending) THEN min(value) ELSE max(value) END, NULL
          FROM planned p JOIN led ON led.indicator_name = p.indicator_name AND led.year = p.year
          WHERE kind = 'ranking' AND CASE WHEN ascending THEN up ELSE down END <= n
            AND (country IS NULL OR contains(location_name, country)) GROUP BY q_id""",
    "answers": """SELECT p.q_id, p.question, p.tier, kind, indicator_name, country, pair, year,
        CAST(CASE WHEN kind IN ('meta', 'existence') THEN 1 WHEN kind NOT LIKE 'no_%' THEN coalesce(n_rows, 0) END AS BIGINT) AS n_rows,
        CAST(coalesce(v, answer, CASE WHEN kind = 'existence' THEN 0 END) AS DOUBLE) AS answer, CAST(other AS DOUBLE) AS other
        FROM planned p LEFT JOIN answered a ON a.q_id = p.q_id LEFT JOIN meta ON meta.tier = p.tier""",
}


def _answers(t: Tables):
    planned, star, meta = _planned(t)
    return N.q_answer_batch(planned, star, meta, N.lookups(planned, star))


def _planned(t: Tables):
    star = t.star_table
    codes = t.dim_indicator
    latest = analytics.max_year(star).first()["max_year"]
    planned = N.plan_answers(t.questions, _aliases(t), _names(t), latest)
    counts = analytics.meta_counts(star, t.dim_location, codes)
    tiers = {
        "total_registos": "meta:count_records",
        "total_paises": "meta:count_countries",
        "total_indicadores": "meta:count_indicators",
        "total_relatorios": "meta:count_reports",
    }
    tier = F.create_map(*[F.lit(x) for item in tiers.items() for x in item])[F.col("measure")]
    lists = t.dim_location.agg(F.count("*").alias("n")).select(
        F.lit("meta:list_countries").alias("tier"), "n"
    ).unionByName(
        codes.select("indicator_code", "indicator_name")
        .distinct()
        .agg(F.count("*").alias("n"))
        .select(F.lit("meta:list_indicators").alias("tier"), "n")
    )
    return planned, star, counts.select(tier.alias("tier"), "n").unionByName(lists)


@query(
    "q_answer_batch",
    "SELECT q_id, kind, year, n_rows, answer, other FROM answers",
    ["questions", "star"],
    _ANSWERS,
)
def q_answer_batch(t: Tables):
    return _answers(t).select("q_id", "kind", "year", "n_rows", "answer", "other")


def _variant_sql(templates: list[str], parts: dict[str, str]) -> str:
    arms = []
    for i, template in enumerate(templates):
        text = _quote(template)
        for name, sql in parts.items():
            text = f"replace({text}, '{{{name}}}', {sql})"
        arms.append(f"WHEN {i} THEN {text}")
    return f"CASE CAST('0x' || md5(question)[1:4] AS INTEGER) % {len(templates)} {' '.join(arms)} END"


_SHOW = "CASE WHEN {0} = floor({0}) THEN replace(format('{{:,}}', CAST({0} AS BIGINT)), ',', ' ') ELSE replace(format('{{:,.2f}}', {0}), ',', ' ') END"
_FILL = {
    "year": "CAST(year AS VARCHAR)",
    "country": "coalesce(country, 'o local indicado')",
    "value": f"coalesce({_SHOW.format('answer')}, '')",
    "indicator": "coalesce(indicator_name, 'indicador')",
}


_ROW = {
    "country": "coalesce(country, row_place)",
    "year": "CAST(row_year AS VARCHAR)",
    "value": _SHOW.format("row_value"),
    "indicator": "indicator_name",
}
_RANKED_ROW = {**_ROW, "ranking": "CAST(row_ranking AS VARCHAR)"}
_ROWS = {
    "every": """SELECT q_id, kind, p.n AS cut, location_name, s.year AS row_year, value, report_id, indicator_sk, NULL AS ranking,
          CASE WHEN kind = 'comparison' THEN location_name ELSE '' END AS f,
          CASE WHEN kind = 'best_year' AND ascending THEN value ELSE -value END AS t
        FROM planned p JOIN star s ON s.indicator_name = p.indicator_name
          AND (kind = 'best_year' OR s.year = p.year)
          AND CASE kind WHEN 'value' THEN contains(location_name, country) WHEN 'best_year' THEN contains(location_name, country)
            WHEN 'comparison' THEN location_name IN (pair[1], pair[2]) WHEN 'snapshot' THEN true ELSE false END
        UNION ALL SELECT q_id, kind, p.n, location_name, led.year, value, report_id, indicator_sk,
          CASE WHEN ascending THEN up ELSE down END, '', CASE WHEN ascending THEN up ELSE down END
        FROM planned p JOIN led ON led.indicator_name = p.indicator_name AND led.year = p.year
        WHERE kind = 'ranking' AND CASE WHEN ascending THEN up ELSE down END <= p.n
          AND (country IS NULL OR contains(location_name, country))""",
    "placed": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id
          ORDER BY f, t, location_name, row_year, report_id, indicator_sk) AS position FROM every)
        WHERE position <= CASE kind WHEN 'ranking' THEN least(cut, 25) WHEN 'best_year' THEN 1 WHEN 'snapshot' THEN 20 ELSE 25 END""",
    "spelled": f"""SELECT q_id, arg_min(location_name, position) AS row_place, arg_min(row_year, position) AS row_year,
          arg_min(value, position) AS row_value, arg_min(ranking, position) AS row_ranking,
          string_agg(CASE kind WHEN 'ranking' THEN ranking || '. ' || location_name || ' (' || row_year || ') — ' || {_SHOW.format('value')}
            WHEN 'snapshot' THEN location_name || ': ' || {_SHOW.format('value')}
            ELSE location_name || ' (' || row_year || '): ' || {_SHOW.format('value')} END, chr(10) ORDER BY position) AS lines
        FROM placed GROUP BY q_id""",
}


@query(
    "answer_text",
    f"""SELECT q_id, kind, CASE kind WHEN 'no_indicator' THEN 'Não foi possível identificar o indicador.'
          WHEN 'no_pair' THEN 'Não foi possível identificar os dois países para comparação.'
          WHEN 'no_country' THEN 'Não foi possível identificar o país.'
          ELSE CASE WHEN kind = 'meta' THEN CASE tier
              WHEN 'meta:count_records' THEN 'A base de dados contém ' || {_SHOW.format('answer')} || ' registos de valores.'
              WHEN 'meta:count_indicators' THEN 'Existem ' || CAST(answer AS BIGINT) || ' indicadores disponíveis.'
              WHEN 'meta:list_countries' THEN (SELECT 'Os ' || count(*) || ' países disponíveis são: '
                || string_agg(name, ', ' ORDER BY name) || '.' FROM dim_location)
              ELSE (SELECT 'Os indicadores disponíveis são:' || chr(10) || string_agg('• ' || x, chr(10) ORDER BY x)
                FROM (SELECT DISTINCT indicator_code || ' – ' || indicator_name AS x FROM dim_indicator)) END
            WHEN kind = 'existence' THEN {_variant_sql(W.EXISTENCE_SENTENCES, {**_FILL, 'count': 'CAST(CAST(answer AS BIGINT) AS VARCHAR)'})}
            WHEN n_rows = 0 THEN
              {_variant_sql(W.NOTHING_SENTENCES, {})} || ' (Pesquisa: ' || concat_ws(', ', 'indicador "' || indicator_name || '"',
                'país "' || country || '"', 'ano ' || year) || '.)'
            WHEN kind = 'comparison' AND answer IS NOT NULL AND other IS NOT NULL THEN pair[1] || ' ficou ' || CASE WHEN answer > other THEN 'acima' ELSE 'abaixo' END
              || ' de ' || pair[2] || ' em ' || indicator_name || ' (' || year || '), com ' || {_SHOW.format('answer')}
              || ' vs ' || {_SHOW.format('other')} || '.'
            WHEN n_rows > 1 THEN 'Resultados para "' || indicator_name || '"' || CASE WHEN n_rows > 25
              THEN ' (mostrando 25 de ' || n_rows || ')' ELSE '' END || ':' || chr(10) || lines
            WHEN kind = 'ranking' THEN {_variant_sql(W.RANKING_SENTENCES, _RANKED_ROW)}
            ELSE {_variant_sql(W.VALUE_SENTENCES, _ROW)} END END AS text FROM answers LEFT JOIN spelled USING (q_id)""",
    ["questions", "star"],
    {**_ANSWERS, **_ROWS},
)
def answer_text(t: Tables):
    planned, star, meta = _planned(t)
    found = N.lookups(planned, star)
    answered = N.q_answer_batch(planned, star, meta, found)
    return N.answer_text(answered, N.answer_rows(star, found), N.list_sentences(t.dim_location, t.dim_indicator))


@query(
    "answer_lines",
    f"""SELECT indicator_sk, year, 'Resultados para "' || min(indicator_name) || '"' ||
          CASE WHEN count(*) > 25 THEN ' (mostrando 25 de ' || count(*) || ')' ELSE '' END || ':' || chr(10) ||
          string_agg(ranking || '. ' || location_name || ' (' || year || ') — ' || {_SHOW.format('value')}, chr(10)
            ORDER BY n) FILTER (WHERE n <= 25) AS text
        FROM (SELECT *, rank() OVER w AS ranking, row_number() OVER (PARTITION BY indicator_sk, year
                ORDER BY value DESC, location_name, report_id) AS n FROM star
              WINDOW w AS (PARTITION BY indicator_sk, year ORDER BY value DESC)) WHERE ranking <= 40 GROUP BY ALL""",
    ["star"],
)
def answer_lines(t: Tables):
    best = analytics.top_n_ranked(t.star_table, 40)
    names = t.dim_indicator.select("indicator_sk", "indicator_name")
    window = Window.partitionBy("indicator_sk", "year").orderBy(F.desc("value"), "location_name", "report_id")
    rows = best.withColumn("position", F.row_number().over(window)).join(names, "indicator_sk")
    return N.answer_lines(rows, ["indicator_sk", "year"])
