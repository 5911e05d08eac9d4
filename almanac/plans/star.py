"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.text import normalise_name
from almanac.operators import analytics as A, warehouse as W
from almanac.plans.catalog import query
from almanac.plans.fixtures import Tables

KEYS = "report_id, indicator_sk, location_code"


# --- dimensions and load -------------------------------------------------------------


@query(
    "seed_dim_date",
    """SELECT CAST(y - lo + 1 AS INTEGER) AS date_id, CAST(y AS INTEGER) AS year FROM (
         SELECT lo, unnest(range(lo, hi + 1)) AS y FROM (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders))""",
)
def seed_dim_date(t: Tables):
    """The years from the first order to the last one."""
    first, last = t.raw("orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return W.seed_dim_date(t.spark, first, last)


@query("seed_dim_location", "SELECT * FROM dim_location", ["dim_location"])
def seed_dim_location(t: Tables):
    return t.dim_location


@query("distinct_join_load", "SELECT * FROM dim_report", ["dim_report"])
def distinct_join_load(t: Tables):
    return t.dim_report


@query(
    "distinct_pairs",
    "SELECT DISTINCT source_code AS source_system, indicator_code, indicator_name FROM silver",
    ["silver"],
)
def distinct_pairs(t: Tables):
    return W.distinct_pairs(t.silver)


@query(
    "union_distinct_pairs",
    """SELECT DISTINCT source_system, indicator_code, indicator_name FROM (
       SELECT source_code AS source_system, indicator_code, indicator_name FROM silver
       UNION ALL SELECT source_system, indicator_code, upper(indicator_name) FROM dim_indicator)""",
    ["silver", "dim_indicator"],
)
def union_distinct_pairs(t: Tables):
    renamed = t.dim_indicator.select(
        "source_system", "indicator_code", F.upper("indicator_name").alias("indicator_name")
    )
    return W.distinct_pairs(t.silver).unionByName(renamed).distinct()


@query("assign_indicator_keys", "SELECT * FROM dim_indicator", ["dim_indicator"])
def assign_indicator_keys(t: Tables):
    return t.built_indicators


@query(
    "surrogate_lookup",
    """SELECT s.ord, s.report_id, l.location_sk, i.indicator_sk, d.date_id, s.value
       FROM silver s JOIN dim_location l ON s.location_code = l.location_code
       JOIN dim_indicator i ON s.source_code = i.source_system AND s.indicator_code = i.indicator_code
       JOIN dim_date d ON s.year = d.year""",
    ["silver", "dim_indicator", "dim_date"],
)
def surrogate_lookup(t: Tables):
    valid, _ = W.surrogate_lookup(t.silver, t.dim_location, t.dim_indicator, t.dim_date)
    return valid.select("ord", "report_id", "location_sk", "indicator_sk", "date_id", "value")


_PARTIAL = {
    "known": "SELECT * FROM dim_location WHERE region <> 'ASIA'",
    "keyed": """SELECT s.file_id, s.ord, k.location_sk, i.indicator_sk, d.date_id
        FROM silver s LEFT JOIN known k ON s.location_code = k.location_code
        LEFT JOIN dim_indicator i ON s.source_code = i.source_system AND s.indicator_code = i.indicator_code
        LEFT JOIN dim_date d ON d.year = CASE WHEN s.file_id % 13 = 0 THEN s.year - 1000 ELSE s.year END""",
}


def _partial_keys(t: Tables):
    known = t.dim_location.where("region <> 'ASIA'")
    shifted = t.silver.withColumn(
        "year", F.when(F.col("file_id") % 13 == 0, F.col("year") - 1000).otherwise(F.col("year"))
    )
    return shifted, known


@query(
    "key_valid_mask",
    """SELECT file_id, ord, location_sk IS NOT NULL AND indicator_sk IS NOT NULL AND date_id IS NOT NULL AS ok
       FROM keyed""",
    ["silver", "dim_indicator", "dim_date"],
    _PARTIAL,
)
def key_valid_mask(t: Tables):
    rows, known = _partial_keys(t)
    valid, quarantine = W.surrogate_lookup(rows, known, t.dim_indicator, t.dim_date)
    return valid.select("file_id", "ord", F.lit(True).alias("ok")).unionByName(
        quarantine.select("file_id", "ord", F.lit(False).alias("ok"))
    )


@query(
    "load_result_message",
    """SELECT file_id, count(*) AS n_rows,
         count(CASE WHEN location_sk IS NOT NULL AND indicator_sk IS NOT NULL AND date_id IS NOT NULL THEN 1 END) AS n_valid,
         CASE WHEN n_valid = 0 THEN '0 linhas válidas de ' || count(*) || ' — location_sk em falta: ' ||
           (count(*) - count(location_sk)) || ', indicator_sk em falta: ' || (count(*) - count(indicator_sk)) ||
           ', date_id em falta: ' || (count(*) - count(date_id)) END AS message
       FROM keyed GROUP BY file_id""",
    ["silver", "dim_indicator", "dim_date"],
    _PARTIAL,
)
def load_result_message(t: Tables):
    rows, known = _partial_keys(t)
    return W.load_result_message(W.with_surrogates(rows, known, t.dim_indicator, t.dim_date))


@query("first_write_wins", "SELECT * FROM facts", ["facts"])
def first_write_wins(t: Tables):
    return t.built_facts


def _facts_of_done(t: Tables):
    done = t.op_report.where(F.col("pipeline_status") == "done")
    return t.facts.join(done.select("report_id"), "report_id", "left_semi")


@query(
    "insert_ignore",
    """SELECT n.report_id, n.location_sk, n.indicator_sk, n.date_id, n.value FROM facts n
       WHERE NOT EXISTS (SELECT 1 FROM facts e JOIN op_report r USING (report_id) WHERE r.pipeline_status = 'done'
         AND e.report_id = n.report_id AND e.location_sk = n.location_sk AND e.indicator_sk = n.indicator_sk
         AND e.date_id = n.date_id)""",
    ["facts", "op_report"],
)
def insert_ignore(t: Tables):
    """Every row is offered again to a store that already holds some of the reports."""
    valid, _ = W.surrogate_lookup(t.silver, t.dim_location, t.dim_indicator, t.dim_date)
    offered = valid.select(*W.FACT_KEY, "ord", "value")
    stored = _facts_of_done(t)
    return W.insert_ignore(stored, offered, W.FACT_KEY, ["ord"]).select(*W.FACT_KEY, "value")


@query(
    "replace_report",
    """SELECT report_id, location_sk, indicator_sk, date_id, CASE WHEN report_id IN (
         SELECT report_id FROM op_report WHERE pipeline_status = 'done') THEN value * 2 ELSE value END AS value FROM facts""",
    ["facts", "op_report"],
)
def replace_report(t: Tables):
    reloaded = _facts_of_done(t).withColumn("value", F.col("value") * 2)
    return W.replace_report(t.facts, reloaded)


# --- flat view, snapshots, series ----------------------------------------------------


@query("star_join", "SELECT * FROM flat", ["flat"])
def star_join(t: Tables):
    return t.flat


@query(
    "snapshot",
    "SELECT location_name, value FROM star WHERE trim(indicator_name) = '1-urgent' AND year = 1997",
    ["star"],
)
def snapshot(t: Tables):
    return A.snapshot(t.star, "1-urgent ", 1997)


@query(
    "snapshot_report",
    "SELECT location_name, value FROM star WHERE indicator_name = '1-urgent' AND year = 1997 AND report_id = 2",
    ["star"],
)
def snapshot_report(t: Tables):
    return A.snapshot(t.star, "1-urgent", 1997, report_id=2)


@query(
    "timeseries",
    """SELECT location_name, year, value FROM star
       WHERE indicator_name = '5-low' AND location_name IN ('NATION_3', 'NATION_14')""",
    ["star"],
)
def timeseries(t: Tables):
    return A.timeseries(t.star, "5-low", "NATION_3, ,NATION_14 ")


@query(
    "facts_of_indicator",
    "SELECT location_code, location_name, year, value FROM star WHERE indicator_sk = 3",
    ["star"],
)
def facts_of_indicator(t: Tables):
    return A.facts_of_indicator(t.star, 3)


@query("dashboard_filters_indicators", "SELECT DISTINCT trim(indicator_name) AS indicator_name FROM star", ["star"])
def dashboard_filters_indicators(t: Tables):
    return A.filter_indicators(t.star)


@query("dashboard_filters_years", "SELECT DISTINCT year FROM star", ["star"])
def dashboard_filters_years(t: Tables):
    return A.filter_years(t.star)


@query(
    "dashboard_filters",
    """SELECT 'indicator' AS filter, indicator_name AS entry FROM star WHERE report_id = 3
       UNION SELECT 'year', CAST(year AS VARCHAR) FROM star WHERE report_id = 3 AND indicator_name = '2-high'""",
    ["star"],
)
def dashboard_filters(t: Tables):
    names = A.filter_indicators(t.star, report_id=3).select(
        F.lit("indicator").alias("filter"), F.col("indicator_name").alias("entry")
    )
    years = A.filter_years(t.star, "2-high", report_id=3).select(
        F.lit("year").alias("filter"), F.col("year").cast("string").alias("entry")
    )
    return names.unionByName(years)


@query(
    "normalise_name",
    r"""SELECT doc_id, trim(replace(replace(text, chr(10), ' '), chr(13), '')) AS name FROM documents""",
)
def normalise_names(t: Tables):
    return t.raw("documents").select("doc_id", normalise_name(F.col("text")).alias("name"))


@query(
    "point_lookup",
    "SELECT location_name, year, value FROM star WHERE indicator_name = '3-medium' AND location_name = 'NATION_24' AND year = 1999",
    ["star"],
)
def point_lookup(t: Tables):
    return A.point_lookup(t.star, "3-MED", "nation_24", 1999)


@query(
    "filter_ilike",
    "SELECT indicator_name, location_name, year, value FROM star WHERE indicator_name ILIKE '%not spec%' AND contains(lower(location_name), 'n_2')",
    ["star"],
)
def filter_ilike(t: Tables):
    rows = A.filter_ilike(t.star, "Not Spec", "n_2")
    return rows.select("indicator_name", "location_name", "year", "value")


@query(
    "filter_eq_in_between",
    """SELECT report_id, source_code, publication_date FROM op_report
       WHERE report_url IS NOT NULL AND report_url <> '' AND source_code IN ('SRC_A', 'SRC_C', 'SRC_E')
         AND publication_date BETWEEN DATE '2000-01-05' AND DATE '2005-12-31'""",
    ["op_report"],
)
def filter_eq_in_between(t: Tables):
    return t.op_report.where(
        F.col("report_url").isNotNull()
        & (F.col("report_url") != "")
        & F.col("source_code").isin("SRC_A", "SRC_C", "SRC_E")
        & F.col("publication_date").between("2000-01-05", "2005-12-31")
    ).select("report_id", "source_code", "publication_date")


@query(
    "existence_count",
    "SELECT count(*) AS registos_encontrados FROM star WHERE indicator_name = '2-high' AND location_name LIKE 'NATION_7' AND year = 1996",
    ["star"],
)
def existence_count(t: Tables):
    return A.existence_count(t.star, "2-high", "NATION_7", 1996)


@query(
    "latest_values",
    """SELECT location_name, year, value FROM (SELECT * FROM star WHERE indicator_name = '4-not specified'
       ORDER BY year DESC, location_name, report_id, indicator_sk LIMIT 50)""",
    ["star"],
)
def latest_values(t: Tables):
    return A.latest_values(t.star, "4-not")


@query(
    "threshold_filter",
    "SELECT location_name, year, value FROM star WHERE indicator_name = '1-urgent' AND year = 1998 AND value > 250000",
    ["star"],
)
def threshold_filter(t: Tables):
    return A.threshold_filter(t.star, "1-urgent", 1998, 250000.0)


@query(
    "threshold_peer",
    """SELECT report_id, indicator_sk, location_code, year, value FROM star JOIN
       (SELECT indicator_sk AS k, year AS y, avg(value) AS m FROM star GROUP BY ALL) ON indicator_sk = k AND year = y
       WHERE value > m""",
    ["star"],
)
def threshold_peer(t: Tables):
    return A.above_mean(t.star_table).select("report_id", "indicator_sk", "location_code", "year", "value")


# --- rankings --------------------------------------------------------------------------

_RANK = """SELECT indicator_name, source_system, location_name, report_id, year,
  rank() OVER (PARTITION BY indicator_sk, year ORDER BY value {d}) AS ranking, value FROM star"""


@query("rank_by_year", _RANK.format(d="DESC"), ["star"])
def rank_by_year(t: Tables):
    return A.rank_by_year(t.star_table)


@query("rank_by_year_asc", _RANK.format(d="ASC"), ["star"])
def rank_by_year_asc(t: Tables):
    return A.rank_by_year(t.star_table, descending=False)


@query(
    "rank_across_names",
    """SELECT indicator_name, location_name, report_id, year,
       rank() OVER (PARTITION BY year ORDER BY value DESC) AS ranking, value FROM star WHERE indicator_name LIKE '%i%'""",
    ["star"],
)
def rank_across_names(t: Tables):
    return A.rank_across_names(t.star_table, "i")


@query(
    "location_rank",
    f"SELECT * FROM ({_RANK.format(d='DESC')}) WHERE location_name = 'NATION_12' AND year = 1997",
    ["star"],
)
def location_rank(t: Tables):
    return A.location_rank(t.star_table, "NATION_12", 1997)


@query(
    "top_n_ranked",
    """SELECT indicator_sk, location_name, report_id, year, CAST(ranking AS INTEGER) AS ranking, value FROM (SELECT *,
       rank() OVER (PARTITION BY indicator_sk, year ORDER BY value DESC) AS ranking FROM star) WHERE ranking <= 3""",
    ["star"],
)
def top_n_ranked(t: Tables):
    return A.top_n_ranked(t.star_table, 3)


@query(
    "top_n_overall",
    """SELECT location_name, report_id, value FROM (SELECT * FROM star WHERE indicator_name = '5-low' AND year = 2000
       ORDER BY value DESC, location_name, report_id, indicator_sk LIMIT 20)""",
    ["star"],
)
def top_n_overall(t: Tables):
    return A.top_n_overall(t.star, "5-low", 2000)


@query(
    "bottom_n_overall",
    """SELECT location_name, report_id, value FROM (SELECT * FROM star WHERE indicator_name = '5-low' AND year = 2000
       ORDER BY value ASC, location_name, report_id, indicator_sk LIMIT 5)""",
    ["star"],
)
def bottom_n_overall(t: Tables):
    return A.top_n_overall(t.star, "5-low", 2000, n=5, descending=False)


@query(
    "best_year_for_location",
    """SELECT indicator_sk, location_name, year, value FROM (SELECT *, row_number() OVER (
       PARTITION BY indicator_sk, location_name ORDER BY value DESC, year, report_id) AS n FROM star) WHERE n = 1""",
    ["star"],
)
def best_year_for_location(t: Tables):
    return A.best_years(t.star)


# --- series ------------------------------------------------------------------------------


@query(
    "year_growth",
    f"""SELECT {KEYS}, year, value, p AS previous_value, round(value - p, 4) AS difference,
        round((value - p) / nullif(p, 0), 6) AS growth
        FROM (SELECT *, lag(value) OVER (PARTITION BY {KEYS} ORDER BY year) AS p FROM star)""",
    ["star"],
)
def year_growth(t: Tables):
    return A.year_growth(t.star)


@query(
    "evolution_last_n",
    f"""SELECT {KEYS}, year, value, CAST(n AS INTEGER) AS age FROM (SELECT *, row_number() OVER (
        PARTITION BY {KEYS} ORDER BY year DESC) AS n FROM star) WHERE n <= 3""",
    ["star"],
)
def evolution_last_n(t: Tables):
    return A.evolution_last_n(t.star, 3)


@query(
    "running_stats",
    f"""SELECT {KEYS}, year, round(avg(value) OVER (PARTITION BY {KEYS} ORDER BY year
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS running_mean FROM star""",
    ["star"],
)
def running_stats(t: Tables):
    return A.running_stats(t.star)


@query(
    "trend",
    """SELECT indicator_sk, location_code, count(*) AS n_values, round(regr_slope(value, year), 6) AS slope
       FROM star GROUP BY ALL""",
    ["star"],
)
def trend(t: Tables):
    return A.trend(t.star)


# --- comparison and aggregates -----------------------------------------------------------


@query(
    "compare_two",
    """SELECT a.report_id, a.indicator_sk, a.year, a.value AS value_1, b.value AS value_2,
       CASE WHEN a.value > b.value THEN 'acima' ELSE 'abaixo' END AS verdict
       FROM star a JOIN star b USING (report_id, indicator_sk, year)
       WHERE a.location_name = 'NATION_4' AND b.location_name = 'NATION_9'""",
    ["star"],
)
def compare_two(t: Tables):
    return A.compare_two(t.star, "NATION_4", "NATION_9")


@query(
    "agg_range",
    """SELECT indicator_sk, location_name, round(avg(value), 4) AS mean_value, round(sum(value), 2) AS total_value,
       max(value) AS max_value, min(value) AS min_value
       FROM star WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL""",
    ["star"],
)
def agg_range(t: Tables):
    return A.agg_range(t.star, 1996, 1999)


@query(
    "region_rollup",
    """SELECT region, sub_region, year, count(*) AS n_values, round(avg(value), 4) AS mean_value
       FROM star GROUP BY ALL""",
    ["star"],
)
def region_rollup(t: Tables):
    return A.region_rollup(t.star)


@query(
    "meta_counts",
    """SELECT 'total_registos' AS measure, count(*) AS n FROM facts
       UNION ALL SELECT 'total_relatorios', count(DISTINCT report_id) FROM facts
       UNION ALL SELECT 'total_paises', count(DISTINCT name) FROM dim_location
       UNION ALL SELECT 'total_indicadores', count(DISTINCT indicator_code) FROM dim_indicator""",
    ["facts", "dim_location", "dim_indicator"],
)
def meta_counts(t: Tables):
    return A.meta_counts(t.facts, t.dim_location, t.dim_indicator)


@query(
    "meta_lists",
    """SELECT 'pais' AS list, name AS code, name AS name FROM dim_location
       UNION ALL SELECT DISTINCT 'indicador', indicator_code, indicator_name FROM dim_indicator""",
    ["dim_location", "dim_indicator"],
)
def meta_lists(t: Tables):
    places = t.dim_location.select(F.lit("pais").alias("list"), F.col("name").alias("code"), "name")
    codes = t.dim_indicator.select(
        F.lit("indicador").alias("list"),
        F.col("indicator_code").alias("code"),
        F.col("indicator_name").alias("name"),
    ).distinct()
    return places.unionByName(codes).orderBy("list", "code")


@query("max_year", "SELECT max(year) AS max_year FROM star", ["star"])
def max_year(t: Tables):
    return A.max_year(t.star)


@query(
    "distinct_on_code",
    "SELECT DISTINCT ON (indicator_code) indicator_code, indicator_name, source_system FROM dim_indicator ORDER BY indicator_code, source_system",
    ["dim_indicator"],
)
def distinct_on_code(t: Tables):
    return A.distinct_on_code(t.dim_indicator)


@query(
    "semi_by_source",
    """SELECT i.*, 'SRC_B' AS source_code FROM dim_indicator i WHERE indicator_sk IN (SELECT indicator_sk FROM facts
       WHERE report_id IN (SELECT report_id FROM op_report WHERE source_code = 'SRC_B'))""",
    ["facts", "op_report", "dim_indicator"],
)
def semi_by_source(t: Tables):
    return A.semi_by_source(t.dim_indicator, t.facts, t.op_report, "SRC_B")


@query(
    "indicators_with_source",
    """SELECT i.indicator_sk, indicator_code, indicator_name, source_system, source_code
       FROM dim_indicator i JOIN (SELECT indicator_sk, min(report_id) AS report_id FROM facts GROUP BY ALL) f
         ON i.indicator_sk = f.indicator_sk LEFT JOIN op_report r ON r.report_id = f.report_id""",
    ["facts", "op_report", "dim_indicator"],
)
def indicators_with_source(t: Tables):
    return A.indicators_with_source(t.dim_indicator, t.facts, t.op_report)


@query(
    "reports_with_facts",
    """SELECT report_id, source_code, file_name, publication_date FROM op_report
       WHERE report_id IN (SELECT report_id FROM facts)""",
    ["facts", "op_report"],
)
def reports_with_facts(t: Tables):
    return A.reports_with_facts(t.op_report, t.facts)


@query(
    "facts_per_report",
    """SELECT r.report_id, count(f.value) AS n_facts FROM op_report r LEFT JOIN facts f ON f.report_id = r.report_id
       GROUP BY ALL""",
    ["facts", "op_report"],
)
def facts_per_report(t: Tables):
    return A.facts_per_report(t.op_report, t.facts)
