"""Questions asked of the star: snapshots, series, rankings, growth, counts.

``star`` below has the columns of :func:`warehouse.star_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.functions.text import contains_ci, csv_list, normalise_name
from almanac.operators.ordering import first_per_key, rank_top, rank_values, top_n_per_key

SERIES = ["report_id", "indicator_sk", "location_code"]


def _named(star: DataFrame, indicator_name: str) -> DataFrame:
    return star.where(normalise_name(F.col("indicator_name")) == indicator_name.strip())


def _of_report(star: DataFrame, report_id: int | None) -> DataFrame:
    return star if report_id is None else star.where(F.col("report_id") == report_id)


# --- lookups and lists -----------------------------------------------------------


def snapshot(star: DataFrame, indicator_name: str, year: int, report_id: int | None = None) -> DataFrame:
    rows = _of_report(_named(star, indicator_name), report_id).where(F.col("year") == year)
    return rows.select("location_name", "value").orderBy("location_name")


def timeseries(star: DataFrame, indicator_name: str, locations: str, report_id: int | None = None) -> DataFrame:
    """``locations`` is a comma-separated list of names."""
    wanted = F.array_contains(csv_list(F.lit(locations)), F.col("location_name"))
    rows = _of_report(_named(star, indicator_name), report_id).where(wanted)
    return rows.select("location_name", "year", "value").orderBy("location_name", "year")


def facts_of_indicator(star: DataFrame, indicator_sk: int) -> DataFrame:
    rows = star.where(F.col("indicator_sk") == indicator_sk)
    return rows.select("location_code", "location_name", "year", "value").orderBy("year", "location_name")


def filter_indicators(star: DataFrame, report_id: int | None = None) -> DataFrame:
    names = normalise_name(F.col("indicator_name")).alias("indicator_name")
    return _of_report(star, report_id).select(names).distinct().orderBy("indicator_name")


def filter_years(star: DataFrame, indicator_name: str | None = None, report_id: int | None = None) -> DataFrame:
    rows = star if indicator_name is None else _named(star, indicator_name)
    return _of_report(rows, report_id).select("year").distinct().orderBy(F.desc("year"))


def filter_ilike(star: DataFrame, indicator: str, location: str | None = None) -> DataFrame:
    rows = star.where(contains_ci(F.col("indicator_name"), indicator))
    return rows if location is None else rows.where(contains_ci(F.col("location_name"), location))


def point_lookup(star: DataFrame, indicator: str, location: str, year: int) -> DataFrame:
    rows = filter_ilike(star, indicator, location).where(F.col("year") == year)
    return rows.select("location_name", "year", "value")


def existence_count(star: DataFrame, indicator: str, location: str, year: int) -> DataFrame:
    rows = filter_ilike(star, indicator, location).where(F.col("year") == year)
    return rows.agg(F.count("*").alias("registos_encontrados"))


def latest_values(star: DataFrame, indicator: str, n: int = 50) -> DataFrame:
    rows = filter_ilike(star, indicator).orderBy(F.desc("year"), "location_name", "report_id", "indicator_sk")
    return rows.limit(n).select("location_name", "year", "value")


def threshold_filter(star: DataFrame, indicator: str, year: int, limit: float, above: bool = True) -> DataFrame:
    rows = filter_ilike(star, indicator).where(F.col("year") == year)
    keep = F.col("value") > limit if above else F.col("value") < limit
    return rows.where(keep).select("location_name", "year", "value")


def above_mean(star: DataFrame) -> DataFrame:
    """Rows above the mean of their indicator and year."""
    mean = star.groupBy("indicator_sk", "year").agg(F.avg("value").alias("mean_value"))
    return star.join(mean, ["indicator_sk", "year"]).where(F.col("value") > F.col("mean_value"))


# --- rankings ----------------------------------------------------------------------


def rank_by_year(star: DataFrame, descending: bool = True) -> DataFrame:
    """Place of every value within its indicator and year."""
    ranked = rank_values(star, ["indicator_sk", "year"], "value", "ranking", descending)
    return ranked.select("indicator_name", "source_system", "location_name", "report_id", "year", "ranking", "value")


def rank_across_names(star: DataFrame, indicator: str, descending: bool = True) -> DataFrame:
    """All indicators whose name contains the text ranked together per year."""
    ranked = rank_values(filter_ilike(star, indicator), ["year"], "value", "ranking", descending)
    return ranked.select("indicator_name", "location_name", "report_id", "year", "ranking", "value")


def location_rank(star: DataFrame, location: str, year: int, descending: bool = True) -> DataFrame:
    """One location's places in a year; every other location still counts for the rank."""
    ranked = rank_by_year(star.where(F.col("year") == year), descending)
    return ranked.where(contains_ci(F.col("location_name"), location))


def top_n_ranked(star: DataFrame, n: int, descending: bool = True) -> DataFrame:
    """Rows ranked n or better per indicator and year, ties included."""
    ranked = rank_top(star, ["indicator_sk", "year"], "value", n, "ranking", descending)
    return ranked.select("indicator_sk", "location_name", "report_id", "year", "ranking", "value")


def top_n_overall(star: DataFrame, indicator: str, year: int, n: int = 20, descending: bool = True) -> DataFrame:
    order = F.col("value").desc() if descending else F.col("value").asc()
    rows = filter_ilike(star, indicator).where(F.col("year") == year)
    return rows.orderBy(order, "location_name", "report_id", "indicator_sk").limit(n).select(
        "location_name", "report_id", "value"
    )


def best_years(star: DataFrame, descending: bool = True) -> DataFrame:
    """Per indicator and location the year of the best value; the earlier year wins a tie."""
    order = [-F.col("value") if descending else F.col("value"), F.col("year"), F.col("report_id")]
    return first_per_key(star, ["indicator_sk", "location_name"], order, ["year", "value"])


# --- series ------------------------------------------------------------------------
# A series is one (report, indicator, location): the fact key allows one row per
# year, so a window over it holds at most as many rows as the date dimension.


def _series(*frame: int) -> Window:
    window = Window.partitionBy(*SERIES).orderBy("year")
    return window.rowsBetween(*frame) if frame else window


def year_growth(star: DataFrame) -> DataFrame:
    before = F.lag("value").over(_series())
    return star.select(
        *SERIES,
        "year",
        "value",
        before.alias("previous_value"),
        F.round(F.col("value") - before, 4).alias("difference"),
        F.round((F.col("value") - before) / F.nullif(before, F.lit(0.0)), 6).alias("growth"),
    )


def evolution_last_n(star: DataFrame, n: int) -> DataFrame:
    recent = top_n_per_key(star, SERIES, [F.desc("year")], n, "age")
    return recent.select(*SERIES, "year", "value", "age")


def running_stats(star: DataFrame, width: int = 3) -> DataFrame:
    return star.select(
        *SERIES, "year", F.round(F.avg("value").over(_series(-(width - 1), 0)), 4).alias("running_mean")
    )


def trend(star: DataFrame) -> DataFrame:
    """Least-squares slope per indicator and location over all years."""
    return star.groupBy("indicator_sk", "location_code").agg(
        F.count("*").alias("n_values"), F.round(F.regr_slope("value", "year"), 6).alias("slope")
    )


# --- comparison and aggregates -----------------------------------------------------


def compare_two(star: DataFrame, first: str, second: str) -> DataFrame:
    """Two locations side by side per report, indicator and year; a tie reads as below."""
    one = F.max(F.when(F.col("location_name") == first, F.col("value")))
    two = F.max(F.when(F.col("location_name") == second, F.col("value")))
    paired = (
        star.where(F.col("location_name").isin(first, second))
        .groupBy("report_id", "indicator_sk", "year")
        .agg(one.alias("value_1"), two.alias("value_2"))
        .where(F.col("value_1").isNotNull() & F.col("value_2").isNotNull())
    )
    verdict = F.when(F.col("value_1") > F.col("value_2"), "acima").otherwise("abaixo")
    return paired.withColumn("verdict", verdict)


def agg_range(star: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return (
        star.where(F.col("year").between(first_year, last_year))
        .groupBy("indicator_sk", "location_name")
        .agg(
            F.round(F.avg("value"), 4).alias("mean_value"),
            F.round(F.sum("value"), 2).alias("total_value"),
            F.max("value").alias("max_value"),
            F.min("value").alias("min_value"),
        )
    )


def region_rollup(star: DataFrame) -> DataFrame:
    return star.groupBy("region", "sub_region", "year").agg(
        F.count("*").alias("n_values"), F.round(F.avg("value"), 4).alias("mean_value")
    )


def meta_counts(facts: DataFrame, locations: DataFrame, indicators: DataFrame) -> DataFrame:
    """Records, countries, indicators and reports; distinct reports are pre-aggregated."""
    per_report = facts.groupBy("report_id").agg(F.count("*").alias("n"))
    totals = per_report.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_registos"), F.count("report_id").alias("total_relatorios")
    )
    places = locations.agg(F.countDistinct("name").alias("total_paises"))
    codes = indicators.agg(F.countDistinct("indicator_code").alias("total_indicadores"))
    measures = [
        df.select(F.lit(name).alias("measure"), F.col(name).cast("long").alias("n"))
        for df, name in [
            (totals, "total_registos"),
            (totals, "total_relatorios"),
            (places, "total_paises"),
            (codes, "total_indicadores"),
        ]
    ]
    out = measures[0]
    for m in measures[1:]:
        out = out.unionByName(m)
    return out


def max_year(star: DataFrame) -> DataFrame:
    return star.agg(F.max("year").alias("max_year"))


def distinct_on_code(indicators: DataFrame) -> DataFrame:
    """One row per code, that of the smallest source."""
    return first_per_key(
        indicators, ["indicator_code"], [F.col("source_system")], ["indicator_name", "source_system"]
    )


def semi_by_source(indicators: DataFrame, facts: DataFrame, reports: DataFrame, source: str) -> DataFrame:
    """Indicators with a fact from any report of the source."""
    of_source = reports.where(F.col("source_code") == source).select("report_id")
    used = facts.join(of_source, "report_id", "left_semi").select("indicator_sk").distinct()
    return (
        indicators.join(used, "indicator_sk", "left_semi")
        .withColumn("source_code", F.lit(source))
        .orderBy("indicator_name", "indicator_sk")
    )


def indicators_with_source(indicators: DataFrame, facts: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per indicator in use, with the source of its smallest report."""
    one_report = facts.groupBy("indicator_sk").agg(F.min("report_id").alias("report_id"))
    return (
        indicators.join(one_report, "indicator_sk")
        .join(reports.select("report_id", "source_code"), "report_id", "left")
        .select("indicator_sk", "indicator_code", "indicator_name", "source_system", "source_code")
    )


def reports_with_facts(reports: DataFrame, facts: DataFrame) -> DataFrame:
    return (
        reports.join(facts.select("report_id").distinct(), "report_id", "left_semi")
        .select("report_id", "source_code", "file_name", "publication_date")
        .orderBy(F.desc("report_id"))
    )


def facts_per_report(reports: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("report_id").agg(F.count("*").alias("n"))
    return reports.select("report_id").join(counts, "report_id", "left").select(
        "report_id", F.coalesce("n", F.lit(0)).alias("n_facts")
    )


def project_exclude_keys(df: DataFrame) -> DataFrame:
    """Only columns fit to be shown: no surrogate keys and no ids."""
    return df.select(*[c for c in df.columns if not c.endswith(("_sk", "_id"))])
