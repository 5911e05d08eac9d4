"""Publisher files made from the facts, one per report and year (or per report)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from almanac.plans.fixtures import Tables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
YEARS = list(range(1995, 2002))


def _rows(t: Tables, stored: bool = False) -> DataFrame:
    """Facts as cells; grids read them several times, so they take the stored table."""
    return (t.star_table if stored else t.star).select(
        (F.col("report_id") * 100 + F.col("year") - 1990).cast("int").alias("file_id"),
        "report_id",
        (F.ascii(F.substring("location_code", 2, 1)) * 5 - 325 + F.ascii(F.substring("location_code", 3, 1)) - 64)
        .cast("int")
        .alias("place"),
        "location_code",
        "location_name",
        "region",
        "indicator_code",
        "indicator_name",
        "year",
        "value",
        F.substring("indicator_code", 1, 1).cast("int").alias("slot"),
    )


def nested_json(t: Tables) -> DataFrame:
    """``(file_id, content)``; a document holds at most locations x indicators values."""
    rows = _rows(t)
    leaf = F.when(F.col("location_code") != "NAA", F.col("value"))
    entry = F.struct(F.col("location_code").alias("k"), F.create_map(F.col("year").cast("string"), leaf).alias("v"))
    aggregate = F.struct(F.lit("ADVEC").alias("k"), F.create_map(F.lit("1999"), F.lit(1.0)).alias("v"))
    per_indicator = rows.groupBy("file_id", "indicator_code", "indicator_name").agg(
        F.map_from_entries(F.array_append(F.collect_list(entry), aggregate)).alias("places")
    )
    label = F.struct(F.when(F.col("indicator_code") != "5-LOW", F.col("indicator_name")).alias("label"))
    labels = F.collect_list(F.struct(F.col("indicator_code").alias("k"), label.alias("v")))
    values = F.collect_list(F.struct(F.col("indicator_code").alias("k"), F.col("places").alias("v")))
    gone = F.struct(F.lit("GONE").alias("k"), F.lit(None).cast("map<string,map<string,double>>").alias("v"))
    return per_indicator.groupBy("file_id").agg(
        F.to_json(
            F.struct(
                F.map_from_entries(labels).alias("indicators"),
                F.map_from_entries(F.array_append(values, gone)).alias("values"),
            )
        ).alias("content")
    )


def wide_unnamed(t: Tables) -> DataFrame:
    wide = (
        _rows(t)
        .groupBy("file_id", "year", "location_code", "location_name", "region")
        .pivot("indicator_code", PRIORITIES)
        .agg(F.max(F.col("value").cast("string")))
    )
    shown = F.when(F.col("location_code") == "NBA", F.lower("location_code")).otherwise(F.col("location_code"))
    return wide.select(
        "file_id",
        F.concat(F.col("year").cast("string"), F.lit(".0")).alias("Unnamed: 0"),
        shown.alias("Unnamed: 1"),
        F.col("location_name").alias("Unnamed: 2"),
        F.col("region").alias("Unnamed: 3"),
        *[F.col(f"`{p}`") for p in PRIORITIES[:4]],
        F.when(F.col("location_code") == "NCC", F.lit("n/a")).otherwise(F.col("`5-LOW`")).alias("5-LOW"),
        F.lit("7").alias("RANK 1-URGENT"),
        F.lit("1").alias("x QUARTILE"),
        F.lit("0.5").alias("data.1"),
        F.lit("3").alias("Rank"),
    )


def raw_year_columns(t: Tables) -> DataFrame:
    """One row per report and location, one column per indicator and year."""
    marker = F.when(F.col("year") % 2 == 0, ".raw.").otherwise(".RAW.")
    titled = _rows(t).withColumn(
        "title", F.concat(F.lower("indicator_code"), marker, F.col("year").cast("string"))
    )
    titles = [f"{p.lower()}{'.raw.' if y % 2 == 0 else '.RAW.'}{y}" for p in PRIORITIES for y in YEARS]
    wide = titled.groupBy("report_id", "location_code", "location_name").pivot("title", titles).agg(F.max("value"))
    return wide.select(
        F.col("report_id").alias("file_id"),
        F.col("location_code").alias("iso"),
        F.col("location_name").alias("country"),
        F.lit("c").alias("code"),
        *[F.col(f"`{x}`") for x in titles],
        F.lit(1.0).alias("1-urgent.note.1997"),
    )


def _cells(rows: DataFrame, r: Column, cells: list[tuple[Column, Column]]) -> DataFrame:
    entries = F.array(*[F.struct(c.cast("int").alias("c"), x.cast("string").alias("text")) for c, x in cells])
    return (
        rows.select("file_id", F.lit("Sheet1").alias("sheet"), r.cast("int").alias("r"), F.explode(entries).alias("e"))
        .select("file_id", "sheet", "r", F.col("e.c").alias("c"), F.col("e.text").alias("text"))
        .where(F.col("text").isNotNull())
    )


def _grid(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _texts(pairs: dict[int, str]) -> list[tuple[Column, Column]]:
    return [(F.lit(c), F.lit(x)) for c, x in pairs.items()]


def two_header_rows(t: Tables) -> DataFrame:
    rows = _rows(t, stored=True)
    files = rows.select("file_id").distinct()
    places = rows.select("file_id", "place", "location_code", "location_name", "region").distinct()
    codes = {0: "Economy", 1: "ISO3Code", 2: "region", 8: "population"} | {
        3 + i: (p + "Score" if i == 1 else p + ".score") for i, p in enumerate(PRIORITIES)
    }
    names = {0: "Economy", 8: "People"} | {3 + i: p.lower() for i, p in enumerate(PRIORITIES) if i != 3}
    iso = F.when(F.col("location_code") != "NAB", F.col("location_code"))
    return _grid(
        _cells(files, F.lit(0), _texts({0: "Readiness"})),
        _cells(files, F.lit(3), _texts(names)),
        _cells(files, F.lit(5), _texts(codes)),
        _cells(
            places,
            F.col("place") + 5,
            [
                (F.lit(0), F.col("location_name")),
                (F.lit(1), iso),
                (F.lit(2), F.col("region")),
                (F.lit(8), F.lit("1000")),
            ],
        ),
        _cells(rows, F.col("place") + 5, [(F.col("slot") + 2, F.col("value"))]),
    )


def country_names(t: Tables) -> DataFrame:
    rows = _rows(t, stored=True)
    files = rows.select("file_id").distinct()
    places = rows.select("file_id", "place", "location_name", "region").distinct()
    shown = (
        F.when(F.col("place") == 6, "Atlantis")
        .when(F.col("place") == 7, " ")
        .when(F.col("place") % 5 == 3, F.overlay("location_name", F.lit(""), 3, 1))
        .when(F.col("place") % 5 == 4, F.translate("location_name", "AO", "ÂÓ"))
        .when(F.col("place") % 2 == 0, F.initcap("location_name"))
        .otherwise(F.col("location_name"))
    )
    header = {0: "Country", 1: "Region", 9: "Unnamed: 9"} | {2 + i: p for i, p in enumerate(PRIORITIES)}
    return _grid(
        _cells(files, F.lit(0), _texts({0: "COMPONENT SCORES"})),
        _cells(files, F.lit(1), _texts(header)),
        _cells(
            places, F.col("place") + 1, [(F.lit(0), shown), (F.lit(1), F.col("region")), (F.lit(9), F.lit("5"))]
        ),
        _cells(rows, F.col("place") + 1, [(F.col("slot") + 1, F.col("value"))]),
    )


def offset_header(t: Tables) -> DataFrame:
    rows = _rows(t, stored=True)
    files = rows.select("file_id").distinct()
    places = rows.select("file_id", "place", "location_code", "location_name", "year").distinct()
    header = {0: "Year", 1: "ISO Code 2", 2: "ISO Code 3", 3: "Countries", 4: "Rank", 10: "1-URGENT Rank"} | {
        5 + i: f" {p} " for i, p in enumerate(PRIORITIES)
    }
    iso = F.when(F.col("location_code") != "NAC", F.concat(F.lit(" "), F.col("location_code")))
    return _grid(
        _cells(files, F.lit(0), _texts({0: "Notes"})),
        _cells(files, F.lit(4), _texts(header)),
        _cells(
            places,
            F.col("place") + 4,
            [
                (F.lit(0), F.concat(F.col("year").cast("string"), F.lit(".0"))),
                (F.lit(2), iso),
                (F.lit(3), F.col("location_name")),
                (F.lit(4), F.lit("12")),
                (F.lit(10), F.lit("3")),
            ],
        ),
        _cells(rows, F.col("place") + 4, [(F.col("slot") + 4, F.col("value"))]),
    )


def transposed(t: Tables) -> DataFrame:
    rows = _rows(t, stored=True)
    head = 2 + F.col("file_id") % 3
    files = rows.select("file_id").distinct()
    countries = rows.select("file_id", "place", "location_code").distinct()
    indicators = rows.select("file_id", "slot", "indicator_code", "indicator_name").distinct()
    title = F.when(F.col("file_id") % 17 == 0, "Attrib").otherwise(" Attribute ")
    line = head + F.col("slot") * 2
    shown = F.when(F.col("file_id") % 19 == 0, "Value").otherwise(" Score ")
    labels = [(F.lit(6), F.concat(F.col("indicator_code"), F.lit(" "))), (F.lit(7), F.col("indicator_name"))]
    return _grid(
        _cells(files, F.lit(0), _texts({0: "Dataset"})),
        _cells(files, head, [(F.lit(9), title)]),
        _cells(countries, head, [(F.col("place") + 9, F.col("location_code"))]),
        _cells(indicators, line, [*labels, (F.lit(9), shown)]),
        _cells(indicators, line + 1, [*labels, (F.lit(9), F.lit("Rank"))]),
        _cells(rows, line, [(F.col("place") + 9, F.col("value"))]),
        _cells(rows, line + 1, [(F.col("place") + 9, F.lit("1"))]),
    )
