"""The job from landed files to facts: resolve, read, reshape, clean, store, check, key, load, and say how each file fared.

``run_job`` takes the files in status ``bronze``, whatever their sources and layouts, through all steps at once. A file
that fails in a step is one log row with the reason; the others go on. Files are never handled one by one: each extractor in use is
applied once to all of its files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from almanac.operators import quality, reshape, warehouse
from almanac.schemas import LONG_COLUMNS
from almanac.session import written
from almanac.sources import fact_store, reading, silver_store

#: What an extractor takes: JSON documents, cells of workbooks, or rows of delimited text.
INPUTS = {
    "nested_json": "json",
    "two_header_rows": "grid",
    "country_names": "grid",
    "offset_header": "grid",
    "transposed": "grid",
    "wide_unnamed": "table",
    "regex_melt": "table",
}
NO_OBJECT = "Objeto não encontrado"
EMPTY = "DataFrame vazio após transformação"  # fixed value: the text logged for a file without rows
_ROWS = "file_id int, location_code string, indicator_code string, indicator_name string, year int, value double"


@dataclass
class Outcome:
    """Tables after a run: every file with its status, the new log rows, the indicator dimension, and the facts added."""

    files: DataFrame
    logs: DataFrame
    indicators: DataFrame
    n_facts: int


def read_table(objects: DataFrame) -> DataFrame:
    """Delimited text of several files as one wide table of text: ``file_id`` and all titles of their first lines.

    Columns are as many as the files have titles. A cell holds no line break; other quoting is read.
    """
    lines = written(reading.read_csv_lines(objects).where("error is null"), "lines")
    width = lines.agg(F.max(F.size(F.split("line", ",")))).first()[0] or 0
    names = [f"c{i}" for i in range(width)]
    cells = F.from_csv("line", ", ".join(f"{n} string" for n in names)) if names else F.lit(None).cast("struct<c0:string>")
    parsed = lines.select("file_id", "line_no", F.posexplode(F.array(*(cells[n] for n in names or ["c0"]))).alias("c", "text"))
    titles = parsed.where("line_no = 0 and text is not null").select("file_id", "c", F.col("text").alias("title"))
    body = parsed.where("line_no > 0").join(titles, ["file_id", "c"])
    return body.groupBy("file_id", "line_no").pivot("title").agg(F.first("text")).drop("line_no")


def _shaped(name: str, objects: DataFrame, cells: DataFrame | None, countries: DataFrame) -> DataFrame:
    """The long rows of all files of one extractor."""
    kind = INPUTS.get(reshape.PUBLISHER_NAMES.get(name, name), "json")
    transform = reshape.extractor(name)
    if kind == "json":
        rows = transform(objects.select("file_id", reading.text_of().alias("content")))
    elif kind == "table":
        rows = transform(read_table(objects))
    elif transform is reshape.reshape_country_names:
        rows = transform(cells, countries)
    else:
        rows = transform(cells)
    return reshape.conform(rows)


def _failed(files: DataFrame, step: str, reason: Column) -> DataFrame:
    return files.select("file_id", F.lit(step).alias("step"), reason.alias("error_message"))


def extract(files: DataFrame, objects: DataFrame, mapping: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long rows, cleaned, of the files that can be read, and (file_id, step, error_message) of the others.

    ``files`` has ``file_id, source_code``, ``objects`` has ``file_id, format, content``.
    """
    spark = files.sparkSession
    resolved = reshape.resolve_extractor(files.select("file_id", "source_code"), mapping)
    landed = objects.select("file_id", "format", "content", F.lit(True).alias("_there"))
    work = written(resolved.join(landed, "file_id", "left"), "work")
    lost = [_failed(work.where("reason is not null"), "silver", F.col("reason"))]
    ready = work.where("reason is null")
    lost.append(_failed(ready.where("_there is null"), "silver", F.lit(NO_OBJECT)))
    ready = ready.where("_there is not null")
    used = sorted(r["extractor"] for r in ready.select("extractor").distinct().collect())  # at most the registered ones
    kinds = {n: INPUTS.get(reshape.PUBLISHER_NAMES.get(n, n), "json") for n in used}
    # an object is read as what it is; what its extractor can't take has no rows
    errors = written(reading.read_errors(ready.select("file_id", "format", "content")), "read-errors")
    lost.append(_failed(errors, "silver", F.col("error")))
    readable = ready.join(errors.select("file_id"), "file_id", "left_anti")
    cells = None
    if "grid" in kinds.values():
        books = readable.where(F.col("extractor").isin([n for n in used if kinds[n] == "grid"]))
        books = books.where(F.col("format").isin("excel", "zip")).select("file_id", "content", "extractor")
        cells = reading.read_workbooks(books).where("error is null").drop("error").join(books.select("file_id", "extractor"), "file_id")
        cells = written(cells, "cells")
    parts = []
    for name in used:
        mine = readable.where(F.col("extractor") == name)
        own = cells.where(F.col("extractor") == name).drop("extractor") if kinds[name] == "grid" else None
        parts.append(_shaped(name, mine, own, countries))
    shaped = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _ROWS)
    shaped = written(shaped, "shaped")
    without = readable.select("file_id").join(shaped.select("file_id").distinct(), "file_id", "left_anti")
    lost.append(_failed(without, "silver", F.lit(EMPTY)))
    cleaned = written(quality.clean_long(shaped), "cleaned")
    emptied = silver_store.reject_empty(cleaned, shaped.select("file_id").distinct())
    lost.append(_failed(emptied, "silver", F.col("error")))
    return cleaned, written(reduce(DataFrame.unionByName, lost), "lost")


def run_job(
    files: DataFrame, reports: DataFrame, objects: DataFrame, mapping: DataFrame, locations: DataFrame, dates: DataFrame,
    indicators: DataFrame | None, silver_path: str, facts_path: str, now: Column, **store: int,
) -> Outcome:
    """Take all files in status ``bronze`` to ``done`` or ``failed``.

    ``files`` has ``file_id, report_id, pipeline_status``, ``reports`` has ``report_id, source_code``, ``locations`` has
    ``location_code, location_sk, name``. Files of unknown reports wait as they are. Of facts with one key those of the smaller
    ``file_id`` stay, and stored ones before all new ones, so a run that is repeated adds nothing.
    """
    claimed = files.where("pipeline_status = 'bronze'").join(reports.select("report_id", "source_code"), "report_id")
    claimed = written(claimed.select("file_id", "report_id", "source_code"), "claimed")
    if claimed.isEmpty() and indicators is not None:
        none = claimed.select(F.lit("").alias("file_id"), F.lit("").alias("step"), F.lit("").alias("error_message"), now.alias("log_time"))
        return Outcome(files, none.limit(0), indicators, 0)
    cleaned, lost = extract(claimed, objects, mapping, locations.select("name", "location_code"))
    silver_store.write_silver(cleaned.select("file_id", *LONG_COLUMNS), silver_path)
    stored = cleaned.select("file_id").distinct()
    gate = written(quality.dq_gate(cleaned, ["location_code", "indicator_code", "year", "value"], stored), "gate")
    lost = lost.unionByName(_failed(gate.where("not ok"), "gold_validations", F.col("message")))
    passed = cleaned.join(gate.where("ok").select("file_id"), "file_id", "left_semi").join(claimed, "file_id")
    passed = written(passed, "passed")
    added = warehouse.new_indicators(passed, indicators)
    known = written(added if indicators is None else indicators.unionByName(added.select(indicators.columns)), "indicators")
    keyed = written(warehouse.with_surrogates(passed, locations, known, dates), "keyed")
    results = warehouse.load_result_message(keyed)
    lost = written(lost.unionByName(_failed(results.where("n_valid = 0"), "gold", F.col("message"))), "failures")
    n_facts = fact_store.load_facts(keyed, facts_path, ["file_id", "value"], **store)
    bad = lost.select("file_id", F.lit("failed").alias("_s")).distinct()
    fared = claimed.select("file_id").join(bad, "file_id", "left").select("file_id", F.coalesce("_s", F.lit("done")).alias("_s"))
    after = files.join(fared, "file_id", "left").withColumn("pipeline_status", F.coalesce("_s", "pipeline_status")).select(files.columns)
    logs = lost.select(F.col("file_id").cast("string").alias("file_id"), "step", "error_message", now.alias("log_time"))
    return Outcome(written(after, "files"), logs, known, n_facts)
