"""Streams, and reads and writes of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.operators import job, reshape, runlog, warehouse as W
from almanac.plans import layouts as L
from almanac.plans.catalog import query
from almanac.plans.conform import FILE_SQL
from almanac.plans.fixtures import Tables, STATUSES, idiv, pick
from almanac.plans.ops import _FUNNEL
from almanac.session import shared_dir, written
from almanac.sources import fact_store, landing, reading, silver_store, workbook
from almanac.streaming import incremental as S


# --- streams ---------------------------------------------------------------------------------


def _arrivals(df: DataFrame, parts: int, purpose: str) -> DataFrame:
    """``df`` landed as some files and read back as a stream."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.repartition(parts).write.parquet(path)
    return S.read_arrivals(spark, path, df.schema, files_per_batch=parts // 2)


def _collected(stream: DataFrame) -> DataFrame:
    """Result rows of a stream in append mode."""
    path = shared_dir(stream.sparkSession, "result")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    S.run_available(stream, shared_dir(stream.sparkSession, "checkpoint"), keep)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query("inc_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def inc_ingest(t: Tables):
    events = t.raw("events").select("event_id", "user_id", "event_type", "value")
    stream = _arrivals(events, 4, "landing")
    path = shared_dir(t.spark, "ingested")
    S.inc_ingest(stream, path, shared_dir(t.spark, "checkpoint"))
    return S.stored_batches(t.spark, path, events.schema)


# a store for some ten thousand keys a folder, as these tables have
STORE = {"buckets": 4, "bits": 1 << 17}


def _values(t: Tables):
    valid, _ = W.surrogate_lookup(t.silver, t.dim_location, t.dim_indicator, t.dim_date)
    return valid.select(*W.FACT_KEY, "ord", "value")


# What two loads leave: a key that the first one offers keeps its value, all others come with the second.
_TWO_LOADS = """SELECT report_id, location_sk, indicator_sk, date_id,
         coalesce(min_by(value, ord) FILTER (WHERE ord % 3 = 0), min_by(value, ord) + 0.5) AS value
       FROM (SELECT s.report_id, l.location_sk, i.indicator_sk, d.date_id, s.ord, s.value FROM silver s
         JOIN dim_location l ON s.location_code = l.location_code
         JOIN dim_indicator i ON s.source_code = i.source_system AND s.indicator_code = i.indicator_code
         JOIN dim_date d ON s.year = d.year) GROUP BY ALL"""


@query("inc_load_facts", _TWO_LOADS, ["silver", "dim_indicator", "dim_date"])
def inc_load_facts(t: Tables):
    """Two runs of one checkpoint: a third of the rows has arrived for the first, all of them with other values for the second."""
    rows = written(_values(t), "values")
    landing_path, path, checkpoint = (shared_dir(t.spark, x) for x in ("offered", "facts", "checkpoint"))
    rows.where("ord % 3 = 0").write.parquet(f"{landing_path}/a")
    stream = S.read_arrivals(t.spark, f"{landing_path}/*", rows.schema)
    S.inc_load_facts(stream, path, checkpoint, ["ord"], **STORE)
    rows.withColumn("value", F.col("value") + 0.5).write.parquet(f"{landing_path}/b")
    S.inc_load_facts(stream, path, checkpoint, ["ord"], **STORE)
    return fact_store.read_facts(t.spark, path).select(*W.FACT_KEY, "value")


@query("gold_facts", _TWO_LOADS, ["silver", "dim_indicator", "dim_date"])
def gold_facts(t: Tables):
    """The batch sink: three loads, of which the last one offers what is stored and adds nothing."""
    rows, path = written(_values(t), "offered"), shared_dir(t.spark, "facts")
    later = rows.withColumn("value", F.col("value") + 0.5)
    for offered in (rows.where("ord % 3 = 0"), later, later):
        fact_store.load_facts(offered, path, ["ord"], **STORE)
    return fact_store.read_facts(t.spark, path).select(*W.FACT_KEY, "value")


@query(
    "gold_batches",
    """SELECT CAST(0 AS BIGINT) AS batch, count(*) FILTER (WHERE first) AS n_rows FROM (
         SELECT *, EXISTS (SELECT 1 FROM offered o WHERE o.ord % 3 = 0 AND o.report_id = g.report_id AND o.location_sk = g.location_sk
           AND o.indicator_sk = g.indicator_sk AND o.date_id = g.date_id) AS first FROM (SELECT DISTINCT report_id, location_sk, indicator_sk, date_id FROM offered) g)
       UNION ALL SELECT 1, count(*) FILTER (WHERE NOT first) FROM (
         SELECT EXISTS (SELECT 1 FROM offered o WHERE o.ord % 3 = 0 AND o.report_id = g.report_id AND o.location_sk = g.location_sk
           AND o.indicator_sk = g.indicator_sk AND o.date_id = g.date_id) AS first FROM (SELECT DISTINCT report_id, location_sk, indicator_sk, date_id FROM offered) g)
       UNION ALL SELECT 2, 0""",
    ["silver", "dim_indicator", "dim_date"],
    {
        "offered": """SELECT s.report_id, l.location_sk, i.indicator_sk, d.date_id, s.ord FROM silver s
            JOIN dim_location l ON s.location_code = l.location_code
            JOIN dim_indicator i ON s.source_code = i.source_system AND s.indicator_code = i.indicator_code
            JOIN dim_date d ON s.year = d.year"""
    },
)
def gold_batches(t: Tables):
    """How many facts each of three loads added: the last one none."""
    rows, path = written(_values(t), "offered"), shared_dir(t.spark, "facts")
    added = [(i, fact_store.load_facts(o, path, ["ord"], **STORE)) for i, o in enumerate((rows.where("ord % 3 = 0"), rows, rows))]
    return t.spark.createDataFrame(added, "batch long, n_rows long")


@query("stream_dedupe", "SELECT DISTINCT file_id, step FROM logs", ["logs"])
def stream_dedupe(t: Tables):
    logs = t.logs.select("file_id", "step", "log_time")
    return _collected(S.stream_dedupe(_arrivals(logs, 2, "logs"), ["file_id", "step"], "log_time", "400 days")).select(
        "file_id", "step"
    )


def _two_runs(t: Tables, df: DataFrame, first: Column, purpose: str) -> tuple[DataFrame, Callable[[], None]]:
    """A stream of ``df`` of which the rows of ``first`` have landed, and what lands the others."""
    path = shared_dir(t.spark, purpose)
    df.where(first).write.parquet(f"{path}/a")
    return S.read_arrivals(t.spark, f"{path}/*", df.schema), lambda: df.where(~first).write.parquet(f"{path}/b")


def _batches(t: Tables, stream: DataFrame, more: Callable[[], None], keyed: bool = False) -> DataFrame:
    """What a stream returns in update mode, batch by batch, in two runs of one checkpoint; ``more`` lands between them."""
    path, checkpoint = shared_dir(t.spark, "result"), shared_dir(t.spark, "checkpoint")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    S.run_available(stream, checkpoint, keep, "update", keyed)
    more()
    S.run_available(stream, checkpoint, keep, "update", keyed)
    paths = T.StructType([*stream.schema.fields, T.StructField("run", T.LongType())])
    return t.spark.read.schema(paths).option("basePath", path).parquet(f"{path}/run=*")


@query(
    "stream_errors_window",
    "SELECT CAST(time_bucket(INTERVAL 15 MINUTE, log_time) AS VARCHAR) AS window_start, count(*) AS errors FROM logs GROUP BY ALL",
    ["logs"],
)
def stream_errors_window(t: Tables):
    """Two runs in update mode: a window's newest count is the one that holds."""
    logs = t.logs.select("id", "log_time")
    stream, more = _two_runs(t, logs, F.col("id") % 2 == 0, "logs")
    counted = _batches(t, S.stream_errors_window(stream, "log_time", late="400 days"), more)
    newest = counted.groupBy("window_start").agg(F.max_by("errors", "run").alias("errors"))
    return newest.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "errors")


@query(
    "stream_status_latest",
    """SELECT file_id, arg_max(status, (log_time, id)) AS status FROM (
       SELECT file_id, id, log_time, (['pending','processing','bronze','silver','done','failed'])[id % 6 + 1] AS status FROM logs)
       GROUP BY ALL""",
    ["logs"],
)
def stream_status_latest(t: Tables):
    """Two runs in update mode over keyed state; the newest change of a file is its status."""
    moves = t.logs.select("file_id", "id", "log_time", pick(STATUSES, F.col("id") % 6).alias("status"))
    stream, more = _two_runs(t, moves, F.col("id") % 2 == 0, "moves")
    changes = _batches(t, S.stream_status_latest(stream, "file_id", "status", "log_time", "id", "400 days"), more, keyed=True)
    return changes.groupBy("file_id").agg(F.max_by("status", F.struct("log_time", "id")).alias("status"))


def _routed(t: Tables) -> str:
    """Two runs of one checkpoint: files and entries with even numbers have come for the first one, the others for the second."""
    logs = t.logs.select("id", "file_id", "step", "log_time")
    files, more_files = _two_runs(t, t.op_data, F.col("file_id") % 2 == 0, "files")
    entries, more_logs = _two_runs(t, logs, F.col("id") % 2 == 0, "logs")
    path, checkpoint = shared_dir(t.spark, "routed"), shared_dir(t.spark, "checkpoint")
    S.stream_retry_route(files, entries, path, checkpoint)
    more_files()
    more_logs()
    S.stream_retry_route(files, entries, path, checkpoint)
    return path


# An even file is sent back before the odd entries have come.
_SEEN = {
    "seen": """SELECT l.*, d.file_id AS fid FROM logs l JOIN op_data d ON l.file_id = CAST(d.file_id AS VARCHAR)
        WHERE d.pipeline_status = 'failed' AND (d.file_id % 2 = 1 OR l.id % 2 = 0)"""
}


@query(
    "stream_retry_route",
    """SELECT d.file_id, CASE WHEN step IN ('silver', 'gold_validations', 'gold') OR (file_url IS NULL AND step IS NOT NULL)
         THEN 'bronze' ELSE 'pending' END AS pipeline_status
       FROM op_data d LEFT JOIN (SELECT fid, arg_max(step, (log_time, id)) AS step FROM seen GROUP BY 1) l ON l.fid = d.file_id
       WHERE d.pipeline_status = 'failed'""",
    ["op_data", "logs"],
    _SEEN,
)
def stream_retry_route(t: Tables):
    return S.routed_files(t.spark, _routed(t))


@query(
    "stream_retry_logs",
    "SELECT id, file_id, step FROM logs WHERE id NOT IN (SELECT id FROM seen)",
    ["op_data", "logs"],
    _SEEN,
)
def stream_retry_logs(t: Tables):
    """The log entries that a streamed retry keeps."""
    return S.kept_logs(t.spark, _routed(t), t.logs.select("id", "file_id", "step"))


# --- files ------------------------------------------------------------------------------------


@query(
    "scan_bronze",
    "SELECT lang AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, sum(strlen(text) + 1) > 0 AS found FROM documents GROUP BY ALL",
)
def scan_bronze(t: Tables):
    """Objects of a folder for each language: what they hold together, listed without a look at their bytes."""
    path = shared_dir(t.spark, "objects")
    t.raw("documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    listed = landing.scan_bronze(t.spark, path).select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("folder"), "key", "length")
    return listed.groupBy("folder").agg(F.sum("length").alias("bytes"), F.bool_or(F.col("key") != "").alias("found"))


@query(
    "read_csv_quoted",
    """SELECT doc_id, 'x "' || text || '", ' || chr(10) || 'z' AS cell FROM documents""",
)
def read_csv_quoted(t: Tables):
    """Cells with quotes, commas and line breaks."""
    path = shared_dir(t.spark, "csv")
    cell = F.concat(F.lit('x "'), F.col("text"), F.lit('", \nz'))
    t.raw("documents").select("doc_id", cell.alias("cell")).write.csv(path, header=True, quote='"', escape='"')
    return landing.read_csv_infer(t.spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query(
    "read_csv_infer",
    "SELECT report_id, location_code, indicator_code, year, value FROM star",
    ["star"],
)
def read_csv_infer(t: Tables):
    path = shared_dir(t.spark, "csv")
    columns = ["report_id", "location_code", "indicator_code", "year", "value"]
    t.star.select(*columns).write.csv(path, header=True)
    return landing.read_csv_infer(t.spark, path)


@query(
    "read_xml_rows",
    "SELECT CAST(report_id AS BIGINT) AS report_id, location_code, indicator_code, CAST(year AS BIGINT) AS year, value FROM star",
    ["star"],
)
def read_xml_rows(t: Tables):
    path = shared_dir(t.spark, "xml")
    columns = ["report_id", "location_code", "indicator_code", "year", "value"]
    # files of some ten megabytes, as many as the rows take: a landed object is read by one task
    t.star.select(*columns).write.format("xml").options(rowTag="row", maxRecordsPerFile=250_000).save(path)
    broken = t.op_data.select(F.concat(F.lit("<ROWS><row><report_id>"), "report_id", F.lit("</report_id><row></ROWS>")).alias("value"))
    broken.write.mode("append").text(path)
    return landing.read_xml_rows(t.spark, path).where("error is null").select(*columns)


def _book(sheet: str) -> bytes:
    """A one-sheet workbook around the rows of its sheet."""
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", "<Types/>")
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
        )
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def _books_of(cells: DataFrame) -> DataFrame:
    """(file_id, content): a workbook of the cells of each file. A file has one sheet row per country, so it stays small."""

    @F.pandas_udf("binary")
    def book(sheets: pd.Series) -> pd.Series:
        return sheets.map(_book)

    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    number = (F.col("r") + 1).cast("string")
    cell = F.concat(F.lit('<c r="'), F.char(65 + F.col("c")), number, F.lit('" t="inlineStr"><is><t>'), text, F.lit("</t></is></c>"))
    placed = F.array_sort(F.collect_list(F.struct("c", cell.alias("x"))))
    row = F.concat(F.lit('<row r="'), number, F.lit('">'), F.array_join(placed["x"], ""), F.lit("</row>"))
    # the cells of a file meet once, by the file alone
    rows = cells.repartition("file_id").groupBy("file_id", "r").agg(row.alias("x"))
    sheet = F.array_join(F.array_sort(F.collect_list(F.struct("r", "x")))["x"], "")
    return rows.groupBy("file_id").agg(sheet.alias("sheet")).select("file_id", book("sheet").alias("content"))


@query(
    "read_workbook_grid",
    f"""SELECT file_id, 'Sheet1' AS sheet, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, text FROM (
          SELECT file_id, 4 + place AS r, 4 + slot AS c, CAST(value AS VARCHAR) AS text FROM rows
          UNION ALL SELECT DISTINCT file_id, 4 + place, 0, year || '.0' FROM rows
          UNION ALL SELECT DISTINCT file_id, 4 + place, 2, ' ' || location_code FROM rows WHERE location_code <> 'NAC'
          UNION ALL SELECT DISTINCT file_id, 4 + place, 3, location_name FROM rows
          UNION ALL SELECT DISTINCT file_id, 4 + place, 4, '12' FROM rows
          UNION ALL SELECT DISTINCT file_id, 4 + place, 10, '3' FROM rows
          UNION ALL SELECT DISTINCT file_id, 0, 0, 'Notes' FROM rows
          UNION ALL SELECT file_id, 4, c, x FROM (SELECT DISTINCT file_id FROM rows), (VALUES (0, 'Year'), (1, 'ISO Code 2'),
            (2, 'ISO Code 3'), (3, 'Countries'), (4, 'Rank'), (10, '1-URGENT Rank'), (5, ' 1-URGENT '), (6, ' 2-HIGH '),
            (7, ' 3-MEDIUM '), (8, ' 4-NOT SPECIFIED '), (9, ' 5-LOW ')) v(c, x))""",
    ["star"],
    {
        "rows": f"""SELECT *, {FILE_SQL} AS file_id, CAST(indicator_code[1] AS INTEGER) AS slot,
            (ascii(location_code[2]) - 65) * 5 + ascii(location_code[3]) - 64 AS place FROM star"""
    },
)
def read_workbook_grid(t: Tables):
    """Workbooks written from the facts, read back as cells; beside each stands one of which the second half is missing."""
    books = written(_books(t), "books")
    halves = books.select((-F.col("file_id")).alias("file_id"), _half("content").alias("content"))
    return workbook.read_workbook_grid(books.union(halves))


def _books(t: Tables) -> DataFrame:
    return _books_of(L.offset_header(t))


def _half(content: str) -> Column:
    return F.substring(F.col(content), F.lit(1), (F.length(content) / 2).cast("int"))


def _landed(t: Tables) -> DataFrame:
    """An object for each file with rows, of four formats by its number; a third is cut in half, every seventh is of no known format."""
    fid = F.col("file_id")
    listed = F.collect_list(F.struct("location_code", "indicator_code", "year", "value"))
    files = t.silver.groupBy("file_id").agg(F.array_sort(listed).alias("r"))
    cells = lambda x: F.concat_ws(",", x["location_code"], x["indicator_code"], x["year"].cast("string"), x["value"].cast("string"))
    element = lambda x: F.concat(F.lit("<row><code>"), x["location_code"], F.lit("</code><value>"), x["value"].cast("string"), F.lit("</value></row>"))
    text = (
        F.when(fid % 4 == 0, F.to_json(F.struct(F.col("r").alias("rows"))))
        .when(fid % 4 == 1, F.concat(F.lit("<ROWS>"), F.array_join(F.transform("r", element), ""), F.lit("</ROWS>")))
        .otherwise(F.concat(F.lit("code,indicator,year,value\n"), F.array_join(F.transform("r", cells), "\n")))
    )
    texts = files.where(fid % 4 != 3).select("file_id", text.cast("binary").alias("content"))
    objects = texts.union(_books(t).where(fid % 4 == 3))
    third = idiv("file_id", 4) % 3 == 0
    content = (
        F.when(fid % 7 == 0, F.lit(b"no table"))
        .when(third & (fid % 4 == 2), F.lit(b""))
        .when(third, _half("content"))
        .otherwise(F.col("content"))
    )
    kind = pick([".json", ".xml", ".csv", ".xlsx"], fid % 4)
    url = F.when(fid % 7 != 0, F.concat(F.lit("https://data.example.org/f/"), fid.cast("string"), kind))
    return landing.sniff_format(objects.select("file_id", url.alias("url"), content.alias("content")))


@query(
    "read_errors",
    """SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 'Formato ''unknown'' não suportado nas funções de transformação silver.'
         ELSE 'Formato ''' || (['json', 'xml', 'csv', 'excel'])[file_id % 4 + 1] || ''' não pôde ser lido automaticamente: ' ||
           (['JSON mal formado', 'XML mal formado', 'No columns to parse from file', 'BadZipFile: File is not a zip file'])[file_id % 4 + 1] ||
           '. Configure uma função de transformação manual no Painel de Controlo.' END AS error
       FROM (SELECT DISTINCT file_id FROM silver) WHERE file_id % 7 = 0 OR (file_id // 4) % 3 = 0""",
    ["silver"],
)
def read_errors(t: Tables):
    """Which of the landed objects can't be read, and why; the others are read beside them."""
    return reading.read_errors(written(_landed(t), "landed"))


@query(
    "read_objects",
    """SELECT file_id, round(sum(value), 2) AS total, count(*) AS n_rows FROM silver
       WHERE file_id % 4 = 1 AND file_id % 7 <> 0 AND (file_id // 4) % 3 <> 0 GROUP BY file_id
       UNION ALL SELECT DISTINCT file_id, NULL, 0 FROM silver WHERE file_id % 4 = 1 AND file_id % 7 <> 0 AND (file_id // 4) % 3 = 0""",
    ["silver"],
)
def read_objects(t: Tables):
    """The rows of readable XML objects, and their unreadable neighbours with none."""
    fields = T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.DoubleType())])
    found = reading.read_xml(_landed(t).where("format = 'xml'"), fields)
    return found.groupBy("file_id").agg(F.round(F.sum("value"), 2).alias("total"), F.count("value").alias("n_rows"))


def _stored(t: Tables) -> str:
    failed = t.op_data.where(F.col("pipeline_status") == "failed").select("file_id")
    again = t.silver.join(failed, "file_id", "left_semi").withColumn("value", F.col("value") + 1)
    path = shared_dir(t.spark, "silver")
    silver_store.write_silver(t.silver, path)
    silver_store.write_silver(again, path)
    return path


@query(
    "write_silver",
    """SELECT file_id, ord, location_code, indicator_code, year,
         CASE WHEN pipeline_status = 'failed' THEN value + 1 ELSE value END AS value FROM silver JOIN op_data USING (file_id)""",
    ["silver", "op_data"],
)
def write_silver(t: Tables):
    """Two writes: the second replaces the files that had failed and leaves the others."""
    stored = silver_store.scan_silver(t.spark, _stored(t))
    return stored.select("file_id", "ord", "location_code", "indicator_code", "year", "value")


@query(
    "scan_silver",
    "SELECT file_id, count(*) AS n_rows, round(sum(value), 2) AS total FROM silver GROUP BY ALL",
    ["silver"],
)
def scan_silver(t: Tables):
    path = shared_dir(t.spark, "silver")
    silver_store.write_silver(t.silver, path)
    stored = silver_store.scan_silver(t.spark, path)
    return stored.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "write_run_report",
    """SELECT '[' || step_no || '] ' || step || '  Total: ' || n_total || '  OK: ' || n_ok || '  Erro: ' || n_error AS line FROM (
         SELECT 1 AS step_no, 'bronze' AS step, count(*) AS n_total, count(*) FILTER (WHERE NOT b) AS n_ok,
           count(*) FILTER (WHERE b) AS n_error FROM bad
         UNION ALL SELECT 2, 'silver', count(*), count(*) FILTER (WHERE NOT s), count(*) FILTER (WHERE s) FROM bad WHERE NOT b
         UNION ALL SELECT 3, 'gold_validations', count(*), count(*) FILTER (WHERE NOT v), count(*) FILTER (WHERE v)
           FROM bad WHERE NOT b AND NOT s
         UNION ALL SELECT 4, 'gold', count(*), count(*) FILTER (WHERE NOT g), count(*) FILTER (WHERE g)
           FROM bad WHERE NOT b AND NOT s AND NOT v)""",
    ["op_data", "logs"],
    _FUNNEL,
)
def write_run_report(t: Tables):
    path = shared_dir(t.spark, "report")
    funnel = runlog.run_funnel(t.op_data, t.logs, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    silver_store.write_run_report(funnel, path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


# --- the whole job ------------------------------------------------------------------------------


def _job(t: Tables):
    """Files of five sources: three layouts, an extractor of one's own whose codes fail the check, and a source without any.

    Every eleventh object is cut in half, every thirteenth JSON document is empty, and the dates lack 1995.
    """
    reshape.register_extractor("valores_minusculos", _lower_codes)
    n = F.ascii(F.substring("source_code", 5, 1)) - 65
    mapping = t.op_report.select("source_code").distinct().select(
        "source_code",
        pick(["nested_json", "fraser", "country_names", None, None], n).alias("extract_function"),
        pick(["manual", None, "manual", "valores_minusculos", None], n).alias("ai_extract_function"),
    )
    fid, source = F.col("file_id"), idiv("file_id", 100) % 5
    docs = L.nested_json(t).where(source.isin(0, 3)).select("file_id", F.lit("json").alias("format"), F.col("content").cast("binary").alias("content"))
    docs = docs.withColumn("content", F.when(fid % 13 == 0, F.lit(b"{}")).otherwise(F.col("content")))
    grids = L.offset_header(t).where(source == 1).unionByName(L.country_names(t).where(source == 2))
    books = _books_of(grids).withColumn("format", F.lit("excel"))
    objects = written(docs.unionByName(books), "objects")
    objects = objects.withColumn("content", F.when(fid % 11 == 0, _half("content")).otherwise(F.col("content")))
    files = t.op_data.withColumn("pipeline_status", F.when(F.col("pipeline_status") == "done", "done").otherwise("bronze"))
    silver, facts = shared_dir(t.spark, "silver"), shared_dir(t.spark, "facts")
    outcomes, known = [], None
    for _ in range(2):  # the second run finds nothing to do
        now = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
        done = job.run_job(files, t.op_report, objects, mapping, t.dim_location, t.dim_date.where("year <> 1995"), known, silver, facts, now, **STORE)
        files, known = done.files, done.indicators
        outcomes.append(done)
    return outcomes, facts


def _lower_codes(docs: DataFrame) -> DataFrame:
    return reshape.reshape_nested_json(docs).withColumn("location_code", F.lower("location_code"))


_FARED = {
    "expected": f"""SELECT {FILE_SQL} AS file_id, report_id, location_code, indicator_code, value, report_id % 5 AS source,
            CASE WHEN report_id % 5 = 2 THEN 2026 ELSE year END AS loaded_year, year
            FROM star WHERE report_id % 5 IN (0, 3) AND location_code <> 'NAA' OR report_id % 5 = 1 AND location_code <> 'NAC'
              OR report_id % 5 = 2 AND location_name NOT IN ('NATION_5', 'NATION_6')""",
    "fared": f"""SELECT d.file_id, CASE
            WHEN d.pipeline_status = 'done' THEN 'done' WHEN report_id % 5 = 4 THEN 'silver|AI não conseguiu gerar função para ''SRC_E'''
            WHEN file_id % 11 = 0 AND report_id % 5 IN (0, 3) THEN 'silver|Formato ''json'' não pôde ser lido automa'
            WHEN file_id % 11 = 0 THEN 'silver|Formato ''excel'' não pôde ser lido autom'
            WHEN file_id % 13 = 0 AND report_id % 5 IN (0, 3) THEN 'silver|DataFrame vazio após transformação'
            WHEN NOT EXISTS (SELECT 1 FROM expected e WHERE e.file_id = d.file_id) AND report_id % 5 IN (0, 3) THEN 'silver|DataFrame vazio após clean_dataframe'
            WHEN NOT EXISTS (SELECT 1 FROM expected e WHERE e.file_id = d.file_id) THEN 'silver|DataFrame vazio após transformação'
            WHEN report_id % 5 = 3 THEN 'gold_validations|''location_code'' não contém códigos ISO3 '
            WHEN report_id % 5 IN (0, 1) AND file_id % 100 = 5 THEN 'gold|0 linhas válidas de ' || (SELECT count(*) FROM expected e WHERE e.file_id = d.file_id) || ' — location'
            ELSE 'done' END AS fate, d.pipeline_status AS was FROM op_data d""",
}


@query(
    "pipeline_run",
    """SELECT file_id, CASE WHEN fate = 'done' THEN 'done' ELSE 'failed' END AS pipeline_status,
         CASE WHEN fate <> 'done' THEN split_part(fate, '|', 1) END AS step, CASE WHEN fate <> 'done' THEN split_part(fate, '|', 2)[1:30] END AS error
       FROM fared""",
    ["star", "op_data"],
    _FARED,
)
def pipeline_run(t: Tables):
    """How each file fared in the job, and the beginning of its log text."""
    (first, second), _ = _job(t)
    logs = first.logs.unionByName(second.logs).select(F.col("file_id").cast("int").alias("file_id"), "step", F.substring("error_message", 1, 30).alias("error"))
    return second.files.select("file_id", "pipeline_status").join(logs, "file_id", "left")


@query(
    "pipeline_facts",
    """SELECT report_id, location_sk, indicator_code, date_id, min_by(value, (file_id, value)) AS value
       FROM expected e JOIN fared f USING (file_id) JOIN dim_location l USING (location_code) JOIN dim_date d ON d.year = loaded_year
       WHERE fate = 'done' AND was <> 'done' AND loaded_year <> 1995 GROUP BY ALL""",
    ["star", "op_data", "dim_date"],
    _FARED,
)
def pipeline_facts(t: Tables):
    """The facts that two runs of the job leave."""
    (_, second), facts = _job(t)
    codes = second.indicators.select("indicator_sk", "indicator_code")
    return fact_store.read_facts(t.spark, facts).join(codes, "indicator_sk").select("report_id", "location_sk", "indicator_code", "date_id", "value")


@query(
    "run_report",
    """SELECT 1 AS section, file_id, 0 AS place, CASE WHEN coalesce(file_url, '') = '' THEN '  UPLOAD    file_id=' || file_id || '  [ficheiro carregado via upload — ja no MinIO]'
           WHEN eb IS NOT NULL THEN '  ERRO      file_id=' || file_id || '  URL=' || file_url ELSE '  OK        file_id=' || file_id || '  URL=' || file_url END AS line FROM ran
       UNION ALL SELECT 1, file_id, 1, '            Erro: ' || eb FROM ran WHERE coalesce(file_url, '') <> '' AND eb IS NOT NULL
       UNION ALL SELECT 2, file_id, 0, CASE WHEN es IS NOT NULL THEN '  ERRO      file_id=' || file_id
           WHEN pipeline_status IN ('silver', 'done') THEN '  OK        file_id=' || file_id || '  -> ' || file_id || '.parquet'
           WHEN pipeline_status = 'failed' THEN '  FAILED    file_id=' || file_id ELSE '  ' || rpad(pipeline_status, 9, ' ') || ' file_id=' || file_id END
         FROM ran WHERE eb IS NULL OR coalesce(file_url, '') = ''
       UNION ALL SELECT 2, file_id, 1, '            Erro: ' || coalesce(es, '—') FROM ran
         WHERE (eb IS NULL OR coalesce(file_url, '') = '') AND (es IS NOT NULL OR pipeline_status = 'failed')
       UNION ALL SELECT 3, file_id, 0, CASE WHEN ev IS NULL THEN '  OK        file_id=' ELSE '  INVALIDO  file_id=' END || file_id FROM reached
       UNION ALL SELECT 3, file_id, 1, '            Erro: ' || ev FROM reached WHERE ev IS NOT NULL
       UNION ALL SELECT 4, file_id, CAST(2 * n - 2 AS INTEGER), '  ERRO      step=gold  file_id=' || file_id FROM gold
       UNION ALL SELECT 4, file_id, CAST(2 * n - 1 AS INTEGER), '            Erro: ' || coalesce(error_message, '') FROM gold""",
    ["op_data", "logs"],
    {
        "recent": "SELECT id, CAST(file_id AS INTEGER) AS file_id, step, error_message, log_time FROM logs WHERE log_time >= TIMESTAMP '2024-01-05 00:00:00'",
        "newest": "SELECT file_id, step, arg_max(coalesce(error_message, ''), (log_time, id)) AS e FROM recent GROUP BY ALL",
        "ran": """SELECT d.*, b.e AS eb, s.e AS es, v.e AS ev FROM op_data d LEFT JOIN newest b ON b.file_id = d.file_id AND b.step = 'bronze'
            LEFT JOIN newest s ON s.file_id = d.file_id AND s.step = 'silver' LEFT JOIN newest v ON v.file_id = d.file_id AND v.step = 'gold_validations'
            WHERE pipeline_status <> 'pending'""",
        "reached": "SELECT * FROM ran WHERE (eb IS NULL OR coalesce(file_url, '') = '') AND es IS NULL AND pipeline_status IN ('silver', 'done')",
        "gold": "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY log_time, id) AS n FROM recent WHERE step = 'gold'",
    },
)
def run_report(t: Tables):
    """The lines of a run's report, file by file."""
    return runlog.run_report(t.op_data, t.logs, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
