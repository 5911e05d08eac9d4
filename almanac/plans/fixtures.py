"""Warehouse-shaped tables derived from the given Parquet tables.

``Tables`` holds the Spark side, ``CTES`` the same definitions as SQL for the
oracle. One report stands for fifty customers, one file for a report and
year, one source row for an order, so every table grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.operators import warehouse
from almanac.schemas import FACT_KEY, FIRST_YEAR, LAST_YEAR
from almanac.session import shared_dir, spread, written
from almanac.sources import fact_store

STATUSES = ["pending", "processing", "bronze", "silver", "done", "failed"]
REPORT_STATUSES = ["pending", "processing", "bronze", "done", "failed"]


def pick(values: list, index: Column) -> Column:
    """``values[index]`` as a column expression."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _pick_sql(values: list, index: str) -> str:
    return "(['" + "','".join(values) + f"'])[CAST({index} AS INTEGER) + 1]"


def idiv(column: str, by: int) -> Column:
    return F.floor(F.col(column) / F.lit(by))


_SCHEMAS: dict = {}  # footers are read once per file, not once per query


@dataclass
class Store:
    path: str
    indicators: DataFrame
    star: DataFrame | None = None


_STORES: dict[tuple, Store] = {}  # warehouses of this session


class Tables:
    """Lazily built DataFrames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # --- operational registry -------------------------------------------------

    @cached_property
    def op_report(self) -> DataFrame:
        rid = F.col("report_id")
        return (
            self.raw("customer")
            .select((idiv("c_custkey", 50) + 1).cast("int").alias("report_id"))
            .distinct()
            .select(
                "report_id",
                F.concat(F.lit("report_"), rid.cast("string"), F.lit(".pdf")).alias("file_name"),
                F.concat(F.lit("SRC_"), F.char(65 + rid % 5)).alias("source_code"),
                F.when(
                    rid % 4 != 0,
                    F.concat(F.lit("https://data.example.org/"), rid.cast("string"), F.lit(".pdf")),
                ).alias("report_url"),
                F.date_add(F.lit("2000-01-01").cast("date"), rid % 3650).alias("publication_date"),
                pick(REPORT_STATUSES, idiv("report_id", 5) % 5).alias("pipeline_status"),
            )
        )

    @cached_property
    def op_data(self) -> DataFrame:
        fid = F.col("file_id")
        return (
            self.raw("orders")
            .select(
                (idiv("o_custkey", 50) + 1).cast("int").alias("report_id"),
                F.year("o_orderdate").alias("year"),
            )
            .distinct()
            .select(
                (F.col("report_id") * 100 + F.col("year") - 1990).cast("int").alias("file_id"),
                "report_id",
            )
            .select(
                "file_id",
                "report_id",
                F.when(
                    fid % 4 != 0,
                    F.concat(
                        F.lit("https://data.example.org/f/"),
                        fid.cast("string"),
                        pick([".csv", ".json", ".xlsx"], fid % 3),
                    ),
                ).alias("file_url"),
                pick(STATUSES, idiv("file_id", 7) % 6).alias("pipeline_status"),
            )
        )

    @cached_property
    def logs(self) -> DataFrame:
        """Error log of the tabular path; ``file_id`` is text, as logged."""
        return self.raw("events").where(F.col("event_type") == "error").select(
            F.col("event_id").alias("id"),
            ((idiv("user_id", 5) + 1) * 100 + 5 + F.col("user_id") % 7).cast("string").alias("file_id"),
            pick(["bronze", "silver", "gold_validations", "gold"], F.col("event_id") % 4).alias("step"),
            F.col("props").alias("error_message"),
            F.col("ts").alias("log_time"),
        )

    @cached_property
    def report_logs(self) -> DataFrame:
        rid = (idiv("user_id", 5) + 1).cast("int")
        return self.raw("events").where(F.col("event_type") == "view").select(
            F.col("event_id").alias("id"),
            rid.alias("report_id"),
            F.concat(F.lit("report_"), rid.cast("string"), F.lit(".pdf")).alias("file_name"),
            pick(["bronze", "silver"], F.col("event_id") % 2).alias("step"),
            F.col("props").alias("error_message"),
            F.col("ts").alias("log_time"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        """Extractor mapping: one row per source code of the reports."""
        n = F.ascii(F.substring("source_code", 5, 1)) - 65
        return (
            self.op_report.select("source_code")
            .distinct()
            .select(
                "source_code",
                pick(["nested_json", None, "regex_melt", "offset_header", None], n).alias("extract_function"),
                pick(["manual", "manual", None, "valores_1a2b", None], n).alias("ai_extract_function"),
                pick(["year in rows", None, None, "codes in row 3", None], n).alias("generation_hint"),
            )
        )

    # --- conformed rows and the star -------------------------------------------

    @cached_property
    def dim_location(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        reference = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            (F.col("n_nationkey") + 1).cast("int").alias("location_sk"),
            F.concat(
                F.lit("N"), F.char(65 + idiv("n_nationkey", 5)), F.char(65 + F.col("n_nationkey") % 5)
            ).alias("location_code"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("region"),
            F.when(F.col("n_regionkey") == 4, "not found")
            .otherwise(F.concat_ws(" ", "r_name", F.char(65 + F.col("n_nationkey") % 2)))
            .alias("sub_region"),
        )
        return warehouse.seed_dim_location(reference)

    @cached_property
    def dim_date(self) -> DataFrame:
        return warehouse.seed_dim_date(self.spark, FIRST_YEAR, LAST_YEAR)

    @cached_property
    def silver(self) -> DataFrame:
        """One conformed row per order."""
        rid = (idiv("o_custkey", 50) + 1).cast("int")
        orders = self.raw("orders").select(
            rid.alias("report_id"),
            "o_custkey",
            F.col("o_orderkey").alias("ord"),
            F.col("o_orderpriority").alias("indicator_code"),
            F.lower("o_orderpriority").alias("indicator_name"),
            F.year("o_orderdate").alias("year"),
            F.col("o_totalprice").alias("value"),
        )
        customer = self.raw("customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("location_sk"))
        places = self.dim_location.select("location_sk", "location_code")
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(places, "location_sk")
            .select(
                (F.col("report_id") * 100 + F.col("year") - 1990).cast("int").alias("file_id"),
                "report_id",
                F.concat(F.lit("SRC_"), F.char(65 + F.col("report_id") % 5)).alias("source_code"),
                "ord",
                "location_code",
                "indicator_code",
                "indicator_name",
                "year",
                "value",
            )
        )

    @cached_property
    def stored(self) -> Store:
        """The warehouse on disk: facts in a ``fact_store`` and the indicator dimension.

        It is loaded once for a session and state of the source files, as a warehouse is, and read by every query after that.
        """
        files = [f"{self.sf_dir}/{n}.parquet" for n in ("orders", "customer", "nation", "region")]
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files)
        state = found.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first()
        key = (self.spark.sparkContext.applicationId, self.sf_dir, tuple(state))
        if key not in _STORES:
            indicators = written(self.built_indicators, "dim-indicator")
            path = shared_dir(self.spark, "warehouse")
            rows, _ = warehouse.surrogate_lookup(self.silver, self.dim_location, indicators, self.dim_date)
            # a bucket for some hundred thousand keys of a date, a filter of sixteen bits a key
            buckets = max(1, round(state[1] / (256 << 20)))
            fact_store.load_facts(rows, path, ["ord"], buckets=buckets)
            _STORES[key] = Store(path, indicators)
        return _STORES[key]

    @cached_property
    def built_indicators(self) -> DataFrame:
        return warehouse.new_indicators(self.silver)

    @cached_property
    def dim_indicator(self) -> DataFrame:
        return self.stored.indicators

    @cached_property
    def dim_report(self) -> DataFrame:
        return warehouse.distinct_join_load(self.op_report, self.op_data)

    @cached_property
    def built_facts(self) -> DataFrame:
        valid, _ = warehouse.surrogate_lookup(
            self.silver, self.dim_location, self.dim_indicator, self.dim_date
        )
        return warehouse.first_write_wins(valid, ["ord"])

    @cached_property
    def facts(self) -> DataFrame:
        """The stored facts; a condition on the date reads the folders of that date."""
        return fact_store.read_facts(self.spark, self.stored.path).select(*FACT_KEY, "value")

    @cached_property
    def star(self) -> DataFrame:
        return warehouse.star_rows(self.facts, self.dim_indicator, self.dim_location, self.dim_date)

    @cached_property
    def star_table(self) -> DataFrame:
        """The star rows as a table, for jobs that read them more than once."""
        if self.stored.star is None:
            self.stored.star = written(self.star, "star")
        return self.stored.star

    @cached_property
    def flat(self) -> DataFrame:
        return warehouse.star_join(self.facts, self.dim_indicator, self.dim_location, self.dim_date)

    @cached_property
    def dirty(self) -> DataFrame:
        """Conformed rows as text with the usual defects: copies, gaps, bad codes, bad numbers."""
        base = self.raw("orders").select(F.col("o_orderkey").alias("ord"), "o_orderstatus")
        rows = self.silver.join(base, "ord")
        copies = F.when(F.col("o_orderstatus") == "P", 2).otherwise(1)
        gone = F.lit(None).cast("string")
        return rows.select(
            "file_id",
            "ord",
            F.when(F.col("ord") % 53 == 0, gone)
            .when(F.col("file_id") % 9 == 0, F.lower("location_code"))
            .otherwise(F.col("location_code"))
            .alias("location_code"),
            F.when((F.col("ord") % 59 == 0) & (F.col("file_id") % 5 == 1), gone)
            .otherwise(F.col("indicator_code"))
            .alias("indicator_code"),
            F.when(F.col("ord") % 3 == 0, gone).otherwise(F.col("indicator_name")).alias("indicator_name"),
            F.when((F.col("ord") % 61 == 0) & (F.col("file_id") % 5 == 2), F.lit("n/d"))
            .when((F.col("ord") % 67 == 0) & (F.col("file_id") % 5 == 3), gone)
            .otherwise(F.col("year").cast("string"))
            .alias("year"),
            F.when((F.col("file_id") % 11 == 0) | (F.col("ord") % 71 == 0), F.lit("n/a"))
            .otherwise(F.col("value").cast("string"))
            .alias("value"),
            F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
        )

    # --- documents ---------------------------------------------------------------

    @cached_property
    def doc_pages(self) -> DataFrame:
        """One page per non-empty line of a document; pages count from 0."""
        blocks = spread(self.raw("documents"), "doc_id").select(
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"),
            F.posexplode(F.split("text", "\n")).alias("page", "text"),
        )
        return blocks.where(F.trim("text") != "")

    @cached_property
    def questions(self) -> DataFrame:
        """One question per order: a template filled with its indicator, nation and year."""
        customer = self.raw("customer").select("c_custkey", "c_nationkey")
        places = self.dim_location.select("location_sk", F.col("name"))
        rows = (
            spread(self.raw("orders"), "o_orderkey")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(places, F.col("location_sk") == F.col("c_nationkey") + 1)
        )
        year = F.year("o_orderdate")
        template = pick(QUESTION_TEMPLATES, F.col("o_orderkey") % len(QUESTION_TEMPLATES))
        other = F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + 7) % 25).cast("string"))
        text = template
        for mark, value in [
            ("{i}", F.lower("o_orderpriority")),
            ("{c}", F.col("name")),
            ("{d}", other),
            ("{y}", year.cast("string")),
            ("{z}", (year + 2).cast("string")),
            ("{n}", (F.col("o_orderkey") % 9 + 1).cast("string")),
        ]:
            text = F.replace(text, F.lit(mark), value)
        return rows.select(F.col("o_orderkey").alias("q_id"), text.alias("question"))


QUESTION_TEMPLATES = [
    "Qual o valor de {i} em {c} no ano {y}?",
    "Qual foi o {i} de {c}?",
    "Quantos registos existem?",
    "Quantos indicadores tem a base?",
    "Que países estão na base?",
    "Tem dados de {i} para {c} em {y}?",
    "Existem dados de {i} para {c}?",
    "{c} ficou acima ou abaixo de {d} em {i} no ano {y}?",
    "Top {n} de {i} em {y}",
    "Quais os piores em {i} em {y}?",
    "Compara {c} com {d} em {i} entre {y} e {z}",
    "Em que lugar ficou {c} em {i} no ano {y}?",
    "Que país teve o mais alto {i} em {y}?",
    "Valor de {i} em {y} ou {z}",
    "Valor de {i} em {c}, ou acima de 100",
    'Contexto anterior: "Qual o valor de {i} em {c} no ano {y}?". Para o mesmo indicador, qual o valor de {d}?',
    'Contexto anterior: "Lista indicadores de {c} em {y}". Qual o valor de {i} de {d}?',
    "Qual a evolução de {i} em {c}?",
    "Mostra a lista indicadores",
    "Valor em {c} no ano {y}",
]


def _questions_sql() -> str:
    arms = "\n".join(
        f"WHEN {n} THEN '" + t.replace("'", "''") + "'" for n, t in enumerate(QUESTION_TEMPLATES)
    )
    return f"""
SELECT o_orderkey AS q_id,
  replace(replace(replace(replace(replace(replace(
    CASE o_orderkey % {len(QUESTION_TEMPLATES)} {arms} END,
    '{{i}}', lower(o_orderpriority)), '{{c}}', name),
    '{{d}}', 'NATION_' || ((c_nationkey + 7) % 25)), '{{y}}', CAST(year(o_orderdate) AS VARCHAR)),
    '{{z}}', CAST(year(o_orderdate) + 2 AS VARCHAR)), '{{n}}', CAST(o_orderkey % 9 + 1 AS VARCHAR)) AS question
FROM orders JOIN customer ON o_custkey = c_custkey JOIN dim_location ON location_sk = c_nationkey + 1"""


# name -> (names of the definitions it needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "op_report": ([], f"""
SELECT report_id, 'report_' || report_id || '.pdf' AS file_name,
  'SRC_' || chr(65 + report_id % 5) AS source_code,
  CASE WHEN report_id % 4 <> 0 THEN 'https://data.example.org/' || report_id || '.pdf' END AS report_url,
  CAST(DATE '2000-01-01' + report_id % 3650 AS DATE) AS publication_date,
  {_pick_sql(REPORT_STATUSES, "(report_id // 5) % 5")} AS pipeline_status
FROM (SELECT DISTINCT CAST(c_custkey // 50 + 1 AS INTEGER) AS report_id FROM customer)"""),
    "op_data": ([], f"""
SELECT file_id, report_id,
  CASE WHEN file_id % 4 <> 0 THEN 'https://data.example.org/f/' || file_id ||
    {_pick_sql([".csv", ".json", ".xlsx"], "file_id % 3")} END AS file_url,
  {_pick_sql(STATUSES, "(file_id // 7) % 6")} AS pipeline_status
FROM (SELECT DISTINCT CAST((o_custkey // 50 + 1) * 100 + year(o_orderdate) - 1990 AS INTEGER) AS file_id,
             CAST(o_custkey // 50 + 1 AS INTEGER) AS report_id FROM orders)"""),
    "logs": ([], f"""
SELECT event_id AS id, CAST((user_id // 5 + 1) * 100 + 5 + user_id % 7 AS VARCHAR) AS file_id,
  {_pick_sql(["bronze", "silver", "gold_validations", "gold"], "event_id % 4")} AS step,
  props AS error_message, ts AS log_time
FROM events WHERE event_type = 'error'"""),
    "report_logs": ([], f"""
SELECT event_id AS id, CAST(user_id // 5 + 1 AS INTEGER) AS report_id,
  'report_' || (user_id // 5 + 1) || '.pdf' AS file_name,
  {_pick_sql(["bronze", "silver"], "event_id % 2")} AS step, props AS error_message, ts AS log_time
FROM events WHERE event_type = 'view'"""),
    "mapping": (["op_report"], """
SELECT source_code,
  CASE source_code WHEN 'SRC_A' THEN 'nested_json' WHEN 'SRC_C' THEN 'regex_melt'
    WHEN 'SRC_D' THEN 'offset_header' END AS extract_function,
  CASE source_code WHEN 'SRC_A' THEN 'manual' WHEN 'SRC_B' THEN 'manual'
    WHEN 'SRC_D' THEN 'valores_1a2b' END AS ai_extract_function,
  CASE source_code WHEN 'SRC_A' THEN 'year in rows' WHEN 'SRC_D' THEN 'codes in row 3' END AS generation_hint
FROM (SELECT DISTINCT source_code FROM op_report)"""),
    "dim_location": ([], """
SELECT CAST(n_nationkey + 1 AS INTEGER) AS location_sk,
  'N' || chr(65 + n_nationkey // 5) || chr(65 + n_nationkey % 5) AS location_code, n_name AS name,
  r_name AS region, CASE WHEN n_regionkey <> 4 THEN r_name || ' ' || chr(65 + n_nationkey % 2) END AS sub_region
FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "dim_date": ([], f"""
SELECT CAST(y - {FIRST_YEAR - 1} AS INTEGER) AS date_id, CAST(y AS INTEGER) AS year
FROM range({FIRST_YEAR}, {LAST_YEAR + 1}) AS t(y)"""),
    "silver": (["dim_location"], """
SELECT CAST((o_custkey // 50 + 1) * 100 + year(o_orderdate) - 1990 AS INTEGER) AS file_id,
  CAST(o_custkey // 50 + 1 AS INTEGER) AS report_id,
  'SRC_' || chr(65 + CAST((o_custkey // 50 + 1) % 5 AS INTEGER)) AS source_code,
  o_orderkey AS ord, location_code, o_orderpriority AS indicator_code,
  lower(o_orderpriority) AS indicator_name, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN dim_location ON location_sk = c_nationkey + 1"""),
    "dim_indicator": (["silver"], """
SELECT CAST(row_number() OVER (ORDER BY md5(source_system || '|' || indicator_code)) AS INTEGER) AS indicator_sk,
  source_system, indicator_code, indicator_name
FROM (SELECT source_code AS source_system, indicator_code, min(indicator_name) AS indicator_name
      FROM silver GROUP BY ALL)"""),
    "dim_report": (["op_report", "op_data"], """
SELECT DISTINCT r.report_id, r.source_code, r.source_code AS source_name, r.report_url, r.publication_date
FROM op_report r JOIN op_data d ON d.report_id = r.report_id WHERE d.pipeline_status IN ('silver', 'done')"""),
    "facts": (["silver", "dim_location", "dim_indicator", "dim_date"], """
SELECT s.report_id, l.location_sk, i.indicator_sk, d.date_id, arg_min(s.value, s.ord) AS value
FROM silver s JOIN dim_location l ON s.location_code = l.location_code
JOIN dim_indicator i ON s.source_code = i.source_system AND s.indicator_code = i.indicator_code
JOIN dim_date d ON s.year = d.year GROUP BY ALL"""),
    "star": (["facts", "dim_location", "dim_indicator", "dim_date"], """
SELECT f.report_id, f.indicator_sk, i.source_system, i.indicator_code, i.indicator_name,
  l.location_code, l.name AS location_name, l.region, l.sub_region, d.year, f.value
FROM facts f JOIN dim_indicator i ON f.indicator_sk = i.indicator_sk
JOIN dim_location l ON f.location_sk = l.location_sk JOIN dim_date d ON f.date_id = d.date_id"""),
    "flat": (["star"], "SELECT indicator_name, location_name, value, year FROM star"),
    "dirty": (["silver"], """
SELECT file_id, ord,
  CASE WHEN ord % 53 = 0 THEN NULL WHEN file_id % 9 = 0 THEN lower(location_code) ELSE location_code END AS location_code,
  CASE WHEN ord % 59 = 0 AND file_id % 5 = 1 THEN NULL ELSE indicator_code END AS indicator_code,
  CASE WHEN ord % 3 = 0 THEN NULL ELSE indicator_name END AS indicator_name,
  CASE WHEN ord % 61 = 0 AND file_id % 5 = 2 THEN 'n/d' WHEN ord % 67 = 0 AND file_id % 5 = 3 THEN NULL
    ELSE CAST(year AS VARCHAR) END AS year,
  CASE WHEN file_id % 11 = 0 OR ord % 71 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
  unnest(range(1, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END)) AS copy
FROM silver JOIN orders ON ord = o_orderkey"""),
    "doc_pages": ([], """
SELECT source, CAST(page - 1 AS INTEGER) AS page, text
FROM (SELECT source || '/' || doc_id AS source, unnest(string_split(text, chr(10))) AS text,
             generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
WHERE trim(text) <> ''"""),
    "questions": (["dim_location"], _questions_sql()),
}


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the CTEs it names and those they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
