"""Registry, logs, ingestion and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import casts, text as X
from almanac.operators import registry as G, runlog as L, warehouse as W
from almanac.plans.catalog import query
from almanac.plans.fixtures import Tables, idiv, pick
from almanac.session import spread

LEGACY = ["PENDING", "VALIDATED", "PROCESSING", "BRONZE_OK", "SILVER_OK", "DONE", "FAILED", "done"]
LEGACY_SQL = "(['" + "','".join(LEGACY) + "'])[file_id % 8 + 1]"


# --- work lists and state ------------------------------------------------------------------


@query(
    "scan_pending",
    "SELECT file_id, report_id, file_url FROM op_data WHERE pipeline_status = 'pending'",
    ["op_data"],
)
def scan_pending(t: Tables):
    from almanac.sources.landing import scan_pending as scan

    return scan(t.op_data, "file_id").select("file_id", "report_id", "file_url")


@query(
    "claim_pending",
    """SELECT file_id, CASE WHEN pipeline_status = 'pending' THEN 'processing' ELSE pipeline_status END AS pipeline_status
       FROM op_data""",
    ["op_data"],
)
def claim_pending(t: Tables):
    from almanac.sources.landing import claim

    return claim(t.op_data, "pending").select("file_id", "pipeline_status")


@query(
    "status_normalise",
    f"""SELECT file_id, CASE s WHEN 'PENDING' THEN 'pending' WHEN 'VALIDATED' THEN 'pending'
          WHEN 'PROCESSING' THEN 'pending' WHEN 'BRONZE_OK' THEN 'bronze' WHEN 'SILVER_OK' THEN 'silver'
          WHEN 'DONE' THEN 'done' WHEN 'FAILED' THEN 'failed' ELSE s END AS file_status,
        CASE s WHEN 'BRONZE_OK' THEN 'pending' WHEN 'PENDING' THEN 'pending' WHEN 'VALIDATED' THEN 'pending'
          WHEN 'PROCESSING' THEN 'processing' WHEN 'SILVER_OK' THEN 'silver' WHEN 'DONE' THEN 'done'
          WHEN 'FAILED' THEN 'failed' ELSE s END AS report_status
        FROM (SELECT file_id, {LEGACY_SQL} AS s FROM op_data)""",
    ["op_data"],
)
def status_normalise(t: Tables):
    old = pick(LEGACY, F.col("file_id") % 8)
    return t.op_data.select(
        "file_id",
        G.crash_recover(G.status_normalise(old)).alias("file_status"),
        G.status_normalise(old, G.REPORT_RUN_STATUS_NAMES).alias("report_status"),
    )


@query(
    "crash_recover",
    """SELECT file_id, CASE WHEN pipeline_status = 'processing' THEN 'pending' ELSE pipeline_status END AS pipeline_status
       FROM op_data""",
    ["op_data"],
)
def crash_recover(t: Tables):
    return t.op_data.select("file_id", G.crash_recover(F.col("pipeline_status")).alias("pipeline_status"))


@query(
    "case_flags",
    """SELECT r.report_id, r.pipeline_status,
         r.pipeline_status IN ('pending', 'failed') AND NOT coalesce(d.started, false) AS can_delete,
         r.pipeline_status IN ('bronze', 'done') AS url_locked
       FROM op_report r LEFT JOIN (SELECT report_id, bool_or(pipeline_status NOT IN ('pending', 'failed')) AS started
         FROM op_data GROUP BY ALL) d USING (report_id)""",
    ["op_report", "op_data"],
)
def case_flags(t: Tables):
    return G.case_flags(t.op_report, t.op_data)


@query(
    "join_file_report",
    """SELECT d.report_id, file_id, source_code FROM op_data d JOIN op_report r USING (report_id)
       WHERE d.pipeline_status = 'bronze'""",
    ["op_report", "op_data"],
)
def join_file_report(t: Tables):
    return G.join_file_report(t.op_data, t.op_report, "bronze")


@query(
    "left_join_report",
    """SELECT d.file_id, d.report_id, d.file_url, r.source_code, r.file_name AS report_name,
         d.pipeline_status IN ('pending', 'failed') AS can_delete
       FROM op_data d LEFT JOIN op_report r ON r.report_id = d.report_id""",
    ["op_report", "op_data"],
)
def left_join_report(t: Tables):
    return G.left_join_report(t.op_data, t.op_report)


@query("distinct_sources", "SELECT DISTINCT source_code FROM op_report", ["op_report"])
def distinct_sources(t: Tables):
    return G.distinct_sources(t.op_report)


# --- payloads ----------------------------------------------------------------------------------

_PAYLOAD = {
    "payload": """SELECT c_custkey AS index, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS source_code,
        CASE WHEN c_custkey % 13 <> 0 THEN c_name || '.pdf' END AS file_name,
        CASE WHEN c_custkey % 5 <> 0 THEN 'https://data.example.org/' || (c_custkey // 2) || '.pdf' END AS url,
        CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN '15/03/2001' WHEN c_custkey % 4 = 1
          THEN '2001-03-15' WHEN c_custkey % 4 = 2 THEN '5-3-2001' ELSE 'March 2001' END AS raw_date
        FROM customer""",
    "dated": """SELECT *, CASE raw_date WHEN '15/03/2001' THEN DATE '2001-03-15' WHEN '2001-03-15' THEN DATE '2001-03-15'
        WHEN '5-3-2001' THEN DATE '2001-03-05' END AS day FROM payload""",
    "checked": """SELECT *, CASE WHEN raw_date <> '' AND day IS NULL THEN 'Formato de data não reconhecido: ' || raw_date
        WHEN source_code = '' OR file_name IS NULL OR day IS NULL
        THEN 'source_code, file_name e publication_date são obrigatórios' END AS problem FROM dated""",
    "judged": """SELECT *, coalesce(problem, CASE WHEN url IN (SELECT report_url FROM op_report WHERE report_url IS NOT NULL)
          OR index > min(CASE WHEN problem IS NULL THEN index END) OVER (PARTITION BY url)
          AND url IS NOT NULL THEN 'URL duplicado' END) AS error FROM checked""",
}


def _payload(t: Tables):
    key = F.col("c_custkey")
    return t.raw("customer").select(
        key.alias("index"),
        F.when(key % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("source_code"),
        F.when(key % 13 != 0, F.concat("c_name", F.lit(".pdf"))).alias("file_name"),
        F.when(
            key % 5 != 0,
            F.concat(F.lit("https://data.example.org/"), idiv("c_custkey", 2).cast("string"), F.lit(".pdf")),
        )
        .otherwise("")
        .alias("report_url"),
        F.when(key % 17 == 0, "")
        .otherwise(pick(["15/03/2001", "2001-03-15", "5-3-2001", "March 2001"], key % 4))
        .alias("publication_date"),
    )


@query(
    "batch_ingest_split",
    """SELECT index, error IS NULL AS accepted, coalesce(file_name, '?') AS file_name, error,
       CASE WHEN error IS NULL THEN day END AS publication_date FROM judged""",
    ["op_report"],
    _PAYLOAD,
)
def batch_ingest_split(t: Tables):
    accepted, errors = G.batch_ingest_split(_payload(t), t.op_report)
    good = accepted.select(
        "index", F.lit(True).alias("accepted"), "file_name", F.lit(None).cast("string").alias("error"), "publication_date"
    )
    bad = errors.select(
        "index", F.lit(False).alias("accepted"), "file_name", "error", F.lit(None).cast("date").alias("publication_date")
    )
    return good.unionByName(bad)


@query(
    "batch_links_split",
    """SELECT index, url, CASE WHEN url IN (SELECT report_url FROM op_report WHERE report_url IS NOT NULL)
         OR index > min(index) OVER (PARTITION BY url) THEN 'URL duplicado' END AS error
       FROM (SELECT c_custkey AS index, 'https://data.example.org/' || (c_custkey // 3) || '.pdf' AS url FROM customer)""",
    ["op_report"],
)
def batch_links_split(t: Tables):
    links = t.raw("customer").select(
        F.col("c_custkey").alias("index"),
        F.concat(F.lit("https://data.example.org/"), idiv("c_custkey", 3).cast("string"), F.lit(".pdf")).alias("url"),
    )
    return G.batch_links_split(links, t.op_report)


_FILES = {
    "offered": """SELECT o_orderkey AS index, CASE WHEN o_orderkey % 10 = 0 THEN NULL
        ELSE CAST(o_custkey // 45 + 1 AS INTEGER) END AS report_id FROM orders"""
}


def _offered(t: Tables):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("index"),
        F.when(F.col("o_orderkey") % 10 != 0, (idiv("o_custkey", 45) + 1).cast("int")).alias("report_id"),
        F.lit("").alias("file_url"),
    )


@query(
    "file_batch_split",
    """SELECT index, report_id, CAST(NULL AS VARCHAR) AS file_url, CASE WHEN report_id IS NULL THEN 'report_id é obrigatório'
         WHEN report_id NOT IN (SELECT report_id FROM op_report) THEN 'report_id ' || report_id || ' não existe' END AS error
       FROM offered""",
    ["op_report"],
    _FILES,
)
def file_batch_split(t: Tables):
    return G.file_batch_split(_offered(t), t.op_report)


@query(
    "fk_check",
    "SELECT index, report_id FROM offered WHERE report_id IS NULL OR report_id NOT IN (SELECT report_id FROM op_report)",
    ["op_report"],
    _FILES,
)
def fk_check(t: Tables):
    return G.fk_check(_offered(t), t.op_report).select("index", "report_id")


@query(
    "check_duplicate",
    """SELECT value, r.report_id IS NOT NULL AS "exists", r.report_id
       FROM (SELECT 'report_' || c_custkey || '.pdf' AS value FROM customer) LEFT JOIN op_report r ON r.file_name = value""",
    ["op_report"],
)
def check_duplicate(t: Tables):
    names = t.raw("customer").select(
        F.concat(F.lit("report_"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("value")
    )
    return G.check_duplicate(names, t.op_report, "file_name")


@query(
    "list_objects_join",
    """SELECT report_id, file_name, pipeline_status IN ('bronze', 'done') AS present FROM op_report""",
    ["op_report"],
)
def list_objects_join(t: Tables):
    from almanac.sources.landing import list_objects_join as join

    listing = t.op_report.where(F.col("pipeline_status").isin("bronze", "done")).select(F.col("file_name").alias("key"))
    present, missing = join(t.op_report, listing)
    return present.select("report_id", "file_name", F.lit(True).alias("present")).unionByName(
        missing.select("report_id", "file_name", F.lit(False).alias("present"))
    )


@query(
    "anti_existing",
    """SELECT file_id, report_id FROM op_data WHERE report_id NOT IN (
       SELECT report_id FROM op_report WHERE pipeline_status = 'done')""",
    ["op_report", "op_data"],
)
def anti_existing(t: Tables):
    done = t.op_report.where(F.col("pipeline_status") == "done")
    return G.anti_existing(t.op_data.select("file_id", "report_id"), done, ["report_id"])


# --- edits ---------------------------------------------------------------------------------------


@query(
    "upsert_update",
    """SELECT coalesce(n.report_id, o.report_id) AS report_id,
         CASE WHEN n.report_id IS NOT NULL THEN n.source_code ELSE o.source_code END AS source_code,
         coalesce(n.file_name, o.file_name) AS file_name
       FROM (SELECT * FROM op_report WHERE report_id % 3 <> 0) o FULL JOIN (
         SELECT report_id, lower(source_code) AS source_code,
           CASE WHEN report_id % 4 <> 0 THEN 'new_' || file_name END AS file_name
         FROM op_report WHERE report_id % 2 = 0 OR report_id % 3 = 0) n ON n.report_id = o.report_id""",
    ["op_report"],
)
def upsert_update(t: Tables):
    columns = ["report_id", "source_code", "file_name"]
    old = t.op_report.where(F.col("report_id") % 3 != 0).select(*columns)
    new = t.op_report.where((F.col("report_id") % 2 == 0) | (F.col("report_id") % 3 == 0)).select(
        "report_id",
        F.lower("source_code").alias("source_code"),
        F.when(F.col("report_id") % 4 != 0, F.concat(F.lit("new_"), F.col("file_name"))).alias("file_name"),
    )
    return W.upsert_update(old, new, "report_id", keep_old_when_null=("file_name",))


@query(
    "patch_coalesce",
    """SELECT file_id, CASE WHEN pipeline_status = 'failed' AND file_id % 2 = 0 THEN report_id + 1 ELSE report_id END AS report_id,
         CASE WHEN pipeline_status <> 'failed' THEN file_url WHEN file_id % 5 <> 0 THEN 'patched' END AS file_url,
         CASE WHEN pipeline_status = 'failed' THEN 'pending' ELSE pipeline_status END AS pipeline_status FROM op_data""",
    ["op_data"],
)
def patch_coalesce(t: Tables):
    patches = t.op_data.where(F.col("pipeline_status") == "failed").select(
        "file_id",
        F.when(F.col("file_id") % 2 == 0, F.col("report_id") + 1).alias("report_id"),
        F.when(F.col("file_id") % 5 != 0, "patched").alias("file_url"),
    )
    return W.patch_coalesce(t.op_data, patches, "file_id", overwrite=("file_url",))


@query(
    "deletable_rows",
    """SELECT d.file_id, d.pipeline_status, coalesce(n, 0) AS n_facts,
         d.pipeline_status IN ('pending', 'failed') OR coalesce(n, 0) = 0 AS deletable
       FROM op_data d LEFT JOIN (SELECT report_id, count(*) AS n FROM facts GROUP BY ALL) USING (report_id)""",
    ["op_data", "facts"],
)
def deletable_rows(t: Tables):
    return G.deletable_files(t.op_data, t.facts)


@query(
    "deletable_reports",
    """SELECT r.report_id, coalesce(n, 0) AS n_started,
         r.pipeline_status IN ('pending', 'failed') AND coalesce(n, 0) = 0 AS deletable
       FROM op_report r LEFT JOIN (SELECT report_id, count(*) AS n FROM op_data
         WHERE pipeline_status NOT IN ('pending', 'failed') GROUP BY ALL) USING (report_id)""",
    ["op_report", "op_data"],
)
def deletable_reports(t: Tables):
    return G.deletable_reports(t.op_report, t.op_data)


@query(
    "cascade_delete",
    """SELECT file_id, report_id FROM op_data
       WHERE report_id NOT IN (SELECT report_id FROM op_report WHERE pipeline_status = 'failed')""",
    ["op_report", "op_data"],
)
def cascade_delete(t: Tables):
    gone = t.op_report.where(F.col("pipeline_status") == "failed")
    _, files = G.cascade_delete(t.op_report, t.op_data, gone)
    return files.select("file_id", "report_id")


@query(
    "mapping_prune",
    """SELECT source_code, extract_function, CASE WHEN source_code NOT IN ('SRC_B', 'SRC_D') THEN ai_extract_function END
         AS ai_extract_function, generation_hint FROM mapping WHERE source_code <> 'SRC_B'""",
    ["mapping"],
)
def mapping_prune(t: Tables):
    sources = t.mapping.where(F.col("source_code").isin("SRC_B", "SRC_D")).select("source_code")
    kept, _ = G.mapping_prune(t.mapping, sources)
    return kept


@query("list_mappings", "SELECT * FROM mapping", ["mapping"])
def list_mappings(t: Tables):
    return t.mapping.orderBy("source_code")


# --- logs -------------------------------------------------------------------------------------------


@query(
    "union_logs",
    """SELECT id, file_id, report_id, file_name, step, error_message, log_time, pipeline FROM (
         SELECT id, file_id, CAST(NULL AS INTEGER) AS report_id, CAST(NULL AS VARCHAR) AS file_name, step, error_message,
           log_time, 'dados' AS pipeline FROM logs
         UNION ALL SELECT id, NULL, report_id, file_name, step, error_message, log_time, 'pdfs' FROM report_logs
       ) ORDER BY log_time DESC, pipeline, id LIMIT 500""",
    ["logs", "report_logs"],
)
def union_logs(t: Tables):
    return L.union_logs(t.logs, t.report_logs)


@query(
    "latest_log_per_file",
    """SELECT file_id, step, error_message FROM (SELECT *, row_number() OVER (
       PARTITION BY file_id ORDER BY log_time DESC, id DESC) AS n FROM logs) WHERE n = 1""",
    ["logs"],
)
def latest_log_per_file(t: Tables):
    return L.latest_log_per_file(t.logs)


@query(
    "errors_since",
    "SELECT count(*) AS errors FROM logs WHERE log_time > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 15 MINUTE",
    ["logs"],
)
def errors_since(t: Tables):
    return L.errors_since(t.logs, F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))


@query(
    "log_enrich",
    """SELECT l.id, l.file_id, l.step, r.file_name FROM logs l LEFT JOIN op_data d ON CAST(d.file_id AS VARCHAR) = l.file_id
       LEFT JOIN op_report r ON r.report_id = d.report_id""",
    ["logs", "op_data", "op_report"],
)
def log_enrich(t: Tables):
    return L.log_enrich(t.logs, t.op_data, t.op_report).select("id", "file_id", "step", "file_name")


@query(
    "errors_numbered",
    """SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY log_time, id) AS n, error_message FROM logs""",
    ["logs"],
)
def errors_numbered(t: Tables):
    return L.errors_numbered(t.logs)


@query(
    "errors_concat",
    """SELECT file_id, CAST(count(*) AS INTEGER) AS n_errors,
         string_agg(error_message, '; ' ORDER BY n) AS errors
       FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY log_time, id) AS n FROM logs) GROUP BY ALL""",
    ["logs"],
)
def errors_concat(t: Tables):
    return L.errors_concat(t.logs)


_FUNNEL = {
    "bad": """SELECT d.file_id, coalesce(bool_or(step = 'bronze'), false) AS b, coalesce(bool_or(step = 'silver'), false) AS s,
        coalesce(bool_or(step = 'gold_validations'), false) AS v, coalesce(bool_or(step = 'gold'), false) AS g
        FROM op_data d LEFT JOIN (SELECT * FROM logs WHERE log_time >= TIMESTAMP '2024-01-05 00:00:00') l
          ON l.file_id = CAST(d.file_id AS VARCHAR)
        WHERE d.pipeline_status <> 'pending' GROUP BY d.file_id"""
}
_FUNNEL_SQL = """SELECT 1 AS step_no, 'bronze' AS step, count(*) AS n_total, count(*) FILTER (WHERE NOT b) AS n_ok,
         count(*) FILTER (WHERE b) AS n_error FROM bad
       UNION ALL SELECT 2, 'silver', count(*), count(*) FILTER (WHERE NOT s), count(*) FILTER (WHERE s) FROM bad WHERE NOT b
       UNION ALL SELECT 3, 'gold_validations', count(*), count(*) FILTER (WHERE NOT v), count(*) FILTER (WHERE v)
         FROM bad WHERE NOT b AND NOT s
       UNION ALL SELECT 4, 'gold', count(*), count(*) FILTER (WHERE NOT g), count(*) FILTER (WHERE g)
         FROM bad WHERE NOT b AND NOT s AND NOT v"""


@query("run_funnel", _FUNNEL_SQL, ["op_data", "logs"], _FUNNEL)
def run_funnel(t: Tables):
    return L.run_funnel(t.op_data, t.logs, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))


@query(
    "retry_route",
    """SELECT d.file_id, CASE WHEN d.pipeline_status <> 'failed' THEN d.pipeline_status
         WHEN step IN ('silver', 'gold_validations', 'gold') OR (file_url IS NULL AND step IS NOT NULL) THEN 'bronze'
         ELSE 'pending' END AS pipeline_status
       FROM op_data d LEFT JOIN (SELECT file_id, step FROM (SELECT *, row_number() OVER (
         PARTITION BY file_id ORDER BY log_time DESC, id DESC) AS n FROM logs) WHERE n = 1) l
       ON l.file_id = CAST(d.file_id AS VARCHAR)""",
    ["op_data", "logs"],
)
def retry_route(t: Tables):
    files, _ = G.retry_route(t.op_data, t.logs)
    return files.select("file_id", "pipeline_status")


@query(
    "clear_logs",
    """SELECT id, file_id FROM logs WHERE file_id NOT IN (
       SELECT CAST(file_id AS VARCHAR) FROM op_data WHERE pipeline_status = 'failed')""",
    ["op_data", "logs"],
)
def clear_logs(t: Tables):
    failed = t.op_data.where(F.col("pipeline_status") == "failed")
    return G.clear_logs(t.logs, failed).select("id", "file_id")


# --- scalar functions ----------------------------------------------------------------------------------


@query(
    "str_basic",
    """SELECT page_id, trim(lower(url)) AS low, upper(url) AS up, replace(url, 'http', 'h') AS shorter,
         starts_with(url, 'https') AS secure, contains(url, 'example') AS hit, split_part(url, '/', 3) AS host,
         trim(url, '/') AS bare FROM pages""",
)
def str_basic(t: Tables):
    return t.raw("pages").select(
        "page_id",
        F.trim(F.lower("url")).alias("low"),
        F.upper("url").alias("up"),
        F.replace("url", F.lit("http"), F.lit("h")).alias("shorter"),
        F.col("url").startswith("https").alias("secure"),
        F.col("url").contains("example").alias("hit"),
        F.split_part("url", F.lit("/"), F.lit(3)).alias("host"),
        F.btrim("url", F.lit("/")).alias("bare"),
    )


@query(
    "regex_basic",
    r"""SELECT q_id, regexp_matches(lower(question), '\btop\s*\d+\b') AS top_n,
          regexp_extract(question, '(\d{4})\D*$', 1) AS last_year,
          array_to_string(regexp_extract_all(question, '\b(?:19|20)\d{2}\b'), ',') AS years FROM questions""",
    ["questions"],
)
def regex_basic(t: Tables):
    return t.questions.select(
        "q_id",
        F.lower("question").rlike(r"(?U)\btop\s*\d+\b").alias("top_n"),
        F.regexp_extract("question", r"(\d{4})\D*$", 1).alias("last_year"),
        F.array_join(F.regexp_extract_all("question", F.lit(r"(?U)\b(?:19|20)\d{2}\b"), F.lit(0)), ",").alias("years"),
    )


@query(
    "strip_jsonc",
    r"""SELECT page_id, regexp_replace(html, '(^|[^:])//[^\n\r]*', '\1', 'g') AS text FROM pages""",
)
def strip_jsonc(t: Tables):
    return t.raw("pages").select("page_id", X.strip_jsonc(F.col("html")).alias("text"))


@query(
    "strip_fence",
    r"""SELECT doc_id, trim(CASE WHEN regexp_matches(t, '(?is)```(?:sql)?\n?(.*?)\n?```')
          THEN regexp_extract(t, '(?is)```(?:sql)?\n?(.*?)\n?```', 1) ELSE t END, E' \n\r\t') AS text
        FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN E'Sure:\n```sql\n' || text || E'\n```\nDone'
                WHEN 1 THEN '```' || text || '```' ELSE E' \n' || text || ' ' END AS t FROM documents)""",
)
def strip_fence(t: Tables):
    wrapped = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Sure:\n```sql\n"), "text", F.lit("\n```\nDone")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```"), "text", F.lit("```")))
        .otherwise(F.concat(F.lit(" \n"), "text", F.lit(" ")))
    )
    return t.raw("documents").select("doc_id", X.strip_fence(wrapped).alias("text"))


@query(
    "format_value",
    """SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice)
           THEN replace(format('{:,}', CAST(o_totalprice AS BIGINT)), ',', ' ')
           ELSE replace(format('{:,.2f}', o_totalprice), ',', ' ') END AS exact_text,
         replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' ') AS whole_text FROM orders""",
)
def format_value(t: Tables):
    return t.raw("orders").select(
        "o_orderkey",
        X.format_value(F.col("o_totalprice")).alias("exact_text"),
        X.format_value(F.floor("o_totalprice").cast("double")).alias("whole_text"),
    )


@query(
    "parse_date_flexible",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def parse_date_flexible(t: Tables):
    day = F.col("o_orderdate")
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "d-M-yyyy"))
        .otherwise(F.date_format(day, "MMM yyyy"))
    )
    return t.raw("orders").select("o_orderkey", casts.parse_date_flexible(raw).alias("day"))


@query(
    "fn_name_hash",
    "SELECT doc_id, md5(encode(text)[1:512])[1:4] AS tag FROM documents",
)
def fn_name_hash(t: Tables):
    return t.raw("documents").select("doc_id", X.fn_name_hash(F.col("text")).alias("tag"))


@query("url_domain", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_domain(t: Tables):
    return t.raw("pages").select("page_id", X.url_domain(F.col("url")).alias("host"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(t: Tables):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "map_lookup",
    """SELECT ord, s.location_code, name FROM (SELECT ord, CASE WHEN ord % 10 = 0 THEN 'QQQ' ELSE location_code END AS location_code
         FROM silver) s LEFT JOIN dim_location l ON s.location_code = l.location_code""",
    ["silver", "dim_location"],
)
def map_lookup(t: Tables):
    code = F.when(F.col("ord") % 10 == 0, "QQQ").otherwise(F.col("location_code"))
    known = t.dim_location.select("location_code", "name")
    return t.silver.select("ord", code.alias("location_code")).join(known, "location_code", "left")


@query(
    "csv_list",
    """SELECT doc_id, len(items) AS n_items, array_to_string(items, '|') AS joined FROM (SELECT doc_id,
         [trim(x) FOR x IN string_split(text, ',') IF trim(x) <> ''] AS items FROM documents)""",
)
def csv_list(t: Tables):
    items = X.csv_list(F.col("text"))
    return t.raw("documents").select(
        "doc_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, "|").alias("joined")
    )


@query(
    "cell_join",
    """SELECT c_custkey, trim(c_name) || ' | ' || coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, '')
       || ' | ' || c_nationkey AS line FROM customer""",
)
def cell_join(t: Tables):
    cells = F.array(
        F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")),
        F.col("c_nationkey").cast("string"),
    )
    return t.raw("customer").select("c_custkey", X.cell_join(cells).alias("line"))


# --- sniffing and reading --------------------------------------------------------------------------------


def _raw_objects(t: Tables):
    """Event payloads, web pages and documents as landed bytes with their URL."""
    ending = pick(["", "", "", ".csv?x=1", ".XLSX", ".zip"], F.col("event_id") % 6)
    events = spread(t.raw("events"), "event_id").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("key"),
        F.concat(F.lit("http://x.org/e"), ending).alias("url"),
        F.encode("props", "UTF-8").alias("content"),
    )
    pages = spread(t.raw("pages"), "page_id").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), "url", F.encode("html", "UTF-8").alias("content")
    )
    documents = spread(t.raw("documents"), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"),
        F.lit("").alias("url"),
        F.encode("text", "UTF-8").alias("content"),
    )
    orders = spread(t.raw("orders"), "o_orderkey").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"),
        F.lit("http://x.org/data").alias("url"),
        F.when(F.col("o_orderkey") % 5 == 0, F.unhex(F.lit("504B030414")))
        .when(F.col("o_orderkey") % 5 == 1, F.unhex(F.lit("D0CF11E0A1")))
        .when(F.col("o_orderkey") % 5 == 2, F.unhex(F.lit("FFFE00")))
        .otherwise(
            F.encode(
                F.concat_ws(
                    "\n",
                    F.lit("key;price;rank"),
                    F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.lit("1")),
                    F.concat_ws(";", F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.lit("2")),
                ),
                "UTF-8",
            )
        )
        .alias("content"),
    )
    return events.unionByName(pages).unionByName(documents).unionByName(orders)


def _sniff_sql() -> str:
    from almanac.sources.landing import DELIMITERS, quoted_field_patterns

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = " OR ".join(
        f"regexp_matches(snippet, {quote(p)})".replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '")
        for p in quoted_field_patterns()
    )
    steady = []
    for d in DELIMITERS:
        d = "chr(9)" if d == "\t" else f"'{d}'"
        counts = f"[len(x) - len(replace(x, {d}, '')) FOR x IN lines]"
        steady.append(
            f"""coalesce(list_bool_or([coalesce(2 * list_max([len([m FOR m IN part IF m = n]) FOR n IN part IF n > 0])
            - len(part) >= 0.91 * len(part), false)
            FOR part IN [({counts})[1:least(k * 10, len(lines))] FOR k IN range(1, CAST(ceil(len(lines) / 10.0) AS BIGINT) + 1)]]), false)"""
        )
    return f"""SELECT key, CASE
      WHEN ends_with(plain, '.csv') THEN 'csv' WHEN ends_with(plain, '.json') THEN 'json'
      WHEN ends_with(plain, '.xlsx') OR ends_with(plain, '.xls') THEN 'excel'
      WHEN ends_with(plain, '.xml') THEN 'xml' WHEN ends_with(plain, '.zip') THEN 'zip'
      WHEN magic = '504B0304' THEN 'zip' WHEN magic = 'D0CF11E0' THEN 'excel'
      WHEN snippet[1] IN ('{{', '[') THEN 'json' WHEN snippet[1] = '<' THEN 'xml'
      WHEN contains(snippet, chr(10)) AND ({patterns} OR {' OR '.join(steady)}) THEN 'csv'
      ELSE 'unknown' END AS format FROM cut"""


_OBJECTS = {
    "objects": """SELECT 'e' || event_id AS key, 'http://x.org/e' || (['', '', '', '.csv?x=1', '.XLSX', '.zip'])[event_id % 6 + 1]
          AS url, encode(props) AS content FROM events
        UNION ALL SELECT 'p' || page_id, url, encode(html) FROM pages
        UNION ALL SELECT 'd' || doc_id, '', encode(text) FROM documents
        UNION ALL SELECT 'o' || o_orderkey, 'http://x.org/data', CASE o_orderkey % 5 WHEN 0 THEN unhex('504B030414')
          WHEN 1 THEN unhex('D0CF11E0A1') WHEN 2 THEN unhex('FFFE00')
          ELSE encode(E'key;price;rank\n' || o_orderkey || ';' || o_totalprice || E';1\n' || o_custkey || ';' || o_orderstatus || ';2') END
          FROM orders""",
    "cut": """SELECT key, lower(split_part(url, '?', 1)) AS plain, hex(content[1:4]) AS magic, snippet,
        [x FOR x IN string_split(snippet, chr(10)) IF x <> ''] AS lines FROM (
          SELECT *, ltrim(coalesce(try(decode(content[1:512])), try(decode(content[1:511])), try(decode(content[1:510])),
            try(decode(content[1:509]))), E' \\t\\n\\r') AS snippet FROM objects)""",
}


@query("sniff_format", _sniff_sql(), [], _OBJECTS)
def sniff_format(t: Tables):
    from almanac.sources.landing import sniff_format as sniff

    return sniff(_raw_objects(t)).select("key", "format")


@query(
    "pdf_magic_filter",
    """SELECT key, is_pdf, CASE WHEN NOT is_pdf AND content[1:1] = encode('<')
         THEN 'O servidor devolveu HTML em vez do PDF (provável bloqueio/CAPTCHA).'
         WHEN NOT is_pdf THEN 'Conteúdo não é PDF válido (não contém %PDF nos primeiros 1024 bytes).' END AS reason
       FROM (SELECT *, contains(hex(content[1:1024]), '25504446') AS is_pdf FROM (
         SELECT 'p' || page_id AS key, encode(html) AS content FROM pages UNION ALL
         SELECT 'd' || doc_id, encode(CASE doc_id % 3 WHEN 0 THEN '%PDF-1.7' || text WHEN 1 THEN left(text, 400) || '%PDF' || text
           ELSE text END) FROM documents))""",
)
def pdf_magic_filter(t: Tables):
    from almanac.sources.landing import pdf_magic_filter as check

    pages = t.raw("pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.encode("html", "UTF-8").alias("content")
    )
    late = F.concat(F.left("text", F.lit(400)), F.lit("%PDF"), F.col("text"))
    body = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7"), F.col("text")))
        .when(F.col("doc_id") % 3 == 1, late)
        .otherwise(F.col("text"))
    )
    documents = t.raw("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.encode(body, "UTF-8").alias("content")
    )
    return check(pages.unionByName(documents)).select("key", "is_pdf", "reason")


@query("read_json_doc", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def read_json_doc(t: Tables):
    from almanac.sources.landing import read_json_doc as read

    objects = t.raw("events").select("event_id", F.encode("props", "UTF-8").alias("content"))
    return read(objects, "k int").select("event_id", "doc.k")
