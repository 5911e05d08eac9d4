"""Document pages, chunks, and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.vectors import cosine_distance
from almanac.operators import documents as D, runlog as L, vectors as V
from almanac.plans.catalog import query
from almanac.plans.fixtures import Tables, idiv
from almanac.session import spread

CHUNKS_SQL = """SELECT source, page, CAST((s) // 450 AS INTEGER) AS idx, substring(text, s + 1, 500) AS text
  FROM (SELECT *, unnest(range(0, greatest(length(text) - 51, 0) + 1, 450)) AS s FROM doc_pages)"""


@query("doc_pages", "SELECT * FROM doc_pages", ["doc_pages"])
def doc_pages(t: Tables):
    return t.doc_pages


@query("chunk_fixed", CHUNKS_SQL, ["doc_pages"])
def chunk_fixed(t: Tables):
    return D.chunk_fixed(t.doc_pages)


@query("chunk_recursive")
def chunk_recursive(t: Tables):
    """Whole documents as pages, so that every separator level is used."""
    whole = spread(t.raw("documents"), "doc_id").select("source", F.col("doc_id").cast("int").alias("page"), "text")
    return D.chunk_recursive(whole)


@query(
    "chunk_ids",
    f"""SELECT coalesce(source, 'unknown') || ':' || coalesce(CAST(page AS VARCHAR), 'unknown') || ':' || idx AS chunk_id, text
        FROM (SELECT CASE WHEN page % 5 <> 4 THEN source END AS source, CASE WHEN page % 7 <> 6 THEN page END AS page, idx, text
              FROM ({CHUNKS_SQL}))""",
    ["doc_pages"],
)
def chunk_ids(t: Tables):
    chunks = D.chunk_fixed(t.doc_pages).select(
        F.when(F.col("page") % 5 != 4, F.col("source")).alias("source"),
        F.when(F.col("page") % 7 != 6, F.col("page")).alias("page"),
        "idx",
        "text",
    )
    return D.chunk_ids(chunks).select("chunk_id", "text")


@query(
    "chunk_index",
    f"SELECT source, page, max(idx) AS last_idx, count(*) AS n_chunks FROM ({CHUNKS_SQL}) GROUP BY ALL",
    ["doc_pages"],
)
def chunk_index(t: Tables):
    chunks = D.chunk_fixed(t.doc_pages)
    return chunks.groupBy("source", "page").agg(F.max("idx").alias("last_idx"), F.count("*").alias("n_chunks"))


# --- page parts and boxes ---------------------------------------------------------------------


def _parts(t: Tables):
    """Three lines make a page; every line ending in a multiple of four is a table of its words."""
    is_table = F.col("page") % 4 == 3
    rows = F.transform(F.split("text", r"\."), lambda line: F.split(line, ","))
    return t.doc_pages.select(
        "source",
        idiv("page", 3).cast("int").alias("page"),
        F.col("page").alias("ord"),
        F.when(is_table, "table").otherwise("text").alias("kind"),
        F.when(~is_table, F.col("text")).alias("text"),
        F.when(is_table, rows).alias("cells"),
    )


_TABLE_TEXT = """array_to_string([array_to_string([trim(c) FOR c IN string_split(line, ',')], ' | ')
  FOR line IN string_split(text, '.')], chr(10))"""


@query(
    "table_to_text",
    f"SELECT source, page, {_TABLE_TEXT} AS text FROM doc_pages",
    ["doc_pages"],
)
def table_to_text(t: Tables):
    rows = F.transform(F.split("text", r"\."), lambda line: F.split(line, ","))
    return t.doc_pages.select("source", "page", D.table_to_text(rows).alias("text"))


@query(
    "page_assemble",
    f"""SELECT source, CAST(page // 3 AS INTEGER) AS page, string_agg(CASE WHEN late = 1 THEN '[TABELA]' || chr(10) || plain
          ELSE plain END, chr(10) || chr(10) ORDER BY late, page) AS text
        FROM (SELECT *, CAST(page % 4 = 3 AS INTEGER) AS late, CASE WHEN page % 4 = 3 THEN {_TABLE_TEXT}
                ELSE trim(text, E' \\t\\n\\r') END AS plain FROM doc_pages)
        WHERE trim(plain, E' \\t\\n\\r') <> '' GROUP BY source, page // 3""",
    ["doc_pages"],
)
def page_assemble(t: Tables):
    return D.page_assemble(_parts(t))


@query(
    "bbox_exclude",
    """SELECT source, page, CAST(i AS INTEGER) AS i, word FROM (
         SELECT source, page, i - 1 AS i, word, ((i - 1) % 10) * 50.0 AS x0, ((i - 1) // 10) * 12.0 AS top FROM (
           SELECT source, page, unnest(string_split(text, ' ')) AS word,
             generate_subscripts(string_split(text, ' '), 1) AS i FROM doc_pages))
       WHERE NOT (page % 2 = 0 AND x0 >= 99 AND top >= 11 AND x0 + 40 <= 301 AND top + 10 <= 61)""",
    ["doc_pages"],
)
def bbox_exclude(t: Tables):
    words = t.doc_pages.select("source", "page", F.posexplode(F.split("text", " ")).alias("i", "word"))
    placed = words.select(
        "*",
        ((F.col("i") % 10) * 50.0).alias("x0"),
        (idiv("i", 10) * 12.0).alias("top"),
        ((F.col("i") % 10) * 50.0 + 40).alias("x1"),
        (idiv("i", 10) * 12.0 + 10).alias("bottom"),
    )
    boxes = t.doc_pages.where(F.col("page") % 2 == 0).select(
        "source",
        "page",
        F.lit(100.0).alias("x0"),
        F.lit(12.0).alias("top"),
        F.lit(300.0).alias("x1"),
        F.lit(60.0).alias("bottom"),
    )
    return D.bbox_exclude(placed, boxes).select("source", "page", "i", "word")


# --- chunk store --------------------------------------------------------------------------------


@query(
    "replace_by_source",
    f"""SELECT source, page, idx, CASE WHEN starts_with(source, 'src1') THEN 'again: ' || text ELSE text END AS text
        FROM ({CHUNKS_SQL}) WHERE NOT (starts_with(source, 'src1') AND page = 0)""",
    ["doc_pages"],
)
def replace_by_source(t: Tables):
    """Documents of some sources are indexed again without their first page."""
    store = D.chunk_fixed(t.doc_pages)
    again = F.col("source").startswith("src1")
    offered = t.doc_pages.where(again & (F.col("page") > 0))
    emptied = t.doc_pages.where(again).select("source").distinct()
    new = D.chunk_fixed(offered).withColumn("text", F.concat(F.lit("again: "), F.col("text")))
    return D.replace_by_source(store.join(emptied, "source", "left_anti"), new)


@query(
    "chunk_counts",
    f"""SELECT source, count(*) AS n_chunks FROM ({CHUNKS_SQL}) GROUP BY ALL
        UNION ALL SELECT '*', count(*) FROM ({CHUNKS_SQL})
        UNION ALL SELECT '#', count(DISTINCT source) FROM ({CHUNKS_SQL})""",
    ["doc_pages"],
)
def chunk_counts(t: Tables):
    counts = D.chunk_counts(D.chunk_fixed(t.doc_pages))
    totals = D.chunk_totals(counts)
    both = totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("*").alias("source"), F.col("n_chunks")),
                F.struct(F.lit("#").alias("source"), F.col("n_sources").alias("n_chunks")),
            )
        )
    )
    return counts.unionByName(both)


@query(
    "index_coverage",
    f"""SELECT r.report_id, r.file_name, n IS NOT NULL AS indexed, coalesce(n, 0) AS n_chunks FROM op_report r
        LEFT JOIN (SELECT 'report_' || 3 * CAST(split_part(source, '/', 2) AS BIGINT) || '.pdf' AS file_name, count(*) AS n
          FROM ({CHUNKS_SQL}) GROUP BY ALL) USING (file_name)""",
    ["doc_pages", "op_report"],
)
def index_coverage(t: Tables):
    """All pages of all documents; a document is the text of every third report."""
    doc = 3 * F.split_part("source", F.lit("/"), F.lit(2)).cast("bigint")
    named = t.doc_pages.withColumn("source", F.concat(F.lit("report_"), doc.cast("string"), F.lit(".pdf")))
    return L.index_coverage(t.op_report, D.chunk_counts(D.chunk_fixed(named)))


# --- vectors ----------------------------------------------------------------------------------------
# One query per label: the mean vector of the label, searched in the whole store.

_QUERIES = {
    "queries": """SELECT query_id, list(m ORDER BY i) AS q FROM (SELECT CAST(label AS BIGINT) AS query_id, i, avg(x) AS m FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY ALL) GROUP BY ALL""",
    "hits": """SELECT * FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n
        FROM (SELECT query_id, vec_id, list_cosine_distance(q, CAST(embedding AS DOUBLE[])) AS d FROM queries, embeddings))
        WHERE n <= 5""",
}


def _label_queries(t: Tables):
    values = t.raw("embeddings").select(
        F.col("label").cast("long").alias("query_id"), F.posexplode("embedding").alias("i", "x")
    )
    means = values.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda e: e["m"]).alias("embedding"))


@query(
    "cosine_distance",
    """SELECT b.vec_id, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_distance(t: Tables):
    a = t.raw("embeddings").select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = t.raw("embeddings").join(a, "vec_id")
    return pairs.select("vec_id", F.round(cosine_distance(F.col("other"), F.col("embedding")), 6).alias("distance"))


@query(
    "vector_topk",
    "SELECT query_id, CAST(n AS INTEGER) AS position, vec_id, round(d, 6) AS distance FROM hits",
    [],
    _QUERIES,
)
def vector_topk(t: Tables):
    hits = V.vector_topk(_label_queries(t), t.raw("embeddings"))
    return hits.withColumn("distance", F.round("distance", 6))


@query(
    "vector_topk_blocks",
    "SELECT query_id, CAST(n AS INTEGER) AS position, vec_id, round(d, 6) AS distance FROM hits",
    [],
    _QUERIES,
)
def vector_topk_blocks(t: Tables):
    """The same through the path for query tables that are too large to send around."""
    hits = V.vector_topk(_label_queries(t), t.raw("embeddings"), broadcast_numbers=0)
    return hits.withColumn("distance", F.round("distance", 6))


@query(
    "vector_topk_ivf",
    "SELECT query_id, CAST(n AS INTEGER) AS position, vec_id, round(d, 6) AS distance FROM hits",
    [],
    _QUERIES,
)
def vector_topk_ivf(t: Tables):
    """All lists, each vector compared: the exact result by way of the index."""
    hits = V.vector_topk_ivf(_label_queries(t), t.raw("embeddings"), probes=1 << 30, exact=True)
    return hits.withColumn("distance", F.round("distance", 6))


@query("vector_ivf_recall", "SELECT count(DISTINCT label) AS n_queries, true AS enough FROM embeddings")
def vector_ivf_recall(t: Tables):
    """Do the nearest lists and codes find nine in ten of the exact hits?"""
    queries, corpus = _label_queries(t), t.raw("embeddings")
    found = V.vector_topk_ivf(queries, corpus)
    share = V.recall(found, V.vector_topk(queries, corpus))
    return share.crossJoin(queries.agg(F.count("*").alias("n_queries"))).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "vector_store_dims",
    "SELECT label, min(len(embedding))::INTEGER AS min_dims, max(len(embedding))::INTEGER AS max_dims, min_dims = max_dims AS ok FROM embeddings GROUP BY ALL",
)
def vector_store_dims(t: Tables):
    return D.vector_store_dims(t.raw("embeddings"), "label")


@query(
    "rag_context",
    """SELECT query_id, coalesce(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n),
         'Não encontrei informação relevante nos documentos indexados.') AS context,
         coalesce(string_agg(source || ':' || doc_id || ':0', ',' ORDER BY n), '') AS sources
       FROM (SELECT query_id FROM queries UNION ALL SELECT query_id + 1000 FROM queries) LEFT JOIN hits USING (query_id)
         LEFT JOIN documents ON doc_id = vec_id GROUP BY ALL""",
    [],
    _QUERIES,
)
def rag_context(t: Tables):
    queries = _label_queries(t)
    hits = V.vector_topk(queries, t.raw("embeddings"))
    chunks = t.raw("documents").select(
        F.col("doc_id").alias("vec_id"),
        F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.lit("0")).alias("chunk_id"),
        "text",
    )
    unanswered = queries.select((F.col("query_id") + 1000).alias("query_id"))
    asked = queries.select("query_id").unionByName(unanswered)
    return V.rag_context(asked, hits, chunks).withColumn("sources", F.array_join("sources", ","))


@query(
    "report_run",
    f"""SELECT r.report_id, step, n IS NOT NULL AS indexed, coalesce(n, 0) AS n_chunks FROM op_report r
        LEFT JOIN (SELECT report_id, step FROM (SELECT *, row_number() OVER (
          PARTITION BY report_id ORDER BY log_time DESC, id DESC) AS k FROM report_logs) WHERE k = 1) l ON l.report_id = r.report_id
        LEFT JOIN (SELECT 'report_' || split_part(source, '/', 2) || '.pdf' AS file_name, count(*) AS n
          FROM ({CHUNKS_SQL}) WHERE page > 0 GROUP BY ALL) c ON c.file_name = r.file_name
        WHERE r.pipeline_status <> 'pending'""",
    ["doc_pages", "op_report", "report_logs"],
)
def report_run(t: Tables):
    """The report run: last failing step and index state of every candidate."""
    doc = F.split_part("source", F.lit("/"), F.lit(2))
    named = t.doc_pages.where(F.col("page") > 0).withColumn(
        "source", F.concat(F.lit("report_"), doc, F.lit(".pdf"))
    )
    coverage = L.index_coverage(t.op_report, D.chunk_counts(D.chunk_fixed(named)))
    return L.step_report(t.op_report, coverage, t.report_logs)
