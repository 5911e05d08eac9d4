"""The queries that apply this subpackage's operators to the given tables, and their SQL."""

import itertools
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import byte_bpe, decontaminate, html_extract, jaccard_join, language_id, license_scan, prefix_trie, quality, simhash, token_store, topk_search, url_filter, whitening
from almanac.llm.common import tables
from almanac.session import written

# fixed values of the query's contract
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RANKS = "byte_bpe_multi_50k.tiktoken"


def rule_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, action)")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    leak = decontaminate.find_leaks(docs, tables(spark, sf_dir, "benchmark")).select("doc_id", "leak.*")
    return leak.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(tables(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, vectors.where("id % 50 = 0"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)), lambda s: s["exact"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first_word"])
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    return found.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(spans).alias("labels"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def bpe_digests(docs: DataFrame, spark: SparkSession) -> list[Column]:
    path = public_tokenizers.path(RANKS)
    ids = byte_bpe.encode(F.col("text"), spark, path, public_tokenizers.PATTERN)
    return [ids.alias("ids"), byte_bpe.decode(ids, spark, path).alias("decoded")]


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return digested(docs.select("doc_id", *bpe_digests(docs, spark)))


def digested(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_store.stored(docs, public_tokenizers.path("byte_bpe_50k.json"))

    @F.arrow_udf("bigint")
    def crc(ids: pa.Array) -> pa.Array:
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4")
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in itertools.pairwise(ends.tolist())], pa.int64())

    return found.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_text(tables(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(tables(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "quality.*", quality.selected(model.cut if model else 0.5).alias("keep"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(tables(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the first h turns of conversation c - c % 100, then c's own turns after its first h."""
    own = written(prefix_trie.sequences(turns), "sequences")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("tokens", 1, 5).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), h)
    return joined.select("conv_id", prefix_trie.path_of(F.concat(head, F.slice("tokens", h + 1, F.size("tokens")))).alias("path"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(rebuilt(tables(spark, sf_dir, "conversations")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.fixed_point(tables(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = whitening.whitened_components(vectors)
    return found.select(F.col("id").alias("vec_id"), *found.columns[1:])


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_decontaminate, op3_topk_search, op4_license_scan, op5_byte_bpe, op6_token_store, op7_html_extract,
        op8_jaccard_join, op9_quality, op10_language_id, op11_simhash, op12_prefix_trie, op13_whitening,
    )
}

_RULE_SQL = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_url_filter": rf"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_SQL}),
parts AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
best AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""",
    "op2_decontaminate": rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM grams))),
hits AS (SELECT doc_id, item_id, i, k FROM place JOIN grams USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op12_prefix_trie": """
WITH bytes AS (
  SELECT c, CAST(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(c AS VARCHAR), i, 1)) AS UBIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda j: CAST(0 AS UBIGINT))),
      lambda r, z: xor(r >> 1, 3988292384 * (r & 1)) + z)) AS UBIGINT) AS crc
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (SELECT c, CAST(xor(crc, CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM bytes),
own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
built AS (
  SELECT own.c, list_concat(coalesce(base.w[1:h], []), own.w[h + 1:]) AS w
  FROM own JOIN heads USING (c) LEFT JOIN own base ON base.c = own.c - own.c % 100),
places AS (SELECT c, d, w[1:d] AS p, len(w) = d AS last FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends,
         (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END) AS own
  FROM places GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)),
up AS (SELECT p[1:a] AS p, a AS d, own, n_children FROM (SELECT p, own, n_children, unnest(range(0, d + 1)) AS a FROM full_nodes)),
below AS (SELECT p, d, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY p, d)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN below USING (p, d) LEFT JOIN full_nodes y ON y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]""",
}
