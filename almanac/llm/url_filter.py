"""URL filters: host-suffix and path-prefix expressions meet rules on short hash prefixes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import ascii_lower

PREFIX_DIGITS = 8  # 4 bytes, as hex digits


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(df: DataFrame, expression: Column) -> DataFrame:
    df = df.withColumn("_digest", F.sha2(expression, 256))
    return df.withColumn("_prefix", F.conv(F.substring("_digest", 1, PREFIX_DIGITS), 16, 10).cast("long"))


def _expression(host: Column, path: Column) -> Column:
    # the line break parts host and path, so no other pair has the same expression
    return F.concat(host, F.lit("\n"), path)


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``urls``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host and all subdomains where the
    URL's path starts with the rule's path. The longest rule (host and path together) wins, then the longer host; of two
    actions for one rule, block. A row without a rule gets ``default`` and a null ``rule``.

    Each distinct host and path becomes one expression for every host suffix and every path length that the rules
    know; expressions and rules meet on 4 bytes of their digest, whole digests confirm. What comes back is one row per
    host and path, so a hot host or a repeated URL never meets in one task, and adaptive execution may split the joins.

    Null URLs, and URLs without ``://``, have an empty host and path and fit no rule. Rules with a null part, or with an
    empty host, are left out. Repeated rows each get their verdict. Columns of ``urls`` with a name of the result are
    replaced; other columns stay. No rules: ``default`` everywhere.
    """
    out = urls.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}).drop("rule", "verdict")
    known = rules.select("host", "path", "action").dropna().where(F.length("host") > 0).distinct()
    known = known.withColumn("host", ascii_lower(F.col("host")))
    # at most one number for each possible path length, however many rules there are
    lengths = known.select(F.sort_array(F.collect_set(F.length("path"))).alias("l")).first()[0]
    keyed_rules = _keyed(known, _expression(F.col("host"), F.col("path"))).select(
        "_prefix",
        F.col("_digest").alias("_rule_digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("action") == "block").alias("block"),
            F.concat("host", "path").alias("rule"),
            F.col("action").alias("action"),
        ).alias("_found"),
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    pairs = out.where(F.col("host") != "").select("host", "path").distinct()
    expressions = (
        pairs.withColumn("_suffix", F.explode(suffixes))
        .where(F.col("_suffix") != "")
        .withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
        .where(F.col("_length") <= F.length("path"))
    )
    expressions = _keyed(expressions, _expression(F.col("_suffix"), F.expr("substring(path, 1, _length)")))
    best = (
        expressions.join(keyed_rules, "_prefix")
        .where(F.col("_digest") == F.col("_rule_digest"))
        .groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
        .agg(F.max("_found").alias("_found"))
    )
    return (
        out.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
        .withColumns({"rule": F.col("_found.rule"), "verdict": F.coalesce("_found.action", F.lit(default))})
        .drop("_host", "_path", "_found")
    )
