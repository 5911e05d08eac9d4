"""Registry of reports and files: state, ingestion, edits, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.casts import parse_date_flexible
from almanac.operators.ordering import last_per_key

# Legacy status names and the names they became.
FILE_STATUS_NAMES = {
    "PENDING": "pending",
    "VALIDATED": "pending",
    "PROCESSING": "processing",
    "BRONZE_OK": "bronze",
    "SILVER_OK": "silver",
    "DONE": "done",
    "FAILED": "failed",
}
REPORT_RUN_STATUS_NAMES = {**FILE_STATUS_NAMES, "BRONZE_OK": "pending"}
NOT_STARTED = ["pending", "failed"]
PAST_BRONZE = ["silver", "gold_validations", "gold"]


def status_normalise(status: Column, names: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for item in (names or FILE_STATUS_NAMES).items() for x in item]
    return F.coalesce(F.create_map(*pairs)[status], status)


def crash_recover(status: Column) -> Column:
    """Work that was under way when a run died starts over."""
    return F.when(status == "processing", "pending").otherwise(status)


def join_file_report(files: DataFrame, reports: DataFrame, status: str) -> DataFrame:
    rows = files.where(F.col("pipeline_status") == status).select("file_id", "report_id")
    return rows.join(reports.select("report_id", "source_code"), "report_id").orderBy("file_id")


def left_join_report(files: DataFrame, reports: DataFrame) -> DataFrame:
    """File listing, newest first, with the deletable flag."""
    named = reports.select("report_id", "source_code", F.col("file_name").alias("report_name"))
    return (
        files.join(named, "report_id", "left")
        .select(
            "file_id",
            "report_id",
            "file_url",
            "source_code",
            "report_name",
            F.col("pipeline_status").isin(*NOT_STARTED).alias("can_delete"),
        )
        .orderBy(F.desc("file_id"))
    )


def case_flags(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Reports with ``can_delete`` and ``url_locked``."""
    progressed = (
        files.where(~F.col("pipeline_status").isin(*NOT_STARTED))
        .groupBy("report_id")
        .agg(F.lit(True).alias("data_done"))
    )
    return reports.join(progressed, "report_id", "left").select(
        "report_id",
        "pipeline_status",
        (F.col("pipeline_status").isin(*NOT_STARTED) & F.col("data_done").isNull()).alias("can_delete"),
        F.col("pipeline_status").isin("bronze", "done").alias("url_locked"),
    )


def batch_ingest_split(payload: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of report rows to accepted rows and errors ``(index, file_name, error)``.

    A URL is a duplicate when the registry holds it or an earlier row of the
    batch that is itself acceptable brought it.
    """
    raw_date = F.col("publication_date").cast("string")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    dated = payload.withColumn("_date", F.when(filled("publication_date"), parse_date_flexible(raw_date)))
    # The texts returned with a refused row.
    problem = F.when(
        filled("publication_date") & F.col("_date").isNull(),
        F.concat(F.lit("Formato de data não reconhecido: "), raw_date),
    ).when(
        ~filled("source_code") | ~filled("file_name") | F.col("_date").isNull(),
        F.lit("source_code, file_name e publication_date são obrigatórios"),
    )
    checked = dated.withColumn("_url", F.nullif("report_url", F.lit(""))).withColumn("_problem", problem)
    offered = checked.where(F.col("_problem").isNull() & F.col("_url").isNotNull())
    first = offered.groupBy("_url").agg(F.min("index").alias("_first"))
    known = registry.where(F.col("report_url").isNotNull()).select(F.col("report_url").alias("_url")).distinct()
    # rows without an URL match nothing; a key of their own keeps them apart
    keyed = checked.withColumn("_key", F.coalesce("_url", F.concat(F.lit("\0"), F.col("index").cast("string"))))
    judged = (
        keyed.join(first.withColumnRenamed("_url", "_key"), "_key", "left")
        .join(known.select(F.col("_url").alias("_key"), F.lit(True).alias("_known")), "_key", "left")
        .withColumn(
            "error",
            F.coalesce(
                "_problem",
                F.when(
                    F.col("_url").isNotNull() & (F.col("_known").isNotNull() | (F.col("index") > F.col("_first"))),
                    F.lit("URL duplicado"),
                ),
            ),
        )
    )
    accepted = judged.where(F.col("error").isNull()).select(
        "index", "source_code", "file_name", F.col("_url").alias("report_url"), F.col("_date").alias("publication_date")
    )
    name = F.coalesce("file_name", F.lit("?"))
    return accepted, judged.where(F.col("error").isNotNull()).select("index", name.alias("file_name"), "error")


def batch_links_split(payload: DataFrame, registry: DataFrame) -> DataFrame:
    """A batch of bare links ``(index, url)``: an error text for duplicates, else null."""
    first = payload.groupBy("url").agg(F.min("index").alias("_first"))
    known = registry.select(F.col("report_url").alias("url"), F.lit(True).alias("_known")).distinct()
    duplicate = F.col("_known").isNotNull() | (F.col("index") > F.col("_first"))
    return (
        payload.join(first, "url", "left")
        .join(known, "url", "left")
        .select("index", "url", F.when(F.col("url").isNotNull() & duplicate, "URL duplicado").alias("error"))
    )


def file_batch_split(payload: DataFrame, reports: DataFrame) -> DataFrame:
    """A batch of file rows ``(index, report_id, file_url)`` with the error of each, if any."""
    known = reports.select("report_id", F.lit(True).alias("_known")).distinct()
    # The texts returned with a refused row.
    missing = F.col("report_id").isNull() | (F.col("report_id") == 0)
    error = F.when(missing, "report_id é obrigatório").when(
        F.col("_known").isNull(), F.concat(F.lit("report_id "), F.col("report_id").cast("string"), F.lit(" não existe"))
    )
    return payload.join(known, "report_id", "left").select(
        "index", "report_id", F.nullif("file_url", F.lit("")).alias("file_url"), error.alias("error")
    )


def fk_check(payload: DataFrame, reports: DataFrame) -> DataFrame:
    return payload.join(reports.select("report_id"), "report_id", "left_anti")


def anti_existing(offered: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return offered.join(existing.select(*keys), keys, "left_anti")


def check_duplicate(candidates: DataFrame, registry: DataFrame, field: str) -> DataFrame:
    """Does each candidate ``value`` exist in the registry, and under which report."""
    if field not in ("file_name", "report_url"):
        raise ValueError(f"field must be file_name or report_url, not {field!r}")
    held = registry.groupBy(F.col(field).alias("value")).agg(F.min("report_id").alias("report_id"))
    return candidates.join(held, "value", "left").select(
        "value", F.col("report_id").isNotNull().alias("exists"), "report_id"
    )


def distinct_sources(reports: DataFrame) -> DataFrame:
    named = F.col("source_code").isNotNull() & (F.col("source_code") != "")
    return reports.where(named).select("source_code").distinct().orderBy("source_code")


def retry_route(files: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed files go back to bronze when they had passed it, else to pending; their logs are cleared."""
    failed = files.where(F.col("pipeline_status") == "failed").select(F.col("file_id").cast("string").alias("file_id"))
    latest = last_per_key(logs.join(failed, "file_id", "left_semi"), ["file_id"], ["log_time", "id"], ["step"])
    step = latest.select(F.col("file_id").cast("int").alias("file_id"), "step")
    reached = F.col("step").isin(*PAST_BRONZE) | (
        (F.coalesce("file_url", F.lit("")) == "") & F.col("step").isNotNull()
    )
    routed = (
        files.join(step, "file_id", "left")
        .withColumn(
            "pipeline_status",
            F.when(F.col("pipeline_status") != "failed", F.col("pipeline_status"))
            .when(reached, "bronze")
            .otherwise("pending"),
        )
        .select(*files.columns)
    )
    return routed, logs.join(failed, "file_id", "left_anti")


def clear_logs(logs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Logs without those of ``files``; without ``files`` all are cleared."""
    if files is None:
        return logs.limit(0)
    return logs.join(files.select(F.col("file_id").cast("string").alias("file_id")), "file_id", "left_anti")


def deletable_files(files: DataFrame, facts: DataFrame) -> DataFrame:
    """A file may go unless it was processed and its report has facts."""
    counts = facts.groupBy("report_id").agg(F.count("*").alias("n"))
    joined = files.join(counts, "report_id", "left").withColumn("n_facts", F.coalesce("n", F.lit(0)))
    allowed = F.col("pipeline_status").isin(*NOT_STARTED) | (F.col("n_facts") == 0)
    return joined.select("file_id", "pipeline_status", "n_facts", allowed.alias("deletable"))


def deletable_reports(reports: DataFrame, files: DataFrame) -> DataFrame:
    """A report may go unless it or one of its files was processed."""
    started = (
        files.where(~F.col("pipeline_status").isin(*NOT_STARTED))
        .groupBy("report_id")
        .agg(F.count("*").alias("n"))
    )
    joined = reports.join(started, "report_id", "left").withColumn("n_started", F.coalesce("n", F.lit(0)))
    allowed = F.col("pipeline_status").isin(*NOT_STARTED) & (F.col("n_started") == 0)
    return joined.select("report_id", "n_started", allowed.alias("deletable"))


def cascade_delete(reports: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("report_id")
    return reports.join(ids, "report_id", "left_anti"), files.join(ids, "report_id", "left_anti")


def mapping_prune(mapping: DataFrame, sources: DataFrame, column: str = "ai_extract_function") -> tuple[DataFrame, DataFrame]:
    """Clear one column for the given sources, drop rows left empty; second result: unknown sources."""
    hit = sources.select("source_code", F.lit(True).alias("_hit")).distinct()
    cleared = F.when(F.col("_hit").isNull(), F.col(column))
    pruned = mapping.join(hit, "source_code", "left").withColumn(column, cleared)
    empty = F.coalesce("extract_function", "ai_extract_function", "generation_hint").isNull()
    kept = pruned.where(~(F.col("_hit").isNotNull() & empty)).select(*mapping.columns)
    return kept, sources.join(mapping.select("source_code"), "source_code", "left_anti")
