"""Error logs and run accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.operators.ordering import last_per_key, number_rows

STEPS = ["bronze", "silver", "gold_validations", "gold"]


def union_logs(data_logs: DataFrame, report_logs: DataFrame, limit: int = 500) -> DataFrame:
    """Newest entries of both logs; columns one log lacks are null."""
    tagged = data_logs.withColumn("pipeline", F.lit("dados")).unionByName(
        report_logs.withColumn("pipeline", F.lit("pdfs")), allowMissingColumns=True
    )
    return tagged.orderBy(F.desc("log_time"), "pipeline", "id").limit(limit)


def latest_log_per_file(logs: DataFrame) -> DataFrame:
    return last_per_key(logs, ["file_id"], ["log_time", "id"], ["step", "error_message"])


def errors_since(logs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    since = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return logs.where(F.col("log_time") > since).agg(F.count("*").alias("errors"))


def log_enrich(logs: DataFrame, files: DataFrame, reports: DataFrame) -> DataFrame:
    """Fill the file name of log rows from the report of the file."""
    names = files.join(reports.select("report_id", "file_name"), "report_id").select(
        F.col("file_id").cast("string").alias("file_id"), "file_name"
    )
    return logs.join(names, "file_id", "left")


def errors_numbered(logs: DataFrame, key: str = "file_id") -> DataFrame:
    """Every message with its number in its file's log order; a hot file is dealt over many tasks."""
    numbered = number_rows(logs, [key], [F.col("log_time"), F.col("id")], "n")
    return numbered.select(key, "n", "error_message")


def errors_concat(logs: DataFrame, key: str = "file_id", part_size: int = 1000) -> DataFrame:
    """One row per file: its messages joined by ``; `` in log order, however many there are.

    The joined text is one cell, so it must fit in memory; ``errors_numbered`` has the same messages a row each.
    Messages are first joined in parts of ``part_size``, so that no task sorts all messages of a file.
    """
    part = F.floor((F.col("n") - 1) / part_size).cast("int").alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("n", "error_message")))
    parts = errors_numbered(logs, key).groupBy(key, part).agg(ordered.alias("m"))
    parts = parts.select(
        key, F.struct("part", F.array_join(F.transform("m", lambda m: m["error_message"]), "; ").alias("text")).alias("p"),
        F.size("m").alias("n"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "; ")
    return parts.groupBy(key).agg(F.sum("n").cast("int").alias("n_errors"), joined.alias("errors"))


def run_funnel(files: DataFrame, logs: DataFrame, run_start: Column) -> DataFrame:
    """Files per step of a run: how many reached it, passed it, failed in it.

    A file fails in the steps the log names for it since ``run_start``; it
    reaches a step unless it failed in an earlier one.
    """
    recent = (
        logs.where(F.col("log_time") >= run_start)
        .groupBy(F.col("file_id").cast("int").alias("file_id"))
        .agg(*[F.bool_or(F.col("step") == s).alias(f"bad_{s}") for s in STEPS])
    )
    joined = files.where(F.col("pipeline_status") != "pending").join(recent, "file_id", "left")
    counts, reached = [], F.lit(True)
    for s in STEPS:
        bad = F.coalesce(F.col(f"bad_{s}"), F.lit(False))
        counts += [F.count_if(reached).alias(f"total_{s}"), F.count_if(reached & bad).alias(f"error_{s}")]
        reached = reached & ~bad
    one = joined.agg(*counts)
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(s).alias("step"),
                F.col(f"total_{s}").alias("n_total"),
                (F.col(f"total_{s}") - F.col(f"error_{s}")).alias("n_ok"),
                F.col(f"error_{s}").alias("n_error"),
            )
            for i, s in enumerate(STEPS)
        ]
    )
    return one.select(F.inline(steps))


def index_coverage(reports: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Reports next to their chunk counts; a report without chunks is not indexed."""
    counts = chunk_counts.select(F.col("source").alias("file_name"), "n_chunks")
    return reports.join(counts, "file_name", "left").select(
        "report_id",
        "file_name",
        F.col("n_chunks").isNotNull().alias("indexed"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )


def step_report(candidates: DataFrame, coverage: DataFrame, report_logs: DataFrame) -> DataFrame:
    """Report run: candidates with the failing step, and whether they are indexed."""
    latest = last_per_key(report_logs, ["report_id"], ["log_time", "id"], ["step"])
    return (
        candidates.where(F.col("pipeline_status") != "pending")
        .join(latest, "report_id", "left")
        .join(coverage.select("report_id", "indexed", "n_chunks"), "report_id", "left")
        .select("report_id", "step", "indexed", "n_chunks")
    )


def run_report(files: DataFrame, logs: DataFrame, run_start: Column) -> DataFrame:
    """The body of a run's report: ``section, file_id, place, line``, in that order to be read.

    Sections 1 to 4 are the steps. A file has a line in each step that it reached, and its newest error of the run below it; every
    error of the last step has lines of its own.
    """
    recent = logs.where(F.col("log_time") >= run_start).withColumn("file_id", F.col("file_id").cast("int"))
    newest = last_per_key(recent, ["file_id", "step"], ["log_time", "id"], ["error_message"])
    errors = newest.groupBy("file_id").agg(
        *[F.max(F.when(F.col("step") == s, F.coalesce("error_message", F.lit("")))).alias(f"e_{s}") for s in STEPS[:3]]
    )
    ran = files.where(F.col("pipeline_status") != "pending").join(errors, "file_id", "left")
    fid, url, status = F.col("file_id").cast("string"), F.coalesce("file_url", F.lit("")), F.col("pipeline_status")
    bronze, silver, valid = (F.col(f"e_{s}") for s in STEPS[:3])
    # The words and columns of the report.
    why = lambda e: F.concat(F.lit("            Erro: "), e)
    told = lambda word, *rest: F.concat(F.rpad(F.lit(f"  {word}"), 12, " "), F.lit("file_id="), fid, *rest)
    one = lambda *lines: F.array(*lines)
    arrived = (
        F.when(url == "", one(told("UPLOAD", F.lit("  [ficheiro carregado via upload — ja no MinIO]"))))
        .when(bronze.isNotNull(), one(told("ERRO", F.lit("  URL="), url), why(bronze)))
        .otherwise(one(told("OK", F.lit("  URL="), url)))
    )
    shaped = (
        F.when(silver.isNotNull(), one(told("ERRO"), why(silver)))
        .when(status.isin("silver", "done"), one(told("OK", F.lit("  -> "), fid, F.lit(".parquet"))))
        .when(status == "failed", one(told("FAILED"), why(F.lit("—"))))
        .otherwise(one(F.concat(F.lit("  "), F.rpad(status, 9, " "), F.lit(" file_id="), fid)))
    )
    checked = F.when(valid.isNotNull(), one(told("INVALIDO"), why(valid))).otherwise(one(told("OK")))
    transformed = bronze.isNull() | (url == "")
    steps = [
        (1, F.lit(True), arrived),
        (2, transformed, shaped),
        (3, transformed & silver.isNull() & status.isin("silver", "done"), checked),
    ]
    parts = [ran.where(reached).select(F.lit(n).alias("section"), "file_id", F.posexplode(lines).alias("place", "line")) for n, reached, lines in steps]
    failed = number_rows(recent.where(F.col("step") == STEPS[3]), ["file_id"], [F.col("log_time"), F.col("id")], "_n")
    lines = one(F.concat(F.lit("  ERRO      step=gold  file_id="), F.coalesce(fid, F.lit("—"))), why(F.coalesce("error_message", F.lit(""))))
    last = failed.select(F.lit(4).alias("section"), "file_id", "_n", F.posexplode(lines).alias("_p", "line"))
    parts.append(last.select("section", "file_id", (2 * F.col("_n") - 2 + F.col("_p")).cast("int").alias("place"), "line"))
    body = parts[0]
    for part in parts[1:]:
        body = body.unionByName(part)
    return body
