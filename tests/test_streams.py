"""Keyed streams over several runs of one checkpoint."""

import datetime as dt

from almanac.session import shared_dir
from almanac.streaming import incremental as S

LOGS = "id long, file_id string, step string, log_time timestamp_ntz"
FILES = "file_id int, file_url string, pipeline_status string"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_retries_clear_entries_and_old_ones_expire(spark):
    files, logs, out, checkpoint = (shared_dir(spark, x) for x in ("files", "logs", "out", "checkpoint"))
    runs = [
        # a file with and one without entries; one whose entry stays
        ([(1, "u", "failed"), (2, None, "failed"), (3, "u", "done")], [(10, "1", "silver", at(0)), (11, "1", "bronze", at(1)), (12, "3", "gold", at(1))]),
        # the first file fails again: only its new entry counts; another moves the watermark far ahead
        ([(1, "u", "failed")], [(13, "1", "gold", at(2)), (14, "9", "gold", at(200))]),
        ([], [(15, "8", "gold", at(201))]),
        # the entry of file 3 has expired by now, so nothing says how far it had come
        ([(3, "u", "failed")], [(16, "8", "gold", at(202))]),
    ]
    for i, (f, entries) in enumerate(runs):
        spark.createDataFrame(f, FILES).write.parquet(f"{files}/{i}")
        spark.createDataFrame(entries, LOGS).write.parquet(f"{logs}/{i}")
        read = [S.read_arrivals(spark, f"{p}/*", spark.createDataFrame([], k).schema) for p, k in ((files, FILES), (logs, LOGS))]
        S.stream_retry_route(*read, out, checkpoint, keep="10 hours")
    got = sorted((r["file_id"], r["pipeline_status"]) for r in S.routed_files(spark, out).collect())
    assert got == [(1, "bronze"), (1, "pending"), (2, "pending"), (3, "pending")]
    kept = S.kept_logs(spark, out, spark.createDataFrame([e for _, entries in runs for e in entries], LOGS))
    assert sorted(r["id"] for r in kept.collect()) == [12, 14, 15, 16]


def test_status_changes_are_reported_once(spark):
    path, out, checkpoint = (shared_dir(spark, x) for x in ("moves", "out", "checkpoint"))
    schema = "file_id string, id long, log_time timestamp_ntz, status string"
    runs = [
        [("a", 1, at(0), "bronze"), ("a", 2, at(1), "silver"), ("b", 3, at(1), "bronze")],
        [("a", 1, at(0), "bronze"), ("b", 4, at(1), "done")],  # an old change, and a tie of time
    ]
    seen = []

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/n={batch_id}")

    for i, moves in enumerate(runs):
        spark.createDataFrame(moves, schema).write.parquet(f"{path}/{i}")
        stream = S.read_arrivals(spark, f"{path}/*", spark.createDataFrame([], schema).schema)
        S.run_available(S.stream_status_latest(stream, "file_id", "status", "log_time", "id", "2 days"), checkpoint, keep, "update", keyed=True)
        seen.append(sorted((r["file_id"], r["status"]) for r in spark.read.parquet(out).select("file_id", "status").collect()))
    assert seen[0] == [("a", "silver"), ("b", "bronze")]
    assert seen[1] == sorted([*seen[0], ("b", "done")])
