"""Age alerts over arriving reports: two arrivals and an expiry between them, however the rows are dealt to batches."""

from __future__ import annotations

import datetime as dt

import pytest

from lodestone.streaming.events import stream_age_alerts, to_table

HOUR = 3600 * 1000
DAY = dt.datetime(2026, 3, 1)
ROWS = "key string, ts timestamp, note string"


def at(hours, micros=0):
    return DAY + dt.timedelta(hours=hours, microseconds=micros)


def run(spark, folder, batches, age=10):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{folder}/in")
        # A start for every arrival: state and timers come from the checkpoint.
        to_table(stream_age_alerts(stream, "key", "ts", age * HOUR, "1 hour"), f"{folder}/out", f"{folder}/check").awaitTermination()
    return sorted((r.key, r.since, r.due) for r in spark.read.parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("cut", [[9], [2, 5, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9]])
def test_an_alert_for_every_silence(spark, tmp_path, cut):
    rows = [
        ("a", at(0), ""), ("b", at(1), ""), ("a", at(1), ""), ("b", at(1), "again"), ("c", at(2), ""),
        ("a", at(12, 5), ""), ("b", at(11, 3), ""), ("c", at(12), "in time"), ("d", at(30), ""),
    ]
    batches = [rows[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=True)]
    got = run(spark, str(tmp_path), batches)
    silent = [("a", 1, 0), ("a", 12, 5), ("b", 1, 0), ("b", 11, 3), ("c", 12, 0)]
    assert got == [(k, at(h, m), at(h + 10, m)) for k, h, m in silent]


def test_late_repeated_and_nameless_reports(spark, tmp_path):
    got = run(
        spark, str(tmp_path),
        [
            [("a", at(0), ""), (None, at(0), ""), ("n", None, "")],
            [("a", at(20), ""), ("z", at(40), "")],
            # The alert of a's newest report was given; a report behind it changes nothing, a new one starts anew.
            [("a", at(19), "late"), ("z", at(41), "")],
            [("a", at(42), ""), ("z", at(45), "")],
            [("z", at(60), "")],
        ],
    )
    assert [(k, s) for k, s, _ in got] == [("a", at(0)), ("a", at(20)), ("a", at(42)), ("z", at(45))]


LATEST = "key string, ts timestamp, n long, note string"


def test_latest_rows_as_a_log_of_changes(spark, tmp_path):
    """A batch writes the keys it moved; a batch that fails leaves the table as it was; compaction changes nothing but folders."""
    from pyspark.sql import functions as F

    from lodestone.streaming import events as E

    folder, key, order = str(tmp_path), ["key"], ["ts", "n"]

    def arrive(rows, fail=False):
        spark.createDataFrame(rows, LATEST).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(LATEST).parquet(f"{folder}/in")
        newest = E.stream_monotonic_latest(stream, key, order)
        if fail:
            newest = newest.withColumn("note", F.when(F.col("key") == "b", F.raise_error(F.lit("stopped"))).otherwise(F.col("note")))
        E.latest_to_log(newest, f"{folder}/log", f"{folder}/check").awaitTermination()

    def now():
        return {r.key: (r.ts, r.n, r.note) for r in E.latest_of(spark, f"{folder}/log", key, order).collect()}

    arrive([("a", at(1), 1, "x"), ("b", at(1), 1, "x"), ("c", at(5), 1, "x"), ("c", at(5), 2, "tie")])
    arrive([("a", at(3), 1, "y"), ("b", at(0), 9, "older")])
    first = {"a": (at(3), 1, "y"), "b": (at(1), 1, "x"), "c": (at(5), 2, "tie")}
    assert now() == first
    moved = {r.key for r in spark.read.parquet(f"{folder}/log/v=1").collect()}
    assert "c" not in moved and "a" in moved
    with pytest.raises(Exception, match="stopped"):
        arrive([("b", at(7), 1, "new"), ("a", at(8), 1, "z")], fail=True)
    assert now() == first
    E.compact_log(spark, f"{folder}/log", key, order)
    assert now() == first
    arrive([("d", at(1), 1, "w")])
    assert now() == first | {"b": (at(7), 1, "new"), "a": (at(8), 1, "z"), "d": (at(1), 1, "w")}
    E.compact_log(spark, f"{folder}/log", key, order)
    assert len(now()) == 4
