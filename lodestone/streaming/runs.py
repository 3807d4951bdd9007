"""Adjacent duplicate runs over an unbounded ordered stream.

Each batch joins the open run of every session it touches, collapses runs with
the batch operator (block by block, so one session may fill a batch), appends
the runs that ended and keeps the last one open. State is one row per session
in a table per batch; a retried batch overwrites its own output and state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.blocks import dense_seq
from lodestone.operators.runs import adjacent_runs
from lodestone.session import stage
from lodestone.streaming.versions import complete

TAIL = "session_id string, last_seq long, open_first long, kind string, role string, text string, last_ts timestamp, last_id long"


def _tails(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    held = [v for v in complete(spark, f"{root}/tails") if before is None or v < before]
    if not held:
        return spark.createDataFrame([], TAIL)
    return spark.read.schema(TAIL).parquet(f"{root}/tails/v={held[-1]}")


def run_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """``batch`` has session_id, kind, role, text, ts and id, ordered by (ts, id)."""
    spark = batch.sparkSession
    tails = _tails(spark, root, batch_id)
    seen = tails.select("session_id", "last_seq", "last_ts", "last_id")
    rows = batch.join(seen, "session_id", "left")
    behind = F.col("last_ts").isNotNull() & (
        (F.col("ts") < F.col("last_ts")) | ((F.col("ts") == F.col("last_ts")) & (F.col("id") <= F.col("last_id")))
    )
    # Rows behind the state cannot be placed any more; they are kept and counted apart.
    late = rows.filter(behind).select(*batch.columns)
    late.write.mode("overwrite").parquet(f"{root}/late/v={batch_id}")
    numbered = dense_seq(rows.filter(~behind), ["session_id"], ["ts", "id"])
    cols = ["session_id", "seq", "kind", "role", "text", "ts", "id", "open_first"]
    placed = numbered.withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).withColumn(
        "open_first", F.lit(None).cast("long")
    )
    touched = placed.select("session_id").distinct()
    opened = tails.join(touched, "session_id", "left_semi").select(
        "session_id", F.col("last_seq").alias("seq"), "kind", "role", "text",
        F.col("last_ts").alias("ts"), F.col("last_id").alias("id"), "open_first",
    )
    runs = stage(adjacent_runs(placed.select(*cols).unionByName(opened)), "stream-runs")
    # the tail row may open the run it stands in earlier than this batch knows
    ended = runs.groupBy("session_id", "run_first_seq").agg(
        F.max("run_last_seq").alias("run_last_seq"),
        F.min("open_first").alias("open_first"),
        F.max(F.when(F.col("seq") == F.col("run_last_seq"), F.struct("kind", "role", "text", "ts", "id"))).alias("l"),
    )
    last = ended.groupBy("session_id").agg(F.max("run_last_seq").alias("top"))
    marked = ended.join(last, "session_id").select(
        "session_id",
        F.coalesce("open_first", "run_first_seq").alias("run_first_seq"),
        "run_last_seq",
        "l",
        (F.col("run_last_seq") == F.col("top")).alias("is_open"),
    )
    marked.filter("not is_open").select("session_id", "run_first_seq", "run_last_seq", "l.kind", "l.text").write.mode(
        "overwrite"
    ).parquet(f"{root}/closed/v={batch_id}")
    fresh = marked.filter("is_open").select(
        "session_id", F.col("run_last_seq").alias("last_seq"), F.col("run_first_seq").alias("open_first"),
        "l.kind", "l.role", "l.text", F.col("l.ts").alias("last_ts"), F.col("l.id").alias("last_id"),
    )
    tails.join(touched, "session_id", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(
        f"{root}/tails/v={batch_id}"
    )


def stream_adjacent_runs(stream: DataFrame, root: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda df, i: run_batch(df, i, root))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def runs_so_far(spark: SparkSession, root: str) -> DataFrame:
    """Ended runs and the open one of each session."""
    done = complete(spark, f"{root}/closed")
    schema = "session_id string, run_first_seq long, run_last_seq long, kind string, text string"
    closed = spark.read.schema(schema).parquet(*[f"{root}/closed/v={v}" for v in done]) if done else spark.createDataFrame([], schema)
    opened = _tails(spark, root).select("session_id", F.col("open_first").alias("run_first_seq"), F.col("last_seq").alias("run_last_seq"), "kind", "text")
    return closed.unionByName(opened)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(*[f"{root}/late/v={v}" for v in complete(spark, f"{root}/late")])
