"""Streaming forms of copy removal and latest-wins state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.intake import withheld
from lodestone.streaming.versions import complete

# How long a copy may lag behind the first delivery; a choice of this library.
COPY_DELAY = "1 day"


def stream_dedup_copies(stream: DataFrame, event_time: str = "ts", delay: str = COPY_DELAY) -> DataFrame:
    """Drop re-delivered events by identity key; events without one pass."""
    return stream.withWatermark(event_time, delay).withColumn(
        # rows without an identity are kept apart by their own position
        "_key", F.coalesce("identity_key", F.concat_ws("\n", "session_id", F.col(event_time).cast("string"), F.col("seq").cast("string")))
    ).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_monotonic_latest(stream: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest report per key as a running aggregate; it never moves backward."""
    rest = [c for c in stream.columns if c not in key and c not in order]
    return stream.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*key, "m.*")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet until the input is used up."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_to_log(aggregate: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a running aggregate as a log of changes: each batch writes the keys that it moved, and no others.

    A retried batch writes its own folder again. What a failed batch left is not marked complete and is not read.
    """
    return (
        aggregate.writeStream.outputMode("update")
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/v={i}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_of(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key in a log of changes: the newest compacted table, and the batches after it."""
    bases, batches = complete(spark, path, "base"), complete(spark, path)
    base = bases[-1] if bases else -1
    folders = [f"{path}/base={base}"] * bool(bases) + [f"{path}/v={v}" for v in batches if v > base]
    rows = spark.read.parquet(*folders)
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*key, "m.*")


def compact_log(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> None:
    """Fold a log's complete batches into a table of one row a key; readers go on with the old one until it is complete."""
    batches, bases = complete(spark, path), complete(spark, path, "base")
    if batches and (not bases or bases[-1] < batches[-1]):
        latest_of(spark, path, key, order).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")


def withheld_age_alerts(evaluations: DataFrame, now: Column) -> DataFrame:
    """The withheld advisory, only where it warns; batch, or a complete-mode stream."""
    return withheld(evaluations, now).filter("retention_warning")


def stream_age_alerts(stream: DataFrame, key: str, event_time: str, age_ms: int, delay: str = COPY_DELAY) -> DataFrame:
    """(key, since, due): an alert for every report of a key that no newer report follows within ``age_ms``.

    State is the newest report of each key, with a timer at the end of its age. The timer fires once the
    watermark (the newest time seen less ``delay``) has passed it; a batch that holds a key's next reports
    decides itself whether the age passed between them. Either way an alert comes once for a report, however the reports are dealt to batches.
    Reports that arrive behind their key's newest one change nothing; reports without key or time are left out. A key's reports
    come to one task as a stream of small batches, in order, so a key with most of the rows takes time there but no memory.
    """
    kind = stream.schema[key].dataType.simpleString()
    named = stream.select(F.col(key).alias("key"), F.col(event_time).cast("timestamp").alias("at"))
    timed = named.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)

    def follow(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        alerts: list[int] = []
        if state.hasTimedOut:
            alerts.append(newest)
            # The report stays as the newest one, with its alert given.
            state.update((newest, True))
        else:
            alerted = bool(state.exists and state.get[1])
            for batch in rows:
                for at in sorted(batch["at"].astype("datetime64[us]").astype("int64").tolist()):
                    if newest is not None and at <= newest:
                        continue
                    if newest is not None and not alerted and at > newest + age_ms * 1000:
                        alerts.append(newest)
                    newest, alerted = at, False
            state.update((newest, alerted))
            if not alerted:
                # A timer may not lie behind the watermark; one that would is due with the next batch.
                state.setTimeoutTimestamp(max(newest // 1000 + age_ms, state.getCurrentWatermarkMs() + 1))
        if alerts:
            since = pd.to_datetime(pd.Series(alerts), unit="us")
            yield pd.DataFrame({"key": [group[0]] * len(alerts), "since": since, "due": since + pd.Timedelta(milliseconds=age_ms)})

    return timed.groupBy("key").applyInPandasWithState(
        follow, f"key {kind}, since timestamp, due timestamp", "newest long, alerted boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
