"""Band match of messages that were recorded twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.instants import instant_micros
from lodestone.operators.blocks import lookup


def mirrored(responses: DataFrame, authored: DataFrame, within_ms: int = 1000) -> DataFrame:
    """Add ``mirrored``: an authored message of the session has the same text nearby.

    Nearby is within ``within_ms``, or either side has no timestamp; a timestamp
    that is no instant matches nothing. Both need session_id, timestamp, text.

    Authored messages reduce to the first and last instant per (session, text,
    bucket of ``within_ms``): a neighbour in the same bucket always counts, from
    the bucket before only its last instant can, from the one after its first.
    So a text repeated without end costs one row per bucket, not pairs.
    """
    key = ["session_id", "_text"]
    ms = F.floor(instant_micros(F.col("timestamp")) / 1000)
    bucket = F.floor(F.col("_ms") / within_ms)
    said = authored.filter(F.col("text").isNotNull()).select(
        "session_id", F.sha2("text", 256).alias("_text"), "timestamp", ms.alias("_ms")
    )
    anytime = said.groupBy(*key).agg(F.bool_or(F.col("timestamp").isNull()).alias("_untimed"))
    per_bucket = (
        said.filter("_ms is not null")
        .groupBy(*key, bucket.alias("_b"))
        .agg(F.min("_ms").alias("lo"), F.max("_ms").alias("hi"))
    )
    none = F.lit(None).cast("bigint")
    near = (
        per_bucket.select(
            *key,
            F.explode(
                F.array(
                    F.struct((F.col("_b") + 1).alias("_b"), F.col("hi").alias("prev"), none.alias("next"), F.lit(False).alias("same")),
                    F.struct(F.col("_b"), none.alias("prev"), none.alias("next"), F.lit(True).alias("same")),
                    F.struct((F.col("_b") - 1).alias("_b"), none.alias("prev"), F.col("lo").alias("next"), F.lit(False).alias("same")),
                )
            ).alias("n"),
        )
        .groupBy(*key, F.col("n._b").alias("_b"))
        .agg(F.max("n.prev").alias("_prev"), F.min("n.next").alias("_next"), F.bool_or("n.same").alias("_same"))
    )
    asked = responses.withColumn("_text", F.sha2("text", 256)).withColumn("_ms", ms).withColumn("_b", bucket)
    joined = lookup(lookup(asked, anytime, key), near, [*key, "_b"])
    close = (
        F.coalesce("_same", F.lit(False))
        | F.coalesce(F.col("_ms") - F.col("_prev") <= within_ms, F.lit(False))
        | F.coalesce(F.col("_next") - F.col("_ms") <= within_ms, F.lit(False))
    )
    hit = F.col("_untimed").isNotNull() & (F.col("_untimed") | F.col("timestamp").isNull() | close)
    return joined.withColumn("mirrored", hit).drop("_text", "_ms", "_b", "_untimed", "_prev", "_next", "_same")
