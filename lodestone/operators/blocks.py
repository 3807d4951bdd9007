"""Ordered computations over keys of any size.

A window partitioned by session puts a whole session into one task, and one
session may hold a third of all rows. Everything ordered here works on *blocks*
instead: a session is cut into runs of ``BLOCK_ROWS`` consecutive sequence
numbers, windows run per (key, block), and what must cross a block boundary is
carried by a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stage

BLOCK_ROWS = 16_384
# Ranges of dense_seq: rows each should hold, and up to how many their offsets are sent to every task.
RANGE_ROWS = 4_000_000
ORDERED_ROWS = 1_000_000  # the same where there are no keys
BROADCAST_RANGES = 50_000


def block_of(seq: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor((seq - 1) / F.lit(rows)).cast("long")


def dense_seq(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "seq",
    parts: int | None = None,
) -> DataFrame:
    """``row_number`` over ``keys`` by ``order`` without one task per key.

    Rows are range-partitioned on (keys, order) and staged, so partition numbers
    are facts of a written table. Numbers are local to (key, partition); a key
    that spans partitions adds the rows before it. Only the first key of a
    partition can have such an offset, so offsets have at most one row per
    partition; up to ``BROADCAST_RANGES`` they are broadcast. The number of ranges follows the number of
    rows, so a range stays small however wide the session's shuffles are set.
    Without keys the ranges are staged in order, and a row's place in its range is its number: no task takes several ranges.
    """
    if parts is None:
        fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(fewest, -(-df.count() // (RANGE_ROWS if keys else ORDERED_ROWS)))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    if not keys:
        return _numbered_ranges(ranged.sortWithinPartitions(*order), out)
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part")
    offsets = (
        counts.withColumn("_before", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("_before is not null")
        .drop("_n")
    )
    return (
        ranged.withColumn("_rn", F.row_number().over(local))
        .join(F.broadcast(offsets) if parts <= BROADCAST_RANGES else offsets, [*keys, "_part"], "left")
        .withColumn(out, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_rn", "_before", "_part")
    )


def _numbered_ranges(ranged: DataFrame, out: str) -> DataFrame:
    """Ranges sorted within and among each other, numbered through: the ids Spark deals are partition * 2^33 + place."""
    placed = stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, place + F.col("_before") + 1)
        .drop("_id", "_part", "_before")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running sum of ``value`` by ``seq`` within ``keys``, block by block."""
    blocked = df.withColumn("_blk", block_of(F.col(seq), rows)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_blk").orderBy(seq)
    per_block = blocked.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_t"))
    carried = per_block.select(
        *keys,
        "_blk",
        F.coalesce(
            F.sum("_t").over(
                Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        blocked.withColumn(
            "_in", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        )
        .join(carried, [*keys, "_blk"], "left")
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_v", "_in", "_before", "_blk")
    )


def lookup(many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows to a table that is unique on ``on``.

    A key with a third of the rows makes one skewed shuffle partition. Adaptive
    execution splits such a partition of the many side by map output and hands
    each piece its copy of the (one-row-per-key) partner, so a plain join holds;
    :func:`lodestone.session.configure` forces that split even where it costs a
    further shuffle. ``many`` must be the left side: outer joins split that one.
    """
    return many.join(one, list(on), how)
