"""Adjacent duplicate runs and positions within a session.

All of it is block-wise (see :mod:`lodestone.operators.blocks`): ``seq`` must be
dense, 1-based and unique per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.blocks import BLOCK_ROWS, block_of, running_sum


def _continues(lag: Window) -> Column:
    """Same kind and same nonnull text as the event before; same role for messages."""
    same_role = (F.col("kind") != "message") | F.lag("role").over(lag).eqNullSafe(F.col("role"))
    return (
        (F.lag("kind").over(lag) == F.col("kind"))
        & (F.lag("text").over(lag) == F.col("text"))
        & same_role
    )


def adjacent_runs(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``run_first_seq`` and ``run_last_seq``.

    The last row of a block is also handed to the next one as a halo, so each
    block decides all its run starts in one sorted pass. Starts beyond the block
    come from a table of block edges.
    """
    blk = block_of(F.col("seq"), block_rows)
    is_last = F.pmod(F.col("seq"), F.lit(block_rows)) == 0
    placed = events.withColumn(
        "_blk", F.explode(F.when(is_last, F.array(blk, blk + 1)).otherwise(F.array(blk)))
    )
    lag = Window.partitionBy("session_id", "_blk").orderBy("seq")
    marked = placed.withColumn(
        "_start", ~F.coalesce(_continues(lag), F.lit(False))
    ).filter(F.col("_blk") == blk)
    edges = marked.groupBy("session_id", "_blk").agg(
        F.min(F.when(F.col("_start"), F.col("seq"))).alias("_first"),
        F.max(F.when(F.col("_start"), F.col("seq"))).alias("_last"),
        F.max("seq").alias("_end"),
    )
    # A frame that looks forward is quadratic in Spark; looking back in
    # descending order is the same thing in one pass.
    before = Window.unboundedPreceding, -1
    by_blk = Window.partitionBy("session_id").orderBy("_blk").rowsBetween(*before)
    by_blk_desc = Window.partitionBy("session_id").orderBy(F.desc("_blk")).rowsBetween(*before)
    carried = edges.select(
        "session_id",
        "_blk",
        F.last("_last", True).over(by_blk).alias("_open"),
        F.last("_first", True).over(by_blk_desc).alias("_next"),
        F.max("_end").over(Window.partitionBy("session_id")).alias("_end"),
    )
    upto = lag.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("session_id", "_blk").orderBy(F.desc("seq")).rowsBetween(*before)
    start = F.when(F.col("_start"), F.col("seq"))
    return (
        marked.withColumn("_in_first", F.max(start).over(upto))
        .withColumn("_in_next", F.min(start).over(after))
        .join(carried, ["session_id", "_blk"], "left")
        .withColumn("run_first_seq", F.coalesce("_in_first", "_open"))
        .withColumn("run_last_seq", F.coalesce(F.coalesce("_in_next", "_next") - 1, F.col("_end")))
        .drop("_blk", "_start", "_in_first", "_in_next", "_open", "_next", "_end")
    )


def representatives(events: DataFrame) -> DataFrame:
    """One row per run: its first member."""
    return events.filter(F.col("seq") == F.col("run_first_seq"))


def logical_positions(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run representatives with their 1-based ``position`` in the session."""
    rep = (F.col("seq") == F.col("run_first_seq")).cast("long")
    return running_sum(events, ["session_id"], "seq", rep, "position", block_rows).filter(
        F.col("seq") == F.col("run_first_seq")
    )


def run_members(events: DataFrame) -> DataFrame:
    """Members of each run: how many, and which one this event is."""
    return events.withColumn("run_length", F.col("run_last_seq") - F.col("run_first_seq") + 1).withColumn(
        "member_index", F.col("seq") - F.col("run_first_seq") + 1
    )


def member_seqs(first: Column, last: Column) -> Column:
    """The members of a run of several; NULL for a single event."""
    return F.when(last > first, F.sequence(first, last))
