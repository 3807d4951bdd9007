"""Mixing sources to target weights by entropy balancing.

A document is taken at a rate of at most ``CAP`` copies. Rates are those closest to
one copy each (in relative entropy) that give every source its target of words:
``rate = min(CAP, exp(tilt * size / mean size))`` with one tilt a source, found by
Newton steps on the convex dual. Steps read a table of (source, size, documents),
summed once, so they cost the same for a source of any size. Rates are rounded to
whole copies by running sums in order of size, and what rounding leaves of a
source's target is moved to its smallest documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.llm.text_stats import words_of
from lodestone.operators.blocks import block_of, dense_seq, running_sum

CAP = 3
TOLERANCE = 1e-9
# Up to so many sources, their state of the iteration passes through the driver, one row each; more are staged by every step.
DRIVER_SOURCES = 10_000


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, source_key, size`` of every row; the key is never null, the size is in words."""
    text, source = F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("source_key"),
        F.size(words_of(text)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """``source_key, source_size, target`` for weights 1, 2, 3, 1, ... by code point, null last.

    Targets share all words by weight, none above ``CAP`` times its source; each round fixes the sources that
    would be above and shares what is left among the others. A round reads three sums.
    """
    sources = sizes.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    ranked = dense_seq(stage(sources.withColumn("_null", F.col("source").isNull()), "sources"), [], ["_null", "source"], out="_rank")
    ranked = stage(ranked.withColumn("_weight", ((F.col("_rank") - 1) % 3 + 1).cast("double")), "ranked")
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    # Sources at their limit are those whose limit by weight lies under the rate of the others.
    limit = CAP * F.col("source_size") / F.col("_weight")
    rate = -math.inf
    while True:
        fixed, weight = ranked.agg(F.sum(F.when(limit <= rate, CAP * F.col("source_size"))), F.sum(F.when(limit > rate, F.col("_weight")))).first()
        if not weight:
            break
        new = (whole - (fixed or 0)) / weight
        if new <= rate:
            break
        rate = new
    target = F.least(F.lit(rate) * F.col("_weight"), (CAP * F.col("source_size")).cast("double"))
    return stage(ranked.select("source_key", "source_size", target.alias("target")), "targets")


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def tilts(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source_key, mean, tilt``: the dual variables at which capped exponential rates meet the targets.

    A Newton step that leaves the bracket known so far is replaced by its middle. Steps end when every source is
    within the tolerance or at a tilt that no step moves. A source that must be taken
    ``CAP`` times whole has an infinite tilt; one without words has none to find and keeps 0.
    """
    spark = sizes.sparkSession
    table = stage(sizes.filter("size > 0").groupBy("source_key", "size").agg(F.count("*").alias("docs")), "sizes")
    means = table.groupBy("source_key").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"))
    capped = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    state = wanted.join(means, "source_key", "left").select(
        "source_key",
        "target",
        F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.when(capped & (F.col("target") > 0), F.lit(math.inf)).otherwise(F.lit(0.0)).alias("tilt"),
        F.lit(-math.inf).alias("lo"),
        F.lit(math.inf).alias("hi"),
    )
    few = wanted.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES

    def held(df: DataFrame) -> DataFrame:
        return spark.createDataFrame(df.toArrow(), df.schema) if few else stage(df, "tilts")

    state = held(state)
    rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
    words = F.col("size") * F.col("docs")
    while True:
        sums = (
            table.join(state.select("source_key", "tilt", "mean"), "source_key")
            .groupBy("source_key")
            .agg(
                F.sum(rate * words).alias("taken"),
                F.sum(F.when(rate < CAP, rate * words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
        )
        open_ = (F.col("tilt") < math.inf) & (F.col("target") > 0)
        missing = F.col("target") - F.coalesce("taken", F.lit(0.0))
        stepped = (
            state.join(sums, "source_key", "left")
            .withColumn("off", F.when(open_, F.abs(missing) / F.col("target")).otherwise(0.0))
            .withColumn("lo", F.when(missing > 0, F.col("tilt")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(missing < 0, F.col("tilt")).otherwise(F.col("hi")))
        )
        newton = F.col("tilt") + missing / F.col("slope")
        middle = (
            F.when((F.col("lo") > -math.inf) & (F.col("hi") < math.inf), (F.col("lo") + F.col("hi")) / 2)
            .when(F.col("lo") > -math.inf, 2 * F.abs(F.col("lo")) + 1)
            .otherwise(-2 * F.abs(F.col("hi")) - 1)
        )
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.col("slope") > 0)
        moved = F.when(open_ & (F.col("off") > TOLERANCE), F.when(inside, newton).otherwise(middle)).otherwise(F.col("tilt"))
        moving = (F.col("off") > TOLERANCE) & (moved != F.col("tilt"))
        stepped = held(stepped.select("source_key", "target", "mean", moved.alias("tilt"), "lo", "hi", moving.alias("moving")))
        state = stepped.drop("moving")
        if stepped.filter("moving").isEmpty():
            return state.select("source_key", "mean", "tilt")


def _with_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """``rows`` with the ``figures`` of their source, joined by (source, block of ``_seq``) so that no source meets in one task.

    The figures go to one row a block first. A join on the source alone would deal its rows by source, and the windows
    after it would keep that dealing, since rows of a block already lie together in it.
    """
    blocked = rows.withColumn("_b", block_of(F.col("_seq")))
    per_block = blocked.select("source_key", "_b").distinct().join(figures, "source_key")
    return blocked.join(per_block, ["source_key", "_b"]).drop("_b")


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs`` (doc_id, source, text).

    A null source is a source of its own and comes last; a null text has no words and is never taken. Rows that
    agree in all columns are rounded in the order of a hash, then as they come; reruns over one table agree.
    An empty table gives no rows.
    """
    sizes = stage(sized(docs), "sizes")
    wanted = targets(sizes)
    found = tilts(sizes, wanted)
    per_source = stage(wanted.join(found, "source_key"), "per_source")
    # Rounding: copies are steps of the running sum of rates, largest documents first, so the words off target
    # are never more than the largest document.
    order = [F.desc("size"), F.xxhash64("doc_id", F.lit("mix")), "doc_id"]
    rated = _with_figures(stage(dense_seq(sizes, ["source_key"], order, out="_seq"), "mix_order"), per_source)
    rate = F.when(F.col("size") > 0, F.when(F.col("tilt") == math.inf, F.lit(float(CAP))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean")))).otherwise(0.0)
    # Millionths of a copy as whole numbers: sums do not depend on the order of addition.
    rated = rated.withColumn("_rate", F.round(rate * 1_000_000).cast("long"))
    summed = running_sum(rated, ["source_key"], "_seq", F.col("_rate"), "_sum")
    whole = lambda c: F.floor((c + 500_000) / 1_000_000)
    rounded = stage(summed.withColumn("copies", (whole(F.col("_sum")) - whole(F.col("_sum") - F.col("_rate"))).cast("long")), "rounded")
    # Repair: the smallest documents take or give a copy while the words still missing or left over allow.
    off = rounded.groupBy("source_key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("_off"), F.max("_seq").alias("_last"))
    rest = _with_figures(rounded, off)
    movable = F.when(F.col("size") == 0, 0).when((F.col("_off") > 0) & (F.col("copies") < CAP), F.col("size")).when((F.col("_off") < 0) & (F.col("copies") > 0), F.col("size")).otherwise(0)
    rest = rest.withColumn("_move", movable.cast("long")).withColumn("_up", F.col("_last") - F.col("_seq") + 1)
    rest = running_sum(rest, ["source_key"], "_up", F.col("_move"), "_moved")
    moves = (F.col("_move") > 0) & (F.col("_moved") <= F.abs("_off"))
    change = F.when(moves, F.signum("_off")).otherwise(0).cast("long")
    return rest.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + change).alias("copies"))
