"""Deterministic merges of replicated keyed tables.

Winners are chosen by ``min``/``max`` of an ordering struct, which combines
before the shuffle, so a key with a third of all rows needs no special care.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import dense_seq, lookup
from lodestone.session import stage

LEDGER_KEY = ["unit", "epoch", "deleted_at", "replica"]


# ---- archive markers: (session_id, state, transitioned_at, replica) ----


def merge_archive(*sides: DataFrame) -> DataFrame:
    """Latest transition per session; equal times go to the larger replica, then state."""
    cols = ["session_id", "state", "transitioned_at", "replica"]
    every = sides[0].select(*cols)
    for side in sides[1:]:
        every = every.unionByName(side.select(*cols))
    return (
        every.groupBy("session_id")
        .agg(F.max(F.struct("transitioned_at", "replica", "state")).alias("m"))
        .select("session_id", "m.state", "m.transitioned_at", "m.replica")
    )


def archive_transition(
    sessions: DataFrame, markers: DataFrame, state: str, at: str, replica: str
) -> DataFrame:
    """Plan of moving ``sessions`` to ``state``: previous state, whether it changes, the marker that results.

    A transition to the state a session is in keeps its marker.
    """
    now = markers.select("session_id", F.col("state").alias("_s"), F.col("transitioned_at").alias("_t"), F.col("replica").alias("_r"))
    planned = sessions.select("session_id").join(now, "session_id", "left")
    previous = F.coalesce("_s", F.lit("active"))
    changed = previous != F.lit(state)
    return planned.select(
        "session_id",
        previous.alias("previous_state"),
        F.lit(state).alias("next_state"),
        changed.alias("changed"),
        F.when(changed, F.lit(at)).otherwise(F.col("_t")).alias("transitioned_at"),
        F.when(changed, F.lit(replica)).otherwise(F.col("_r")).alias("replica"),
    )


# ---- deletion ledgers: (unit, epoch, deleted_at, replica) ----


def merge_ledger(*sides: DataFrame) -> DataFrame:
    """Union; one event per (unit, epoch): the earliest, then the smaller replica."""
    every = sides[0].select(*LEDGER_KEY)
    for side in sides[1:]:
        every = every.unionByName(side.select(*LEDGER_KEY))
    return (
        every.groupBy("unit", "epoch")
        .agg(F.min(F.struct("deleted_at", "replica")).alias("m"))
        .select("unit", "epoch", "m.deleted_at", "m.replica")
    )


def events_beyond(at: DataFrame, base: DataFrame) -> DataFrame:
    return at.join(base.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")


def renumbered(pending: DataFrame, after: Column) -> DataFrame:
    """Consecutive epochs above ``after`` in event order, over the whole table."""
    numbered = dense_seq(pending, [], ["epoch", "deleted_at", "replica", "unit"], "_n")
    return numbered.withColumn("epoch", after + F.col("_n")).drop("_n")


def reconcile_ledgers(local: DataFrame, remote: DataFrame, renumber: bool = False) -> DataFrame:
    """Merged ledger; with ``renumber`` local-only events move past the remote's epochs.

    Local events the remote has, or whose (unit, epoch) slot it has, stay. If any
    of the others is not above the remote's last epoch, all of them move, in order.
    """
    if not renumber:
        return merge_ledger(local, remote)
    fresh = events_beyond(local, remote).join(
        remote.select("unit", "epoch").distinct(), ["unit", "epoch"], "left_anti"
    ).select(*LEDGER_KEY)
    fresh = stage(fresh, "pending")
    kept = local.join(fresh, LEDGER_KEY, "left_anti").select(*LEDGER_KEY)
    top = remote.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("m"))
    lowest = fresh.agg(F.min("epoch").alias("m"))
    moved = dense_seq(fresh, [], ["epoch", "deleted_at", "replica", "unit"], "_n")
    moved = moved.select(
        "unit",
        F.when(lowest.scalar() <= top.scalar(), top.scalar() + F.col("_n")).otherwise(F.col("epoch")).alias("epoch"),
        "deleted_at",
        "replica",
    )
    return merge_ledger(kept, moved, remote)


def ledger_order() -> list[Column]:
    return [F.col("epoch").asc(), F.col("deleted_at").asc(), F.col("replica").asc(), F.col("unit").asc()]


def tombstones(ledger: DataFrame, live: DataFrame, conflicted: DataFrame | None = None) -> DataFrame:
    """Ledger events of units that are neither live nor in conflict."""
    gone = ledger.join(live.select(F.col("session_id").alias("unit")).distinct(), "unit", "left_anti")
    if conflicted is not None:
        gone = gone.join(conflicted.select(F.col("session_id").alias("unit")).distinct(), "unit", "left_anti")
    return gone


def is_tombstoned(ids: DataFrame, ledger: DataFrame, live: DataFrame, conflicted: DataFrame | None = None) -> DataFrame:
    """Ids with the last deletion of those that are tombstoned."""
    last = (
        tombstones(ledger, live, conflicted)
        .groupBy(F.col("unit").alias("session_id"))
        .agg(F.max(F.struct("epoch", "deleted_at", "replica")).alias("d"))
    )
    return ids.join(last, "session_id", "left").select(
        *[F.col(c) for c in ids.columns],
        F.col("d").isNotNull().alias("tombstoned"),
        F.col("d.deleted_at").alias("deleted_at"),
        F.col("d.epoch").alias("deletion_epoch"),
    )


def purge_set(events: DataFrame) -> DataFrame:
    """Distinct units to drop with the event that first names them, in event order."""
    return (
        events.groupBy("unit")
        .agg(F.min(F.struct("epoch", "deleted_at", "replica")).alias("f"))
        .select("unit", "f.epoch", "f.deleted_at")
        .orderBy("epoch", "deleted_at", "unit")
    )


def purge(tables: dict[str, DataFrame], units: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of purged sessions."""
    gone = units.select(F.col("unit").alias("session_id")).distinct()
    return {name: t.join(gone, "session_id", "left_anti") for name, t in tables.items()}


# ---- three-way merge and conflicts ----


def three_way_merge(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Outcome per unit of three (unit, digest) snapshots; content inside a unit is never stitched."""
    sides = {"base": base, "local": local, "remote": remote}
    tagged = None
    for name, side in sides.items():
        rows = side.select("unit", *[(F.col("digest") if n == name else F.lit(None).cast("string")).alias(f"{n}_digest") for n in sides])
        tagged = rows if tagged is None else tagged.unionByName(rows)
    # one row per unit and side, so one shuffle brings the three digests together
    both = tagged.groupBy("unit").agg(*[F.max(f"{n}_digest").alias(f"{n}_digest") for n in sides])
    moved_l = ~F.col("base_digest").eqNullSafe(F.col("local_digest"))
    moved_r = ~F.col("base_digest").eqNullSafe(F.col("remote_digest"))
    same = F.col("local_digest").eqNullSafe(F.col("remote_digest"))
    outcome = (
        F.when(~moved_l & ~moved_r, F.lit("unchanged"))
        .when(~moved_l, F.lit("pulled"))
        .when(~moved_r, F.lit("pushed"))
        .when(same, F.lit("merged"))
        .otherwise(F.lit("conflicted"))
    )
    return both.withColumn("outcome", outcome)


CANDIDATE = ["session_id", "key", "digest", "accepted_at"]


def capture_conflicts(*sides: DataFrame) -> DataFrame:
    """Distinct candidates (by key) of sessions with at least two of them."""
    every = sides[0].select(*CANDIDATE)
    for side in sides[1:]:
        every = every.unionByName(side.select(*CANDIDATE))
    distinct = (
        every.groupBy("session_id", "key")
        .agg(F.min(F.struct("digest", "accepted_at")).alias("c"))
        .select("session_id", "key", "c.digest", "c.accepted_at")
    )
    several = (
        distinct.groupBy("session_id").agg(F.count("*").alias("candidates")).filter("candidates >= 2")
    )
    return lookup(distinct, several, ["session_id"], "inner")


def candidate_order() -> list[Column]:
    return [F.col("session_id").asc(), F.col("digest").asc(), F.col("accepted_at").asc(), F.col("key").asc()]


def resolve_conflicts(conflicts: DataFrame, choices: DataFrame, strict: bool = False) -> DataFrame:
    """Candidate each (session_id, prefix) choice selects.

    The prefix must pick one digest; of its candidates the earliest accepted, then
    the smaller key, is taken. ``status`` is resolved, none or ambiguous; with
    ``strict`` anything but resolved fails the job.
    """
    matching = choices.join(conflicts, "session_id", "left").withColumn(
        "_hit", F.coalesce(F.startswith("digest", F.col("prefix")), F.lit(False))
    )
    picked = matching.groupBy("session_id", "prefix").agg(
        F.min(F.when(F.col("_hit"), F.col("digest"))).alias("lo"),
        F.max(F.when(F.col("_hit"), F.col("digest"))).alias("hi"),
        F.min(F.when(F.col("_hit"), F.struct("accepted_at", "key", "digest"))).alias("c"),
        F.count_if(~F.col("_hit") & F.col("digest").isNotNull()).alias("others"),
    )
    status = (
        F.when(F.col("lo").isNull(), F.lit("none"))
        .when(F.col("lo") != F.col("hi"), F.lit("ambiguous"))
        .otherwise(F.lit("resolved"))
    )
    sure = F.col("status") == "resolved"
    out = picked.withColumn("status", status).select(
        "session_id",
        "prefix",
        "status",
        F.when(sure, F.col("c.key")).alias("key"),
        F.when(sure, F.col("c.digest")).alias("digest"),
        F.when(sure, F.col("c.accepted_at")).alias("accepted_at"),
        "others",
    )
    if strict:
        guard = F.assert_true(sure, F.concat(F.lit("conflict not resolved: "), F.col("status")))
        out = out.filter(guard.isNull())
    return out


# ---- adopting one store into another ----


def missing_digests(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct (session_id, digest) of ``incoming`` that ``held`` lacks."""
    return incoming.select("session_id", "digest").distinct().join(
        held.select("session_id", "digest").distinct(), ["session_id", "digest"], "left_anti"
    )


def adopt_units(source: DataFrame, target: DataFrame, target_ledger: DataFrame) -> DataFrame:
    """merged, skipped or conflict for every session of ``source``.

    Both sides are (session_id, key, digest, accepted_at) candidates. The
    target's tombstones win; digests decide, not acceptance times; a source
    conflict migrates as a conflict.
    """
    ids = source.groupBy("session_id").agg((F.min("key") != F.max("key")).alias("frozen"))
    there = target.select("session_id", F.lit(True).alias("held")).distinct()
    gone = target_ledger.select(F.col("unit").alias("session_id"), F.lit(True).alias("deleted")).distinct()
    lacks = missing_digests(source, target).select("session_id", F.lit(True).alias("lacks")).distinct()
    joined = ids.join(there, "session_id", "left").join(gone, "session_id", "left").join(lacks, "session_id", "left")
    outcome = (
        F.when(F.col("held").isNull() & F.col("deleted").isNotNull(), F.lit("skipped"))
        .when(F.col("held").isNull(), F.when(F.col("frozen"), F.lit("conflict")).otherwise(F.lit("merged")))
        .when(F.col("lacks").isNull(), F.lit("skipped"))
        .otherwise(F.lit("conflict"))
    )
    return joined.select("session_id", outcome.alias("outcome"))


def adopt_ledger(
    source: DataFrame, target: DataFrame, live_in_target: DataFrame, marker: Column | int = 0
) -> DataFrame:
    """Target ledger with the source's unknown events of sessions not live there, in new epochs.

    New epochs follow the target's last one and its store's ``marker``, whichever is larger.
    """
    incoming = stage(tombstones(events_beyond(source, target), live_in_target).select(*LEDGER_KEY), "incoming")
    top = target.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("m"))
    after = F.greatest(top.scalar(), F.lit(marker).cast("long"))
    return merge_ledger(target, renumbered(incoming, after).select(*LEDGER_KEY))


def advanced_marker(before: DataFrame, after: DataFrame, marker: Column | int = 0) -> DataFrame:
    """The store's marker once its ledger went from ``before`` to ``after``: the largest epoch handed out, or as it was."""
    fresh = events_beyond(after, before).agg(F.max("epoch").alias("m"))
    was = F.lit(marker).cast("long")
    return fresh.select(F.greatest(was, F.coalesce("m", was)).alias("marker"))


# ---- monotone latest ----


def monotonic_latest(reports: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest report per key; an older one never replaces it."""
    rest = [c for c in reports.columns if c not in key and c not in order]
    return (
        reports.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*key, "m.*")
    )
