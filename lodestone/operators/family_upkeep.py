"""Families kept up under changes: what a change leaves alone is not computed again.

A family is a connected component of sessions that hold a key in common, and its
name is its smallest session. Added holdings can only merge families, so the sessions
that hold an added key are reduced to the names of their families and components
are found among those names. Removed holdings can split a family, so the families that lost a
shared holding, and no others, are found again from their members' holdings.
The holdings are read by the keys and sessions of the change; they are never shuffled as a whole
while those are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import lookup
from lodestone.operators.families import components, continuation_edges, holdings, identity_edges
from lodestone.session import stage

KEY = ["harness_id", "identity_key"]
HELD = [*KEY, "session_id"]
# Keys or sessions of a change that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def all_holdings(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Distinct (harness, key, session): shared events, and each continuation as a key that child and parent hold."""
    held = holdings(events)
    if sessions is None:
        return held
    links = continuation_edges(sessions).select(
        F.lit("continuation").alias("harness_id"), F.concat_ws("\n", "child", "parent").alias("identity_key"), F.array("child", "parent").alias("both")
    )
    return held.unionByName(links.select(*KEY, F.explode("both").alias("session_id")))


def _few(df: DataFrame) -> DataFrame:
    """A staged table of the change, marked for broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def family_changes(families: DataFrame, held: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """(session_id, family_key) of every session whose family is another one now; null where it has none any more.

    ``families`` and ``held`` are the state before (:func:`fork_families`, :func:`all_holdings`), ``touched`` the
    ids of sessions that were added, changed or removed, ``fresh`` the holdings that touched sessions have now.
    """
    touched = _few(stage(touched.select("session_id").distinct(), "touched"))
    fresh = stage(fresh.select(*HELD).distinct().join(touched, "session_id", "left_semi").select(*HELD), "fresh")
    old = stage(held.join(touched, "session_id", "left_semi").select(*HELD), "old")
    lost = stage(old.join(fresh, HELD, "left_anti"), "lost")
    won = stage(fresh.join(old, HELD, "left_anti"), "won")

    def now(keys_or_sessions: DataFrame, on: list[str]) -> DataFrame:
        """Present holdings of some keys or sessions."""
        rows = held.join(keys_or_sessions, on, "left_semi").join(touched, "session_id", "left_anti")
        return rows.select(*HELD).unionByName(fresh.join(keys_or_sessions, on, "left_semi").select(*HELD))

    # A holding nobody shared holds no family together.
    lost_keys = _few(stage(lost.select(*KEY).distinct(), "lost-keys"))
    shared = held.join(lost_keys, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*KEY)
    losers = lost.join(shared, KEY, "left_semi").select("session_id").distinct()
    broken = _few(stage(families.join(losers, "session_id", "left_semi").select("family_key").distinct(), "broken"))
    members = _few(stage(families.join(broken, "family_key", "left_semi").select("session_id"), "members"))
    parts = stage(components(identity_edges(now(members, ["session_id"]))).toDF("session_id", "part"), "parts")

    # Names before the merge: a part of a broken family, a family that holds, or the session itself.
    won_keys = _few(stage(won.select(*KEY).distinct(), "won-keys"))
    holders = stage(now(won_keys, KEY), "holders")
    whole = families.join(broken, "family_key", "left_anti").select("session_id", F.col("family_key").alias("whole"))
    named = lookup(lookup(holders, parts, ["session_id"]), whole, ["session_id"]).select(*KEY, "session_id", F.coalesce("part", "whole", "session_id").alias("name"))
    named = stage(named, "named")
    edges = identity_edges(named.select("harness_id", "identity_key", F.col("name").alias("session_id")))
    merged = _few(stage(components(edges).toDF("name", "root"), "merged"))

    apart = lookup(members, parts, ["session_id"]).select("session_id", "part", F.coalesce("part", "session_id").alias("name"))
    apart = apart.join(merged, "name", "left").select("session_id", F.coalesce("root", "part").alias("family_key"))
    single = named.filter(F.col("name") == F.col("session_id")).select("session_id", "name").distinct().join(members, "session_id", "left_anti")
    single = single.join(merged, "name").select("session_id", F.col("root").alias("family_key"))
    renamed = families.select("session_id", F.col("family_key").alias("name")).join(merged, "name").join(members, "session_id", "left_anti")
    found = apart.unionByName(single).unionByName(renamed.select("session_id", F.col("root").alias("family_key"))).distinct()
    before = families.select("session_id", F.col("family_key").alias("was"))
    return stage(lookup(found, before, ["session_id"]).filter(~F.col("was").eqNullSafe(F.col("family_key"))).drop("was"), "family-changes")


def apply_family_changes(families: DataFrame, changes: DataFrame) -> DataFrame:
    """The families after ``changes``."""
    kept = families.join(_few(changes.select("session_id")), "session_id", "left_anti").select("session_id", "family_key")
    return kept.unionByName(changes.filter("family_key is not null").select("session_id", "family_key"))
