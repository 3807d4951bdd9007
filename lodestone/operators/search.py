"""Ranked text search and file-touch search over canonical events.

Matching is a scan with pushed-down predicates; the per-session figures come
from an aggregate with map-side combine, the shown rows from a per-session
top-k that Spark also limits before the shuffle, so a session with a third of
all matches costs no task more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import file_matches
from lodestone.functions.text import bm25, bm25_stats, excerpt, word_rank
from lodestone.operators.blocks import BLOCK_ROWS, block_of, lookup
from lodestone.operators.predicates import (
    active_sessions,
    contains_all,
    event_filter,
    since,
    split_query,
    touches_file,
)
from lodestone.session import stage

# Result window defaults.
LIMIT = 20
PER_SESSION = 3


@dataclass
class SearchResult:
    """``matches`` is at most ``limit`` rows; ``totals`` and ``also_in`` are whole."""

    matches: DataFrame
    totals: DataFrame
    also_in: DataFrame | None = None


def text_matches(
    events: DataFrame,
    sessions: DataFrame | None,
    query: str,
    *,
    file: str | None = None,
    harness: str | None = None,
    since_bound: str | None = None,
    filters: Sequence[str] = (),
    include_archived: bool = False,
    word: bool = False,
) -> DataFrame:
    """Every matching run representative with its ``rank``, before collapse and caps."""
    terms, long, _ = split_query(query)
    found = events.filter(F.col("text").isNotNull() & contains_all(query, word=word))
    found = found.filter(F.col("seq") == F.col("run_first_seq"))
    if filters:
        found = found.filter(event_filter(filters))
    if harness is not None:
        found = found.filter(F.col("harness_id") == harness)
    if since_bound is not None:
        found = found.filter(since(since_bound))
    if file is not None:
        touched = events.filter(touches_file(file)).select("session_id").distinct()
        found = found.join(touched, "session_id", "left_semi")
    if sessions is not None:
        shown = active_sessions(sessions, include_archived, harness).select("session_id")
        found = found.join(shown, "session_id", "left_semi")
    text = F.col("text")
    if not long:
        return found.withColumn("rank", F.lit(None).cast("double"))
    if word:
        return found.withColumn("rank", word_rank(text, terms))
    # The statistics cover every row with text, as an index over all of them would.
    stats = events.filter(F.col("text").isNotNull()).agg(bm25_stats(text, long).alias("s"))
    scored = found.withColumn("_s", stats.scalar())
    return scored.withColumn("rank", bm25(text, long, F.col("_s"))).drop("_s")


def touch_matches(
    events: DataFrame,
    sessions: DataFrame | None,
    path: str,
    *,
    harness: str | None = None,
    since_bound: str | None = None,
    filters: Sequence[str] = (),
    include_archived: bool = False,
) -> DataFrame:
    """One row per matching file touch; all rank alike."""
    found = events.filter(touches_file(path))
    if "run_first_seq" in events.columns:
        found = found.filter(F.col("seq") == F.col("run_first_seq"))
    if filters:
        found = found.filter(event_filter(filters))
    if harness is not None:
        found = found.filter(F.col("harness_id") == harness)
    if since_bound is not None:
        found = found.filter(since(since_bound))
    if sessions is not None:
        shown = active_sessions(sessions, include_archived, harness).select("session_id")
        found = found.join(shown, "session_id", "left_semi")
    return (
        found.withColumn("_t", F.explode("file_touches"))
        .filter(file_matches(F.col("_t.source_path"), F.col("_t.normalized_path"), path))
        .withColumn("operation", F.col("_t.operation"))
        .withColumn("source_path", F.col("_t.source_path"))
        .withColumn("normalized_path", F.col("_t.normalized_path"))
        .withColumn("rank", F.lit(0.0))
        .drop("_t")
    )


def collapse_copies(matches: DataFrame, families: DataFrame, first_seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop copies of an event held by other sessions of its family.

    ``families`` is (session_id, family_key), ``first_seen`` is (session_id,
    first_timestamp). The session with the earliest first timestamp among the
    holders keeps all its copies. Returns the surviving matches, with
    ``copy_key`` set where copies were dropped, and the rows that were dropped.
    """
    held = lookup(matches, families.select("session_id", "family_key"), ["session_id"])
    # a session listed twice must not bring its events twice
    seen = first_seen.groupBy("session_id").agg(F.min("first_timestamp").alias("first_timestamp"))
    held = lookup(held, seen, ["session_id"])
    shared = (
        held.filter(F.col("family_key").isNotNull() & F.col("identity_key").isNotNull())
        .groupBy("family_key", "identity_key")
        .agg(
            F.min(F.struct(F.col("first_timestamp").isNull().alias("late"), "first_timestamp", "session_id")).alias("_a"),
            F.min("session_id").alias("_lo"),
            F.max("session_id").alias("_hi"),
        )
        .filter(F.col("_lo") != F.col("_hi"))
        .select("family_key", "identity_key", F.col("_a.session_id").alias("anchor_session"))
    )
    judged = lookup(held, shared, ["family_key", "identity_key"])
    survives = F.col("anchor_session").isNull() | (F.col("anchor_session") == F.col("session_id"))
    kept = judged.filter(survives).withColumn(
        "copy_key", F.when(F.col("anchor_session").isNotNull(), F.col("identity_key"))
    )
    return kept.drop("anchor_session", "first_timestamp"), judged.filter(~survives)


def _recency(prefix: str = "") -> list[Column]:
    return [F.col(prefix + "timestamp").desc_nulls_last(), F.col("seq").desc()]


def windowed(matches: DataFrame, *, limit: int = LIMIT, per_session: int = PER_SESSION, sort: str = "relevance",
             by_recency: bool = False) -> DataFrame:
    """Per-session cap, group order and global limit.

    Adds ``rn``, ``total_in_session``, ``best_rank`` and ``time_key``. Sessions
    order by best rank (or newest match, or earliest match), rows within the cut
    by rank; every shown session takes at least one row, so only the first
    ``limit`` sessions matter and the rest never shuffle their rows.
    """
    if sort not in ("relevance", "time"):
        raise ValueError(f"sort must be relevance or time, got {sort}")
    newest = F.max(F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), F.col("seq").alias("s")))
    groups = matches.groupBy("session_id").agg(
        F.count("*").alias("total_in_session"),
        F.min("rank").alias("best_rank"),
        F.min("timestamp").alias("time_key"),
        newest.alias("_newest"),
    )
    if sort == "time":
        order = [F.col("time_key").asc_nulls_last(), F.col("session_id").asc()]
    elif by_recency:
        order = [F.col("_newest.t").desc(), F.col("session_id").desc()]
    else:
        order = [F.col("best_rank").asc(), F.col("session_id").asc()]
    top = groups.orderBy(*order).limit(limit)
    inside = _recency() if by_recency else [F.col("rank"), F.col("seq")]
    capped = (
        matches.join(F.broadcast(top), "session_id")
        .withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(*inside)))
        .filter(F.col("rn") <= per_session)
    )
    return capped.orderBy(*order, F.col("rn").asc()).limit(limit)


def in_source_order(shown: DataFrame, sort: str = "relevance", by_recency: bool = False) -> DataFrame:
    """Shown rows by group, then by position in the session."""
    if sort == "time":
        order = [F.col("time_key").asc_nulls_last(), F.col("session_id").asc()]
    elif by_recency:
        order = [F.col("_newest.t").desc(), F.col("session_id").desc()]
    else:
        order = [F.col("best_rank").asc(), F.col("session_id").asc()]
    return shown.orderBy(*order, F.col("seq").asc())


def search_text(
    events: DataFrame,
    sessions: DataFrame | None,
    query: str,
    *,
    families: DataFrame | None = None,
    limit: int = LIMIT,
    per_session: int = PER_SESSION,
    sort: str = "relevance",
    word: bool = False,
    **filters,
) -> SearchResult:
    """Grouped, ranked full-text search.

    ``events`` need run bounds (``adjacent_runs``); with ``families`` copies
    collapse before caps and totals.
    """
    terms, long, _ = split_query(query)
    matches = text_matches(events, sessions, query, word=word, **filters)
    return _finish(matches, sessions, families, limit, per_session, sort, not long, terms, word)


def search_file_touches(
    events: DataFrame,
    sessions: DataFrame | None,
    path: str,
    *,
    families: DataFrame | None = None,
    limit: int = LIMIT,
    per_session: int = PER_SESSION,
    sort: str = "relevance",
    **filters,
) -> SearchResult:
    matches = touch_matches(events, sessions, path, **filters)
    return _finish(matches, sessions, families, limit, per_session, sort, False, None, False)


def _finish(matches, sessions, families, limit, per_session, sort, by_recency, terms, word) -> SearchResult:
    also = None
    dropped = None
    if families is not None:
        seen = sessions.select("session_id", "first_timestamp")
        matches, dropped = collapse_copies(matches, families, seen)
    shown = windowed(matches, limit=limit, per_session=per_session, sort=sort, by_recency=by_recency)
    if terms is not None:
        shown = shown.withColumn("excerpt", excerpt(F.col("text"), terms, word))
    shown = in_source_order(shown, sort, by_recency)
    total = matches.agg(F.count("*").alias("total_matches"), F.count_distinct("session_id").alias("total_sessions"))
    if dropped is not None:
        total = total.withColumn("family_collapsed_matches", dropped.agg(F.count("*")).scalar())
        keys = shown.filter(F.col("copy_key").isNotNull()).select("family_key", F.col("copy_key").alias("identity_key")).distinct()
        also = (
            dropped.join(F.broadcast(keys), ["family_key", "identity_key"])
            .select("family_key", "identity_key", "session_id")
            .distinct()
        )
    else:
        total = total.withColumn("family_collapsed_matches", F.lit(0).cast("long"))
    return SearchResult(shown, total, also)


def limit_through_groups(groups: DataFrame, order: Sequence[Column], limit: int, per_session: int = PER_SESSION) -> DataFrame:
    """How many rows of each group a global limit leaves, groups in ``order``.

    Needs ``total_in_session``; at most ``limit`` groups can show anything.
    """
    top = groups.orderBy(*order).limit(limit)
    # The window sees at most ``limit`` rows.
    before = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.col("total_in_session"), F.lit(per_session))
    return (
        top.withColumn("_used", F.coalesce(F.sum(want).over(before), F.lit(0)))
        .withColumn("shown", F.greatest(F.lit(0), F.least(want, F.lit(limit) - F.col("_used"))))
        .filter("shown > 0")
        .drop("_used")
    )


# Blocks of events that are asked for by value, so that a scan of sorted events skips the others.
LISTED_BLOCKS = 200


def run_counts(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session_id, blk, starts, before): logical events that begin in each block, and in the session's blocks before.

    A small table (one row a block) to keep beside published events: with it a context window reads no others than its own blocks.
    """
    begins = F.count_if(F.col("seq") == F.col("run_first_seq"))
    counts = events.groupBy("session_id", block_of(F.col("seq"), block_rows).alias("blk")).agg(begins.alias("starts"))
    earlier = Window.partitionBy("session_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))


def context_window(shown: DataFrame, events: DataFrame, n: int, index: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Up to ``n`` logical events on each side of every shown match.

    Rows are (session_id, match_seq, seq); the session is unfiltered, windows clip at its ends and shown matches never
    repeat as context. ``index`` (:func:`run_counts` with the same ``block_rows``) says in which blocks the events around a match
    lie, and only those are read; without it the sessions of the matches are read once to make it.
    """
    hits = stage(shown.select("session_id", F.col("seq").alias("match_seq")).distinct(), "hits")
    slim = events.select("session_id", "seq", "run_first_seq")
    if index is None:
        slim = stage(slim.join(hits.select("session_id").distinct(), "session_id", "left_semi"), "hit-sessions")
        index = run_counts(slim, block_rows)
    # Where a match stands in its block is not known yet: all that may be within n of any place of the block is wanted.
    own = index.join(hits.withColumn("blk", block_of(F.col("match_seq"), block_rows)), ["session_id", "blk"])
    spans = own.select("session_id", (F.col("before") - n).alias("low"), (F.col("before") + F.col("starts") + n).alias("high")).distinct()
    near = index.join(spans, "session_id").filter((F.col("starts") > 0) & (F.col("before") < F.col("high")) & (F.col("before") + F.col("starts") > F.col("low")))
    near = stage(near.select("session_id", "blk", "before").distinct(), "near-blocks")
    listed = sorted((r.session_id, r.blk) for r in near.limit(LISTED_BLOCKS + 1).collect())
    if len(listed) <= LISTED_BLOCKS:
        # One range for neighbouring blocks, on the columns events are sorted by.
        ranges: list[list] = []
        for session, blk in listed:
            if ranges and ranges[-1][0] == session and ranges[-1][2] == blk - 1:
                ranges[-1][2] = blk
            else:
                ranges.append([session, blk, blk])
        inside = [(F.col("session_id") == s) & F.col("seq").between(a * block_rows + 1, (b + 1) * block_rows) for s, a, b in ranges]
        slim = slim.filter(reduce(or_, inside, F.lit(False)))
    starts = slim.filter(F.col("seq") == F.col("run_first_seq")).withColumn("blk", block_of(F.col("seq"), block_rows))
    within = Window.partitionBy("session_id", "blk").orderBy("seq")
    placed = starts.join(near, ["session_id", "blk"]).select("session_id", "seq", (F.row_number().over(within) + F.col("before")).alias("position"))
    places = stage(placed, "places")
    at = places.join(hits.withColumnRenamed("match_seq", "seq"), ["session_id", "seq"]).select(
        "session_id", F.col("seq").alias("match_seq"), F.explode(F.sequence(F.col("position") - n, F.col("position") + n)).alias("position")
    )
    around = places.join(at, ["session_id", "position"])
    return around.join(
        hits.select("session_id", F.col("match_seq").alias("seq")), ["session_id", "seq"], "left_anti"
    ).select("session_id", "match_seq", "seq")
