"""Session-level facts, listings and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.instants import date_range
from lodestone.functions.paths import is_subagent_transcript
from lodestone.functions.secrets import session_label_text
from lodestone.operators.blocks import lookup
from lodestone.operators.predicates import event_filter

# Label precedence and the heading of sessions without a date.
LABEL_SOURCES = ("custom_title", "ai_title", "summary", "user_message")
UNDATED = "undated"


def session_summary(events: DataFrame) -> DataFrame:
    """Event count and the least and greatest raw timestamp per session."""
    stamp = F.nullif(F.col("timestamp"), F.lit(""))
    return events.groupBy("session_id").agg(
        F.count("*").alias("event_count"),
        F.min(stamp).alias("first_timestamp"),
        F.max(stamp).alias("last_timestamp"),
    )


def kind_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "kind").agg(F.count("*").alias("events"))


def kind_count_map(events: DataFrame) -> DataFrame:
    """One map kind -> events per session; there are six kinds, so groups stay small."""
    return kind_counts(events).groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "events")))).alias("kinds")
    )


def touch_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.sum(F.size("file_touches")).alias("file_touches"))


def subagent_counts(files: DataFrame) -> DataFrame:
    """Subagent transcripts per session; sidecars are not transcripts."""
    return files.groupBy("session_id").agg(
        F.count_if(is_subagent_transcript(F.col("path"))).alias("subagent_count")
    )


def session_labels(events: DataFrame) -> DataFrame:
    """Label, its source and its event per session; sessions without one are absent.

    The latest line of each title kind, else the first message its user spoke;
    a kind whose chosen text normalizes to nothing falls through. Only sequence
    numbers are aggregated (twice the number, plus one if the text is readable);
    texts are fetched for the chosen rows.
    """
    label = session_label_text(F.col("text"))
    source = F.coalesce(
        "label_source",
        F.when(
            (F.col("kind") == "message") & (F.col("role") == "user") & ~F.coalesce("harness_injected", F.lit(False)),
            F.lit("user_message"),
        ),
    )
    candidates = events.filter(F.col("text").isNotNull()).select(
        "session_id", "seq", source.alias("source"), label.alias("label")
    ).filter(F.col("source").isin(*LABEL_SOURCES))
    code = F.col("seq") * 2 + F.col("label").isNotNull().cast("int")
    picked = candidates.groupBy("session_id").agg(
        *[
            (F.min if s == "user_message" else F.max)(F.when(F.col("source") == s, code)).alias(s)
            for s in LABEL_SOURCES
        ]
    )
    readable = lambda s: F.when(F.col(s) % 2 == 1, F.floor(F.col(s) / 2))
    chosen = picked.select(
        "session_id",
        F.coalesce(*[readable(s) for s in LABEL_SOURCES]).cast("long").alias("label_seq"),
    ).filter("label_seq is not null")
    return (
        candidates.withColumnRenamed("seq", "label_seq")
        .join(chosen, ["session_id", "label_seq"])
        .select("session_id", "label", F.col("source").alias("label_source"), "label_seq")
    )


def filtered_totals(events: DataFrame, filters: Sequence[str] = ()) -> DataFrame:
    """Logical events passing the filters, and how far they and the session reach."""
    rep = (F.col("seq") == F.col("run_first_seq")) & event_filter(filters)
    return events.groupBy("session_id").agg(
        F.count_if(rep).alias("total_events"),
        F.max("seq").alias("max_seq"),
        F.max(F.when(rep, F.col("run_last_seq"))).alias("max_filtered_seq"),
    )


# ---- listings ----


def _listed() -> Column:
    return F.coalesce("last_timestamp", "accepted_at")


def list_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, then by id."""
    out = sessions.orderBy(_listed().desc(), F.col("session_id").asc())
    return out.limit(limit) if limit is not None else out


def list_summary(sessions: DataFrame) -> DataFrame:
    facts = sessions.agg(
        F.count("*").alias("sessions"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
        # harness names are an enumeration, so the set is small
        F.array_join(F.array_sort(F.collect_set("harness_id")), ", ").alias("harnesses"),
        F.count_if(F.col("archive_state") == "archived").alias("archived"),
    )
    return facts.withColumn("span", date_range(F.col("first_timestamp"), F.col("last_timestamp")))


def dated_groups(sessions: DataFrame) -> DataFrame:
    """Listing headings: sessions by the date of their last event, newest first."""
    heading = F.coalesce(F.substring("last_timestamp", 1, 10), F.lit(UNDATED))
    return (
        sessions.withColumn("heading", heading)
        .groupBy("heading")
        .agg(F.count("*").alias("sessions"), F.max(_listed()).alias("newest"))
        .orderBy(F.col("newest").desc(), F.col("heading"))
    )


# ---- timelines ----


def timeline(
    events: DataFrame,
    session_id: str,
    *,
    filters: Sequence[str] = (),
    start: int | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Logical events in source order; a run with any member at or past ``start`` shows whole."""
    rows = _logical(events, session_id, filters)
    if start is not None:
        rows = rows.filter(F.col("run_last_seq") >= start)
    rows = rows.orderBy("seq")
    return rows.limit(limit) if limit is not None else rows


def _logical(events: DataFrame, session_id: str, filters: Sequence[str]) -> DataFrame:
    return events.filter(
        (F.col("session_id") == session_id) & (F.col("seq") == F.col("run_first_seq")) & event_filter(filters)
    )


def timeline_tail(events: DataFrame, session_id: str, count: int, filters: Sequence[str] = ()) -> DataFrame:
    return _logical(events, session_id, filters).orderBy(F.desc("seq")).limit(count).orderBy("seq")


def next_cursor(shown: DataFrame, events: DataFrame, session_id: str, filters: Sequence[str] = ()) -> DataFrame:
    """Where to resume after ``shown``; NULL at the end."""
    most = _logical(events, session_id, filters).agg(F.max("run_last_seq").alias("m"))
    return shown.agg(F.max("run_last_seq").alias("last")).select(
        F.when(F.col("last") < most.scalar(), F.col("last") + 1).alias("next_cursor")
    )


def event_at(events: DataFrame, session_id: str, seq: int) -> DataFrame:
    """One event; every member of a run is addressable."""
    return events.filter((F.col("session_id") == session_id) & (F.col("seq") == seq))


def timeline_pages(events: DataFrame, filters: Sequence[str] = (), page: int = 50) -> DataFrame:
    """Every session's timeline cut into pages: first and next cursor of each page."""
    from lodestone.operators.blocks import running_sum

    rep = ((F.col("seq") == F.col("run_first_seq")) & event_filter(filters)).cast("long")
    placed = running_sum(events, ["session_id"], "seq", rep, "nth")
    shown = placed.filter((F.col("seq") == F.col("run_first_seq")) & event_filter(filters))
    pages = shown.groupBy("session_id", F.floor((F.col("nth") - 1) / page).cast("long").alias("page")).agg(
        F.min("seq").alias("first_seq"),
        F.max("run_last_seq").alias("last_seq"),
        F.count("*").alias("events"),
    )
    last = shown.groupBy("session_id").agg(F.max("run_last_seq").alias("most"))
    return pages.join(last, "session_id").select(
        "session_id",
        "page",
        "first_seq",
        "events",
        F.when(F.col("last_seq") < F.col("most"), F.col("last_seq") + 1).alias("next_cursor"),
    )


# ---- links between sessions ----


def resolve_parents(sessions: DataFrame, parent: str = "subagent_parent") -> DataFrame:
    """Stated parent source ids as session ids of the same harness; the raw id where unknown."""
    known = sessions.groupBy("harness_id", F.col("source_session_id").alias(parent)).agg(
        F.min("session_id").alias("parent_session")
    )
    linked = lookup(sessions.filter(F.col(parent).isNotNull()), known, ["harness_id", parent])
    return linked.withColumn("resolved", F.col("parent_session").isNotNull()).withColumn(
        "parent", F.coalesce("parent_session", parent)
    ).drop("parent_session")


def spawned_sessions(sessions: DataFrame, parent: str = "subagent_parent") -> DataFrame:
    """(parent session, child session) rows, the inverse of :func:`resolve_parents`."""
    return (
        resolve_parents(sessions, parent)
        .filter("resolved")
        .select(F.col("parent").alias("session_id"), F.col("session_id").alias("child_session"))
    )


def archive_states(sessions: DataFrame, markers: DataFrame) -> DataFrame:
    """Archive state by session, active where there is no marker."""
    states = markers.select("session_id", F.col("state").alias("_state"))
    return sessions.join(states, "session_id", "left").withColumn(
        "archive_state", F.coalesce("_state", F.lit("active"))
    ).drop("_state")


def expect_sessions(sessions: DataFrame, expected: DataFrame | int) -> DataFrame:
    """``sessions`` unchanged, failing the job unless their number is the expected one."""
    want = F.lit(expected) if isinstance(expected, int) else expected.agg(F.count("*")).scalar()
    have = sessions.agg(F.count("*")).scalar()
    ok = F.assert_true(have == want, F.lit("projection session count mismatch"))
    return sessions.filter(ok.isNull())
