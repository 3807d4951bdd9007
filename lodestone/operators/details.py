"""Everything known about sessions, as one row a session and as the lists of a single one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.families import family_detail, family_facts
from lodestone.operators.sessions import kind_count_map, resolve_parents, session_labels, spawned_sessions, touch_counts

ARTIFACT = ("path", "size", "media_type", "sha256")
SESSION = ("session_id", "harness_id", "source_session_id", "first_timestamp")
COUNTS = ("file_touches", "artifacts", "artifact_bytes", "children")


def artifact_list(files: DataFrame) -> DataFrame:
    """Every session's artifacts; a path listed more than once counts once, by its smallest digest."""
    once = files.groupBy("session_id", "path").agg(F.min(F.struct("sha256", "size", "media_type")).alias("f"))
    return once.select("session_id", "path", "f.size", "f.media_type", "f.sha256")


def artifact_totals(files: DataFrame) -> DataFrame:
    """Artifacts of each session and their bytes."""
    return artifact_list(files).groupBy("session_id").agg(F.count("*").alias("artifacts"), F.sum("size").alias("artifact_bytes"))


def linked(sessions: DataFrame, parent: str = "subagent_parent") -> DataFrame:
    """The parent of each session that states one, and whether it is stored."""
    return resolve_parents(sessions, parent).select(
        "session_id", F.col("parent").alias("parent_session"), F.col("resolved").alias("parent_resolved")
    )


def child_counts(sessions: DataFrame, parent: str = "subagent_parent") -> DataFrame:
    """How many sessions name each one as their parent, and the first of them."""
    return spawned_sessions(sessions, parent).groupBy("session_id").agg(
        F.count("*").alias("children"), F.min("child_session").alias("first_child")
    )


def session_details(
    sessions: DataFrame, events: DataFrame, files: DataFrame, families: DataFrame, parent: str = "subagent_parent"
) -> DataFrame:
    """One row for every session: label, parent, event kinds, touches, artifacts, children and family.

    ``sessions`` has session_id, harness_id, source_session_id, first_timestamp and the ``parent`` column; ``files`` is
    (session_id, path, size, media_type, sha256). Every fact is aggregated by session before it is joined, so no join
    multiplies rows. What there is none of counts 0; label, parent and family are null where there is none. A parent
    that is not stored stays as its source names it, with ``parent_resolved`` false.
    """
    known = sessions.select(*SESSION, parent)
    facts = [
        session_labels(events).select("session_id", "label", "label_source", "label_seq"),
        linked(known, parent),
        kind_count_map(events),
        events.groupBy("session_id").agg(F.count("*").alias("event_count")),
        touch_counts(events),
        artifact_totals(files),
        child_counts(known, parent),
        family_facts(known, families),
    ]
    taken = {c for f in facts for c in f.columns} - {"session_id"}
    out = sessions.select(*[c for c in sessions.columns if c not in taken])
    for fact in facts:
        out = out.join(fact, "session_id", "left")
    return out.na.fill(0, ["event_count", *COUNTS])


@dataclass(frozen=True)
class SessionDetail:
    """``head`` is the session's row of :func:`session_details`; the lists are ordered tables, of any length."""

    head: DataFrame
    artifacts: DataFrame
    family: DataFrame
    children: DataFrame


def session_detail(
    sessions: DataFrame, events: DataFrame, files: DataFrame, families: DataFrame, session_id: str, parent: str = "subagent_parent"
) -> SessionDetail:
    """One session whole. Its family is that of the whole store, archived members included."""
    mine = lambda df: df.filter(F.col("session_id") == session_id)
    key = mine(families).select("family_key")
    members = families.join(key, "family_key", "left_semi")
    known = sessions.select(*SESSION, parent)
    children = mine(spawned_sessions(known, parent)).select("child_session").orderBy("child_session")
    own = mine(events)
    tally = children.agg(F.count("*").alias("children"), F.min("child_session").alias("first_child"))
    head = mine(sessions)
    facts = [
        session_labels(own).select("session_id", "label", "label_source", "label_seq"),
        mine(linked(known, parent)),
        kind_count_map(own),
        own.groupBy("session_id").agg(F.count("*").alias("event_count")),
        touch_counts(own),
        artifact_totals(mine(files)),
        mine(family_facts(known, members)),
        tally.select(F.lit(session_id).alias("session_id"), "*"),
    ]
    taken = {c for f in facts for c in f.columns} - {"session_id"}
    head = head.select(*[c for c in head.columns if c not in taken])
    for fact in facts:
        head = head.join(fact, "session_id", "left")
    return SessionDetail(
        head.na.fill(0, ["event_count", *COUNTS]),
        artifact_list(mine(files)).select(*ARTIFACT).orderBy("path"),
        family_detail(events, sessions, families, session_id),
        children,
    )
