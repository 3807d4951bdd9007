"""Event and session predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.instants import since as since_instant
from lodestone.functions.paths import file_matches
from lodestone.functions.text import contains_short, contains_term, split_terms, word_bounded

# The filter vocabulary.
SPEAKERS = {"user": "user", "agent": "assistant"}
KINDS = {
    "message": "message",
    "toolcall": "tool_call",
    "toolresult": "tool_result",
    "lifecycle": "lifecycle",
    "system": "system",
    "unknown": "unknown",
}


def speaker(role: str) -> Column:
    """Messages of one speaker; roles on other kinds do not count."""
    return (F.col("kind") == "message") & (F.col("role") == role)


def kind(name: str) -> Column:
    return F.col("kind") == name


def tool(name: str) -> Column:
    return (F.col("kind") == "tool_call") & F.exists(
        "tool_names", lambda n: F.lower(n) == F.lit(name.lower())
    )


def subagent() -> Column:
    """Subagent evidence: the id is stated, possibly empty."""
    return F.col("subagent_id").isNotNull()


def event_filter(values: Iterable[str]) -> Column:
    """Union of filter words; unknown words are an error."""
    slices = []
    for value in values:
        if value in SPEAKERS:
            slices.append(speaker(SPEAKERS[value]))
        elif value in KINDS:
            slices.append(kind(KINDS[value]))
        elif value == "subagent":
            slices.append(subagent())
        elif value.startswith("toolcall:") and len(value) > len("toolcall:"):
            slices.append(tool(value[len("toolcall:") :]))
        else:
            raise ValueError(f"unknown event filter: {value}")
    return reduce(or_, slices) if slices else F.lit(True)


def event_label(kind_col: Column, role: Column) -> Column:
    """An event's word in the filter vocabulary."""
    return (
        F.when((kind_col == "message") & (role == "user"), F.lit("user"))
        .when((kind_col == "message") & (role == "assistant"), F.lit("agent"))
        .when(kind_col == "tool_call", F.lit("toolcall"))
        .when(kind_col == "tool_result", F.lit("toolresult"))
        .otherwise(kind_col)
    )


def split_query(query: str) -> tuple[list[str], list[str], list[str]]:
    """All terms, those long enough to carry relevance, and the short ones."""
    terms = split_terms(query)
    return terms, [t for t in terms if len(t) >= 3], [t for t in terms if len(t) < 3]


def contains_all(query: str, text: str = "text", word: bool = False) -> Column:
    terms, long, short = split_query(query)
    col = F.col(text)
    conds = [contains_term(col, t) for t in long] + [contains_short(col, t) for t in short]
    if word:
        conds += [word_bounded(col, t) for t in terms]
    return reduce(and_, conds)


def since(bound: str, column: str = "timestamp") -> Column:
    return since_instant(F.col(column), bound)


def touches_file(path: str) -> Column:
    return F.exists(
        "file_touches", lambda t: file_matches(t["source_path"], t["normalized_path"], path)
    )


def active_sessions(sessions: DataFrame, include_archived: bool = False, harness: str | None = None) -> DataFrame:
    if not include_archived:
        sessions = sessions.filter(F.col("archive_state") == "active")
    if harness is not None:
        sessions = sessions.filter(F.col("harness_id") == harness)
    return sessions


def with_touch(events: DataFrame, path: str) -> DataFrame:
    """Events of the sessions that touched a matching file."""
    touched = events.filter(touches_file(path)).select("session_id").distinct()
    return events.join(touched, "session_id", "left_semi")


def visible(
    sessions: DataFrame,
    tombstoned: DataFrame | None = None,
    conflicted: DataFrame | None = None,
    forgotten: DataFrame | None = None,
) -> DataFrame:
    for gone in (tombstoned, conflicted, forgotten):
        if gone is not None:
            sessions = sessions.join(gone.select("session_id"), "session_id", "left_anti")
    return sessions


def pin_revision(results: DataFrame, sessions: DataFrame, cited: Column, strict: bool = False) -> DataFrame:
    """Flag rows whose session has moved on from the cited digest, or fail on them."""
    current = sessions.select("session_id", F.col("revision_digest").alias("current_digest"))
    out = results.withColumn("cited_digest", cited).join(current, "session_id", "left")
    same = F.col("cited_digest").eqNullSafe(F.col("current_digest"))
    if strict:
        guard = F.assert_true(same, F.lit("cited revision is not the current one"))
        return out.withColumn("revision_mismatch", F.when(guard.isNull(), F.lit(False)))
    return out.withColumn("revision_mismatch", ~same)


def candidate_status(values: Iterable[str]) -> Column:
    """Union of candidate classes; ``flagged`` is associated with an evaluation."""
    conds = [
        ((F.col("class") == "associated") & F.col("has_evaluation")) if v == "flagged" else F.col("class") == v
        for v in values
    ]
    return reduce(or_, conds) if conds else F.lit(True)
