"""Text search, predicates, runs and timelines over conversations and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import predicates as P
from lodestone.operators import search as S
from lodestone.operators import sessions as N
from lodestone.operators.runs import adjacent_runs, logical_positions, representatives, run_members
from lodestone.plans.registry import (
    LINES_SQL,
    LOG_RUNS_SQL,
    LOG_SQL,
    TURN_RUNS_SQL,
    TURNS_SQL,
    bm25_sql,
    bm25_stats_sql,
    occurrences_sql,
    query,
    runs_sql,
)
from lodestone.session import stage
from lodestone.sources.tables import conversation_events, document_lines, log_events, read_table


def turns(spark: SparkSession, root: str) -> DataFrame:
    """Conversation events with run bounds, written once as the published table would be."""
    return stage(adjacent_runs(conversation_events(read_table(spark, root, "conversations"))), "turns")


def log(spark: SparkSession, root: str) -> DataFrame:
    return log_events(read_table(spark, root, "events"))


def log_runs(spark: SparkSession, root: str) -> DataFrame:
    return stage(adjacent_runs(log(spark, root)), "log")


# ---- ranked search ----

TERMS = ["the", "tion"]
_MATCHED = f"""m AS (SELECT cv.*, {bm25_sql('text', TERMS)} AS rank FROM cv, st
  WHERE text IS NOT NULL AND contains(lower(text), 'the') AND contains(lower(text), 'tion') AND seq = run_first_seq),
c AS (SELECT m.*, row_number() OVER (PARTITION BY session_id ORDER BY rank, seq) AS rn,
    count(*) OVER (PARTITION BY session_id) AS total_in_session,
    min(rank) OVER (PARTITION BY session_id) AS best_rank FROM m)"""
_HEAD = f"WITH {TURN_RUNS_SQL}, {bm25_stats_sql('cv', TERMS)}, {_MATCHED}"


@query(
    "search_relevance",
    f"""{_HEAD}
SELECT session_id, seq, role, total_in_session, round(rank, 6) AS rank FROM c WHERE rn <= 3
ORDER BY best_rank, session_id, rn LIMIT 20""",
)
def search_relevance(spark, root):
    found = S.search_text(turns(spark, root), None, "the tion").matches
    return found.select("session_id", "seq", "role", "total_in_session", F.round("rank", 6).alias("rank"))


@query(
    "search_all_ranks",
    f"{_HEAD} SELECT session_id, seq, round(rank, 6) AS rank FROM c",
)
def search_all_ranks(spark, root):
    return S.text_matches(turns(spark, root), None, "the tion").select(
        "session_id", "seq", F.round("rank", 6).alias("rank")
    )


@query(
    "search_totals",
    f"""{_HEAD} SELECT count(*) AS total_matches, count(DISTINCT session_id) AS total_sessions,
  CAST(0 AS BIGINT) AS family_collapsed_matches FROM m""",
)
def search_totals(spark, root):
    return S.search_text(turns(spark, root), None, "the tion").totals


@query(
    "search_session_groups",
    f"""{_HEAD} SELECT DISTINCT session_id, total_in_session, round(best_rank, 6) AS best_rank FROM c""",
)
def search_session_groups(spark, root):
    m = S.text_matches(turns(spark, root), None, "the tion")
    return m.groupBy("session_id").agg(
        F.count("*").alias("total_in_session"), F.round(F.min("rank"), 6).alias("best_rank")
    )


@query(
    "search_time",
    f"""WITH {LOG_RUNS_SQL},
m AS (SELECT * FROM ev WHERE contains(lower(text), 'click') AND seq = run_first_seq),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn,
    count(*) OVER (PARTITION BY session_id) AS total_in_session,
    min(timestamp) OVER (PARTITION BY session_id) AS time_key FROM m)
SELECT session_id, seq, run_last_seq, timestamp, total_in_session FROM c WHERE rn <= 3
ORDER BY time_key, session_id, rn LIMIT 20""",
)
def search_time(spark, root):
    found = S.search_text(log_runs(spark, root), None, "click", sort="time").matches
    return found.select("session_id", "seq", "run_last_seq", "timestamp", "total_in_session")


@query(
    "search_recency",
    f"""WITH {LOG_RUNS_SQL},
m AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, session_id DESC, seq DESC) AS rank FROM ev
  WHERE contains(text, 'up') AND seq = run_first_seq),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank) AS rn,
    min(rank) OVER (PARTITION BY session_id) AS best_rank FROM m)
SELECT session_id, seq, timestamp FROM c WHERE rn <= 3 ORDER BY best_rank, session_id, rn LIMIT 20""",
)
def search_recency(spark, root):
    return S.search_text(log_runs(spark, root), None, "up").matches.select("session_id", "seq", "timestamp")


_WORD_THE = r"(^|[^0-9A-Za-z_])(?:the)($|[^0-9A-Za-z_])"


def _word_count_sql(text: str, term: str) -> str:
    k = len(term)
    edge = lambda i: f"regexp_matches(substring({text}, {i}, 1), '[0-9A-Za-z_]')"
    return (
        f"len(list_filter(range(1, length({text}) - {k - 2}), lambda i: substring(lower({text}), i, {k}) = '{term}' "
        f"AND (i = 1 OR NOT {edge('i - 1')}) AND NOT {edge(f'i + {k}')}))"
    )


@query(
    "search_word_mode",
    f"""WITH {TURN_RUNS_SQL},
m AS (SELECT *, {_word_count_sql('text', 'the')} AS n FROM cv WHERE text IS NOT NULL AND seq = run_first_seq),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY -n, seq) AS rn,
    min(-n) OVER (PARTITION BY session_id) AS best FROM m WHERE n > 0)
SELECT session_id, seq, CAST(-n AS DOUBLE) AS rank FROM c WHERE rn <= 3 ORDER BY best, session_id, rn LIMIT 20""",
)
def search_word_mode(spark, root):
    return S.search_text(turns(spark, root), None, "the", word=True).matches.select("session_id", "seq", "rank")


@query(
    "limit_through_groups",
    f"""{_HEAD},
g AS (SELECT session_id, count(*) AS total_in_session, min(rank) AS best FROM m GROUP BY 1),
u AS (SELECT *, coalesce(sum(least(total_in_session, 3)) OVER (ORDER BY best, session_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g)
SELECT session_id, total_in_session, CAST(greatest(0, least(least(total_in_session, 3), 20 - used)) AS BIGINT) AS shown
FROM u WHERE used < 20""",
)
def limit_through_groups(spark, root):
    m = S.text_matches(turns(spark, root), None, "the tion")
    g = m.groupBy("session_id").agg(F.count("*").alias("total_in_session"), F.min("rank").alias("best"))
    return S.limit_through_groups(g, [F.col("best"), F.col("session_id")], 20).select(
        "session_id", "total_in_session", F.col("shown").cast("long").alias("shown")
    )


@query(
    "context_window",
    f"""{_HEAD},
s AS (SELECT session_id, seq FROM c WHERE rn <= 3 ORDER BY best_rank, session_id, rn LIMIT 20),
p AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS pos FROM cv WHERE seq = run_first_seq)
SELECT a.session_id, a.seq AS match_seq, b.seq AS seq
FROM s JOIN p a ON a.session_id = s.session_id AND a.seq = s.seq
JOIN p b ON b.session_id = a.session_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2
WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.session_id = b.session_id AND x.seq = b.seq)""",
)
def context_window(spark, root):
    events = turns(spark, root)
    return S.context_window(S.search_text(events, None, "the tion").matches, events, 2)


# The excerpt in SQL: mark each character of the window that lies in a match.
_HIT = "(lower(substring(line, {i}, 3)) = 'the')"
_MARK = (
    "(" + " OR ".join(_HIT.format(i=f"({{i}}) - {d}") + f" AND ({{i}}) - {d} >= 1" for d in range(3)) + ")"
)


def excerpt_sql(source: str, out: str) -> str:
    """CTEs adding to ``source`` the excerpt of its text for the term ``the``."""
    return f"""{out}_l AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM {source}),
{out}_a AS (SELECT *, length(line) AS n, greatest(strpos(lower(line), 'the') - 1, 0) AS anchor FROM {out}_l),
{out}_b AS (SELECT *, CASE WHEN n <= 120 THEN n ELSE least(n, greatest(anchor - 24, 0) + 120) END AS e FROM {out}_a),
{out}_w AS (SELECT *, CASE WHEN n <= 120 THEN 0 ELSE greatest(e - 120, 0) END AS s FROM {out}_b),
{out} AS (SELECT *, (CASE WHEN s > 0 THEN '…' ELSE '' END) || list_aggregate(list_transform(range(s + 1, e + 1),
  lambda i: (CASE WHEN {_MARK.format(i='i')} AND (i = s + 1 OR NOT {_MARK.format(i='i - 1')}) THEN '«' ELSE '' END)
    || substring(line, i, 1)
    || (CASE WHEN {_MARK.format(i='i')} AND (i = e OR NOT {_MARK.format(i='i + 1')}) THEN '»' ELSE '' END)),
  'string_agg', '') || (CASE WHEN e < n THEN '…' ELSE '' END) AS excerpt FROM {out}_w)"""


@query(
    "excerpts",
    f"""WITH {TURNS_SQL}, hit AS (SELECT * FROM turns WHERE contains(lower(text), 'the')), {excerpt_sql('hit', 'ex')}
SELECT session_id, seq, excerpt FROM ex""",
)
def excerpts(spark, root):
    cv = conversation_events(read_table(spark, root, "conversations"))
    return cv.filter(P.contains_all("the")).select(
        "session_id", "seq", X.excerpt(F.col("text"), ["the"]).alias("excerpt")
    )


# ---- predicates ----


@query(
    "filter_speaker",
    f"WITH {TURNS_SQL} SELECT session_id, seq, role FROM turns WHERE kind = 'message' AND role = 'assistant'",
)
def filter_speaker(spark, root):
    cv = conversation_events(read_table(spark, root, "conversations"))
    return cv.filter(P.event_filter(["agent"])).select("session_id", "seq", "role")


@query(
    "filter_union",
    f"""WITH {TURNS_SQL} SELECT session_id, seq, kind, CASE WHEN kind = 'message' AND role = 'user' THEN 'user'
  WHEN kind = 'message' AND role = 'assistant' THEN 'agent' ELSE kind END AS label
FROM turns WHERE (kind = 'message' AND role = 'user') OR kind = 'system'""",
)
def filter_union(spark, root):
    cv = conversation_events(read_table(spark, root, "conversations"))
    return cv.filter(P.event_filter(["user", "system"])).select(
        "session_id", "seq", "kind", P.event_label(F.col("kind"), F.col("role")).alias("label")
    )


@query(
    "since_instants",
    "SELECT CAST(event_id AS VARCHAR) AS source_event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 02:30:00.5'",
)
def since_instants(spark, root):
    ev = read_table(spark, root, "events").select(
        F.col("event_id").cast("string").alias("source_event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    return ev.filter(P.since("2024-01-15T10:30:00.500000000+0800")).select("source_event_id")


@query(
    "short_terms",
    f"WITH {TURNS_SQL} SELECT session_id, seq FROM turns WHERE contains(lower(text), 'of') AND contains(lower(text), 'is')",
)
def short_terms(spark, root):
    cv = conversation_events(read_table(spark, root, "conversations"))
    return cv.filter(P.contains_all("of IS")).select("session_id", "seq")


@query(
    "word_mode",
    f"WITH {TURNS_SQL} SELECT session_id, seq, CAST({_word_count_sql('text', 'the')} AS BIGINT) AS n FROM turns "
    f"WHERE {_word_count_sql('text', 'the')} > 0",
)
def word_mode(spark, root):
    cv = conversation_events(read_table(spark, root, "conversations"))
    return cv.filter(P.contains_all("the", word=True)).select(
        "session_id", "seq", X.occurrences(F.col("text"), "the", True).cast("long").alias("n")
    )


@query(
    "json_payload_filter",
    "SELECT CAST(event_id AS VARCHAR) AS source_event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k "
    "FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90",
)
def json_payload_filter(spark, root):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    ev = read_table(spark, root, "events")
    return ev.select(F.col("event_id").cast("string").alias("source_event_id"), k.alias("k")).filter("k >= 90")


@query(
    "occurrence_counts",
    f"WITH {LINES_SQL} SELECT session_id, CAST(sum({occurrences_sql('lower(text)', 'the')}) AS BIGINT) AS the_n, "
    f"CAST(sum({occurrences_sql('lower(text)', 'ana')}) AS BIGINT) AS ana_n FROM lines WHERE text IS NOT NULL GROUP BY 1",
)
def occurrence_counts(spark, root):
    docs = document_lines(read_table(spark, root, "documents")).filter("text is not null")
    return docs.groupBy("session_id").agg(
        F.sum(X.occurrences(F.col("text"), "the")).alias("the_n"),
        F.sum(X.occurrences(F.col("text"), "ana")).alias("ana_n"),
    )


# ---- runs and windows ----


@query(
    "adjacent_runs_events",
    f"WITH {LOG_RUNS_SQL} SELECT session_id, seq, source_event_id, run_first_seq, run_last_seq FROM ev",
)
def adjacent_runs_events(spark, root):
    return adjacent_runs(log(spark, root)).select("session_id", "seq", "source_event_id", "run_first_seq", "run_last_seq")


@query(
    "adjacent_runs_doc_lines",
    f"WITH {LINES_SQL}, {runs_sql('lines', 'dl')} SELECT session_id, run_first_seq, run_last_seq FROM dl "
    "WHERE seq = run_first_seq AND run_last_seq > run_first_seq",
)
def adjacent_runs_doc_lines(spark, root):
    runs = representatives(adjacent_runs(document_lines(read_table(spark, root, "documents"))))
    return runs.filter("run_last_seq > run_first_seq").select("session_id", "run_first_seq", "run_last_seq")


@query(
    "run_lengths",
    f"WITH {LOG_RUNS_SQL} SELECT run_last_seq - run_first_seq + 1 AS run_length, count(*) AS runs "
    "FROM ev WHERE seq = run_first_seq GROUP BY 1",
)
def run_lengths(spark, root):
    return (
        representatives(run_members(log_runs(spark, root))).groupBy("run_length").agg(F.count("*").alias("runs"))
    )


@query(
    "run_membership",
    f"""WITH {LOG_RUNS_SQL} SELECT session_id, seq, run_last_seq - run_first_seq + 1 AS run_length,
  seq - run_first_seq + 1 AS member_index FROM ev WHERE run_last_seq > run_first_seq""",
)
def run_membership(spark, root):
    members = run_members(log_runs(spark, root)).filter("run_length > 1")
    return members.select("session_id", "seq", "run_length", "member_index")


@query(
    "event_sequence",
    f"WITH {LOG_SQL} SELECT session_id, seq, source_event_id, timestamp FROM lg",
)
def event_sequence(spark, root):
    return log(spark, root).select("session_id", "seq", "source_event_id", "timestamp")


@query(
    "logical_positions",
    f"""WITH {LOG_RUNS_SQL} SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS position
FROM ev WHERE seq = run_first_seq""",
)
def logical_position_query(spark, root):
    return logical_positions(log_runs(spark, root)).select("session_id", "seq", "position")


# ---- sessions and timelines ----

_SUMMARY = """ss AS (SELECT session_id, count(*) AS event_count, min(timestamp) AS first_timestamp,
    max(timestamp) AS last_timestamp FROM lg GROUP BY 1)"""


def log_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of the event log; those whose last event is an error count as archived."""
    ev = read_table(spark, root, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    return N.session_summary(ev).withColumn("harness_id", F.lit("log")).withColumn(
        "accepted_at", F.lit(None).cast("string")
    )


@query("session_summary", f"WITH {LOG_SQL}, {_SUMMARY} SELECT * FROM ss")
def session_summary(spark, root):
    return log_sessions(spark, root).select("session_id", "event_count", "first_timestamp", "last_timestamp")


@query(
    "list_sessions",
    f"WITH {LOG_SQL}, {_SUMMARY} SELECT * FROM ss ORDER BY last_timestamp DESC, session_id LIMIT 50",
)
def list_sessions(spark, root):
    return N.list_sessions(log_sessions(spark, root), 50).select(
        "session_id", "event_count", "first_timestamp", "last_timestamp"
    )


_MARKED = """mk AS (SELECT CAST(user_id AS VARCHAR) AS session_id,
    CASE WHEN max_by(event_type, ts) = 'error' THEN 'archived' ELSE 'active' END AS archive_state FROM events GROUP BY 1)"""


def archive_markers(spark: SparkSession, root: str) -> DataFrame:
    """A user whose last event is an error is archived; others have no marker."""
    ev = read_table(spark, root, "events")
    return (
        ev.groupBy(F.col("user_id").cast("string").alias("session_id"))
        .agg(F.max_by("event_type", "ts").alias("last_type"))
        .filter("last_type = 'error'")
        .select("session_id", F.lit("archived").alias("state"))
    )


@query(
    "archive_filter",
    f"WITH {LOG_SQL}, {_SUMMARY}, {_MARKED} SELECT ss.session_id, event_count, archive_state FROM ss JOIN mk USING (session_id) "
    "WHERE archive_state = 'active'",
)
def archive_filter(spark, root):
    marked = N.archive_states(log_sessions(spark, root), archive_markers(spark, root))
    return P.active_sessions(marked).select("session_id", "event_count", "archive_state")


@query(
    "list_summary",
    f"""WITH {LOG_SQL}, {_SUMMARY}, {_MARKED}
SELECT count(*) AS sessions, min(first_timestamp) AS first_timestamp, max(last_timestamp) AS last_timestamp,
  'log' AS harnesses, count(*) FILTER (WHERE archive_state = 'archived') AS archived,
  min(first_timestamp)[1:10] || ' → ' || max(last_timestamp)[1:10] AS span FROM ss JOIN mk USING (session_id)""",
)
def list_summary(spark, root):
    return N.list_summary(N.archive_states(log_sessions(spark, root), archive_markers(spark, root)))


@query(
    "dated_groups",
    f"""WITH {LOG_SQL}, {_SUMMARY} SELECT last_timestamp[1:10] AS heading, count(*) AS sessions,
  max(last_timestamp) AS newest FROM ss GROUP BY 1""",
)
def dated_groups(spark, root):
    return N.dated_groups(log_sessions(spark, root))


@query("kind_counts", f"WITH {LOG_SQL} SELECT session_id, kind, count(*) AS events FROM lg GROUP BY 1, 2")
def kind_counts(spark, root):
    ev = read_table(spark, root, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("kind")
    )
    return N.kind_counts(ev)


@query(
    "filtered_totals",
    f"""WITH {TURN_RUNS_SQL} SELECT session_id,
  count(*) FILTER (WHERE seq = run_first_seq AND kind = 'message' AND role = 'user') AS total_events, max(seq) AS max_seq,
  max(run_last_seq) FILTER (WHERE seq = run_first_seq AND kind = 'message' AND role = 'user') AS max_filtered_seq
FROM cv GROUP BY 1""",
)
def filtered_totals(spark, root):
    return N.filtered_totals(turns(spark, root), ["user"])


@query(
    "timeline_from",
    f"""WITH {LOG_RUNS_SQL} SELECT seq, run_last_seq, kind, timestamp FROM ev
WHERE session_id = '7' AND seq = run_first_seq AND run_last_seq >= 10 ORDER BY seq LIMIT 50""",
)
def timeline_from(spark, root):
    return N.timeline(log_runs(spark, root), "7", start=10).select("seq", "run_last_seq", "kind", "timestamp")


@query(
    "timeline_tail",
    f"""WITH {LOG_RUNS_SQL} SELECT seq, run_last_seq, kind FROM ev
WHERE session_id = '7' AND seq = run_first_seq ORDER BY seq DESC LIMIT 10""",
)
def timeline_tail(spark, root):
    return N.timeline_tail(log_runs(spark, root), "7", 10).select("seq", "run_last_seq", "kind")


@query(
    "timeline_pages",
    f"""WITH {LOG_RUNS_SQL},
r AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 50 AS page,
    max(run_last_seq) OVER (PARTITION BY session_id) AS most FROM ev WHERE seq = run_first_seq)
SELECT session_id, page, min(seq) AS first_seq, count(*) AS events,
  CASE WHEN max(run_last_seq) < max(most) THEN max(run_last_seq) + 1 END AS next_cursor FROM r GROUP BY 1, 2""",
)
def timeline_pages(spark, root):
    return N.timeline_pages(log_runs(spark, root))


@query(
    "event_at",
    f"WITH {LOG_RUNS_SQL} SELECT seq, source_event_id, run_first_seq, run_last_seq FROM ev WHERE session_id = '7' AND seq = 5",
)
def event_at(spark, root):
    return N.event_at(log_runs(spark, root), "7", 5).select("seq", "source_event_id", "run_first_seq", "run_last_seq")


_LABEL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "session_labels",
    f"""WITH {TURNS_SQL},
u AS (SELECT session_id, min(seq) AS seq FROM turns WHERE kind = 'message' AND role = 'user' AND text IS NOT NULL GROUP BY 1),
l AS (SELECT turns.session_id, turns.seq, regexp_replace({_LABEL}, '((?:api_key|secret|token|password) = ")[0-9A-Za-z]{{20,}}"', '\\1…', 'g') AS line
  FROM turns JOIN u USING (session_id, seq))
SELECT session_id, CASE WHEN length(line) > 120 THEN rtrim(line[1:119]) || '…' ELSE line END AS label,
  'user_message' AS label_source, seq AS label_seq FROM l WHERE line <> ''""",
)
def session_labels(spark, root):
    return N.session_labels(conversation_events(read_table(spark, root, "conversations")))


@query(
    "session_archive_search",
    f"""WITH {LOG_RUNS_SQL}, {_MARKED}
SELECT session_id, count(*) AS matches FROM ev JOIN mk USING (session_id)
WHERE archive_state = 'active' AND seq = run_first_seq AND contains(text, 'view') GROUP BY 1""",
)
def session_archive_search(spark, root):
    sessions = N.archive_states(log_sessions(spark, root), archive_markers(spark, root))
    found = S.text_matches(log_runs(spark, root), sessions, "view")
    return found.groupBy("session_id").agg(F.count("*").alias("matches"))
