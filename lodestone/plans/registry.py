"""Registered queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            configure(spark)
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# ---- SQL pieces shared by the statements ----


def runs_sql(source: str, out: str) -> str:
    """CTEs adding run bounds to ``source``."""
    return f"""
{out}_m AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(text) OVER w = text
      AND (kind <> 'message' OR lag(role) OVER w IS NOT DISTINCT FROM role) THEN 0 ELSE 1 END AS st
    FROM {source} WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
{out}_g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY seq) AS grp FROM {out}_m),
{out} AS (SELECT * EXCLUDE (st, grp), min(seq) OVER (PARTITION BY session_id, grp) AS run_first_seq,
      max(seq) OVER (PARTITION BY session_id, grp) AS run_last_seq FROM {out}_g)"""


TURNS_SQL = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS seq,
    CASE WHEN role = 'system' THEN 'system' ELSE 'message' END AS kind, role, nullif(text, '') AS text
  FROM conversations)"""
TURN_RUNS_SQL = f"{TURNS_SQL}, {runs_sql('turns', 'cv')}"

LOG_SQL = """lg AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS source_event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    event_type AS kind, CAST(NULL AS VARCHAR) AS role, event_type AS text, props, value, ts, event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
  FROM events)"""
LOG_RUNS_SQL = f"{LOG_SQL}, {runs_sql('lg', 'ev')}"

LINES_SQL = """lines AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, lang AS harness_id, source, i AS seq,
    'message' AS kind, CAST(NULL AS VARCHAR) AS role, nullif(parts[i], '') AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS i) u)"""


def occurrences_sql(text: str, term: str) -> str:
    k = len(term)
    return f"len(list_filter(range(1, length({text}) - {k - 2}), lambda i: substring({text}, i, {k}) = '{term}'))"


def bm25_sql(text: str, terms: list[str], stats: str = "st") -> str:
    parts = []
    for i, t in enumerate(terms):
        tf = f"CAST({occurrences_sql(f'lower({text})', t)} AS DOUBLE)"
        raw = f"ln(({stats}.n - {stats}.df{i} + 0.5) / ({stats}.df{i} + 0.5))"
        idf = f"(CASE WHEN {raw} <= 0 THEN 1e-6 ELSE {raw} END)"
        dl = f"greatest(length({text}) - 2, 0)"
        parts.append(f"{idf} * ({tf} * 2.2) / ({tf} + 1.2 * (1 - 0.75 + 0.75 * {dl} / ({stats}.tokens / {stats}.n)))")
    return "-(" + " + ".join(parts) + ")"


def bm25_stats_sql(source: str, terms: list[str]) -> str:
    dfs = ", ".join(
        f"count(*) FILTER (WHERE contains(lower(text), '{t}')) AS df{i}" for i, t in enumerate(terms)
    )
    return (
        f"st AS (SELECT count(text) AS n, sum(greatest(length(text) - 2, 0)) AS tokens, {dfs} "
        f"FROM {source} WHERE text IS NOT NULL)"
    )
