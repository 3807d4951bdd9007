"""Slices, guards and roll-ups that complete the operator inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import paths as H
from lodestone.functions import text as X
from lodestone.operators import families as G
from lodestone.operators import intake as I
from lodestone.operators import layout as L
from lodestone.operators import predicates as P
from lodestone.operators import refresh as U
from lodestone.operators import search as S
from lodestone.operators import sessions as N
from lodestone.plans.family_queries import _COPIES, copies, doc_sessions, lines
from lodestone.plans.governance_queries import (
    _CLASSIFIED,
    _LEDGERS,
    _NOW,
    _PAGES,
    classified_pages,
    ledgers,
    order_candidates,
    page_evaluations,
)
from lodestone.plans.registry import (
    LINES_SQL,
    LOG_RUNS_SQL,
    LOG_SQL,
    TURN_RUNS_SQL,
    TURNS_SQL,
    bm25_sql,
    bm25_stats_sql,
    query,
)
from lodestone.plans.search_queries import _SUMMARY, excerpt_sql, log_runs, log_sessions, turns
from lodestone.plans.transcript_queries import _ROLLOUT, claude_events, codex_lines
from lodestone.session import fresh_path, stage
from lodestone.sources import codex
from lodestone.sources.jsonl import fingerprint_files, parsed
from lodestone.sources.tables import conversation_events, read_table, whole_documents
from lodestone.streaming.events import withheld_age_alerts

_SES = "'ses_' || sha256('claude-code' || chr(10) || 's' || conv_id)[1:32]"


@query(
    "subagent_slice",
    f"SELECT {_SES} AS session_id, turn + 1 AS seq, 'a' || conv_id AS subagent_id FROM conversations WHERE role = 'system'",
)
def subagent_slice(spark, root):
    return claude_events(spark, root).filter(P.event_filter(["subagent"])).select("session_id", "seq", "subagent_id")


@query(
    "harness_filter",
    "SELECT CAST(doc_id AS VARCHAR) AS session_id FROM documents WHERE lang = 'fr' AND contains(lower(text), 'eau')",
)
def harness_filter(spark, root):
    ev = whole_documents(read_table(spark, root, "documents")).withColumn("run_first_seq", F.col("seq"))
    return S.text_matches(ev, None, "eau", harness="fr").select("session_id")


@query(
    "search_since",
    f"""WITH {LOG_RUNS_SQL} SELECT session_id, seq FROM ev WHERE seq = run_first_seq AND contains(text, 'error') AND ts >= TIMESTAMP '2024-01-20 00:00:00'""",
)
def search_since(spark, root):
    return S.text_matches(log_runs(spark, root), None, "error", since_bound="2024-01-20").select("session_id", "seq")


@query(
    "representatives",
    f"WITH {TURN_RUNS_SQL} SELECT session_id, count(*) AS events, count(*) FILTER (WHERE seq = run_first_seq) AS logical FROM cv GROUP BY 1",
)
def representatives(spark, root):
    return turns(spark, root).groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("seq") == F.col("run_first_seq")).alias("logical")
    )


@query(
    "candidate_status",
    f"WITH {_CLASSIFIED} SELECT candidate_id, class FROM cl WHERE class = 'pending' OR (class = 'associated' AND contains(html, 'track('))",
)
def candidate_status(spark, root):
    c = classified_pages(spark, root).withColumn("has_evaluation", F.contains("html", F.lit("track(")))
    return c.filter(P.candidate_status(["pending", "flagged"])).select("candidate_id", "class")


@query(
    "visible_sessions",
    f"""WITH {_LEDGERS} SELECT CAST(o_orderkey AS VARCHAR) AS session_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT unit FROM lo)
  AND o_orderpriority <> '5-LOW' AND o_totalprice >= 1000""",
)
def visible_sessions(spark, root):
    o = read_table(spark, root, "orders").withColumn("session_id", F.col("o_orderkey").cast("string"))
    gone = ledgers(spark, root)[0].select(F.col("unit").alias("session_id"))
    return P.visible(
        o.select("session_id"), gone, o.filter("o_orderpriority = '5-LOW'"), o.filter("o_totalprice < 1000")
    )


@query(
    "rollout_candidates",
    f"""WITH {_ROLLOUT}, f AS (SELECT source_session_id, min(line) FILTER (WHERE pos = 1) AS reported,
    min(line) FILTER (WHERE event_type = 'signup' AND pos = 0) AS legacy FROM rr GROUP BY 1)
SELECT source_session_id, CASE WHEN coalesce(reported, legacy) IS NOT NULL THEN 'sign up ' || (coalesce(reported, legacy) - 1) // 2 END AS label, false AS subagent_origin FROM f""",
)
def rollout_candidates(spark, root):
    found = codex.candidates(parsed(codex_lines(spark, root)))
    return found.select(F.lower("source_session_id").alias("source_session_id"), "label", "subagent_origin")


@query(
    "subagent_counts",
    f"""WITH {LINES_SQL} SELECT session_id, count(*) FILTER (WHERE text IS NOT NULL) AS subagent_count FROM lines GROUP BY 1""",
)
def subagent_counts(spark, root):
    """Lines with text stand for transcripts of subagents, empty ones for sidecars."""
    name = F.when(F.col("text").isNotNull(), F.lit(".jsonl")).otherwise(F.lit(".meta.json"))
    files = lines(spark, root).select(
        "session_id", F.concat(F.lit(H.SUBAGENT_DIR + "agent-"), F.col("seq").cast("string"), name).alias("path")
    )
    return N.subagent_counts(files)


@query(
    "bundle_sizes",
    "SELECT source AS session_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents GROUP BY 1",
)
def bundle_sizes(spark, root):
    d = read_table(spark, root, "documents")
    return I.bundle_sizes(d.select(F.col("source").alias("session_id"), F.octet_length("text").cast("long").alias("size")))


_FILES_SQL = """SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn // 64 AS VARCHAR) AS section, CAST(sum(2 * strlen(text) + 1) AS BIGINT) AS size,
  sha256(string_agg(hex(text) || chr(10), '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1, 2"""


@query("fingerprint_sizes", _FILES_SQL)
def fingerprint_sizes(spark, root):
    """Whole turns written as files, a line each and a file for every 64 turns, then fingerprinted."""
    return _fingerprints(spark, root)


@query("fingerprint_ranges", _FILES_SQL)
def fingerprint_ranges(spark, root):
    """The same files through running digests, as files of any size are."""
    return _fingerprints(spark, root, whole_bytes=0)


def _fingerprints(spark, root, **bounds):
    out = fresh_path(spark, "files")
    c = read_table(spark, root, "conversations").select(
        F.col("conv_id").cast("string").alias("conv"), F.floor(F.col("turn") / 64).cast("string").alias("section"), "turn",
        F.hex(F.coalesce("text", F.lit(""))).alias("value"),
    )
    placed = c.repartitionByRange("conv", "section").sortWithinPartitions("conv", "section", "turn")
    placed.select("conv", "section", "value").write.partitionBy("conv", "section").text(out)
    part = lambda i: F.regexp_extract("file", "conv=([^/]+)/section=([^/]+)/", i)
    return fingerprint_files(spark, out, "*.txt", **bounds).select(part(1).alias("conv"), part(2).alias("section"), "size", "sha256")


@query(
    "visible_family_facts",
    f"""WITH {_COPIES}, m AS (SELECT * FROM cp JOIN cf USING (lang, text) WHERE n >= 2),
g AS (SELECT lang, text, count(*) AS member_count, any_value(anchor) AS anchor, any_value(family_key) AS family_key FROM m GROUP BY 1, 2)
SELECT session_id, g.family_key, g.anchor, member_count FROM m JOIN g USING (lang, text)""",
)
def visible_family_facts(spark, root):
    ev = copies(spark, root)
    families, sessions = G.fork_families(ev), doc_sessions(spark, root)
    kept, dropped = S.collapse_copies(ev, families, sessions)
    return G.visible_family_facts(kept, dropped, sessions, families)


@query("validate_projection", f"WITH {LOG_SQL}, {_SUMMARY} SELECT session_id, event_count FROM ss")
def validate_projection(spark, root):
    expected = read_table(spark, root, "events").select("user_id").distinct()
    return N.expect_sessions(log_sessions(spark, root), expected).select("session_id", "event_count")


@query(
    "adopt_decisions",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS candidate_id, CASE WHEN toxic = 1 THEN 'ignore' ELSE 'associate' END AS action,
    CASE WHEN toxic = 0 THEN 'old' END AS project_id, quality FROM labels),
t AS (SELECT candidate_id, action, project_id FROM d WHERE quality = 0)
SELECT * FROM t UNION ALL SELECT candidate_id, action, CASE WHEN action = 'associate' THEN 'new' END FROM d
WHERE candidate_id NOT IN (SELECT candidate_id FROM t)""",
)
def adopt_decisions(spark, root):
    toxic = F.col("toxic") == 1
    d = read_table(spark, root, "labels").select(
        F.col("doc_id").cast("string").alias("candidate_id"),
        F.when(toxic, F.lit("ignore")).otherwise(F.lit("associate")).alias("action"),
        F.when(~toxic, F.lit("old")).alias("project_id"),
        "quality",
    )
    return I.adopt_decisions(d.drop("quality"), d.filter("quality = 0").drop("quality"), "old", "new")


@query(
    "latest_versions",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey FROM orders
QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""",
)
def latest_versions(spark, root):
    o = read_table(spark, root, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderdate").alias("modified_at"), "o_orderkey"
    )
    return U.latest_versions(o).select("session_id", "o_orderkey")


@query(
    "withheld_age_alerts",
    f"""WITH {_PAGES} SELECT count(*) AS count, min(strftime(DATE '2024-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%d')) AS oldest, true AS retention_warning
FROM pg WHERE contains(html, 'track(') HAVING date_diff('day', min(DATE '2024-01-01' + CAST(page_id AS INTEGER)), DATE '{_NOW}') >= 14""",
)
def withheld_age_alerts_query(spark, root):
    return withheld_age_alerts(page_evaluations(spark, root), F.lit(_NOW).cast("timestamp"))


@query(
    "width_forms",
    f"""WITH {TURNS_SQL}, w AS (SELECT *, 2 * length(text) - length(regexp_replace(text, '{X.WIDE}', '', 'g')) AS cells,
  list_max(list_filter(range(0, 40), lambda k: 2 * length(text[1:k]) - length(regexp_replace(text[1:k], '{X.WIDE}', '', 'g')) <= 39)) AS kept FROM turns)
SELECT session_id, seq, CASE WHEN cells > 40 THEN regexp_replace(text[1:kept], '\\s+$', '') || '…' ELSE text END AS cut,
  text || repeat(' ', greatest(0, 60 - cells)) AS padded FROM w""",
)
def width_forms(spark, root):
    c = conversation_events(read_table(spark, root, "conversations"))
    return c.select(
        "session_id", "seq", X.truncate_width(F.col("text"), 40).alias("cut"), X.pad_width(F.col("text"), 60).alias("padded")
    )


@query(
    "terms_visible",
    f"""WITH {TURNS_SQL} SELECT count(*) AS matches, count(*) AS all_terms_visible FROM turns WHERE contains(lower(text), 'the')""",
)
def terms_visible(spark, root):
    from lodestone.operators.evaluate import terms_visible as visible

    c = conversation_events(read_table(spark, root, "conversations")).filter(P.contains_all("the"))
    return visible(c.select(X.excerpt(F.col("text"), ["the"]).alias("excerpt")), ["the"])


@query(
    "conflict_listing",
    """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, sha256(CAST(o_orderkey AS VARCHAR))[1:16] AS key,
    sha256(o_orderstatus || o_orderpriority) AS digest, strftime(o_orderdate, '%Y-%m-%d') AS accepted_at FROM orders)
SELECT session_id, digest, accepted_at, key FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM c) WHERE n >= 2
ORDER BY session_id, digest, accepted_at, key""",
)
def conflict_listing(spark, root):
    from lodestone.operators.merges import candidate_order, capture_conflicts

    listed = capture_conflicts(order_candidates(spark, root)).orderBy(*candidate_order())
    return listed.select("session_id", "digest", "accepted_at", "key")


@query(
    "tombstone_listing",
    f"""WITH {_LEDGERS} SELECT unit, epoch, deleted_at, replica FROM lo
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderkey AS VARCHAR) = unit AND o_orderstatus = 'O')
ORDER BY epoch, deleted_at, replica, unit""",
)
def tombstone_listing(spark, root):
    from lodestone.operators.merges import ledger_order, tombstones

    live = read_table(spark, root, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("session_id"))
    return tombstones(ledgers(spark, root)[0], live).orderBy(*ledger_order())


@query(
    "next_cursor",
    f"""WITH {LOG_RUNS_SQL}, p AS (SELECT * FROM ev WHERE session_id = '7' AND seq = run_first_seq ORDER BY seq LIMIT 20)
SELECT CASE WHEN max(p.run_last_seq) < (SELECT max(run_last_seq) FROM ev WHERE session_id = '7') THEN max(p.run_last_seq) + 1 END AS next_cursor FROM p""",
)
def next_cursor(spark, root):
    ev = log_runs(spark, root)
    return N.next_cursor(N.timeline(ev, "7", limit=20), ev, "7")


# ---- result documents of one search, byte for byte ----

_THE = f"""{TURN_RUNS_SQL}, {bm25_stats_sql('cv', ['the'])},
m AS (SELECT cv.*, {bm25_sql('text', ['the'])} AS rank FROM cv, st WHERE text IS NOT NULL AND contains(lower(text), 'the') AND seq = run_first_seq),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank, seq) AS rn, min(rank) OVER (PARTITION BY session_id) AS best FROM m),
sh AS (SELECT * FROM c WHERE rn <= 3 ORDER BY best, session_id, rn LIMIT 20), {excerpt_sql('sh', 'ex')},
j AS (SELECT *, '"eventSeq":' || seq || ',"eventKind":' || to_json(kind) || ',"role":' || to_json(role) || ',"timestamp":null,"excerpt":' || to_json(excerpt) || ',"locator":{{' AS body,
  '"sourceCursor":"line:' || seq || '","sourceEventId":null}}}}' AS tail, '"sourceFile":"conversations/' || session_id || '",' AS file,
  '{{"sessionId":' || to_json(session_id) || ',"harnessId":"chat",' AS head FROM ex),
fl AS (SELECT '{{"matches":[' || string_agg(head || body || file || tail, ',' ORDER BY best, session_id, seq) || ']}}' AS doc FROM j),
gr AS (SELECT best, session_id, head || file || '"matches":[' || string_agg('{{' || body || tail, ',' ORDER BY seq) || ']}}' AS g FROM j GROUP BY best, session_id, head, file),
gd AS (SELECT '{{"layout":"grouped","groups":[' || string_agg(g, ',' ORDER BY best, session_id) || ']}}' AS doc FROM gr)"""


@query(
    "result_documents",
    f"""WITH {_THE} SELECT strlen(fl.doc) AS flat_bytes, strlen(gd.doc) AS grouped_bytes, sha256(fl.doc) AS flat_digest, sha256(gd.doc) AS grouped_digest,
  CASE WHEN strlen(gd.doc) < strlen(fl.doc) THEN 'grouped' ELSE 'flat' END AS layout FROM fl, gd""",
)
def result_documents(spark, root):
    shown = S.search_text(turns(spark, root), None, "the").matches.drop("_newest")
    # numbers the rows of one result, at most the limit
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("best_rank", "session_id", "seq"))
    rows = stage(L.result_rows(shown.withColumn("ord", place), "ord"), "result")
    docs = L.result_documents(rows)
    return docs.select(
        F.col("flat_bytes").cast("long").alias("flat_bytes"), F.col("grouped_bytes").cast("long").alias("grouped_bytes"),
        F.sha2("flat", 256).alias("flat_digest"), F.sha2("grouped", 256).alias("grouped_digest"), "layout",
    )
