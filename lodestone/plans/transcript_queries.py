"""Transcripts derived from the tables, normalized again; layouts, sinks, evaluation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as H
from lodestone.functions import text as X
from lodestone.functions.json import canonical_json, sparse_json
from lodestone.functions.secrets import session_label_text
from lodestone.operators import details as D
from lodestone.operators import evaluate as E
from lodestone.operators import families as G
from lodestone.operators import layout as L
from lodestone.operators import refresh as U
from lodestone.operators import search as S
from lodestone.operators import sessions as N
from lodestone.operators.blocks import block_of
from lodestone.operators.canonical import canonical_documents
from lodestone.operators.runs import adjacent_runs
from lodestone.plans.family_queries import _FAMILIES, copies, doc_sessions, lines
from lodestone.plans.registry import LINES_SQL, LOG_RUNS_SQL, LOG_SQL, TURNS_SQL, query
from lodestone.plans.search_queries import _LABEL, _MARKED, _SUMMARY, archive_markers, log_runs, log_sessions, turns
from lodestone.session import fresh_path, stage
from lodestone.sources import claude, codex
from lodestone.sources.jsonl import joined_parts, parsed, read_jsonl, revisions
from lodestone.sources.projection import (
    current_pointer,
    export_sessions,
    freshness,
    read_projection,
    session_documents,
    write_projection,
)
from lodestone.sources.tables import iso_micros, read_table
from lodestone.streaming.events import (
    compact_log,
    latest_of,
    latest_to_log,
    stream_age_alerts,
    stream_dedup_copies,
    stream_monotonic_latest,
    to_table,
)
from lodestone.streaming.runs import late_rows, runs_so_far, stream_adjacent_runs
from lodestone.streaming.upsert import current, ingest_transcripts, stream_upsert, transcripts


# ---- conversations as transcripts of the first harness ----


def claude_lines(spark: SparkSession, root: str) -> DataFrame:
    """Each conversation as a transcript.

    Assistants answer in blocks and read the file their turn names; system turns
    are an agent's side chain.
    """
    c = read_table(spark, root, "conversations")
    text_block = F.struct(
        F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("struct<file_path:string>").alias("input"),
    )
    use_block = F.struct(
        F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"),
        F.struct(F.concat(F.lit("/work/"), F.col("turn").cast("string"), F.lit(".txt")).alias("file_path")).alias("input"),
    )
    blocks = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(text_block, use_block).alias("content")))
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    message = F.when(F.col("role") == "assistant", blocks).otherwise(plain)
    record = F.concat(
        F.lit('{"type":"'), "role",
        F.lit('","sessionId":"s'), F.col("conv_id").cast("string"),
        F.lit('","uuid":"u'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
        F.lit('","message":'), message,
        F.when(F.col("role") == "system", F.concat(F.lit(',"isSidechain":true,"agentId":"a'), F.col("conv_id").cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.lit("}"),
    )
    return c.select(
        F.concat(F.lit("/x/projects/p/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"),
        block_of(F.col("turn") + 1).alias("block"),
        (F.col("turn") + 1).alias("line"),
        record.alias("raw"),
    )


def _placed(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("folder", F.lit("p"))
        .withColumn("stem", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
        .withColumn("bundle_path", F.lit(H.TRANSCRIPT))
        .withColumn("is_sub", F.lit(False))
    )


def claude_events(spark: SparkSession, root: str) -> DataFrame:
    return claude.normalize(_placed(parsed(claude_lines(spark, root))))


_EVENTS = """SELECT 'ses_' || sha256('claude-code' || chr(10) || 's' || conv_id)[1:32] AS session_id, turn + 1 AS seq,
  CASE role WHEN 'assistant' THEN 'tool_call' WHEN 'user' THEN 'message' ELSE 'system' END AS kind, role,
  'u' || conv_id || '-' || turn AS source_event_id, 'line:' || (turn + 1) AS source_cursor, sha256(text) AS text_digest,
  CASE WHEN role = 'assistant' THEN 'Read' ELSE '' END AS tools, CASE WHEN role = 'assistant' THEN 'read /work/' || turn || '.txt' ELSE '' END AS touches
FROM conversations"""


def _event_view(ev: DataFrame) -> DataFrame:
    return ev.select(
        "session_id", "seq", "kind", "role", "source_event_id", "source_cursor", F.sha2("text", 256).alias("text_digest"),
        F.array_join("tool_names", ",").alias("tools"),
        F.array_join(F.transform("file_touches", lambda t: F.concat_ws(" ", t["operation"], t["normalized_path"])), ",").alias("touches"),
    )


@query("transcript_events", _EVENTS)
def transcript_events(spark, root):
    return _event_view(claude_events(spark, root))


def written_transcripts(spark: SparkSession, root: str) -> str:
    """The derived transcripts as JSONL files, a folder per conversation."""
    out = fresh_path(spark, "transcripts")
    rows = claude_lines(spark, root).select(
        F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("conv"), "line", F.col("raw").alias("value")
    )
    ordered = rows.repartitionByRange("conv", "line").sortWithinPartitions("conv", "line")
    ordered.select("conv", "value").write.partitionBy("conv").text(out)
    return out


@query("jsonl_files", "SELECT CAST(conv_id AS VARCHAR) AS conv, turn + 1 AS line, 'u' || conv_id || '-' || turn AS uuid FROM conversations")
def jsonl_files(spark, root):
    got = joined_parts(read_jsonl(spark, written_transcripts(spark, root), "*.txt"))
    return got.select(
        F.regexp_extract("file", "conv=([^/]+)/", 1).alias("conv"), "line",
        F.try_variant_get("value", "$.uuid", "string").alias("uuid"),
    )


@query(
    "transcript_candidates",
    f"""SELECT 'ses_' || sha256('claude-code' || chr(10) || 's' || conv_id)[1:32] AS candidate_id, 's' || conv_id AS source_session_id,
  CASE WHEN length(line) > 120 THEN rtrim(line[1:119]) || '…' ELSE line END AS label
FROM (SELECT conv_id, first({_LABEL} ORDER BY turn) AS line FROM conversations WHERE role = 'user' GROUP BY 1)""",
)
def transcript_candidates(spark, root):
    return claude.candidates(_placed(parsed(claude_lines(spark, root)))).select("candidate_id", "source_session_id", "label")


@query(
    "tool_slice",
    "SELECT 'ses_' || sha256('claude-code' || chr(10) || 's' || conv_id)[1:32] AS session_id, turn + 1 AS seq FROM conversations WHERE role = 'assistant'",
)
def tool_slice(spark, root):
    from lodestone.operators.predicates import event_filter

    return claude_events(spark, root).filter(event_filter(["toolcall:read"])).select("session_id", "seq")


_SES = "'ses_' || sha256('claude-code' || chr(10) || 's' || conv_id)[1:32]"


@query(
    "search_file_touches",
    f"""WITH t AS (SELECT {_SES} AS session_id, turn + 1 AS seq FROM conversations WHERE role = 'assistant' AND turn = 3)
SELECT session_id, seq, 'read' AS operation, '/work/3.txt' AS source_path FROM t ORDER BY session_id, seq LIMIT 20""",
)
def search_file_touches(spark, root):
    found = S.search_file_touches(adjacent_runs(claude_events(spark, root)), None, "3.txt")
    return found.matches.select("session_id", "seq", "operation", "source_path")


@query(
    "file_touch_totals",
    """SELECT count(*) AS total_matches, count(DISTINCT conv_id) AS total_sessions, CAST(0 AS BIGINT) AS family_collapsed_matches
FROM conversations WHERE role = 'assistant' AND turn = 3""",
)
def file_touch_totals(spark, root):
    return S.search_file_touches(adjacent_runs(claude_events(spark, root)), None, "work/3.txt").totals


@query(
    "semi_touch",
    f"""SELECT {_SES} AS session_id, turn + 1 AS seq FROM conversations WHERE conv_id IN
(SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn = 3) AND contains(lower(text), 'the')""",
)
def semi_touch(spark, root):
    from lodestone.operators.predicates import contains_all, with_touch

    ev = claude_events(spark, root)
    return with_touch(ev, "3.txt").filter(contains_all("the")).select("session_id", "seq")


@query(
    "touch_counts",
    f"SELECT {_SES} AS session_id, count(*) FILTER (WHERE role = 'assistant') AS file_touches FROM conversations GROUP BY 1",
)
def touch_counts(spark, root):
    return N.touch_counts(claude_events(spark, root))


@query(
    "touch_table",
    f"SELECT {_SES} AS session_id, turn + 1 AS seq, 'read' AS operation, '/work/' || turn || '.txt' AS source_path FROM conversations WHERE role = 'assistant'",
)
def touch_table(spark, root):
    return U.touch_table(claude_events(spark, root)).select("session_id", "seq", "operation", "source_path")


@query(
    "verify_citations",
    f"SELECT {_SES} AS session_id, turn + 1 AS seq, true AS text_exact, true AS timestamp_exact, true AS locator_exact FROM conversations",
)
def verify_citations(spark, root):
    cited = claude_events(spark, root).select(
        "session_id", "seq", "text", "timestamp", "source_event_id",
        F.regexp_extract("source_cursor", r"line:(\d+)", 1).cast("long").alias("line"),
        F.concat(F.lit("s"), F.regexp_extract("source_event_id", r"u(\d+)-", 1)).alias("source_file"),
    )
    source = read_table(spark, root, "conversations").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source_file"),
        (F.col("turn") + 1).alias("line"), "text", F.lit(None).cast("string").alias("timestamp"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("source_event_id"),
    )
    return E.verify_citations(cited, source)


@query(
    "revision_digests",
    f"""WITH {LINES_SQL}, f AS (SELECT session_id, 'source/' || seq AS path, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS sha FROM lines)
SELECT session_id, sha256(string_agg(d, chr(10) ORDER BY cut)) AS revision_digest, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(b) AS BIGINT) AS total_bytes
FROM (SELECT session_id, substr(sha256(path), 1, 3) AS cut, count(*) AS n, sum(size) AS b,
    sha256(string_agg(path || chr(10) || size || chr(10) || sha, chr(10) || '---' || chr(10) ORDER BY path, size, sha)) AS d FROM f GROUP BY 1, 2) GROUP BY 1""",
)
def revision_digests(spark, root):
    body = F.coalesce("text", F.lit(""))
    files = lines(spark, root).select(
        "session_id", F.concat(F.lit("source/"), F.col("seq").cast("string")).alias("path"),
        F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"),
    )
    return revisions(files)


@query("partial_issues", "SELECT CAST(page_id AS VARCHAR) AS session_id, CAST(1 AS BIGINT) AS unparseable, false AS failed, false AS changed, true AS partial FROM pages")
def partial_issues(spark, root):
    # a page is no JSON, so every page is one unparseable record
    raw = read_table(spark, root, "pages").select(F.col("page_id").cast("string").alias("session_id"), F.col("html").alias("raw"))
    return U.partial_issues(parsed(raw))


# ---- rollouts of the second harness from the event log ----


def codex_lines(spark: SparkSession, root: str) -> DataFrame:
    """The log as rollouts: signups are the user's words, sent and reported; views are shell commands."""
    ev = read_table(spark, root, "events")
    stamp = F.concat(F.lit('{"timestamp":"'), iso_micros(F.col("ts")), F.lit('",'))
    words = F.concat(F.lit("sign up "), F.col("event_id").cast("string"))
    said = F.concat(stamp, F.lit('"type":"response_item","payload":{"type":"message","role":"user","content":[{"text":"'), words, F.lit('"}]}}'))
    report = F.concat(stamp, F.lit('"type":"event_msg","payload":{"type":"user_message","message":"'), words, F.lit('"}}'))
    shell = F.concat(stamp, F.lit('"type":"event_msg","payload":{"type":"exec_command_begin","command":["view","'), F.col("event_id").cast("string"), F.lit('"]}}'))
    patch = F.concat(stamp, F.lit('"type":"event_msg","payload":{"type":"patch_apply_end","changes":{"/p/'), F.col("event_id").cast("string"), F.lit('":{"type":"add"}}}}'))
    other = F.concat(stamp, F.lit('"type":"'), "event_type", F.lit('"}'))
    records = (
        F.when((F.col("event_type") == "signup") & (F.col("value") < 50), F.array(said, report))
        .when(F.col("event_type") == "signup", F.array(said))
        .when(F.col("event_type") == "view", F.array(shell))
        .when(F.col("event_type") == "purchase", F.array(patch))
        .otherwise(F.array(other))
    )
    # lines are numbered by event, two to each, so a file's order is the log's
    return ev.select("user_id", "event_id", F.posexplode(records).alias("pos", "raw")).select(
        F.concat(F.lit("/x/sessions/r-"), F.lpad(F.hex("user_id"), 8, "0"), F.lit("-0000-0000-0000-000000000000.jsonl")).alias("file"),
        block_of(F.col("event_id") * 2 + F.col("pos") + 1).alias("block"),
        (F.col("event_id") * 2 + F.col("pos") + 1).alias("line"),
        "raw",
    )


_ROLLOUT = r"""rl AS (SELECT user_id, event_id, event_type, value, ts, u.pos FROM events e, LATERAL (SELECT unnest(CASE WHEN event_type = 'signup' AND value < 50 THEN [0, 1] ELSE [0] END) AS pos) u),
rr AS (SELECT lower(lpad(printf('%x', user_id), 8, '0')) || '-0000-0000-0000-000000000000' AS source_session_id, event_id, event_type, pos, value,
  event_id * 2 + pos + 1 AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id, pos) AS seq FROM rl)"""


@query(
    "rollout_events",
    f"""WITH {_ROLLOUT} SELECT source_session_id, seq, 'line:' || line AS source_cursor,
  CASE event_type WHEN 'signup' THEN 'message' WHEN 'view' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' ELSE 'unknown' END AS kind,
  CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'purchase' THEN 'assistant' END AS role,
  CASE event_type WHEN 'signup' THEN 'sign up ' || event_id WHEN 'view' THEN 'view ' || event_id WHEN 'purchase' THEN 'apply_patch' END AS text,
  CASE WHEN event_type = 'view' THEN 'shell' ELSE '' END AS tools,
  CASE WHEN event_type = 'purchase' THEN 'created /p/' || event_id ELSE '' END AS touches,
  event_type = 'signup' AND value >= 50 AND source_session_id IN (SELECT source_session_id FROM rr WHERE pos = 1) AS injected
FROM rr""",
)
def rollout_events(spark, root):
    ev = codex.normalize(parsed(codex_lines(spark, root)).withColumn("bundle_path", F.lit(H.TRANSCRIPT)))
    return ev.select(
        F.lower("source_session_id").alias("source_session_id"), "seq", "source_cursor", "kind", "role", "text", F.array_join("tool_names", ",").alias("tools"),
        F.array_join(F.transform("file_touches", lambda t: F.concat_ws(" ", t["operation"], t["source_path"])), ",").alias("touches"),
        F.col("harness_injected").alias("injected"),
    )


# ---- text scalars over whole tables ----


@query(
    "one_line_label",
    f"SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN length(l) > 120 THEN rtrim(l[1:119]) || '…' ELSE l END AS label "
    f"FROM (SELECT doc_id, nullif(regexp_replace({_LABEL}, '((?:api_key|secret|token|password) = \")[0-9A-Za-z]{{20,}}\"', '\\1…', 'g'), '') AS l FROM documents)",
)
def one_line_label(spark, root):
    d = read_table(spark, root, "documents")
    return d.select(F.col("doc_id").cast("string").alias("session_id"), session_label_text(F.col("text")).alias("label"))


@query(
    "display_widths",
    f"""WITH {TURNS_SQL} SELECT session_id, seq, length(text) + length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS width,
  length(text[1:39]) AS cut FROM turns""",
)
def display_widths(spark, root):
    from lodestone.sources.tables import conversation_events

    c = conversation_events(read_table(spark, root, "conversations"))
    return c.select("session_id", "seq", X.display_width(F.col("text")).cast("long").alias("width"), F.length(F.substring("text", 1, 39)).cast("long").alias("cut"))


@query(
    "term_ranges",
    f"""WITH {TURNS_SQL}, p AS (SELECT session_id, seq, unnest(list_filter(range(1, length(text) + 1), lambda i:
    substring(lower(text), i, 3) = 'tio' OR substring(lower(text), i, 3) = 'ion')) AS s FROM turns),
g AS (SELECT *, CASE WHEN s <= lag(s + 3) OVER (PARTITION BY session_id, seq ORDER BY s) THEN 0 ELSE 1 END AS st FROM p),
h AS (SELECT *, sum(st) OVER (PARTITION BY session_id, seq ORDER BY s) AS grp FROM g)
SELECT session_id, seq, CAST(min(s) AS BIGINT) AS range_start, CAST(max(s) + 3 AS BIGINT) AS range_end FROM h GROUP BY session_id, seq, grp""",
)
def term_ranges(spark, root):
    from lodestone.sources.tables import conversation_events

    c = conversation_events(read_table(spark, root, "conversations")).filter("text is not null")
    both = F.concat(X.term_positions(F.col("text"), "tio"), X.term_positions(F.col("text"), "ion"))
    ranges = F.transform(both, lambda s: F.struct(s.alias("start"), (s + 3).alias("end")))
    return c.select("session_id", "seq", F.explode(X.merge_ranges(ranges)).alias("r")).select(
        "session_id", "seq", F.col("r.start").cast("long").alias("range_start"), F.col("r.end").cast("long").alias("range_end")
    )


@query(
    "path_parts",
    "SELECT page_id, list_last(string_split(url, '/')) AS base, CAST(len(string_split(url, '/')) AS BIGINT) AS suffixes, string_split(url, '-')[1] AS short FROM pages",
)
def path_parts(spark, root):
    p = read_table(spark, root, "pages")
    u = F.col("url")
    return p.select("page_id", H.basename(u).alias("base"), F.size(H.path_suffixes(u)).cast("long").alias("suffixes"), H.short_id(u).alias("short"))


@query(
    "canonical_documents",
    """SELECT c_custkey, '{' || chr(10) || '  "schemaVersion": 1,' || chr(10) || '  "store": {' || chr(10)
  || '    "a": [' || chr(10) || '      ' || c_nationkey || ',' || chr(10) || '      {' || chr(10) || '        "b": null,' || chr(10)
  || '        "z": []' || chr(10) || '      }' || chr(10) || '    ],' || chr(10) || '    "segment": "' || c_mktsegment || '"' || chr(10) || '  },' || chr(10)
  || '  "B": {},' || chr(10) || '  "name": "' || c_name || '"' || chr(10) || '}' || chr(10) AS canonical FROM customer""",
)
def canonical_documents_query(spark, root):
    """Customers as nested documents whose keys stand in another order."""
    c = read_table(spark, root, "customer")
    nested = F.format_string(
        '{"name":"%s", "B":{}, "store":{"segment":"%s","a":[%d,{"z":[],"b":null}]}, "schemaVersion":1}', "c_name", "c_mktsegment", "c_nationkey"
    )
    return canonical_documents(c.select("c_custkey", nested.alias("raw")), "raw", ["schemaVersion", "projectId", "store"]).select("c_custkey", "canonical")


@query(
    "canonical_json",
    """SELECT o_orderkey, '{"status":"' || o_orderstatus || '","cust":"' || o_custkey || '","priority":"' || o_orderpriority || '"}' AS doc FROM orders""",
)
def canonical_json_query(spark, root):
    o = read_table(spark, root, "orders")
    q = lambda c: L.quoted(F.col(c).cast("string"))
    entries = F.create_map(F.lit("priority"), q("o_orderpriority"), F.lit("cust"), q("o_custkey"), F.lit("status"), q("o_orderstatus"))
    return o.select("o_orderkey", canonical_json(entries, ["status"]).alias("doc"))


@query(
    "omit_defaults_json",
    f"""WITH {LOG_SQL}, {_SUMMARY}, {_MARKED} SELECT session_id, '{{"sessionId":"' || session_id || '"' ||
  CASE WHEN archive_state = 'archived' THEN ',"archiveState":"archived"' ELSE '' END || ',"eventCount":' || event_count || '}}' AS doc FROM ss JOIN mk USING (session_id)""",
)
def omit_defaults_json(spark, root):
    s = N.archive_states(log_sessions(spark, root), archive_markers(spark, root))
    doc = sparse_json(
        {"sessionId": F.col("session_id"), "archiveState": (F.col("archive_state"), "active"), "eventCount": (F.col("event_count"), 0),
         "acceptedAt": F.col("accepted_at")},
        always=["sessionId"],
    )
    return s.select("session_id", doc.alias("doc"))


# ---- result documents ----


def result_rows(spark: SparkSession, root: str, context: int = 2) -> DataFrame:
    from pyspark.sql import Window

    events = turns(spark, root)
    shown = S.search_text(events, None, "the tion").matches.drop("_newest")
    # numbers the rows of one result, at most the limit
    shown = shown.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("best_rank", "session_id", "seq")))
    shown = stage(shown, "shown")
    around = S.context_window(shown, events, context)
    return stage(L.result_rows(shown, "ord", around, events), "result")


@query("compact_layout_bytes")
def compact_layout_bytes(spark, root):
    docs = L.result_documents(result_rows(spark, root))
    return docs.select("flat_bytes", "grouped_bytes", "layout")


@query("layout_round_trip")
def layout_round_trip(spark, root):
    rows = result_rows(spark, root)
    rebuilt = L.expand_groups(L.result_documents(rows)).select("json")
    flat = L.flat_json(rows).select("json")
    return rebuilt.exceptAll(flat).agg(F.count("*").alias("lost")).select(
        "lost", flat.exceptAll(rebuilt).agg(F.count("*").alias("n")).scalar().alias("missing")
    )


# ---- retrieval evaluation ----


def _passages(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


_CONTAINED = "SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS session_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query("passage_containment", _CONTAINED)
def passage_containment(spark, root):
    return E.phrase_matches(_passages(spark, root), copies(spark, root)).select("query_id", "session_id")


@query(
    "retrieval_eval",
    f"""WITH {LINES_SQL}, e AS ({_CONTAINED}), r AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, session_id FROM
  (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) b JOIN lines l ON l.text = b.line AND b.line <> ''),
c AS (SELECT coalesce(e.query_id, r.query_id) AS query_id, count(e.session_id) AS expected, count(r.session_id) AS returned,
  count(*) FILTER (WHERE e.session_id IS NOT NULL AND r.session_id IS NOT NULL) AS tp FROM e FULL JOIN r ON e.query_id = r.query_id AND e.session_id = r.session_id GROUP BY 1)
SELECT CAST(item_id AS VARCHAR) AS query_id, coalesce(expected, 0) AS expected, coalesce(returned, 0) AS returned, coalesce(tp, 0) AS true_positives,
  CASE WHEN coalesce(returned, 0) > 0 THEN tp / returned WHEN coalesce(expected, 0) = 0 THEN 1.0 ELSE 0.0 END AS precision,
  CASE WHEN coalesce(expected, 0) > 0 THEN tp / expected ELSE 1.0 END AS recall FROM benchmark LEFT JOIN c ON c.query_id = CAST(item_id AS VARCHAR)""",
)
def retrieval_eval(spark, root):
    passages = _passages(spark, root)
    expected = E.phrase_matches(passages, copies(spark, root)).withColumnRenamed("session_id", "event_id")
    by_line = passages.select("query_id", F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''").distinct()
    # a line that a session repeats meets a passage once
    once = lines(spark, root).filter("text is not null").select("session_id", "text").distinct()
    returned = once.join(by_line, "text").select("query_id", F.col("session_id").alias("event_id"))
    return E.retrieval_eval(expected, returned, passages)


@query(
    "label_eval",
    """WITH e AS (SELECT lang, d.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1),
r AS (SELECT lang, d.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE contains(lower(text), 'tion')),
c AS (SELECT lang, (SELECT count(*) FROM e WHERE e.lang = q.lang) AS expected, (SELECT count(*) FROM r WHERE r.lang = q.lang) AS returned,
  (SELECT count(*) FROM e JOIN r USING (lang, doc_id) WHERE e.lang = q.lang) AS true_positives FROM (SELECT DISTINCT lang FROM documents) q)
SELECT lang AS query_id, expected, returned, true_positives,
  CASE WHEN returned > 0 THEN true_positives / returned WHEN expected = 0 THEN 1.0 ELSE 0.0 END AS precision,
  CASE WHEN expected > 0 THEN true_positives / expected ELSE 1.0 END AS recall FROM c""",
)
def label_eval(spark, root):
    judged = read_table(spark, root, "documents").join(read_table(spark, root, "labels"), "doc_id")
    pair = [F.col("lang").alias("query_id"), F.col("doc_id").alias("event_id")]
    found = judged.filter(F.contains(F.lower("text"), F.lit("tion"))).select(*pair)
    every = read_table(spark, root, "documents").select(F.col("lang").alias("query_id"))
    return E.retrieval_eval(judged.filter("quality = 1").select(*pair), found, every)


@query(
    "output_cost",
    """SELECT lang AS product, source AS mode, count(*) AS queries, CAST(sum(strlen(text)) AS BIGINT) AS bytes, avg(strlen(text)) AS mean_bytes,
  CAST(sum(n_chars) AS BIGINT) AS n_chars, avg(n_chars) AS mean_n_chars FROM documents GROUP BY 1, 2""",
)
def output_cost(spark, root):
    d = read_table(spark, root, "documents").select(
        F.col("lang").alias("product"), F.col("source").alias("mode"), F.octet_length("text").cast("long").alias("bytes"), "n_chars"
    )
    return E.output_cost(d, ["product", "mode"], ["bytes", "n_chars"])


# ---- detail composites ----


@query(
    "session_detail",
    f"""WITH {LOG_SQL}, {_SUMMARY} SELECT session_id, event_count,
  (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM lg WHERE session_id = '7' GROUP BY 1)) AS kinds
FROM ss WHERE session_id = '7'""",
)
def session_detail(spark, root):
    sessions = log_sessions(spark, root).withColumn("subagent_parent", F.lit(None).cast("string")).withColumn(
        "source_session_id", F.col("session_id")
    )
    events, none = log_runs(spark, root), F.lit(None).cast("string")
    files = read_table(spark, root, "pages").select(
        F.col("page_id").cast("string").alias("session_id"), F.col("url").alias("path"),
        F.octet_length("html").cast("long").alias("size"), none.alias("media_type"), F.sha2("html", 256).alias("sha256"),
    )
    families = sessions.select("session_id", "harness_id").filter("false").withColumnRenamed("harness_id", "family_key")
    detail = D.session_detail(sessions.withColumn("archive_state", F.lit("active")), events, files, families, "7").head
    kinds = F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return detail.select("session_id", "event_count", F.array_join(kinds, ",").alias("kinds"))


@query(
    "family_detail",
    f"""WITH RECURSIVE {_FAMILIES},
me AS (SELECT text, max(seq) AS seq FROM lines WHERE session_id = '1' AND text IS NOT NULL GROUP BY 1),
mb AS (SELECT fam.session_id, source, n_chars FROM fam JOIN documents d ON CAST(d.doc_id AS VARCHAR) = fam.session_id
  WHERE family_key = (SELECT family_key FROM fam WHERE session_id = '1')),
ov AS (SELECT h.session_id, count(*) AS shared_events, max(me.seq) AS last_shared_seq FROM h JOIN me USING (text) WHERE h.session_id <> '1' GROUP BY 1)
SELECT mb.session_id, coalesce(shared_events, 0) AS shared_events, last_shared_seq,
  mb.session_id = (SELECT first(session_id ORDER BY source, session_id) FROM mb) AS is_anchor FROM mb LEFT JOIN ov USING (session_id)""",
)
def family_detail(spark, root):
    ev = lines(spark, root)
    detail = G.family_detail(ev, doc_sessions(spark, root), G.fork_families(ev), "1")
    return detail.select("session_id", "shared_events", "last_shared_seq", "is_anchor")


@query(
    "events_with_sessions",
    f"WITH {LOG_SQL}, {_SUMMARY} SELECT lg.session_id, seq, event_count FROM lg JOIN ss USING (session_id)",
)
def events_with_sessions(spark, root):
    joined = U.events_with_sessions(log_runs(spark, root), log_sessions(spark, root))
    return joined.select("session_id", "seq", "event_count")


# ---- published tables ----


@query(
    "projection_round_trip",
    f"WITH {LOG_RUNS_SQL} SELECT session_id, count(*) AS events, count(*) FILTER (WHERE seq = run_first_seq) AS runs, 'fresh' AS state FROM ev GROUP BY 1",
)
def projection_round_trip(spark, root):
    out = fresh_path(spark, "projection")
    ev = log_runs(spark, root)
    write_projection({"events": ev.drop("file_touches", "tool_names"), "sessions": log_sessions(spark, root)}, out, "c1", spark)
    state = freshness(current_pointer(spark, out), "c1").select("state")
    back = read_projection(spark, out, "events").groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("seq") == F.col("run_first_seq")).alias("runs")
    )
    return back.withColumn("state", state.scalar())


@query(
    "export_sessions",
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS lines FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1",
)
def export_sessions_query(spark, root):
    out = fresh_path(spark, "export")
    src = claude_lines(spark, root).withColumn("session_id", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
    src = src.withColumn("file", F.lit(H.TRANSCRIPT))
    ids = read_table(spark, root, "conversations").filter("role = 'system'").select(F.col("conv_id").cast("string").alias("session_id"))
    none = F.lit(None).cast("string")
    sessions = src.select("session_id").distinct().select(
        "session_id", none.alias("revision_digest"), F.lit("claude-code").alias("harness_id"), F.col("session_id").alias("source_session_id"),
        F.lit("inferred").alias("association_mode"), none.alias("opening_path"), none.alias("continuation_parent"),
        F.lit(False).alias("subagent_origin"), none.alias("subagent_kind"), none.alias("subagent_parent"),
        F.lit("active").alias("archive_state"), none.alias("accepted_at"),
    )
    files = src.groupBy("session_id", F.col("file").alias("path")).agg(
        F.sum(F.octet_length("raw")).cast("long").alias("size"), F.lit("application/jsonl").alias("media_type"), none.alias("sha256")
    )
    export_sessions(src, session_documents(sessions, files), ids, out)
    back = spark.read.text(f"{out}/source").groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.count("*").alias("lines"))
    docs = spark.read.text(f"{out}/session").select(F.col("session_id").cast("string").alias("session_id"))
    return back.join(docs, "session_id")


# ---- streams over the event log, delivered in four parts by time ----


# Files of each part; a trigger that takes so many takes a part.
PART_FILES = 4


def event_parts(spark: SparkSession, root: str, columns: list, repeat: bool = False) -> str:
    """The log as files that arrive in time order, a quarter of its span at a time."""
    out = fresh_path(spark, "arrivals")
    ev = read_table(spark, root, "events")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 4
    for i in range(4):
        part = ev.filter(F.col("ts") >= F.lit(lo + i * step))
        if i < 3:
            part = part.filter(F.col("ts") < F.lit(lo + (i + 1) * step))
        for _ in range(2 if repeat else 1):
            part.select(*columns).repartition(PART_FILES).write.mode("append").parquet(out)
    return out


@query(
    "stream_runs",
    f"WITH {LOG_RUNS_SQL} SELECT session_id, run_first_seq, run_last_seq, kind FROM ev WHERE seq = run_first_seq",
)
def stream_runs(spark, root):
    cols = [
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("role"),
        F.col("event_type").alias("text"), "ts", F.col("event_id").alias("id"),
    ]
    src, out = event_parts(spark, root, cols), fresh_path(spark, "runs")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", PART_FILES).parquet(src)
    stream_adjacent_runs(stream, out).awaitTermination()
    assert late_rows(spark, out).isEmpty()
    return runs_so_far(spark, out).select("session_id", "run_first_seq", "run_last_seq", "kind")


@query("stream_dedup", "SELECT CAST(event_id AS VARCHAR) AS identity_key, CAST(user_id AS VARCHAR) AS session_id FROM events")
def stream_dedup(spark, root):
    cols = [
        F.col("event_id").cast("string").alias("identity_key"), F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    ]
    src, out = event_parts(spark, root, cols, repeat=True), fresh_path(spark, "dedup")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 2 * PART_FILES).parquet(src)
    to_table(stream_dedup_copies(stream, delay="20 days"), f"{out}/t", f"{out}/c").awaitTermination()
    return spark.read.parquet(f"{out}/t").select("identity_key", "session_id")


@query(
    "stream_monotonic_latest",
    """SELECT CAST(user_id AS VARCHAR) AS session_id, max(event_id) FILTER (WHERE ts = top) AS event_id,
  arg_max(event_type, ts) AS event_type FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY 1""",
)
def stream_monotonic_latest_query(spark, root):
    cols = [F.col("user_id").cast("string").alias("session_id"), "ts", "event_id", "event_type"]
    src, out = event_parts(spark, root, cols), fresh_path(spark, "latest")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", PART_FILES).parquet(src)
    key, order = ["session_id"], ["ts", "event_id"]
    latest_to_log(stream_monotonic_latest(stream, key, order), f"{out}/t", f"{out}/c").awaitTermination()
    compact_log(spark, f"{out}/t", key, order)
    return latest_of(spark, f"{out}/t", key, order).select("session_id", "event_id", "event_type")


@query(
    "stream_age_alerts",
    """WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, ts, max(ts) OVER () AS top FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts) AS next_ts FROM e)
SELECT session_id, epoch_us(ts) AS since_us FROM n
WHERE next_ts > ts + INTERVAL 36 HOUR OR (next_ts IS NULL AND epoch_us(ts) // 1000 + 36 * 3600000 < epoch_us(top) // 1000 - 3600000)""",
)
def stream_age_alerts_query(spark, root):
    """Users of whom nothing comes for 36 hours, found while the log arrives in four parts."""
    cols = [F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")]
    src, out = event_parts(spark, root, cols), fresh_path(spark, "alerts")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", PART_FILES).parquet(src)
    to_table(stream_age_alerts(stream, "session_id", "ts", 36 * 3600 * 1000, "1 hour"), f"{out}/t", f"{out}/c").awaitTermination()
    return spark.read.parquet(f"{out}/t").select(F.col("key").alias("session_id"), F.unix_micros("since").alias("since_us"))


@query(
    "stream_upsert",
    """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, date_trunc('month', ts) AS version FROM events)
SELECT session_id, count(*) AS events, sum(event_id) AS event_ids FROM b
WHERE version = (SELECT max(version) FROM b x WHERE x.session_id = b.session_id) GROUP BY 1""",
)
def stream_upsert_query(spark, root):
    """Events of a user's last month, whose parts come in several batches."""
    cols = [F.col("user_id").cast("string").alias("session_id"), "event_id", F.date_trunc("month", "ts").alias("modified_at")]
    src, out = event_parts(spark, root, cols), fresh_path(spark, "upsert")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", PART_FILES).parquet(src)
    stream_upsert(stream, f"{out}/t", f"{out}/c").awaitTermination()
    newest = current(spark, f"{out}/t", "modified_at")
    return newest.groupBy("session_id").agg(F.count("*").alias("events"), F.sum("event_id").alias("event_ids"))


@query("stream_transcripts", _EVENTS)
def stream_transcripts_query(spark, root):
    src, out = fresh_path(spark, "arriving"), fresh_path(spark, "ingested")
    rows = claude_lines(spark, root).select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("conv"), "line", F.col("raw").alias("value"))
    rows.repartitionByRange("conv", "line").sortWithinPartitions("conv", "line").select("conv", "value").write.partitionBy("conv").text(src)

    def normalize(found: DataFrame) -> DataFrame:
        placed = joined_parts(found).withColumn("folder", F.lit("p")).withColumn("stem", F.regexp_extract("file", "conv=([^/]+)/", 1))
        return claude.normalize(placed.withColumn("bundle_path", F.lit(H.TRANSCRIPT)).withColumn("is_sub", F.lit(False)))

    ingest_transcripts(spark, src, f"{out}/t", f"{out}/c", normalize, files_per_batch=40, glob="*.txt", session_files="/[^/]+$")
    return _event_view(transcripts(spark, f"{out}/t"))
