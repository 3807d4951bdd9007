"""Sessions in full, imports with every outcome, adoption behind a marker, bound paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import details as D
from lodestone.operators import families as G
from lodestone.operators import intake as I
from lodestone.operators import merges as M
from lodestone.plans.family_queries import _FAMILIES, doc_sessions, lines
from lodestone.plans.governance_queries import (
    _CLASSIFIED,
    _PAGES,
    _SIDES,
    _merged,
    classified_pages,
    ledgers,
    order_candidates,
    page_bindings,
    page_paths,
)
from lodestone.plans.registry import query
from lodestone.plans.search_queries import _LABEL
from lodestone.session import stage
from lodestone.sources.tables import read_table

# ---- documents as sessions: a length names the parent, marks in lines the titles ----


def told_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines with title kinds by the words in them; a line that is not empty reads one file."""
    has = lambda w: F.contains(F.coalesce("text", F.lit("")), F.lit(w))
    touch = F.struct(F.lit("read").alias("operation"), F.col("text").alias("source_path"), F.col("text").alias("normalized_path"))
    return lines(spark, root).select(
        "session_id", "seq", "timestamp", "text", "harness_id", "identity_key",
        F.when(F.col("text").isNull(), F.lit("unknown")).otherwise(F.lit("message")).alias("kind"),
        F.when(F.length("text") % 3 != 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(False).alias("harness_injected"),
        F.when(has("#"), F.lit("custom_title")).when(has("Que "), F.lit("ai_title")).when(has("with "), F.lit("summary")).alias("label_source"),
        F.when(F.col("text").isNotNull(), F.array(touch)).otherwise(F.array().cast("array<struct<operation:string,source_path:string,normalized_path:string>>")).alias("file_touches"),
    )


def told_sessions(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("session_id"),
        F.col("doc_id").cast("string").alias("source_session_id"),
        F.col("n_chars").cast("string").alias("subagent_parent"),
    )
    return doc_sessions(spark, root).join(d, "session_id")


def told_files(spark: SparkSession, root: str) -> DataFrame:
    """A session's document and the page of its number."""
    one = lambda df, key, path, body, kind: df.select(
        F.col(key).cast("string").alias("session_id"), F.col(path).alias("path"), F.octet_length(body).cast("long").alias("size"),
        F.lit(kind).alias("media_type"), F.sha2(body, 256).alias("sha256"),
    )
    docs = one(read_table(spark, root, "documents"), "doc_id", "source", "text", "text/plain")
    ids = read_table(spark, root, "documents").select(F.col("doc_id").alias("page_id"))
    pages = read_table(spark, root, "pages").join(ids, "page_id", "left_semi")
    return docs.unionByName(one(pages, "page_id", "url", "html", "text/html"))


_TOLD = f"""{_FAMILIES},
ln AS (SELECT session_id, seq, text, CASE WHEN text IS NULL THEN 'unknown' ELSE 'message' END AS kind,
    CASE WHEN contains(text, '#') THEN 'custom_title' WHEN contains(text, 'Que ') THEN 'ai_title' WHEN contains(text, 'with ') THEN 'summary'
         WHEN length(text) % 3 <> 0 THEN 'user_message' END AS src FROM lines),
l0 AS (SELECT session_id, seq, src, nullif(regexp_replace({_LABEL}, '((?:api_key|secret|token|password) = ")[0-9A-Za-z]{{20,}}"', '\\1…', 'g'), '') AS l
    FROM ln WHERE src IS NOT NULL AND text IS NOT NULL),
l1 AS (SELECT session_id, src, CASE WHEN src = 'user_message' THEN min(seq) ELSE max(seq) END AS seq FROM l0 GROUP BY 1, 2),
lb AS (SELECT session_id, CASE WHEN length(l) > 120 THEN rtrim(l[1:119]) || '…' ELSE l END AS label, src AS label_source, seq AS label_seq
    FROM l1 JOIN l0 USING (session_id, src, seq) WHERE l IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY list_position(['custom_title', 'ai_title', 'summary', 'user_message'], src)) = 1),
sx AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, lang, source, CAST(n_chars AS VARCHAR) AS parent FROM documents),
ff AS (SELECT session_id, family_key, first(session_id) OVER (PARTITION BY family_key ORDER BY source, session_id) AS anchor,
    count(*) OVER (PARTITION BY family_key) AS member_count FROM fam JOIN sx USING (session_id)),
ft AS (SELECT session_id, path, size, media_type, sha256 FROM (SELECT CAST(doc_id AS VARCHAR) AS session_id, source AS path, strlen(text) AS size,
      'text/plain' AS media_type, sha256(text) AS sha256 FROM documents
    UNION ALL SELECT CAST(page_id AS VARCHAR), url, strlen(html), 'text/html', sha256(html) FROM pages WHERE page_id IN (SELECT doc_id FROM documents)))"""


@query(
    "session_details",
    f"""WITH RECURSIVE {_TOLD},
kc AS (SELECT session_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds, sum(n) AS event_count,
    sum(CASE WHEN kind = 'message' THEN n ELSE 0 END) AS file_touches FROM (SELECT session_id, kind, count(*) AS n FROM ln GROUP BY 1, 2) GROUP BY 1),
ch AS (SELECT p.session_id, count(*) AS children, min(c.session_id) AS first_child FROM sx c JOIN sx p ON p.session_id = c.parent AND p.lang = c.lang GROUP BY 1),
fc AS (SELECT session_id, count(*) AS artifacts, sum(size) AS artifact_bytes FROM ft GROUP BY 1)
SELECT sx.session_id, label, label_source, label_seq, sx.parent AS parent_session, q.session_id IS NOT NULL AS parent_resolved, kinds,
  CAST(event_count AS BIGINT) AS event_count, CAST(file_touches AS BIGINT) AS file_touches, artifacts, CAST(artifact_bytes AS BIGINT) AS artifact_bytes,
  coalesce(children, 0) AS children, first_child, family_key, anchor, member_count
FROM sx LEFT JOIN lb USING (session_id) LEFT JOIN kc USING (session_id) LEFT JOIN ch USING (session_id) LEFT JOIN fc USING (session_id)
  LEFT JOIN ff USING (session_id) LEFT JOIN sx q ON q.session_id = sx.parent AND q.lang = sx.lang""",
)
def session_details(spark, root):
    events = stage(told_lines(spark, root), "told")
    sessions, families = told_sessions(spark, root), stage(G.fork_families(events), "families")
    found = D.session_details(sessions, events, told_files(spark, root), families)
    kinds = F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.select(
        "session_id", "label", "label_source", "label_seq", "parent_session", "parent_resolved", F.array_join(kinds, ",").alias("kinds"),
        "event_count", "file_touches", "artifacts", "artifact_bytes", "children", "first_child", "family_key", "anchor", "member_count",
    )


@query("artifact_list", f"WITH RECURSIVE {_TOLD} SELECT * FROM ft")
def artifact_list(spark, root):
    return D.artifact_list(told_files(spark, root))


# ---- imports ----


def page_import(spark: SparkSession, root: str, **how) -> DataFrame:
    """Pages against a store that holds https pages as they are and http pages by their URL alone.

    Sessions whose document is German are frozen; pages with a third advertisement cannot be read.
    """
    pages = classified_pages(spark, root)
    candidates = pages.select(
        "candidate_id", "class", F.sha2("html", 256).alias("digest"),
        F.contains("html", F.lit("ad 0")).alias("flagged"), F.contains("html", F.lit("ad 1")).alias("override"),
    )
    held = read_table(spark, root, "pages").select(
        F.col("page_id").cast("string").alias("session_id"),
        F.when(F.startswith("url", F.lit("https")), F.sha2("html", 256)).otherwise(F.sha2("url", 256)).alias("digest"),
    )
    frozen = read_table(spark, root, "documents").filter("lang = 'de'").select(F.col("doc_id").cast("string").alias("session_id"))
    errors = pages.filter(F.contains("html", F.lit("ad 3"))).select("candidate_id", F.lit("unreadable").alias("message"))
    return I.accept_revisions(candidates, held, frozen, errors=errors, **how)


def _outcomes(tombstoned: str) -> str:
    return f"""oc AS (SELECT cl.candidate_id, class, CASE WHEN class IN ('ignored', 'out_of_scope', 'pending'{tombstoned}) THEN class
  WHEN class = 'associated' AND cl.candidate_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'de') THEN 'conflicted'
  WHEN contains(cl.html, 'ad 3') THEN 'error' WHEN url LIKE 'https%' THEN 'unchanged' WHEN sha256(url) = sha256(cl.html) THEN 'unchanged'
  WHEN contains(cl.html, 'ad 0') AND NOT contains(cl.html, 'ad 1') THEN 'flagged' ELSE 'accepted' END AS outcome
  FROM cl JOIN pages ON CAST(page_id AS VARCHAR) = cl.candidate_id)"""


_FULL_RUN = _outcomes(", 'tombstoned'")


@query("import_outcomes", f"WITH {_CLASSIFIED}, {_FULL_RUN} SELECT candidate_id, class, outcome FROM oc")
def import_outcomes(spark, root):
    return page_import(spark, root).select("candidate_id", "class", "outcome")


@query(
    "import_report_whole",
    f"""WITH {_CLASSIFIED}, {_FULL_RUN} SELECT outcome, count(*) AS candidates FROM oc GROUP BY 1
UNION ALL SELECT 'pruned_withheld', count(*) FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) HAVING count(*) > 0""",
)
def import_report_whole(spark, root):
    """The report with errors, and documents once withheld that are no candidates any more."""
    done = page_import(spark, root)
    none = F.lit(None).cast("string")
    before = read_table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("candidate_id"), F.col("lang").alias("harness_id"), F.lit("").alias("bundle_digest"),
        F.lit("2024-01-01").alias("evaluated_at"), none.alias("first_flagged_at"),
    )
    accepted = done.filter("outcome = 'accepted'").select(F.col("candidate_id").alias("session_id"), "digest")
    state = I.evaluation_state(before, before.filter("false"), done.select("candidate_id", "class"), accepted)
    return I.import_report(done, state)


@query(
    "readmission",
    f"""WITH {_CLASSIFIED}, {_outcomes('')} SELECT candidate_id, class, outcome FROM oc
WHERE candidate_id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)""",
)
def readmission(spark, root):
    """A run narrowed to the candidates that benchmark items name, tombstoned ones among them."""
    named = read_table(spark, root, "benchmark").select(F.col("item_id").cast("string").alias("candidate_id"))
    return page_import(spark, root, only=named, readmit=True).select("candidate_id", "class", "outcome")


# ---- adoption and bound paths ----

_ADOPTED = f"""{_SIDES}, mk AS (SELECT max(l_suppkey) AS m FROM lineitem),
inc AS (SELECT * FROM (SELECT * FROM lo EXCEPT SELECT * FROM re) WHERE unit NOT IN (SELECT session_id FROM tgt)),
nw AS (SELECT unit, greatest((SELECT max(epoch) FROM re), (SELECT m FROM mk)) + row_number() OVER (ORDER BY epoch, deleted_at, replica, unit) AS epoch,
    deleted_at, replica FROM inc)"""


def _adopted(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The target ledger before and after, and its marker: the largest supplier, above every epoch."""
    local, remote = ledgers(spark, root)
    live = order_candidates(spark, root).filter("o_orderstatus = 'O'")
    marker = read_table(spark, root, "lineitem").agg(F.max("l_suppkey").cast("long").alias("m"))
    return remote, M.adopt_ledger(local, remote, live, marker.scalar()), marker


@query("adopt_ledger_marked", f"WITH {_ADOPTED} {_merged('SELECT * FROM re UNION ALL SELECT * FROM nw')}")
def adopt_ledger_marked(spark, root):
    return _adopted(spark, root)[1]


@query("adopt_marker", f"WITH {_ADOPTED} SELECT CAST(coalesce((SELECT max(epoch) FROM nw), (SELECT m FROM mk)) AS BIGINT) AS marker")
def adopt_marker(spark, root):
    before, after, marker = _adopted(spark, root)
    return M.advanced_marker(before, after, marker.scalar())


@query(
    "bound_paths",
    f"""WITH {_PAGES}, s AS (SELECT owner AS project_id, owner_root AS path, count(*) AS sessions FROM pg JOIN ow USING (opening_path) GROUP BY 1, 2)
SELECT project_id, path, CASE WHEN is_root THEN 'root' ELSE 'alias' END AS bound_as,
  CASE WHEN max(is_root) OVER (PARTITION BY project_id) THEN 'capturing' ELSE 'history_only' END AS capture_state, coalesce(sessions, 0) AS sessions
FROM (SELECT project_id, path, bool_or(is_root) AS is_root FROM bd GROUP BY 1, 2) LEFT JOIN s USING (project_id, path)""",
)
def bound_paths(spark, root):
    pages, bindings = page_paths(spark, root), page_bindings(spark, root)
    return I.bound_paths(bindings, pages.join(I.longest_prefix_owner(pages, bindings), "opening_path"))
