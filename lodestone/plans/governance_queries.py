"""Merges, admission and upkeep over replicas that the fact tables already contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.instants import age_days
from lodestone.functions.secrets import mask_secrets
from lodestone.operators import intake as I
from lodestone.operators import merges as M
from lodestone.operators import mirror as R
from lodestone.operators import refresh as U
from lodestone.operators.predicates import pin_revision
from lodestone.plans.registry import query
from lodestone.sources.tables import document_lines, iso_micros, read_table

DAY = "yyyy-MM-dd"


# ---- archive markers: customers' orders, one replica per priority ----


def order_markers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Open orders are the local side, all others the remote one."""
    o = read_table(spark, root, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("archived")).otherwise(F.lit("active")).alias("state"),
        F.date_format("o_orderdate", DAY).alias("transitioned_at"),
        F.col("o_orderpriority").alias("replica"),
        (F.col("o_orderstatus") == "O").alias("is_local"),
    )
    return rows.filter("is_local"), rows.filter("not is_local")


_MARKERS = """mk AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS state,
    strftime(o_orderdate, '%Y-%m-%d') AS transitioned_at, o_orderpriority AS replica FROM orders),
lw AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY transitioned_at DESC, replica DESC, state DESC) = 1)"""


@query("merge_lww", f"WITH {_MARKERS} SELECT session_id, state, transitioned_at, replica FROM lw")
def merge_lww(spark, root):
    return M.merge_archive(*order_markers(spark, root))


@query(
    "archive_transition",
    f"""WITH {_MARKERS}, c AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id FROM customer)
SELECT c.session_id, coalesce(state, 'active') AS previous_state, 'archived' AS next_state, coalesce(state, 'active') <> 'archived' AS changed,
  CASE WHEN coalesce(state, 'active') <> 'archived' THEN '2026-01-01' ELSE transitioned_at END AS transitioned_at,
  CASE WHEN coalesce(state, 'active') <> 'archived' THEN 'r0' ELSE replica END AS replica
FROM c LEFT JOIN lw USING (session_id)""",
)
def archive_transition(spark, root):
    customers = read_table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    markers = M.merge_archive(*order_markers(spark, root))
    return M.archive_transition(customers, markers, "archived", "2026-01-01", "r0")


@query(
    "monotonic_latest",
    """SELECT CAST(o_custkey AS VARCHAR) AS customer, max(o_orderdate)::DATE::VARCHAR AS finished_at,
  max(o_orderkey) FILTER (WHERE o_orderdate = top) AS order_key
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS top FROM orders) GROUP BY 1""",
)
def monotonic_latest(spark, root):
    o = read_table(spark, root, "orders").select(
        F.col("o_custkey").cast("string").alias("customer"),
        F.date_format("o_orderdate", DAY).alias("finished_at"),
        F.col("o_orderkey").alias("order_key"),
    )
    return M.monotonic_latest(o, ["customer"], ["finished_at", "order_key"])


# ---- deletion ledgers: line items, the returned ones being local ----


LEDGER_ROWS = 1_000_000


def ledgers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Both sides, dealt by whole event to partitions of about ``LEDGER_ROWS`` line items, in which they are also compared."""
    items = read_table(spark, root, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // LEDGER_ROWS))
    li = items.select(
        F.col("l_orderkey").cast("string").alias("unit"),
        F.col("l_linenumber").cast("long").alias("epoch"),
        F.date_format("l_shipdate", DAY).alias("deleted_at"),
        F.col("l_suppkey").cast("string").alias("replica"),
        (F.col("l_returnflag") == "A").alias("is_local"),
    )
    li = li.repartition(parts, *M.LEDGER_KEY).distinct()
    return li.filter("is_local").drop("is_local"), li.filter("not is_local").drop("is_local")


_LEDGERS = """li AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS unit, CAST(l_linenumber AS BIGINT) AS epoch,
    strftime(l_shipdate, '%Y-%m-%d') AS deleted_at, CAST(l_suppkey AS VARCHAR) AS replica, l_returnflag = 'A' AS is_local FROM lineitem),
lo AS (SELECT * EXCLUDE (is_local) FROM li WHERE is_local), re AS (SELECT * EXCLUDE (is_local) FROM li WHERE NOT is_local)"""


def _merged(rows: str) -> str:
    return (
        f"SELECT unit, epoch, deleted_at, replica FROM ({rows}) "
        "QUALIFY row_number() OVER (PARTITION BY unit, epoch ORDER BY deleted_at, replica) = 1"
    )


@query("merge_ledger", f"WITH {_LEDGERS} {_merged('SELECT * FROM lo UNION ALL SELECT * FROM re')}")
def merge_ledger(spark, root):
    return M.merge_ledger(*ledgers(spark, root))


@query("events_beyond", f"WITH {_LEDGERS} SELECT * FROM lo EXCEPT SELECT * FROM re")
def events_beyond(spark, root):
    return M.events_beyond(*ledgers(spark, root))


_PENDING = """pd AS (SELECT * FROM lo WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.unit = lo.unit AND re.epoch = lo.epoch)),
kp AS (SELECT * FROM lo EXCEPT SELECT * FROM pd),
nm AS (SELECT unit, CASE WHEN (SELECT min(epoch) FROM pd) <= (SELECT max(epoch) FROM re)
    THEN (SELECT max(epoch) FROM re) + row_number() OVER (ORDER BY epoch, deleted_at, replica, unit) ELSE epoch END AS epoch, deleted_at, replica FROM pd)"""


@query(
    "reconcile_epochs",
    f"WITH {_LEDGERS}, {_PENDING} {_merged('SELECT * FROM kp UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM re')}",
)
def reconcile_epochs(spark, root):
    return M.reconcile_ledgers(*ledgers(spark, root), renumber=True)


@query(
    "tombstones",
    f"""WITH {_LEDGERS} SELECT unit, epoch, deleted_at, replica FROM lo
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderkey AS VARCHAR) = unit AND o_orderstatus = 'O')""",
)
def tombstones(spark, root):
    live = read_table(spark, root, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").cast("string").alias("session_id")
    )
    return M.tombstones(ledgers(spark, root)[0], live)


@query(
    "is_tombstoned",
    f"""WITH {_LEDGERS}, d AS (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY unit ORDER BY epoch DESC, deleted_at DESC, replica DESC) = 1)
SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderstatus <> 'O' AND unit IS NOT NULL AS tombstoned,
  CASE WHEN o_orderstatus <> 'O' THEN deleted_at END AS deleted_at, CASE WHEN o_orderstatus <> 'O' THEN epoch END AS deletion_epoch
FROM orders LEFT JOIN d ON unit = CAST(o_orderkey AS VARCHAR)""",
)
def is_tombstoned(spark, root):
    o = read_table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("session_id"), "o_orderstatus"
    )
    live = o.filter("o_orderstatus = 'O'")
    return M.is_tombstoned(o.select("session_id"), ledgers(spark, root)[0], live)


@query(
    "purge_set",
    f"""WITH {_LEDGERS} SELECT unit, epoch, deleted_at FROM lo
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY epoch, deleted_at, replica) = 1""",
)
def purge_set(spark, root):
    return M.purge_set(ledgers(spark, root)[0])


@query(
    "purge",
    f"""WITH {_LEDGERS} SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderstatus FROM orders
WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT unit FROM lo)""",
)
def purge(spark, root):
    o = read_table(spark, root, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), "o_orderstatus")
    return M.purge({"sessions": o}, ledgers(spark, root)[0])["sessions"]


# ---- snapshots and conflicts: a part's line items by return flag ----


def snapshots(spark: SparkSession, root: str) -> list[DataFrame]:
    """Per return flag one digest (the number of line items) per part."""
    li = read_table(spark, root, "lineitem")
    counted = li.groupBy(F.col("l_partkey").cast("string").alias("unit"), "l_returnflag").agg(
        F.sha2(F.count("*").cast("string"), 256).alias("digest")
    )
    return [counted.filter(F.col("l_returnflag") == flag) for flag in "RAN"]


@query(
    "three_way_merge",
    """WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS unit, l_returnflag AS f, sha256(CAST(count(*) AS VARCHAR)) AS d FROM lineitem GROUP BY 1, 2),
u AS (SELECT unit, max(d) FILTER (WHERE f = 'R') AS base_digest, max(d) FILTER (WHERE f = 'A') AS local_digest,
    max(d) FILTER (WHERE f = 'N') AS remote_digest FROM c GROUP BY 1)
SELECT *, CASE WHEN local_digest IS NOT DISTINCT FROM base_digest AND remote_digest IS NOT DISTINCT FROM base_digest THEN 'unchanged'
  WHEN local_digest IS NOT DISTINCT FROM base_digest THEN 'pulled' WHEN remote_digest IS NOT DISTINCT FROM base_digest THEN 'pushed'
  WHEN local_digest IS NOT DISTINCT FROM remote_digest THEN 'merged' ELSE 'conflicted' END AS outcome FROM u""",
)
def three_way_merge(spark, root):
    return M.three_way_merge(*snapshots(spark, root))


def order_candidates(spark: SparkSession, root: str) -> DataFrame:
    """A customer's orders as revisions of one session; the digest covers status and priority."""
    return read_table(spark, root, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 16).alias("key"),
        F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("digest"),
        F.date_format("o_orderdate", DAY).alias("accepted_at"),
        "o_orderstatus",
    )


_CANDS = """cd AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, sha256(CAST(o_orderkey AS VARCHAR))[1:16] AS key,
    sha256(o_orderstatus || o_orderpriority) AS digest, strftime(o_orderdate, '%Y-%m-%d') AS accepted_at, o_orderstatus FROM orders)"""


@query(
    "capture_conflicts",
    f"""WITH {_CANDS} SELECT session_id, key, digest, accepted_at, candidates FROM
(SELECT *, count(*) OVER (PARTITION BY session_id) AS candidates FROM cd) WHERE candidates >= 2""",
)
def capture_conflicts(spark, root):
    cands = order_candidates(spark, root)
    return M.capture_conflicts(cands.filter("o_orderstatus = 'O'"), cands.filter("o_orderstatus <> 'O'"))


@query(
    "resolve_conflict",
    f"""WITH {_CANDS}, k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM cd) WHERE n >= 2),
ch AS (SELECT session_id, substring(max(digest), 1, 1) AS prefix FROM k GROUP BY 1),
p AS (SELECT ch.session_id, prefix, min(digest) FILTER (WHERE starts_with(digest, prefix)) AS lo, max(digest) FILTER (WHERE starts_with(digest, prefix)) AS hi,
  min((accepted_at, key, digest)) FILTER (WHERE starts_with(digest, prefix)) AS c, count(*) FILTER (WHERE NOT starts_with(digest, prefix)) AS others
  FROM ch JOIN k USING (session_id) GROUP BY 1, 2)
SELECT session_id, prefix, CASE WHEN lo <> hi THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE WHEN lo = hi THEN c[2] END AS key, CASE WHEN lo = hi THEN c[3] END AS digest, CASE WHEN lo = hi THEN c[1] END AS accepted_at, others FROM p""",
)
def resolve_conflict(spark, root):
    conflicts = M.capture_conflicts(order_candidates(spark, root))
    choices = conflicts.groupBy("session_id").agg(F.substring(F.max("digest"), 1, 1).alias("prefix"))
    return M.resolve_conflicts(conflicts, choices)


_SIDES = f"""{_CANDS}, {_LEDGERS},
src AS (SELECT * FROM cd WHERE o_orderstatus = 'F'), tgt AS (SELECT * FROM cd WHERE o_orderstatus = 'O')"""


@query(
    "adopt_units",
    f"""WITH {_SIDES}, s AS (SELECT session_id, count(DISTINCT key) > 1 AS frozen,
    bool_or(NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.session_id = src.session_id AND tgt.digest = src.digest)) AS lacks FROM src GROUP BY 1)
SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM tgt) THEN CASE WHEN lacks THEN 'conflict' ELSE 'skipped' END
  WHEN session_id IN (SELECT unit FROM lo) THEN 'skipped' WHEN frozen THEN 'conflict' ELSE 'merged' END AS outcome FROM s""",
)
def adopt_units(spark, root):
    cands = order_candidates(spark, root)
    return M.adopt_units(
        cands.filter("o_orderstatus = 'F'"), cands.filter("o_orderstatus = 'O'"), ledgers(spark, root)[0]
    )


@query(
    "digest_containment",
    f"WITH {_SIDES} SELECT DISTINCT session_id, digest FROM src EXCEPT SELECT session_id, digest FROM tgt",
)
def digest_containment(spark, root):
    cands = order_candidates(spark, root)
    return M.missing_digests(cands.filter("o_orderstatus = 'F'"), cands.filter("o_orderstatus = 'O'"))


@query(
    "adopt_ledger",
    f"""WITH {_SIDES}, inc AS (SELECT * FROM (SELECT * FROM lo EXCEPT SELECT * FROM re) WHERE unit NOT IN (SELECT session_id FROM tgt)),
nw AS (SELECT unit, (SELECT max(epoch) FROM re) + row_number() OVER (ORDER BY epoch, deleted_at, replica, unit) AS epoch, deleted_at, replica FROM inc)
{_merged('SELECT * FROM re UNION ALL SELECT * FROM nw')}""",
)
def adopt_ledger(spark, root):
    local, remote = ledgers(spark, root)
    live = order_candidates(spark, root).filter("o_orderstatus = 'O'")
    return M.adopt_ledger(local, remote, live)


# ---- admission: pages as candidates, hosts and language folders as bound roots ----


def page_paths(spark: SparkSession, root: str) -> DataFrame:
    """A page's URL without scheme, query and fragment, as an absolute path."""
    return read_table(spark, root, "pages").select(
        "page_id",
        F.col("page_id").cast("string").alias("candidate_id"),
        F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://([^?#]*)", 1)).alias("opening_path"),
        F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"),
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("lang"),
        "html",
    )


def page_bindings(spark: SparkSession, root: str) -> DataFrame:
    """Each scheme binds the hosts it is seen with; each language its folder of ``.com`` hosts."""
    p = page_paths(spark, root)
    hosts = p.select(F.col("scheme").alias("project_id"), F.concat(F.lit("/"), "host").alias("path"), F.lit(True).alias("is_root"))
    folders = p.filter(F.endswith("host", F.lit(".com")) & (F.col("lang") != "")).select(
        F.col("lang").alias("project_id"), F.concat(F.lit("/"), "host", F.lit("/"), "lang").alias("path"), F.lit(False).alias("is_root")
    )
    return hosts.unionByName(folders).distinct()


_PAGES = r"""pg AS (SELECT page_id, CAST(page_id AS VARCHAR) AS candidate_id, '/' || regexp_extract(url, '^https?://([^?#]*)', 1) AS opening_path,
    regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, html FROM pages),
bd AS (SELECT scheme AS project_id, '/' || host AS path, true AS is_root FROM pg UNION
    SELECT lang, '/' || host || '/' || lang, false FROM pg WHERE host LIKE '%.com' AND lang <> ''),
ow AS (SELECT DISTINCT pg.opening_path, bd.project_id AS owner, bd.path AS owner_root FROM pg JOIN bd
    ON rtrim(pg.opening_path, '/') = bd.path OR starts_with(pg.opening_path, bd.path || '/')
  QUALIFY row_number() OVER (PARTITION BY pg.opening_path ORDER BY length(bd.path) DESC, bd.project_id) = 1)"""


@query("longest_prefix_owner", f"WITH {_PAGES} SELECT opening_path, owner, owner_root FROM ow")
def longest_prefix_owner(spark, root):
    return I.longest_prefix_owner(page_paths(spark, root), page_bindings(spark, root))


@query(
    "project_inventory",
    f"""WITH {_PAGES}, s AS (SELECT owner AS project_id, count(*) AS sessions FROM pg JOIN ow USING (opening_path) GROUP BY 1)
SELECT project_id, count(*) FILTER (WHERE is_root) AS roots, count(*) FILTER (WHERE NOT is_root) AS aliases,
  CASE WHEN count(*) FILTER (WHERE is_root) > 0 THEN 'capturing' ELSE 'history_only' END AS capture_state,
  coalesce(any_value(sessions), 0) AS sessions FROM bd LEFT JOIN s USING (project_id) GROUP BY 1""",
)
def project_inventory(spark, root):
    pages, bindings = page_paths(spark, root), page_bindings(spark, root)
    owners = I.longest_prefix_owner(pages, bindings)
    owned = pages.join(owners, "opening_path").withColumnRenamed("owner", "project_id")
    return I.project_inventory(bindings, owned)


@query(
    "url_suffix_match",
    f"WITH {_PAGES} SELECT candidate_id, opening_path FROM pg WHERE opening_path = 'en' OR suffix(opening_path, '/index.html') OR suffix(opening_path, '/960')",
)
def url_suffix_match(spark, root):
    from lodestone.functions.paths import file_matches

    p, none = page_paths(spark, root), F.lit(None).cast("string")
    hit = file_matches(F.col("opening_path"), none, "index.html") | file_matches(F.col("opening_path"), none, "960")
    return p.filter(hit).select("candidate_id", "opening_path")


def classified_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages judged by the https project: labels say ignored (toxic) and decided (good quality)."""
    pages = page_paths(spark, root).withColumn("resolvable", ~F.endswith("opening_path", F.lit("/")))
    pages = pages.withColumn("opening_path", F.when(F.length("html") >= 1000, F.col("opening_path")))
    labels = read_table(spark, root, "labels")
    ids = F.col("doc_id").cast("string").alias("candidate_id")
    ignored = labels.filter("toxic = 1").select(ids)
    decided = labels.filter("quality = 1").select(ids, F.lit("https").alias("project_id"))
    gone = read_table(spark, root, "benchmark").filter(F.length("text") > 250).select(
        F.col("item_id").cast("string").alias("candidate_id")
    )
    bindings = page_bindings(spark, root).filter(F.endswith("path", F.lit(".net")) | (~F.col("is_root")))
    owners = I.longest_prefix_owner(pages, bindings)
    return I.classify_candidates(pages, "https", owners, ignored, gone, decided)


_CLASSIFIED = f"""{_PAGES},
b2 AS (SELECT * FROM bd WHERE path LIKE '%.net' OR NOT is_root),
c0 AS (SELECT *, NOT suffix(opening_path, '/') AS resolvable, CASE WHEN length(html) >= 1000 THEN opening_path END AS op FROM pg),
o2 AS (SELECT DISTINCT c0.op, b2.project_id AS owner FROM c0 JOIN b2 ON rtrim(c0.op, '/') = b2.path OR starts_with(c0.op, b2.path || '/')
  QUALIFY row_number() OVER (PARTITION BY c0.op ORDER BY length(b2.path) DESC, b2.project_id) = 1),
dc AS (SELECT CAST(doc_id AS VARCHAR) AS candidate_id, 'https' AS decided FROM labels WHERE quality = 1),
cl AS (SELECT c0.candidate_id, c0.op AS opening_path, owner, decided, html, CASE
  WHEN c0.candidate_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) THEN 'ignored'
  WHEN c0.candidate_id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark WHERE length(text) > 250) THEN 'tombstoned'
  WHEN c0.op IS NOT NULL AND owner IS NOT NULL THEN CASE WHEN owner = 'https' THEN 'associated' ELSE 'out_of_scope' END
  WHEN c0.op IS NOT NULL AND NOT resolvable AND decided IS NULL THEN 'pending'
  WHEN decided IS NOT NULL THEN 'associated' WHEN c0.op IS NULL THEN 'pending' ELSE 'out_of_scope' END AS class
  FROM c0 LEFT JOIN o2 ON o2.op = c0.op LEFT JOIN dc USING (candidate_id))"""


@query(
    "classify_candidates",
    f"WITH {_CLASSIFIED} SELECT candidate_id, class, CASE WHEN class IN ('associated', 'out_of_scope') THEN coalesce(owner, decided) END AS mapped_project FROM cl",
)
def classify_candidates(spark, root):
    return classified_pages(spark, root).select("candidate_id", "class", "mapped_project")


def page_evaluations(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose markup loads a script count as flagged; their id is the day they were first flagged."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int")), DAY)
    return page_paths(spark, root).filter(F.contains("html", F.lit("track("))).select(
        "candidate_id", F.col("lang").alias("harness_id"), F.sha2("html", 256).alias("bundle_digest"),
        day.alias("evaluated_at"), F.when(F.col("scheme") == "https", day).alias("first_flagged_at"),
    )


@query(
    "candidate_tallies",
    f"""WITH {_CLASSIFIED} SELECT count(*) FILTER (WHERE class = 'pending') AS pending, count(*) FILTER (WHERE class = 'associated') AS associated,
  count(*) FILTER (WHERE class = 'out_of_scope') AS out_of_scope, count(*) FILTER (WHERE class = 'ignored') AS ignored,
  count(*) FILTER (WHERE class = 'tombstoned') AS tombstoned,
  count(*) FILTER (WHERE class = 'associated' AND contains(html, 'track(')) AS flagged FROM cl""",
)
def candidate_tallies(spark, root):
    c = classified_pages(spark, root).withColumn("has_evaluation", F.contains("html", F.lit("track(")))
    return I.candidate_tallies(c)


@query(
    "candidate_listing",
    f"""WITH {_CLASSIFIED} SELECT candidate_id, class, contains(html, 'track(') AS has_evaluation FROM cl
ORDER BY list_position(['pending', 'flagged', 'associated', 'out_of_scope', 'ignored', 'tombstoned'],
  CASE WHEN class = 'associated' AND contains(html, 'track(') THEN 'flagged' ELSE class END), opening_path DESC NULLS LAST, candidate_id LIMIT 50""",
)
def candidate_listing(spark, root):
    c = classified_pages(spark, root).withColumn("has_evaluation", F.contains("html", F.lit("track(")))
    c = c.withColumn("session_time", F.col("opening_path"))
    return c.orderBy(*I.candidate_order()).limit(50).select("candidate_id", "class", "has_evaluation")


@query(
    "accept_revisions",
    f"""WITH {_CLASSIFIED} SELECT candidate_id, CASE WHEN class <> 'associated' THEN class
  WHEN d.text IS NOT NULL AND sha256(d.text) = sha256(html) THEN 'unchanged'
  WHEN contains(html, 'ad 0') THEN 'flagged' ELSE 'accepted' END AS outcome
FROM cl LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = cl.candidate_id""",
)
def accept_revisions(spark, root):
    return page_outcomes(spark, root).select("candidate_id", "outcome")


def page_outcomes(spark: SparkSession, root: str) -> DataFrame:
    c = classified_pages(spark, root).select(
        "candidate_id", "class", F.sha2("html", 256).alias("digest"),
        F.contains("html", F.lit("ad 0")).alias("flagged"), F.lit(False).alias("override"),
    )
    return I.accept_revisions(c, page_store(spark, root), spark.createDataFrame([], "session_id string"))


def page_store(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("session_id"), F.sha2("text", 256).alias("digest")
    )


@query(
    "import_report",
    f"""WITH {_CLASSIFIED} SELECT CASE WHEN class <> 'associated' THEN class WHEN contains(html, 'ad 0') THEN 'flagged' ELSE 'accepted' END AS outcome,
  count(*) AS candidates FROM cl GROUP BY 1""",
)
def import_report(spark, root):
    return I.import_report(page_outcomes(spark, root))


@query(
    "accepted_store",
    f"""WITH {_CLASSIFIED}, ac AS (SELECT candidate_id AS session_id, sha256(html) AS digest FROM cl WHERE class = 'associated' AND NOT contains(html, 'ad 0'))
SELECT CAST(doc_id AS VARCHAR) AS session_id, sha256(text) AS digest FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT session_id FROM ac)
UNION ALL SELECT * FROM ac""",
)
def accepted_store(spark, root):
    return I.accepted_store(page_store(spark, root), page_outcomes(spark, root))


_NOW = "2024-12-31"


@query(
    "withheld_summary",
    f"""WITH {_PAGES} SELECT count(*) AS count, min(strftime(DATE '2024-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%d')) AS oldest,
  date_diff('day', min(DATE '2024-01-01' + CAST(page_id AS INTEGER)), DATE '{_NOW}') >= 14 AS retention_warning
FROM pg WHERE contains(html, 'track(')""",
)
def withheld_summary(spark, root):
    return I.withheld(page_evaluations(spark, root), F.lit(_NOW).cast("timestamp"))


@query(
    "advisories",
    f"""WITH {_CLASSIFIED}, e AS (SELECT DATE '2024-01-01' + CAST(page_id AS INTEGER) AS d FROM pg WHERE contains(html, 'track('))
SELECT 'importable' AS kind, count(*) AS count, NULL AS oldest, NULL AS retention_warning FROM cl WHERE class = 'associated'
  AND candidate_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'de')
UNION ALL SELECT 'pending', count(*), NULL, NULL FROM cl WHERE class = 'pending'
UNION ALL SELECT 'withheld', count(*), strftime(min(d), '%Y-%m-%d'), date_diff('day', min(d), DATE '{_NOW}') >= 14 FROM e""",
)
def advisories(spark, root):
    conflicted = read_table(spark, root, "documents").filter("lang = 'de'").select(
        F.col("doc_id").cast("string").alias("session_id")
    )
    return I.advisories(
        classified_pages(spark, root), page_evaluations(spark, root), conflicted, F.lit(_NOW).cast("timestamp")
    )


@query(
    "evaluation_state",
    f"""WITH {_CLASSIFIED}, fl AS (SELECT candidate_id, lang, scheme, sha256(html) AS dg, strftime(DATE '2024-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%d') AS d FROM pg WHERE contains(html, 'track(')),
o AS (SELECT * FROM fl WHERE scheme = 'http'), n AS (SELECT * FROM fl WHERE lang = 'en'),
j AS (SELECT coalesce(n.candidate_id, o.candidate_id) AS candidate_id, coalesce(n.lang, o.lang) AS harness_id, coalesce(n.dg, o.dg) AS bundle_digest,
  coalesce(o.d, n.d) AS first_flagged_at, n.candidate_id IS NULL AS unseen FROM o FULL JOIN n ON o.candidate_id = n.candidate_id)
SELECT j.candidate_id, harness_id, bundle_digest, first_flagged_at, CASE WHEN class IN ('ignored', 'out_of_scope', 'tombstoned') THEN 'cleared'
  WHEN class IS NULL AND unseen AND harness_id <> 'de' THEN 'lost' ELSE 'keep' END AS action
FROM j LEFT JOIN (SELECT * FROM cl WHERE class <> 'associated') c USING (candidate_id)""",
)
def evaluation_state(spark, root):
    ev = page_evaluations(spark, root).join(page_paths(spark, root).select("candidate_id", "scheme"), "candidate_id")
    found = classified_pages(spark, root).filter("class <> 'associated'")
    exempt = spark.createDataFrame([("de",)], "harness_id string")
    return I.evaluation_state(
        ev.filter("scheme = 'http'"), ev.filter("harness_id = 'en'"), found, page_store(spark, root), exempt
    )


@query(
    "explicit_decisions",
    """WITH d AS (SELECT o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'ignore' ELSE 'associate' END AS action,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS project_id, strftime(o_orderdate, '%Y-%m-%d') AS decided_at FROM orders)
SELECT CAST(c AS VARCHAR) AS candidate_id, action, project_id, decided_at FROM d
QUALIFY row_number() OVER (PARTITION BY c ORDER BY decided_at DESC, action, project_id DESC) = 1""",
)
def explicit_decisions(spark, root):
    o = read_table(spark, root, "orders").select(
        F.col("o_custkey").cast("string").alias("candidate_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("ignore")).otherwise(F.lit("associate")).alias("action"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("project_id"),
        F.date_format("o_orderdate", DAY).alias("decided_at"),
    )
    return I.explicit_decisions(o)


@query(
    "loss_records",
    """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS candidate_id, strftime(o_orderdate, '%Y-%m-%d') AS first_flagged_at,
  strftime(o_orderdate, '%Y-%m-%d') AS pruned_at FROM orders ORDER BY pruned_at DESC, candidate_id DESC LIMIT 100""",
)
def loss_records(spark, root):
    o = read_table(spark, root, "orders")
    day = F.date_format("o_orderdate", DAY)
    rows = o.select(
        F.col("o_custkey").cast("string").alias("candidate_id"), day.alias("first_flagged_at"), day.alias("pruned_at"), "o_orderstatus"
    )
    return I.append_losses(rows.filter("o_orderstatus = 'O'").drop("o_orderstatus"), rows.filter("o_orderstatus <> 'O'").drop("o_orderstatus"))


@query(
    "status_rollup",
    f"""WITH {_CLASSIFIED}, {_LEDGERS} SELECT (SELECT count(*) FROM documents) AS sessions, (SELECT count(*) FROM documents WHERE n_chars < 200) AS archived,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)) AS conflicts, (SELECT count(*) FROM lo) AS tombstone_events,
  (SELECT count(*) FROM cl WHERE class = 'pending') AS pending, (SELECT count(*) FROM cl WHERE class = 'associated') AS importable,
  (SELECT count(*) FROM cl WHERE class = 'ignored') AS ignored, (SELECT count(*) FROM pg WHERE contains(html, 'track(')) AS withheld,
  (SELECT count(*) FROM labels) AS lost""",
)
def status_rollup(spark, root):
    from lodestone.plans.family_queries import doc_sessions

    return I.status_rollup(
        doc_sessions(spark, root),
        M.capture_conflicts(order_candidates(spark, root)),
        ledgers(spark, root)[0],
        classified_pages(spark, root),
        page_evaluations(spark, root),
        read_table(spark, root, "labels"),
    )


@query(
    "age_days",
    "SELECT CAST(event_id AS VARCHAR) AS source_event_id, CAST(greatest(0, floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 86400000000.0)) AS BIGINT) AS age FROM events",
)
def age_days_query(spark, root):
    ev = read_table(spark, root, "events")
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return ev.select(F.col("event_id").cast("string").alias("source_event_id"), age_days(iso_micros(F.col("ts")), now).alias("age"))


# ---- upkeep ----


@query(
    "source_changes",
    """SELECT coalesce(a.s, b.s) AS session_id, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'unchanged' END AS change
FROM (SELECT CAST(l_partkey AS VARCHAR) AS s, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT CAST(l_partkey AS VARCHAR) AS s, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON a.s = b.s""",
)
def source_changes(spark, root):
    return U.source_changes(*part_fingerprints(spark, root))


def part_fingerprints(spark: SparkSession, root: str) -> list[DataFrame]:
    li = read_table(spark, root, "lineitem")
    f = li.groupBy(F.col("l_partkey").cast("string").alias("session_id"), "l_linestatus").agg(
        F.count("*").cast("string").alias("fingerprint")
    )
    return [f.filter(F.col("l_linestatus") == s).drop("l_linestatus") for s in "FO"]


@query(
    "upsert_projection",
    """WITH n AS (SELECT CAST(l_partkey AS VARCHAR) AS s, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)
SELECT CAST(l_partkey AS VARCHAR) AS session_id, l_linestatus, count(*) AS row_count FROM lineitem JOIN n ON n.s = CAST(l_partkey AS VARCHAR)
WHERE (l_linestatus = 'F' AND f = o) OR (l_linestatus = 'O' AND f <> o AND o > 0) GROUP BY 1, 2""",
)
def upsert_projection(spark, root):
    changes = U.source_changes(*part_fingerprints(spark, root))
    li = read_table(spark, root, "lineitem").select(
        F.col("l_partkey").cast("string").alias("session_id"), "l_linestatus", "l_orderkey"
    )
    out = U.upsert_projection(li.filter("l_linestatus = 'F'"), changes, li.filter("l_linestatus = 'O'"))
    return out.groupBy("session_id", "l_linestatus").agg(F.count("*").alias("row_count"))


@query(
    "revision_pin",
    """SELECT CAST(doc_id AS VARCHAR) AS session_id, p.page_id IS NULL OR sha256(p.html) <> sha256(d.text) AS revision_mismatch
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
)
def revision_pin(spark, root):
    docs = page_store(spark, root)
    now = page_paths(spark, root).select(
        F.col("candidate_id").alias("session_id"), F.sha2("html", 256).alias("revision_digest")
    )
    return pin_revision(docs, now, F.col("digest")).select("session_id", "revision_mismatch")


@query(
    "overlay_saved_local",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS s, text, sha256(text) AS dg, string_split(text, chr(10)) AS parts, source FROM documents),
x AS (SELECT *, CASE WHEN source < 'src3' THEN text || 'tail' ELSE parts[1] END AS loc FROM d)
SELECT s AS session_id, CASE WHEN source < 'src3' THEN 'local' ELSE 'store' END AS source, true AS saved,
  CASE WHEN source < 'src3' THEN sha256(loc) ELSE dg END AS revision_digest, dg AS saved_digest, source < 'src3' AS saved_version_behind FROM x""",
)
def overlay_saved_local(spark, root):
    # local copies: grown where the source sorts low, cut to the first line elsewhere
    d = read_table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.lit("t").alias("path"), "text", "source")
    saved = d.select("session_id", "path", F.col("text").alias("content"), F.sha2("text", 256).alias("digest"))
    grown = F.when(F.col("source") < "src3", F.concat("text", F.lit("tail"))).otherwise(F.split("text", "\n")[0])
    local = d.select("session_id", "path", grown.alias("content"), F.sha2(grown, 256).alias("digest"))
    return U.overlay_saved_local(saved, local)


# ---- secrets ----

_TOKEN = r"""((?:api_key|secret|token|password) = ")[0-9A-Za-z]{20,}\""""


@query(
    "secret_scan",
    f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, i, string_split(text, chr(10))[i] AS line FROM documents,
  LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i))
SELECT session_id, 'line:' || i AS source_cursor, 'labelled-token' AS rule_id, regexp_extract(line, '{_TOKEN}', 1) || '…' AS preview
FROM l WHERE regexp_matches(line, '{_TOKEN}')""",
)
def secret_scan(spark, root):
    ev = document_lines(read_table(spark, root, "documents")).filter("text is not null")
    return U.secret_hits(ev, F.col("text")).select("session_id", "source_cursor", "rule_id", "preview")


@query(
    "withheld_sessions",
    f"""SELECT CAST(doc_id AS VARCHAR) AS session_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_TOKEN}'))) AS BIGINT) AS hits,
  CAST(0 AS BIGINT) AS unscanned FROM documents WHERE regexp_matches(text, '{_TOKEN}')""",
)
def withheld_sessions(spark, root):
    ev = document_lines(read_table(spark, root, "documents")).filter("text is not null")
    return U.withheld_sessions(U.secret_hits(ev, F.col("text")))


@query(
    "mask_secrets",
    f"SELECT CAST(doc_id AS VARCHAR) AS session_id, sha256(regexp_replace(text, '{_TOKEN}', '\\1…', 'g')) AS masked FROM documents",
)
def mask_secrets_query(spark, root):
    d = read_table(spark, root, "documents")
    return d.select(F.col("doc_id").cast("string").alias("session_id"), F.sha2(mask_secrets(F.col("text")), 256).alias("masked"))


# ---- mirrored messages: purchases that a view announced ----


@query(
    "mirror_interval",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS source_event_id, event_type,
    CAST(floor(value / 10) AS BIGINT) AS text, epoch_us(ts) // 1000 AS ms FROM events)
SELECT source_event_id, EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.session_id = p.session_id AND v.text = p.text AND abs(v.ms - p.ms) <= 86400000) AS mirrored
FROM e p WHERE p.event_type = 'purchase'""",
)
def mirror_interval(spark, root):
    ev = read_table(spark, root, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").cast("string").alias("source_event_id"),
        "event_type",
        F.floor(F.col("value") / 10).cast("string").alias("text"),
        iso_micros(F.col("ts")).alias("timestamp"),
    )
    return R.mirrored(ev.filter("event_type = 'purchase'"), ev.filter("event_type = 'view'"), 86_400_000).select(
        "source_event_id", "mirrored"
    )
