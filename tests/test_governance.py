import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intake as I
from lodestone.operators import merges as M
from lodestone.operators import predicates as P
from lodestone.operators import refresh as U
from lodestone.sources import projection as J
from lodestone.sources.jsonl import parsed, revisions
from lodestone.streaming.runs import late_rows, run_batch, runs_so_far
from lodestone.streaming.upsert import compact, current, ingest_transcripts, publish, replace_sessions, transcripts


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_longest_root_wins_then_smaller_project(spark):
    b = df(spark, [("p2", "/a", True), ("p1", "/a/", True), ("p3", "/a/b", False), ("p0", "/ab", True)], "project_id string, path string, is_root boolean")
    paths = df(spark, [("/a",), ("/a/x",), ("/a/b/c",), ("/a/bc",), ("/ab",), ("/q",), (None,)], "opening_path string")
    got = {r.opening_path: r.owner for r in I.longest_prefix_owner(paths, b).collect()}
    assert got == {"/a": "p1", "/a/x": "p1", "/a/b/c": "p3", "/a/bc": "p1", "/ab": "p0", "/q": None}


def test_classification_precedence(spark):
    c = df(
        spark,
        [("ign", "/mine", True), ("gone", "/mine", True), ("own", "/mine", True), ("theirs", "/theirs", True),
         ("lost", "/lost", False), ("lost-decided", "/lost", False), ("free", "/free", True), ("free-decided", "/free", True),
         ("nopath", None, True), ("nopath-decided", None, True), ("stale", "/mine", True)],
        "candidate_id string, opening_path string, resolvable boolean",
    )
    owners = df(spark, [("/mine", "me"), ("/theirs", "you")], "opening_path string, owner string")
    one = lambda *ids: df(spark, [(i,) for i in ids], "candidate_id string")
    decided = df(
        spark,
        [("lost-decided", "me"), ("free-decided", "you"), ("nopath-decided", "me"), ("ign", "me"), ("stale", "you")],
        "candidate_id string, project_id string",
    )
    got = {r.candidate_id: r["class"] for r in I.classify_candidates(c, "me", owners, one("ign", "gone"), one("gone"), decided).collect()}
    assert got == {
        "ign": "ignored", "gone": "ignored", "own": "associated", "theirs": "out_of_scope", "lost": "pending",
        "lost-decided": "associated", "free": "out_of_scope", "free-decided": "out_of_scope", "nopath": "pending",
        "nopath-decided": "associated", "stale": "associated",
    }
    gone = {r.candidate_id: r["class"] for r in I.classify_candidates(c, "me", owners, one(), one("gone"), decided).collect()}
    assert gone["gone"] == "tombstoned"


def test_acceptance_gates(spark):
    c = df(
        spark,
        [("a", "associated", "d1", False, False), ("b", "associated", "d2", True, False), ("c", "associated", "d2", True, True),
         ("d", "associated", "d1", True, False), ("e", "pending", "d9", False, False), ("f", "associated", "d1", False, False)],
        "candidate_id string, class string, digest string, flagged boolean, override boolean",
    )
    store = df(spark, [("d", "d1"), ("a", "d0")], "session_id string, digest string")
    out = I.accept_revisions(c, store, df(spark, [("f",)], "session_id string"))
    assert {r.candidate_id: r.outcome for r in out.collect()} == {
        "a": "accepted", "b": "flagged", "c": "accepted", "d": "unchanged", "e": "pending", "f": "conflicted"}
    assert {(r.session_id, r.digest) for r in I.accepted_store(store, out).collect()} == {("a", "d1"), ("c", "d2"), ("d", "d1")}


EVAL = "candidate_id string, harness_id string, bundle_digest string, evaluated_at string, first_flagged_at string"


def test_evaluation_state(spark):
    prev = df(spark, [("keep", "h", "d1", "2026-02", "2026-01"), ("lost", "h", "d1", "2026-01", None), ("down", "x", "d1", "2026-01", None),
                      ("done", "h", "d7", "2026-01", None), ("ign", "h", "d1", "2026-01", None)], EVAL)
    cur = df(spark, [("keep", "h", "d2", "2026-03", "2026-03"), ("new", "h", "d3", "2026-03", None)], EVAL)
    found = df(spark, [("keep", "associated"), ("new", "associated"), ("done", "associated"), ("ign", "ignored")], "candidate_id string, class string")
    store = df(spark, [("done", "d7")], "session_id string, digest string")
    down = df(spark, [("x",)], "harness_id string")
    got = {r.candidate_id: (r.action, r.first_flagged_at) for r in I.evaluation_state(prev, cur, found, store, down).collect()}
    assert got == {"keep": ("keep", "2026-01"), "new": ("keep", "2026-03"), "lost": ("lost", "2026-01"), "down": ("keep", "2026-01"),
                   "done": ("cleared", "2026-01"), "ign": ("cleared", "2026-01")}
    narrowed = {r.candidate_id: r.action for r in I.evaluation_state(prev, cur, found, store, down, full_run=False).collect()}
    assert narrowed["lost"] == "keep"


def test_decisions_and_losses(spark):
    d = df(spark, [("c", "ignore", None, "2026-01"), ("c", "associate", "p", "2026-02"), ("e", "associate", "p", "2026-01"), ("e", "ignore", None, "2026-03")],
           "candidate_id string, action string, project_id string, decided_at string")
    assert {r.candidate_id: r.action for r in I.explicit_decisions(d).collect()} == {"c": "associate", "e": "ignore"}
    loss = "candidate_id string, first_flagged_at string, pruned_at string"
    old = df(spark, [(f"c{i:03}", "f", f"2026-{i:03}") for i in range(100)], loss)
    kept = I.append_losses(old, df(spark, [("new", "f", "2027"), ("c050", "f", "2028")], loss)).collect()
    ids = {r.candidate_id for r in kept}
    assert len(kept) == 100 and "new" in ids and "c000" not in ids and "c050" in ids


def test_adoption(spark):
    cand = "session_id string, key string, digest string, accepted_at string"
    src = df(spark, [("new", "k", "d", "1"), ("same", "k9", "d", "1"), ("differs", "k", "d2", "1"), ("deleted", "k", "d", "1"),
                     ("frozen", "k1", "d1", "1"), ("frozen", "k2", "d2", "1")], cand)
    tgt = df(spark, [("same", "k", "d", "2"), ("differs", "k", "d1", "2")], cand)
    led = df(spark, [("deleted", 1, "t", "r"), ("same", 2, "t", "r")], "unit string, epoch long, deleted_at string, replica string")
    got = {r.session_id: r.outcome for r in M.adopt_units(src, tgt, led).collect()}
    assert got == {"new": "merged", "same": "skipped", "differs": "conflict", "deleted": "skipped", "frozen": "conflict"}
    inc = df(spark, [("x", 7, "t2", "r"), ("y", 3, "t1", "r"), ("same", 9, "t", "r"), ("deleted", 1, "t", "r")], led.schema)
    out = {(r.unit, r.epoch) for r in M.adopt_ledger(inc, led, tgt).collect()}
    assert out == {("deleted", 1), ("same", 2), ("y", 3), ("x", 4)}


def test_three_way(spark):
    s = "unit string, digest string"
    base = df(spark, [("u", "1"), ("pl", "1"), ("ps", "1"), ("m", "1"), ("c", "1"), ("gone", "1")], s)
    local = df(spark, [("u", "1"), ("pl", "1"), ("ps", "2"), ("m", "3"), ("c", "4"), ("mine", "1")], s)
    remote = df(spark, [("u", "1"), ("pl", "2"), ("ps", "1"), ("m", "3"), ("c", "5"), ("gone", "1"), ("theirs", "1")], s)
    got = {r.unit: r.outcome for r in M.three_way_merge(base, local, remote).collect()}
    assert got == {"u": "unchanged", "pl": "pulled", "ps": "pushed", "m": "merged", "c": "conflicted", "gone": "pushed", "mine": "pushed", "theirs": "pulled"}


def test_overlay_needs_every_file_to_be_a_prefix(spark):
    s = "session_id string, path string, content string, digest string"
    saved = df(spark, [("a", "f", "abcdef", "A"), ("a", "g", "xy", "A"), ("b", "f", "abc", "B"), ("s", "f", "z", "S")], s)
    local = df(spark, [("a", "f", "abc", "a"), ("a", "g", "xy", "a"), ("b", "f", "abd", "b"), ("l", "f", "q", "L")], s)
    got = {r.session_id: (r.source, r.saved, r.revision_digest, r.saved_version_behind) for r in U.overlay_saved_local(saved, local).collect()}
    assert got == {"a": ("store", True, "A", False), "b": ("local", True, "b", True), "s": ("store", True, "S", False), "l": ("local", False, "L", False)}
    extra = local.union(df(spark, [("a", "h", "", "a")], s))
    assert {r.session_id: r.source for r in U.overlay_saved_local(saved, extra).collect()}["a"] == "local"


def test_pin_fails_the_job_when_strict(spark):
    rows = df(spark, [("s", "d1")], "session_id string, cited string")
    now = df(spark, [("s", "d2")], "session_id string, revision_digest string")
    assert P.pin_revision(rows, now, F.col("cited")).first().revision_mismatch is True
    with pytest.raises(Exception, match="cited revision"):
        P.pin_revision(rows, now, F.col("cited"), strict=True).collect()


def test_bundles_of_any_size_digest_alike(spark):
    files = spark.range(500).select(F.lit("s").alias("session_id"), F.concat(F.lit("f"), "id").alias("path"), F.col("id").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    a, b = revisions(files).first(), revisions(files.orderBy(F.desc("id"))).first()
    other = revisions(files.filter("id <> 7")).first()
    assert a == b and a.file_count == 500 and a.revision_digest != other.revision_digest


def test_export_documents_list_all_files(spark):
    files = spark.range(10_050).select(F.lit("s").alias("session_id"), F.col("id").cast("string").alias("path"), F.col("id").alias("size"), F.lit("t").alias("media_type"), F.lit("d").alias("sha256"))
    names = "session_id revision_digest harness_id source_session_id association_mode opening_path continuation_parent subagent_kind subagent_parent archive_state accepted_at".split()
    sessions = df(spark, [("s",) * len(names)], ", ".join(f"{n} string" for n in names)).withColumn("subagent_origin", F.lit(False))
    assert J.session_documents(sessions, files).first().document.count('"path"') == 10_050


def test_a_root_owns_what_lies_below_it_and_a_slash(spark):
    paths = df(spark, [("/",), ("/a/b",), ("/ab",), ("/a/",)], "opening_path string")
    roots = df(spark, [("top", "/"), ("a", "/a/")], "project_id string, path string")
    got = {r.opening_path: r.owner for r in I.longest_prefix_owner(paths, roots).collect()}
    assert got == {"/": "top", "/a/b": "a", "/ab": None, "/a/": "a"}


def test_publish_switches_and_prunes(spark, tmp_path):
    root = str(tmp_path / "p")
    t = df(spark, [("h", "s", 1)], "harness_id string, session_id string, seq long")
    J.write_projection({"events": t}, root, "c1", spark)
    J.write_projection({"events": t.union(t.withColumn("seq", F.lit(2)))}, root, "c2", spark)
    assert J.read_projection(spark, root, "events").count() == 2
    assert J.freshness(J.current_pointer(spark, root), "c2").first().state == "fresh"
    assert J.freshness(J.current_pointer(spark, root), "c3").first().state == "stale"
    J.prune_versions(spark, root)
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.name.startswith("v=")) == ["v=c2"]
    with pytest.raises(FileNotFoundError):
        J.read_projection(spark, str(tmp_path / "none"), "events")


RUN = "session_id string, kind string, role string, text string, ts timestamp, id long"


def test_stream_runs_survive_retries_and_keep_late_rows(spark, tmp_path):
    root = str(tmp_path / "r")
    at = lambda i: dt.datetime(2026, 1, 1, 0, 0, i)
    row = lambda s, i, t: (s, "system", None, t, at(i), i)
    b0 = df(spark, [row("s", 1, "a"), row("s", 2, "a"), row("t", 1, "x")], RUN)
    b1 = df(spark, [row("s", 3, "a"), row("s", 4, "b"), row("s", 2, "late")], RUN)
    b2 = df(spark, [row("s", 5, "b"), row("t", 9, "x")], RUN)
    run_batch(b0, 0, root)
    run_batch(b1, 1, root)
    run_batch(b1, 1, root)
    run_batch(b2, 2, root)
    got = {(r.session_id, r.run_first_seq, r.run_last_seq, r.text) for r in runs_so_far(spark, root).collect()}
    assert got == {("s", 1, 3, "a"), ("s", 4, 5, "b"), ("t", 1, 2, "x")}
    assert [r.text for r in late_rows(spark, root).collect()] == ["late"]


def test_replacing_sessions_twice_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    s = "session_id string, seq long"
    replace_sessions(spark, table, df(spark, [("a", 1), ("a", 2), ("b", 1)], s))
    for _ in range(2):
        replace_sessions(spark, table, df(spark, [("a", 9)], s), df(spark, [("b",)], "session_id string"))
    assert {(r.session_id, r.seq) for r in spark.read.parquet(table).collect()} == {("a", 9)}


def _normalize(lines):
    """Sessions of main and subagent files by the main file's stem."""
    stem = F.regexp_extract("file", r"/in/([^/]+?)(?:\.jsonl|/subagents/[^/]+)$", 1)
    return lines.select(stem.alias("session_id"), F.col("file"), F.col("line").alias("seq"), F.col("value").isNull().alias("bad"))


@pytest.mark.parametrize("files_per_batch", [1, 2, 1000])
def test_transcripts_do_not_depend_on_batches(spark, tmp_path, files_per_batch):
    src, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    (src / "a" / "subagents").mkdir(parents=True)
    (src / "a.jsonl").write_text('{"n":1}\nbroken\n')
    (src / "a" / "subagents" / "agent-1.jsonl").write_text('{"n":1}\n')
    (src / "b.jsonl").write_text('{"n":1}\n')

    def seen():
        rows = transcripts(spark, table).collect()
        return sorted((r.session_id, r.file.rsplit("/", 1)[1], r.seq, r.bad) for r in rows)

    def ingest():
        return ingest_transcripts(spark, str(src), table, state, _normalize, files_per_batch=files_per_batch)

    assert ingest() == 2
    first = [("a", "a.jsonl", 1, False), ("a", "a.jsonl", 2, True), ("a", "agent-1.jsonl", 1, False), ("b", "b.jsonl", 1, False)]
    assert seen() == first and ingest() == 0
    with (src / "b.jsonl").open("a") as f:  # an appended transcript is read again
        f.write('{"n":2}\n')
    (src / "c.jsonl").write_text('{"n":1}\n')
    assert ingest() == 2
    assert seen() == [*first, ("b", "b.jsonl", 2, False), ("c", "c.jsonl", 1, False)]
    (src / "a" / "subagents" / "agent-1.jsonl").unlink()
    assert ingest() == 1
    assert seen() == [*first[:2], first[3], ("b", "b.jsonl", 2, False), ("c", "c.jsonl", 1, False)]


@pytest.mark.parametrize(("most", "batches"), [(10_000, 4), (4, 5)])
def test_batches_of_transcripts_grow(spark, tmp_path, monkeypatch, most, batches):
    """Twelve files from one a batch on: 1, 2, 4 and the rest, or never more than ``most``."""
    from lodestone.streaming import upsert

    monkeypatch.setattr(upsert, "BATCH_FILES", most, raising=False)
    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / "in" / f"{i}.jsonl").write_text('{"n":1}\n')
    table, state = str(tmp_path / "t"), str(tmp_path / "state")
    assert ingest_transcripts(spark, str(tmp_path / "in"), table, state, _normalize, files_per_batch=1) == 12
    assert sorted(int(r.session_id) for r in transcripts(spark, table).collect()) == list(range(12))
    assert len(list((tmp_path / "t" / "rows").glob("batch=*"))) <= batches


def test_versions_may_come_in_any_batches(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "u"), ("b", 3, "v"), ("b", 5, "w")]
    for name, cuts in (("one", [rows]), ("many", [[r] for r in rows]), ("back", [[r] for r in rows[::-1]])):
        table = str(tmp_path / name)
        for n, part in enumerate(cuts):
            for _ in range(2):  # a batch may be repeated
                publish(spark, table, df(spark, part, "session_id string, modified_at long, text string"), "modified_at", n)
        got = sorted(r.text for r in current(spark, table, "modified_at").collect())
        assert got == ["u", "w", "y", "z"]
    compact(spark, table, "modified_at", f"{table}-compact")
    assert sorted(r.text for r in spark.read.parquet(f"{table}-compact/rows").collect()) == got


def test_partial_issues(spark):
    raw = df(spark, [("s", "{}"), ("s", "nope"), ("t", "{}")], "session_id string, raw string")
    failed = df(spark, [("u",)], "session_id string")
    got = {r.session_id: (r.unparseable, r.failed, r.partial) for r in U.partial_issues(parsed(raw), failed).collect()}
    assert got == {"s": (1, False, True), "t": (0, False, False), "u": (0, True, True)}


def test_secret_hits_never_show_the_secret(spark):
    body = "k3" * 15
    lines = df(spark, [("s", "f", "line:1", f'token = "{body}"'), ("s", "f", "line:2", "fine")], "session_id string, source_file string, source_cursor string, text string")
    hits = U.secret_hits(lines, F.col("text")).collect()
    assert [(h.rule_id, h.source_cursor) for h in hits] == [("labelled-token", "line:1")]
    assert body not in hits[0].preview and hits[0].preview == 'token = "…'


def test_ledger_partitions_follow_the_line_items(spark, monkeypatch):
    """A task takes some of the events, however few partitions the session's shuffles have, also where the sides are compared."""
    from lodestone.plans import governance_queries as G

    root = "/root/testdata/sf0.001"
    expected = {tuple(r) for r in M.events_beyond(*G.ledgers(spark, root)).collect()}
    items = spark.read.parquet(f"{root}/lineitem.parquet").count()
    monkeypatch.setattr(G, "LEDGER_ROWS", 100, raising=False)
    beyond = M.events_beyond(*G.ledgers(spark, root))
    assert beyond.rdd.getNumPartitions() >= items // 100
    assert {tuple(r) for r in beyond.collect()} == expected


def test_events_are_numbered_in_their_ranges(spark):
    """Ranges keep to themselves: none is shuffled again, where several could meet in one task, to be numbered."""
    from lodestone.operators.blocks import dense_seq

    rows = spark.createDataFrame([((k * 7919) % 1000 // 3, k) for k in range(1000)], "a int, b int")
    numbered = dense_seq(rows, [], ["a", "b"], "n", 9)
    assert "row_number" not in numbered._jdf.queryExecution().toString()
    got = sorted((r.n, r.a, r.b) for r in numbered.collect())
    assert got == [(i, *row) for i, row in enumerate(sorted(((k * 7919) % 1000 // 3, k) for k in range(1000)), 1)]
    assert dense_seq(rows.limit(0), [], ["a", "b"], "n").collect() == []
