import pytest

from lodestone.operators import details as D
from lodestone.operators import intake as I
from lodestone.operators import merges as M

SESSION = "session_id string, harness_id string, source_session_id string, first_timestamp string, archive_state string, subagent_parent string"
TOUCH = "array<struct<operation:string,source_path:string,normalized_path:string>>"
EVENT = (
    "session_id string, harness_id string, seq long, kind string, role string, text string, timestamp string, identity_key string, "
    f"harness_injected boolean, label_source string, file_touches {TOUCH}"
)
FILE = "session_id string, path string, size long, media_type string, sha256 string"


@pytest.fixture
def store(spark):
    sessions = spark.createDataFrame(
        [("a", "h", "src-a", "2026-01-02", "active", None), ("b", "h", "src-b", None, "archived", "src-a"),
         ("c", "h", "src-c", "2026-01-01", "active", "src-a"), ("d", "g", "src-d", None, "active", "src-a")],
        SESSION,
    )
    e = lambda s, seq, text, key, source=None, touches=(): (s, "h", seq, "message", "user", text, f"t{seq}", key, False, source, list(touches))
    events = spark.createDataFrame(
        [e("a", 1, " first  words ", "k1", touches=[("read", "x", "x"), ("read", "y", "y")]), e("a", 2, "shared", "k2"), e("a", 3, "later", "k3"),
         e("b", 1, "shared", "k2"), e("b", 2, "a title", None, "ai_title"), e("b", 3, "  ", None, "custom_title"), e("c", 1, "alone", "k9")],
        EVENT,
    )
    files = spark.createDataFrame(
        [("a", "z.jsonl", 5, "t", "s1"), ("a", "b.jsonl", 7, "t", "s2"), ("a", "b.jsonl", 7, "t", "s2"), ("b", "q", 1, None, "s3")], FILE
    )
    families = spark.createDataFrame([("a", "a"), ("b", "a")], "session_id string, family_key string")
    return sessions, events, files, families


def test_every_session_in_one_row(store):
    got = {r.session_id: r for r in D.session_details(*store).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    a, b, d = got["a"], got["b"], got["d"]
    assert (a.label, a.label_source, a.label_seq) == ("first words", "user_message", 1)
    assert (b.label, b.label_source) == ("a title", "ai_title"), "a title of spaces falls through"
    assert (a.artifacts, a.artifact_bytes, a.file_touches, a.event_count, a.kinds) == (2, 12, 2, 3, {"message": 3})
    assert (a.children, a.first_child, a.parent_session) == (2, "b", None)
    assert (b.parent_session, b.parent_resolved) == ("a", True)
    assert (d.parent_session, d.parent_resolved, d.event_count, d.artifacts, d.children, d.label) == ("src-a", False, 0, 0, 0, None), "another harness"
    assert (a.anchor, b.anchor, a.member_count, got["c"].family_key) == ("a", "a", 2, None)


def test_one_session_whole(store):
    detail = D.session_detail(*store, "a")
    every = {r.session_id: r.asDict() for r in D.session_details(*store).collect()}
    assert [r.asDict() for r in detail.head.collect()] == [every["a"]]
    assert [r.path for r in detail.artifacts.collect()] == ["b.jsonl", "z.jsonl"]
    assert [r.child_session for r in detail.children.collect()] == ["b", "c"]
    assert [(r.session_id, r.is_anchor, r.shared_events, r.last_shared_seq) for r in detail.family.collect()] == [("a", True, 0, None), ("b", False, 1, 2)]
    lone = D.session_detail(*store, "c")
    assert lone.family.collect() == [] and lone.head.first().children == 0
    assert D.session_detail(*store, "none").head.collect() == []


def test_columns_with_clashing_names(store):
    from pyspark.sql import functions as F

    sessions, *rest = store
    named = sessions.withColumn("label", F.lit("old")).withColumn("children", F.lit(9)).withColumn("anchor", F.lit("old"))
    got = {r.session_id: r for r in D.session_details(named, *rest).collect()}
    assert (got["a"].label, got["a"].children, got["a"].anchor) == ("first words", 2, "a")
    assert D.session_details(*[t.filter("false") for t in store]).collect() == []


def test_readmission_and_errors(spark):
    c = spark.createDataFrame(
        [("gone", "tombstoned", "d1", False, False), ("secret", "tombstoned", "d2", True, False), ("other", "associated", "d3", False, False),
         ("frozen", "associated", "d4", False, False), ("broken", "associated", "d5", False, False), ("out", "out_of_scope", "d6", False, False)],
        "candidate_id string, class string, digest string, flagged boolean, override boolean",
    )
    store = spark.createDataFrame([], "session_id string, digest string")
    frozen = spark.createDataFrame([("frozen",), ("gone",)], "session_id string")
    errors = spark.createDataFrame([("broken", "m"), ("broken", "again"), ("out", "m"), ("frozen", "m")], "candidate_id string, message string")
    full = {r.candidate_id: r.outcome for r in I.accept_revisions(c, store, frozen, errors=errors).collect()}
    assert full == {"gone": "tombstoned", "secret": "tombstoned", "other": "accepted", "frozen": "conflicted", "broken": "error", "out": "out_of_scope"}
    named = spark.createDataFrame([("gone",), ("gone",), ("secret",)], "candidate_id string")
    out = I.accept_revisions(c, store, frozen, only=named, readmit=True, errors=errors)
    assert {r.candidate_id: r.outcome for r in out.collect()} == {"gone": "accepted", "secret": "flagged"}
    ledger = spark.createDataFrame([("gone", 1, "t", "r"), ("secret", 2, "t", "r")], "unit string, epoch long, deleted_at string, replica string")
    assert [r.unit for r in M.tombstones(ledger, I.accepted_store(store, out)).collect()] == ["secret"], "a session that is live again is no tombstone"
    with pytest.raises(ValueError):
        I.accept_revisions(c, store, frozen, readmit=True)


def test_adoption_follows_the_marker(spark):
    led = "unit string, epoch long, deleted_at string, replica string"
    target = spark.createDataFrame([("t", 4, "t1", "r")], led)
    source = spark.createDataFrame([("x", 9, "t2", "r"), ("y", 3, "t1", "r"), ("live", 1, "t", "r")], led)
    live = spark.createDataFrame([("live",)], "session_id string")
    for marker, first in ((0, 5), (4, 5), (70, 71)):
        after = M.adopt_ledger(source, target, live, marker)
        assert {(r.unit, r.epoch) for r in after.collect()} == {("t", 4), ("y", first), ("x", first + 1)}
        assert M.advanced_marker(target, after, marker).first().marker == first + 1
    assert M.advanced_marker(target, target, 70).first().marker == 70, "nothing moved"


def test_bound_paths(spark):
    b = spark.createDataFrame([("p", "/a", False), ("p", "/a/", True), ("q", "/b", False)], "project_id string, path string, is_root boolean")
    owned = spark.createDataFrame([("p", "/a"), ("p", "/a"), (None, None)], "owner string, owner_root string")
    got = {(r.project_id, r.path): (r.bound_as, r.capture_state, r.sessions) for r in I.bound_paths(b, owned).collect()}
    assert got == {("p", "/a"): ("root", "capturing", 2), ("q", "/b"): ("alias", "history_only", 0)}
