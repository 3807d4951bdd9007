import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.json import canonical_json, sparse_json
from lodestone.operators import evaluate as E
from lodestone.operators import families as G
from lodestone.operators import layout as L
from lodestone.operators import merges as M
from lodestone.operators import search as S
from lodestone.operators import sessions as N
from lodestone.operators.blocks import dense_seq, running_sum
from lodestone.operators.mirror import mirrored
from lodestone.operators.runs import adjacent_runs, logical_positions
from lodestone.sources.tables import canonical

EVENT = "session_id string, seq long, kind string, role string, text string, timestamp string"


def events(spark, rows):
    df = spark.createDataFrame(rows, EVENT)
    cols = {c: F.col(c) for c in df.columns}
    return canonical(df, harness_id=F.lit("h"), source_file=F.lit("t.jsonl"), source_cursor=F.concat(F.lit("line:"), F.col("seq").cast("string")), source_event_id=F.concat("session_id", F.lit("-"), F.col("seq").cast("string")), **cols)


def brute_runs(rows):
    out, prev, first = {}, None, None
    for sid, seq, kind, role, text, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        same = (
            prev is not None and prev[0] == sid and prev[2] == kind and text is not None and prev[4] == text
            and (kind != "message" or prev[3] == role)
        )
        first = first if same else seq
        prev = (sid, seq, kind, role, text)
        out[(sid, seq)] = first
    last = {}
    for (sid, seq), f in out.items():
        last[(sid, f)] = max(seq, last.get((sid, f), 0))
    return {k: (f, last[(k[0], f)]) for k, f in out.items()}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_runs_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    rows = [
        (s, i, rng.choice(["message", "tool_call"]), rng.choice(["user", None]), rng.choice(["a", None]) if s == "x" else rng.choice("ab"), None)
        for s, n in (("x", 40), ("y", 61), ("z", 1))
        for i in range(1, n + 1)
    ] + [("long", i, "system", None, "same", None) for i in range(1, 30)]
    got = {(r.session_id, r.seq): (r.run_first_seq, r.run_last_seq) for r in adjacent_runs(events(spark, rows), block).collect()}
    want = brute_runs(rows)
    assert got == want
    total = sum(b - a + 1 for (s, q), (a, b) in got.items() if q == a)
    assert total == len(rows)
    places = logical_positions(adjacent_runs(events(spark, rows), block), block).collect()
    for sid in {"x", "y", "z", "long"}:
        reps = sorted(q for (s, q), (a, _) in want.items() if s == sid and q == a)
        assert sorted((p.seq, p.position) for p in places if p.session_id == sid) == list(zip(reps, range(1, len(reps) + 1)))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_dense_seq_with_a_hot_key(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", rng.randrange(50), i) for i in range(400)] + [(f"k{i % 7}", rng.randrange(50), i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    got = {(r.k, r.a, r.b): r.seq for r in dense_seq(df, ["k"], ["a", "b"], parts=parts).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        assert [got[r] for r in mine] == list(range(1, len(mine) + 1))
    whole = {(r.k, r.a, r.b): r.n for r in dense_seq(df, [], ["a", "b", "k"], "n", parts).collect()}
    assert [whole[r] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]))] == list(range(1, len(rows) + 1))


def test_running_sum_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(1, 20)], "k string, seq long, v long")
    got = {r.seq: r.s for r in running_sum(df, ["k"], "seq", F.col("v"), "s", 4).collect()}
    assert got == {i: sum(j % 3 for j in range(1, i + 1)) for i in range(1, 20)}


# ---- search ----


def test_rank_selects_source_order_shows(spark):
    rows = [
        ("s", 1, "message", "user", "needle padding padding padding", None),
        ("s", 2, "message", "user", "needle needle needle", None),
        ("s", 3, "message", "user", "needle needle", None),
    ]
    found = S.search_text(adjacent_runs(events(spark, rows)), None, "needle", limit=2)
    assert [r.seq for r in found.matches.collect()] == [2, 3]
    assert found.totals.first().total_matches == 3


def test_search_limit_cuts_through_groups_and_recency(spark):
    rows = [(s, i, "message", "user", f"up {s} {i}", f"2026-01-0{9 - i if s == 'a' else i}") for s in "abc" for i in (1, 2, 3, 4)]
    ev = adjacent_runs(events(spark, rows))
    got = S.search_text(ev, None, "up", limit=4, per_session=3).matches.collect()
    # the newest of a is its first event; ties go to the larger id
    assert [(r.session_id, r.seq) for r in got] == [("a", 1), ("a", 2), ("a", 3), ("c", 4)]
    timed = S.search_text(ev, None, "up", limit=5, per_session=2, sort="time").matches.collect()
    assert [(r.session_id, r.seq) for r in timed] == [("b", 3), ("b", 4), ("c", 3), ("c", 4), ("a", 1)]


def test_copies_collapse_before_caps(spark):
    rows = [(s, i, "message", "user", f"needle {i}", None) for s in "abc" for i in (1, 2)]
    ev = adjacent_runs(events(spark, rows)).withColumn("identity_key", F.when(F.col("session_id") != "c", F.col("text")))
    sessions = spark.createDataFrame(
        [("a", "h", "2026-02", "active"), ("b", "h", "2026-01", "active"), ("c", "h", None, "active")],
        "session_id string, harness_id string, first_timestamp string, archive_state string",
    )
    fam = G.fork_families(ev)
    assert {(r.session_id, r.family_key) for r in fam.collect()} == {("a", "a"), ("b", "a")}
    found = S.search_text(ev, sessions, "needle", families=fam)
    t = found.totals.first()
    assert (t.total_matches, t.family_collapsed_matches) == (4, 2)
    assert {(r.session_id, r.seq) for r in found.matches.collect()} == {("b", 1), ("b", 2), ("c", 1), ("c", 2)}
    assert {r.session_id for r in found.also_in.collect()} == {"a"}
    facts = G.visible_family_facts(found.matches, found.also_in, sessions, fam).collect()
    assert {(r.session_id, r.anchor, r.member_count) for r in facts} == {("a", "b", 2), ("b", "b", 2)}


def test_context_merges_and_skips_matches(spark):
    rows = [("s", i, "message", "user", "needle" if i in (3, 5) else f"t{i // 10 if i > 8 else i}", None) for i in range(1, 13)]
    ev = adjacent_runs(events(spark, rows))
    shown = S.search_text(ev, None, "needle").matches
    got = {(r.match_seq, r.seq) for r in S.context_window(shown, ev, 2).collect()}
    assert got == {(3, 1), (3, 2), (3, 4), (5, 4), (5, 6), (5, 7)}


def test_layouts_are_lossless(spark):
    rows = [(s, i, "message", "user", f'needle "{i}" — x' if i % 2 else f"pad {i}", None) for s in ("a", "b") for i in range(1, 7)]
    rows += [("a", 7, "message", "user", "needle run", "2026"), ("a", 8, "message", "user", "needle run", "2026")]
    ev = adjacent_runs(events(spark, rows))
    shown = S.search_text(ev, None, "needle", limit=6).matches.withColumn("ord", F.monotonically_increasing_id())
    for context in (None, S.context_window(shown, ev, 1)):
        r = L.result_rows(shown, "ord", context, ev).cache()
        docs = L.result_documents(r).first()
        flat = [x.json for x in L.flat_json(r).orderBy("_ord").collect()]
        back = [x.json for x in L.expand_groups(L.result_documents(r)).collect()]
        assert back == flat and len(flat) > 3
        assert docs.layout == ("grouped" if docs.grouped_bytes < docs.flat_bytes else "flat")
        assert '"archiveState"' not in docs.flat and '"timestamp":null' in docs.flat


def test_timeline(spark):
    rows = [("s", i, "message", "user", t, None) for i, t in enumerate("abbbcd", 1)]
    ev = adjacent_runs(events(spark, rows))
    assert [r.seq for r in N.timeline(ev, "s", start=3).collect()] == [2, 5, 6]
    page = N.timeline(ev, "s", limit=2)
    assert [r.seq for r in page.collect()] == [1, 2]
    assert N.next_cursor(page, ev, "s").first().next_cursor == 5
    assert [r.seq for r in N.timeline_tail(ev, "s", 2).collect()] == [5, 6]
    e = N.event_at(ev, "s", 3).first()
    assert (e.run_first_seq, e.run_last_seq) == (2, 4)


def test_labels_fall_through_empty_titles(spark):
    rows = [("s", 1, "message", "user", "first", None), ("s", 2, "lifecycle", None, "Title", None), ("s", 3, "lifecycle", None, " \n", None)]
    ev = events(spark, rows).withColumn(
        "label_source", F.when(F.col("seq") == 2, "ai_title").when(F.col("seq") == 3, "custom_title")
    )
    r = N.session_labels(ev).first()
    assert (r.label, r.label_source, r.label_seq) == ("Title", "ai_title", 2)


# ---- families ----


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    want = {x: find(x) for x in parent}
    rng.shuffle(edges)
    got = {r.node: r.root for r in G.components(spark.createDataFrame(edges, "v string, p string")).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [1, 2, 4, 1000])
def test_family_hint_against_brute_force(spark, hot):
    rng = random.Random(hot)
    held = {f"s{i:02}": {f"k{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(1, 7))} for i in range(25)}
    held["s90"] = set(held["s00"])
    cand = {"c1": {"k1", "k2", "k3"}, "c2": {"none"}, "c3": {"k1"}, **{k: held[k] | {"extra"} for k in list(held)[:10]}, "s90": held["s90"]}
    as_df = lambda d: spark.createDataFrame([(s, "h", k) for s, ks in d.items() for k in ks], "session_id string, harness_id string, identity_key string")
    got = {r.session_id: (r.with_session, r.shared_events, r.total_events, r.further_sessions) for r in G.family_hint(as_df(cand), as_df(held), hot).collect()}
    want = {}
    for c, keys in cand.items():
        shared = {s: len(keys & ks) for s, ks in held.items() if s != c and keys & ks}
        if shared:
            best = min(shared, key=lambda s: (-shared[s], s))
            want[c] = (best, shared[best], len(keys), len(shared) - 1)
    assert got == want


def test_family_hint_of_a_common_key_writes_no_pairs(spark, monkeypatch):
    """300 sessions that share one key, some a second one: sets of keys are compared, not their holders."""
    rows = [(f"s{i:03}", "h", k) for i in range(300) for k in ("all", f"own{i}", *(["few"] if i % 3 == 2 else []))]
    held = spark.createDataFrame(rows, "session_id string, harness_id string, identity_key string")
    staged = []

    def counting(df, name, stage=G.stage):
        out = stage(df, name)
        staged.append(out.count())
        return out

    monkeypatch.setattr(G, "stage", counting)
    got = {r.session_id: (r.with_session, r.shared_events, r.further_sessions) for r in G.family_hint(held, held, 8, bitmap_holders=150).collect()}
    assert got == {
        f"s{i:03}": (("s002" if i != 2 else "s005", 2, 298) if i % 3 == 2 else ("s000" if i else "s001", 1, 298)) for i in range(300)
    }
    assert max(staged) <= len(rows)


# ---- merges ----

MARK = "session_id string, state string, transitioned_at string, replica string"


def test_archive_merge_commutes(spark):
    a = spark.createDataFrame([("s", "archived", "2026-01", "r1"), ("t", "active", "2026-02", "r1"), ("u", "archived", "2026-01", "r1")], MARK)
    b = spark.createDataFrame([("s", "active", "2026-01", "r2"), ("t", "archived", "2026-01", "r9")], MARK)
    ab, ba = (sorted(M.merge_archive(*p).collect()) for p in ((a, b), (b, a)))
    assert ab == ba == sorted(M.merge_archive(M.merge_archive(a, b), b).collect())
    assert {r.session_id: r.state for r in ab} == {"s": "active", "t": "active", "u": "archived"}


LEDGER = "unit string, epoch long, deleted_at string, replica string"


def test_reconcile_moves_all_pending(spark):
    local = spark.createDataFrame([("a", 1, "d1", "r"), ("b", 2, "d2", "r"), ("c", 9, "d9", "r"), ("x", 3, "d5", "z")], LEDGER)
    remote = spark.createDataFrame([("a", 1, "d1", "r"), ("x", 3, "d4", "q"), ("y", 4, "d1", "q")], LEDGER)
    got = {(r.unit, r.epoch, r.deleted_at) for r in M.reconcile_ledgers(local, remote, True).collect()}
    assert got == {("a", 1, "d1"), ("x", 3, "d4"), ("y", 4, "d1"), ("b", 5, "d2"), ("c", 6, "d9")}
    ahead = local.filter("unit <> 'b'")
    kept = {(r.unit, r.epoch) for r in M.reconcile_ledgers(ahead, remote, True).collect()}
    assert ("c", 9) in kept
    plain = {(r.unit, r.epoch) for r in M.reconcile_ledgers(local, remote).collect()}
    assert ("b", 2) in plain and ("c", 9) in plain


def test_resolve_conflict_statuses(spark):
    c = spark.createDataFrame(
        [("s", "k1", "ab1", "2026-02"), ("s", "k2", "ab1", "2026-01"), ("s", "k3", "ac2", "2026-01")],
        "session_id string, key string, digest string, accepted_at string",
    )
    conflicts = M.capture_conflicts(c)
    choices = spark.createDataFrame([("s", "ab"), ("s", "a"), ("s", "zz")], "session_id string, prefix string")
    got = {r.prefix: (r.status, r.key) for r in M.resolve_conflicts(conflicts, choices).collect()}
    assert got == {"ab": ("resolved", "k2"), "a": ("ambiguous", None), "zz": ("none", None)}
    with pytest.raises(Exception, match="ambiguous"):
        M.resolve_conflicts(conflicts, choices.filter("prefix = 'a'"), strict=True).collect()


def test_session_count_guard(spark):
    df = spark.range(3)
    assert N.expect_sessions(df, 3).count() == 3
    with pytest.raises(Exception, match="mismatch"):
        N.expect_sessions(df, 4).collect()


def test_mirror_against_brute_force(spark):
    rng = random.Random(5)

    def stamp():
        return rng.choice([None, "bad"] + [f"2026-01-01T00:00:0{rng.randrange(10)}.{rng.randrange(1000):03}Z" for _ in range(20)])

    said = [(f"s{rng.randrange(3)}", stamp(), rng.choice("abcdefgh")) for _ in range(40)]
    asked = [(i, f"s{rng.randrange(3)}", stamp(), rng.choice("abcdefgh")) for i in range(120)]

    def ms(t):
        return None if t == "bad" else int(t[17:19]) * 1000 + int(t[20:23])

    def hit(s, t, x):
        same = [u for (s2, u, x2) in said if s2 == s and x2 == x]
        if not same:
            return False
        if t is None or None in same:
            return True
        return ms(t) is not None and any(ms(u) is not None and abs(ms(u) - ms(t)) <= 1000 for u in same)

    got = mirrored(
        spark.createDataFrame(asked, "i long, session_id string, timestamp string, text string"),
        spark.createDataFrame(said, "session_id string, timestamp string, text string"),
    )
    assert {r.i: r.mirrored for r in got.collect()} == {i: hit(s, t, x) for i, s, t, x in asked}


def test_phrases_against_brute_force(spark):
    docs = [("d1", 1, "the cat sat on the mat"), ("d2", 1, "xthe cat saty"), ("d3", 1, "cat sat"), ("d4", 1, "a\ncat  sat on it")]
    phrases = [("q1", "the cat sat"), ("q2", "cat sat"), ("q3", "on the ma"), ("q4", "zzz"), ("q5", "cat  sat on"), ("q6", "at"), ("q7", "a")]
    got = E.phrase_matches(
        spark.createDataFrame(phrases, "query_id string, text string"), spark.createDataFrame(docs, "session_id string, seq long, text string")
    )
    assert {(r.query_id, r.session_id) for r in got.collect()} == {(q, d) for (q, p), (d, _, t) in itertools.product(phrases, docs) if p in t}


def test_json_forms(spark):
    df = spark.createDataFrame([("s", "active", 0)], "id string, state string, n int")
    doc = sparse_json({"id": F.col("id"), "state": (F.col("state"), "active"), "n": (F.col("n"), 0)}, always=["n"])
    assert df.select(doc.alias("d")).first().d == '{"id":"s","n":0}'
    entries = F.create_map(F.lit("b\""), F.lit("1"), F.lit("a"), F.lit("{}"), F.lit("z"), F.lit("2"))
    assert df.select(canonical_json(entries, ["z"]).alias("d")).first().d == '{"z":2,"a":{},"b\\"":1}'


def test_copies_among_odd_documents_as_in_sql(spark, tmp_path):
    """Documents without text or language, and rows that came twice, count as the SQL counts them."""
    duckdb = pytest.importorskip("duckdb")
    from lodestone.plans import family_queries, more_queries  # noqa: F401
    from lodestone.plans.registry import QUERIES, SQL

    rows = [
        (1, "", "en", "s1"), (2, "", "en", "s2"), (3, None, "en", "s1"), (4, "", "de", "s1"), (5, "a mention", None, "s1"), (6, "a mention", None, "s2"),
        (7, "station", "en", None), (8, "station", "en", "s9"), (9, "station", "de", "s9"), (10, "twice", "en", "s1"), (10, "twice", "en", "s1"),
        (11, "again", "en", "s3"), (11, "again", "en", "s1"), (12, "again", "en", "s2"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("collapse_copies", "search_with_families"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name


def test_staging_leaves_no_shuffle_files(spark):
    """Else they stay until the driver collects garbage."""
    import re
    import time

    from lodestone.session import stage

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString("\n")))
    before = names()
    staged = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counted")
    ends = time.time() + 20
    while (left := names() - before) and time.time() < ends:  # executors delete them a little later
        time.sleep(0.2)
    assert not left
    assert sorted((r.k, r.n) for r in staged.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_family_hint_keeps_keys_with_partners_only(spark, monkeypatch):
    """Keys of one holder are not staged again, and keys with the same holders are paired once."""
    rows = [(s, "h", f"{s}-{i}") for s in "abcdef" for i in range(9)] + [(s, "h", f"shared-{i}") for s in "abc" for i in range(5)] + [("d", "h", "shared-0")]
    held = spark.createDataFrame(rows, "session_id string, harness_id string, identity_key string")
    sizes, staged = {}, G.stage

    def counted(df, name):
        out = staged(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(G, "stage", counted)
    got = {r.session_id: (r.with_session, r.shared_events, r.total_events, r.further_sessions) for r in G.family_hint(held, held).collect()}
    assert got == {"a": ("b", 5, 14, 2), "b": ("a", 5, 14, 2), "c": ("a", 5, 14, 2), "d": ("a", 1, 10, 2)}
    assert sizes["known"] == 16 and sizes["few-holders"] == 5
