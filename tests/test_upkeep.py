"""Families after changes against families found anew, and how much of the store a change reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import families as G
from lodestone.operators import family_upkeep as K

HELD = "harness_id string, identity_key string, session_id string"


def rows(rng, sessions, keys):
    return {(h, f"k{rng.randrange(keys)}", f"s{s:04d}") for s in sessions for h in ("a", "b")[: 1 + s % 2] for _ in range(rng.randrange(4))}


def families(df):
    return {r.session_id: r.family_key for r in G.components(G.identity_edges(df)).toDF("session_id", "family_key").collect()}


@pytest.mark.parametrize("seed, keys, bound", [(1, 60, 200_000), (2, 150, 1), (3, 400, 200_000)])
def test_changes_equal_a_full_run(spark, seed, keys, bound, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_ROWS", bound)
    rng = random.Random(seed)
    state = rows(rng, range(120), keys)
    # one session holds a third of all rows
    state |= {("a", f"k{i}", "s0007") for i in range(len(state) // 2)} if seed == 2 else set()
    touched = rng.sample(range(140), 25) + ([7] if seed == 2 else [])
    fresh = rows(rng, [s for s in touched if rng.random() < 0.7], keys)
    names = {f"s{s:04d}" for s in touched}
    after = {r for r in state if r[2] not in names} | {r for r in fresh if r[2] in names}
    held = spark.createDataFrame(sorted(state), HELD)
    before = G.components(G.identity_edges(held)).toDF("session_id", "family_key")
    changes = K.family_changes(before, held, spark.createDataFrame([(n,) for n in sorted(names)], "session_id string"), spark.createDataFrame(sorted(fresh), HELD))
    got = {r.session_id: r.family_key for r in K.apply_family_changes(before, changes).collect()}
    expected = families(spark.createDataFrame(sorted(after), HELD))
    assert got == expected
    was = {r.session_id: r.family_key for r in before.collect()}
    assert {r.session_id for r in changes.collect()} == {s for s in was.keys() | expected.keys() if was.get(s) != expected.get(s)}


def test_a_change_reads_its_own_families_only(spark, monkeypatch):
    """A thousand families; one is split, two are merged: components see the edges of those alone."""
    store = {("a", f"k{f}_{i}", f"s{f:04d}_{m}") for f in range(1000) for i in range(2) for m in range(3)} | {("a", "own", "s0005_1")}
    held = spark.createDataFrame(sorted(store), HELD)
    before = spark.createDataFrame([(f"s{f:04d}_{m}", f"s{f:04d}_0") for f in range(1000) for m in range(3)], "session_id string, family_key string")
    seen, found = [], K.components

    def counted(edges):
        seen.append(edges.count())
        return found(edges)

    monkeypatch.setattr(K, "components", counted)
    # 3_0 leaves its family; 8_1 takes a key of family 9; 5_1 loses a key that nobody shares.
    fresh = [("a", "new", "s0003_0"), *[("a", f"k8_{i}", "s0008_1") for i in range(2)], ("a", "k9_0", "s0008_1"), *[("a", f"k5_{i}", "s0005_1") for i in range(2)]]
    touched = spark.createDataFrame([("s0003_0",), ("s0008_1",), ("s0005_1",)], "session_id string")
    changes = K.family_changes(before, held, touched, spark.createDataFrame(fresh, HELD))
    assert {(r.session_id, r.family_key) for r in changes.collect()} == {
        ("s0003_0", None), ("s0003_1", "s0003_1"), ("s0003_2", "s0003_1"), *[(f"s0009_{m}", "s0008_0") for m in range(3)],
    }
    assert sum(seen) <= 4


def test_no_changes_and_nothing(spark):
    empty = spark.createDataFrame([], HELD)
    none = spark.createDataFrame([], "session_id string")
    families = spark.createDataFrame([("a", "a"), ("b", "a")], "session_id string, family_key string")
    held = spark.createDataFrame([("h", "k", "a"), ("h", "k", "b"), ("h", None, "c")], HELD)
    assert K.family_changes(families, held, none, empty).count() == 0
    gone = K.family_changes(families, held, none.union(spark.createDataFrame([("b",)], "session_id string")), empty)
    assert sorted((r.session_id, r.family_key) for r in gone.collect()) == [("a", None), ("b", None)]
    assert K.apply_family_changes(families, gone).count() == 0


def test_continuations_hold_families_together(spark):
    sessions = spark.createDataFrame(
        [("ses1", "h", "x1", None), ("ses2", "h", "x2", "x1"), ("ses3", "h", "x3", "x9")], "session_id string, harness_id string, source_session_id string, continuation_parent string"
    )
    held = K.all_holdings(spark.createDataFrame([], HELD), sessions)
    assert sorted(r.session_id for r in held.select("session_id").collect()) == ["ses1", "ses2"]
    assert families(held.withColumn("identity_key", F.col("identity_key"))) == {"ses1": "ses1", "ses2": "ses1"}


@pytest.mark.parametrize("hot, packed", [(2, 3), (8, 1000)])
def test_hint_where_one_session_holds_a_third_of_all_keys(spark, hot, packed):
    """Hot keys of many sessions and a session with most keys; ties, labels, a candidate of its own keys alone."""
    rng = random.Random(hot)
    held = {f"s{i:03}": {f"k{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randrange(1, 12))} for i in range(120)}
    held["s777"] = {f"k{i}" for i in range(300)}
    cand = {f"c{i}": {f"k{int(rng.paretovariate(0.5)) % 420}" for _ in range(rng.randrange(1, 15))} for i in range(40)}
    cand |= {"c90": {"k1"}, "c91": {f"k{i}" for i in range(0, 400, 3)}, "c92": {"only mine"}, "s777": held["s777"], "s003": held["s003"]}
    as_df = lambda d: spark.createDataFrame([(s, "h", k) for s, ks in d.items() for k in ks], "session_id string, harness_id string, identity_key string")
    labels = spark.createDataFrame([(s, f"label {s}") for s in held if s != "s001"], "session_id string, label string")
    found = G.family_hint(as_df(cand), as_df(held), hot, labels, packed)
    got = {r.session_id: (r.with_session, r.shared_events, r.total_events, r.further_sessions, r.with_label) for r in found.collect()}
    want = {}
    for c, keys in cand.items():
        shared = {s: len(keys & ks) for s, ks in held.items() if s != c and keys & ks}
        if shared:
            best = min(shared, key=lambda s: (-shared[s], s))
            want[c] = (best, shared[best], len(keys), len(shared) - 1, f"label {best}" if best != "s001" else None)
    assert got == want


def test_context_reads_the_blocks_around_matches(spark, tmp_path):
    """Windows of every size equal those over all positions, and published events are read by block."""
    from lodestone.operators.search import context_window, run_counts

    rng = random.Random(4)
    events, starts = [], {}
    for s in range(6):
        seq, firsts = 1, []
        while seq <= (900 if s == 0 else 130):
            length = rng.choice([1, 1, 2, 3, 25])
            events += [(f"s{s}", q, seq) for q in range(seq, seq + length)]
            firsts.append(seq)
            seq += length
        starts[f"s{s}"] = firsts
    shown = [(s, q) for s in ("s0", "s1", "s5") for q in rng.sample(starts[s], 4)]
    schema = "session_id string, seq long, run_first_seq long"
    spark.createDataFrame(events, schema).repartitionByRange(8, "session_id", "seq").sortWithinPartitions("session_id", "seq").write.option(
        "parquet.block.size", 4096
    ).parquet(str(tmp_path / "events"))
    table = spark.read.parquet(str(tmp_path / "events"))
    hits = spark.createDataFrame(shown, "session_id string, seq long")
    for n, block in ((0, 16), (2, 16), (9, 16), (3, 10_000)):
        want = set()
        for s, q in shown:
            at = starts[s].index(q)
            want |= {(s, q, x) for x in starts[s][max(0, at - n) : at + n + 1] if (s, x) not in shown}
        for index in (None, run_counts(table, block)):
            got = context_window(hits, table, n, index, block)
            assert {tuple(r) for r in got.select("session_id", "match_seq", "seq").collect()} == want


def test_context_pushes_its_blocks_to_the_scan(spark, tmp_path, monkeypatch):
    from lodestone.operators import search

    rows = [(f"s{s}", q, q) for s in range(20) for q in range(1, 200)]
    spark.createDataFrame(rows, "session_id string, seq long, run_first_seq long").coalesce(1).sortWithinPartitions("session_id", "seq").write.parquet(str(tmp_path / "e"))
    table, plans, stage = spark.read.parquet(str(tmp_path / "e")), {}, search.stage

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(search, "stage", watched)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    index = search.run_counts(table, 16)
    found = search.context_window(spark.createDataFrame([("s3", 40)], "session_id string, seq long"), table, 2, index, 16)
    assert sorted(r.seq for r in found.collect()) == [38, 39, 41, 42]
    scan = next(line for line in plans["places"].split("\n") if "PushedFilters" in line)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = scan[scan.index("PushedFilters") :]
    assert "EqualTo(session_id,s3)" in pushed and "GreaterThanOrEqual(seq,17)" in pushed and "LessThanOrEqual(seq,64)" in pushed
