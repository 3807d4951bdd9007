"""The corpus pipeline: near-duplicate, mixing and token stages against brute force, the other two against their operators."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import decontamination, quality_classifier
from lodestone.llm.common import read

ROOT = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_of_each_component(rows):
    """Ids kept by brute force: every pair's full sets are compared."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    common = collections.Counter((a, b) for group in holders.values() for k, a in enumerate(group) for b in group[k + 1 :])
    for (a, b), both in common.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i for i in ids if top(i) == i}


def test_every_stage(spark, monkeypatch):
    seen = []

    def watched(step):
        def call(session, docs, sf_dir):
            seen.append((docs.columns, docs.collect()))
            return step(session, docs, sf_dir)

        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(step)) for name, step in corpus_pipeline.STAGES])
    stored = corpus_pipeline.run(spark, ROOT).collect()
    assert len(seen) == 5 and all(columns == seen[0][0] for columns, _ in seen)
    first, good, single, clean, mixed = (rows for _, rows in seen)

    scored = quality_classifier.scored(read(spark, ROOT, "documents"), read(spark, ROOT, "labels"))
    rejected = {r.doc_id for r in scored.filter("predicted = 0").collect()}
    assert {r.doc_id for r in first} > {r.doc_id for r in good} == {r.doc_id for r in first} - rejected

    assert {r.doc_id for r in single} == least_of_each_component(good)

    frame = spark.createDataFrame([(r.doc_id, r.text) for r in single], "doc_id long, text string")
    leaks = {r.doc_id for r in decontamination.leaks(frame, read(spark, ROOT, "benchmark")).collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - leaks

    sizes, largest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in clean:
        n = len(words_of(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in clean} and max(copies.values()) <= 3
    for r in mixed:
        taken[r.source] += len(words_of(r.text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, fixed, whole = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        rate = (whole - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = {s: 3 * sizes[s] for s in rest if rate * weight[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in order:
        assert abs(taken[s] - fixed.get(s, rate * weight[s])) <= largest[s], s

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, at = [], 0
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*encode.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stored) == sorted(expected)


def test_stages_with_clashing_columns_and_null_ids(spark):
    """Columns named as the stages name theirs; ids that are null or repeated."""
    import random

    rng = random.Random(2)
    words = "the of and lease river stone harbor winter ledger copper signal meadow".split()
    rows = []
    for i in range(30):
        text = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(40))
        rows += [(i, text, f"s{i % 3}", i, i, "x", [1], None)] + ([(i + 100, text, "s0", 0, 0, "y", [], 1)] if i % 7 == 0 else [])
    rows += [(None, "a text without an id of its own, kept as it is", "s1", 1, 1, "z", [], 2), (5, {r[0]: r[1] for r in rows}[5], "s2", 5, 5, "x", [1], None), (400, None, None, 0, 0, "", [], 3)]
    schema = "doc_id long, text string, source string, _copies int, copies int, row string, _id array<int>, n long"
    docs = spark.createDataFrame(rows, schema)
    single = corpus_pipeline.near_dedup_stage(spark, docs, ROOT)
    assert single.columns == docs.columns
    ids = [r.doc_id for r in single.collect()]
    assert sorted(ids, key=str) == sorted([*range(30), None, 400], key=str)
    mixed = corpus_pipeline.mix(spark, single, ROOT)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {*range(30), None}
    clean = corpus_pipeline.decontaminate(spark, docs, ROOT)
    assert clean.columns == docs.columns and clean.count() == len(rows)


def test_ids_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 1)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (7,)], "doc_id long")
    assert sorted(r.text for r in corpus_pipeline._by_id(docs, ids, "left_semi").collect()) == ["a", "b", "d"]
    assert sorted(r.text for r in corpus_pipeline._by_id(docs, ids, "left_anti").collect()) == ["c", "e"]
    assert sorted(r.text for r in corpus_pipeline._by_id(docs, ids.filter("doc_id = 1"), "left_anti").collect()) == ["c", "d", "e"]
