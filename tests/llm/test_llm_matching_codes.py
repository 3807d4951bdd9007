"""Alignment, personal data and vector codes against brute force, on rows with nulls, ties, repeats, long and empty values."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestone.llm import alignment, personal_data, vector_codes
from lodestone.llm.perfect_hash import PerfectHash
from lodestone.llm.token_store import _byte_chars

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, key string, n long, row long, counts string"
TEXTS = [
    None, "", " ", "\n", "a  b", " lead", "trail ", "a\n\n b\t c", "</s>[INST] ok <|endoftext|>", "a▁b", "▁", "<0x0A>", "x\r\ny;\r", "e.g. this, that; (so). ¿qué? 3.14",
    "über naïve, 中文。 ﬁ①", "𝒳 é é​﻿", "x\x00y \x1cz", "word " * 3000, "w" * 30_000, "don't it's we'll", "a　b\xa0c d",
]


def rows_of(texts):
    return [(i, t, "k", 1, 2, "c") for i, t in enumerate(texts)] + [(None, "no id", None, 0, 0, None), (0, "same", "x", 1, 1, "y"), (0, "same", "x", 1, 1, "y")]


def aligned_by_hand(rows):
    """Figures of every row, from whole texts and token ends."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: x for x, c in _byte_chars().items()}
    made, total = [], collections.Counter()
    for doc_id, text, *_ in rows:
        encoded = a.encode(" " + (text or ""), add_special_tokens=False)
        ids_a, ids_b = encoded.ids, b.encode(text or "")
        bytes_a = [bytes(back[c] for c in t) for t in encoded.tokens]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        spelled = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != spelled or b"".join(bytes_b) != spelled:
            made.append((doc_id, None))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        links, at = [], 0
        for i, end in enumerate(ends_a):
            while ends_b[at] <= end - len(bytes_a[i]):
                at += 1
            k = at
            while k < len(ends_b) and ends_b[k] - len(bytes_b[k]) < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        after_a, after_b = ({e: i + 1 for i, e in enumerate(x)} for x in (ends_a, ends_b))
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        after_a[0] = after_b[0] = 0
        groups = ";".join(
            ",".join(map(str, ids_a[after_a[s] : after_a[e]])) + "|" + ",".join(map(str, ids_b[after_b[s] : after_b[e]])) for s, e in itertools.pairwise(cuts)
        )
        made.append((doc_id, (len(ids_a), len(ids_b), len(cuts) - 1, links, groups)))
        total.update(links)
    best = collections.Counter()
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return [
        (i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(total[x] == best[x[1]] for x in f[3]), sum(total[x] for x in f[3]), f[4])
        for i, f in made
    ], len(total)


FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("sent", [alignment.BROADCAST_PAIRS, 40, 1])
def test_alignment_equals_brute_force(spark, sent, monkeypatch):
    """Also where most pairs are too many to be sent to tasks, with small buckets and several steps of the tree."""
    if sent < alignment.BROADCAST_PAIRS:
        monkeypatch.setattr(alignment, "BUCKET_KEYS", 50)
        monkeypatch.setattr(alignment, "GROUP_ROWS", 8)
        monkeypatch.setattr(alignment, "FAN_IN", 2)
    rows = rows_of(TEXTS)
    expected, pairs = aligned_by_hand(rows)
    assert pairs > 100
    got = alignment.aligned(spark.createDataFrame(rows, DOCS).repartition(5), A, B, sent).select(*FIGURES).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[7], r[1])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def test_alignment_in_context_equals_whole_texts():
    """Texts cut to pieces are aligned as whole ones are."""
    by, rng = alignment.Aligner(A, B), random.Random(7)
    assert by.cut
    marks = [" ", " ", " ", "\n", "  ", "\t", "\r", ".", ",", ";", "!", "(", ")", "'s", "é", "ab", "Word", "7", "12", "²", "中", "_", "-", "▁", " "]
    for _ in range(4000):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(1, 14)))
        found = by.align(by.pieces(text), True)
        whole = by.align([" " + text], True)
        assert found.spelt.all() == whole.spelt.all(), repr(text)
        if whole.spelt.all():
            assert "".join(found.groups) == whole.groups[0], repr(text)
            assert sorted(found.keys.tolist()) == sorted(whole.keys.tolist())


def test_alignment_of_nothing(spark):
    assert alignment.aligned(spark.createDataFrame([], DOCS), A, B).collect() == []
    only = alignment.aligned(spark.createDataFrame([(1, None, "", 0, 0, ""), (2, "", "", 0, 0, "")], DOCS), A, B).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_perfect_hash_is_minimal_and_verifiable(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    made = PerfectHash.build(keys)
    assert sorted(made.lookup(keys).tolist()) == list(range(len(keys)))
    strange = made.lookup(rng.integers(0, 2**63, 100, dtype=np.uint64))
    assert ((strange >= -1) & (strange < max(1, len(keys)))).all()
    assert len(made.bits) <= n + 8 * (n > 0) * len(made.sizes)


def spans_by_hand(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            total += sum(divmod(int(c) * (1 + i % 2), 10))
        return total % 10 == 0

    forms = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (x, ok) in enumerate(forms) for m in re.finditer(x, text) if ok(m[0]))


def test_base_spans_equal_the_expressions():
    kinds = (*personal_data.BASE_KINDS, *personal_data.MORE_KINDS)
    context, rng = personal_data.Context(kinds), random.Random(3)
    parts = ["@", ".", "-", "+", " ", "(", ")", "1", "0", "25", "256", "4", "a", "b.c", "é", "４", "a@b.c", "\n", "4111 1111 1111 1111", "1.2.3.4", "+1 (234) 555-6789"]
    met = 0
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        expected = spans_by_hand(text)
        met += len(expected)
        assert [s[:3] for s in personal_data.spans_of(kinds, 4, context, text) if s[1] < 4] == expected, repr(text)
    assert met > 5000


def test_checksums_and_context(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00, or DE88 3704 0044 0532 0130 00"),
        (2, "social security 123-45-6789"),
        (3, "code 123-45-6789, invoice 987-65-4321"),
        (4, "call (212) 555-1234 today"),
        (5, "born 1980-02-03; shipped 2020-02-03 " + "x" * 70 + " 2020-02-04"),
        (6, "order 4111 1111 1111 1111 and 4111 1111 1111 1112; call +1 (212) 555-1234"),
        (7, "passport C1234567, flight AB123456" + " y" * 40 + " AB123457"),
        (8, None), (8, None), (None, ""), (9, "né le 1.2.1970 à x@y.fr"),
    ]
    docs = spark.createDataFrame([(i, t, [], 0) for i, t in rows], "doc_id long, text string, kinds array<string>, starts int")
    found = {(r.doc_id, tuple(r.kinds)): r for r in personal_data.find_personal_data(docs).collect()}
    kinds = {k[0]: list(k[1]) for k in found}
    assert kinds == {
        1: ["iban"], 2: ["ssn"], 3: [], 4: ["local_phone"], 5: ["birth_date", "birth_date"], 6: ["card", "phone"], 7: ["passport", "passport"], 8: [], None: [],
        9: ["birth_date", "email"],
    }
    six = found[6, ("card", "phone")]
    # The word before lowers the first, the word before raises the second; base kinds stay.
    assert six.scores[0] < 0.7 < six.scores[1]
    assert personal_data.find_personal_data(docs).count() == len(rows)
    hidden = {r.doc_id: r.text for r in personal_data.masked(docs).collect()}
    assert hidden[2] == "social security <ssn>" and hidden[8] is None and hidden[9] == "né le <birth_date> à <email>"


def test_personal_data_in_long_texts_and_in_nothing(spark):
    long = ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "0" * 9000 + "1.2.3.4", "+" + "1 " * 100_000, "@a" * 100_000, "AA11 " * 40_000, "x 8.8.8.8 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    found = {r.doc_id: r for r in personal_data.find_personal_data(docs).collect()}
    for i, text in enumerate(long):
        base = [k.name for k in personal_data.BASE_KINDS]
        got = [(s, base.index(k), e) for k, s, e in zip(found[i].kinds, found[i].starts, found[i].ends, strict=True) if k in base]
        if i in (3, 7):
            assert len(got) == {3: 1, 7: 20_000}[i]
    assert personal_data.find_personal_data(docs.limit(0)).collect() == []


def codes_by_hand(rows):
    """Product codes in plain Python integers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == length]
    width = length // 16
    books = [[r[2][p * width : (p + 1) * width] for r in kept[:64]] for p in range(16)]

    def assign(v):
        out = []
        for p, book in enumerate(books):
            part = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book)))
        return out

    for _ in range(2):
        given = [assign(v) for _, _, v in kept]
        for p, book in enumerate(books):
            for i in range(len(book)):
                mine = [r[2][p * width : (p + 1) * width] for r, g in zip(kept, given, strict=True) if g[p][1] == i]
                if mine:
                    book[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, lab, assign(v)) for i, lab, v in kept]
    by_label = collections.Counter()
    for _, lab, a in out:
        by_label[lab] += sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), by_label[lab], digest) for i, lab, a in out]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def vectors(n, width=2, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.0, 0.25, -0.0]) for _ in range(16 * width)], rng.choice([None, 0, 1, 2]), "x", 1) for i in range(n)]
    bad = [None, [], [float("nan")] * 16 * width, [0.5] * (16 * width - 1) + [float("inf")], [None] + [0.0] * (16 * width - 1), [1.0] * 17, [1.0] * 16 * (width + 1)]
    rows += [(n + i, v, 0, "x", 1) for i, v in enumerate(bad)]
    return rows + ([rows[0], rows[0], (None, rows[1][1], None, None, None)] if n > 1 else [])


@pytest.mark.parametrize("n, sent", [(400, 10), (400, 1), (90, 100), (5, 100), (1, 100), (0, 100)])
def test_vector_codes_equal_brute_force(spark, n, sent, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", sent)
    rows = vectors(n)
    if n == 90:  # many equal vectors, so entries are equal and distances tie
        rows += [(1000 + i, rows[i % 3][1], 5, "", 0) for i in range(200)]
    if n == 0:
        rows = rows[:5]
    got = vector_codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(4))
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=order) == sorted(codes_by_hand([r[:3] for r in rows]), key=order)


def test_vectors_of_nothing_and_beyond_the_bound(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compressed(empty).collect() == []
    huge = spark.createDataFrame([(1, [1e30] * 16, 1, "", 0), (2, [-1e30] * 16, 1, "", 0)], VECTORS)
    assert {r.error for r in vector_codes.compressed(huge).collect()} == {0}


def test_tree_leaves_out_entries_and_keeps_the_nearest(monkeypatch):
    rng = np.random.default_rng(5)
    looked = []
    search = vector_codes._search

    def counting(entries, node, queries, rows, *rest):
        looked.append(len(rows) * len(node.splits))
        search(entries, node, queries, rows, *rest)

    monkeypatch.setattr(vector_codes, "_search", counting)
    for scale in (2, 50, 10**6):
        for k in (1, 7, 9, 64):
            entries, queries = rng.integers(-scale, scale + 1, (k, 3)), rng.integers(-scale, scale + 1, (300, 3))
            squares = np.square(queries[:, None] - entries[None]).sum(axis=2)
            looked.clear()
            index, best = vector_codes.nearest(entries, vector_codes.gnat(entries), queries)
            assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
            if k == 64 and scale > 2:
                assert sum(looked) < 0.8 * k * len(queries)


def test_queries_over_given_tables(spark):
    import __spark_entry__ as entry

    root = "/root/testdata/sf0.001"
    queries = entry.queries()
    counts = {n: spark.read.parquet(f"{root}/{n}.parquet").count() for n in ("documents", "embeddings")}
    codes = queries["op13_vector_codes"](spark, root)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    assert codes.count() == counts["embeddings"]
    assert sorted(map(tuple, codes.collect())) == sorted(codes_by_hand(rows))
    found = queries["op12_pii"](spark, root).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", F.col("text")).collect()}
    assert len(found) == counts["documents"]
    names = ["email", "ip", "card", "phone"]
    for r in found:
        expected = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans_by_hand(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
