"""Operators of the llm folder against brute force, on rows with nulls, ties, repeats, very long and empty texts."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lodestone.llm import (
    automaton,
    chat_format,
    decontamination,
    license_scan,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_store,
    url_filter,
)
from lodestone.llm.components import components
from lodestone.session import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and lease river stone harbor winter ledger copper signal meadow 7 12 km Ada Über naïve 中文".split()
DOCS = "doc_id long, text string, source string, n_words long, size long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=60, seed=3):
    """Rows of (doc_id, text, source, and columns whose names operators use themselves)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.choice([3, 20, 60, 120]))]
        rows.append((i, " ".join(words[:10]) + "\n" + " ".join(words[10:]), f"s{i % 4}", 1, 1))
        if i % 5 == 0:  # near copies and exact ones
            near = list(words)
            near[len(near) // 2] = "changed"
            rows.append((1000 + i, " ".join(near), "s0", 2, 2))
            rows.append((2000 + i, rows[-2][1].upper(), None, 3, 3))
    rows += [(i + 3000, t, "s9", 0, 0) for i, t in enumerate([None, "", " \n\t ", "one", "x" * 50_000, "a b " * 4000])]
    rows += [(None, "null id text here", "s1", 0, 0), rows[0], rows[0]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- token blocks ----


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(BPE), token_store.Encoder(BPE, 0)
    rng = random.Random(1)
    parts = ["a", "ß", "²", "½", "ʰ", "中", "\u0301", " ", "  ", "\n", "\n\n", " \n", "\t", "\x1c", "\u00a0", "\u2003", ".", "'s", "'", "!", "|", "<|endoftext|>", "12", "_", "😀", "the", " and", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.frombuffer(ours.encode(text)[:-2], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_of_letters_and_marks_equals_the_library():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(BPE), token_store.Encoder(BPE, 0)
    rng = random.Random(2)
    stems = ["the", "Zürich", "élan", "ñ", "ªº", "ɐ", "ɏ", "Ǆ", "中文", "a²", "½", "x_y", "don't", "'s", "v2", "", "a\u0301", "ß", "\u00a0", "\u0130"]
    marks = ["", "", ".", ",", "!!", "###", ".'", "…", "|x", "-", "&*$"]
    for _ in range(3000):
        text = "".join(rng.choice(["", " ", "\n", " \n"] if rng.random() < 0.1 else [" ", " ", "\n"]) + rng.choice(stems) + rng.choice(marks) for _ in range(rng.randrange(12)))
        assert np.frombuffer(ours.encode(text)[:-2], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_keeps_the_pieces_of_a_large_task():
    """300,000 pieces, as a task of some thousand documents has, are asked for once."""
    enc, asked = token_store.Encoder(BPE, 0), []
    enc.piece = lambda piece: asked.append(piece) or b""
    for _ in range(2):
        for k in range(300_000):
            enc.cache[f"p{k}"]
    assert len(asked) == 300_000


def test_token_blocks_round_trip(spark, docs):
    from tokenizers import Tokenizer

    folder = fresh_path(spark, "t")
    token_store.write_tokens(docs, folder, BPE)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.stored_documents(spark, folder).collect())
    library, start, expected, ids_of = Tokenizer.from_file(BPE), 0, [], {}
    for doc_id, text, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        ids_of[doc_id] = ids.tolist()
        expected.append((start, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    fetched = {r.doc_id: r.ids for r in token_store.fetch(spark, folder, [3003, 5]).collect()}
    assert fetched == {3003: ids_of[3003], 5: ids_of[5]}


def test_token_blocks_of_nothing(spark, nothing):
    folder = fresh_path(spark, "t")
    token_store.write_tokens(nothing, folder, BPE)
    assert token_store.stored_documents(spark, folder).collect() == []


# ---- near-duplicates ----


def shingles(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("part", [512, 3])
def test_near_duplicates_equal_brute_force(spark, part):
    """Chains of copies whose ends are unlike, and a bucket cut into several parts."""
    rows = corpus(40)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    for i in range(25):  # a cloud of copies, some linked only through others
        words = list(base)
        for _ in range(i // 3):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        rows.append((5000 + i, " ".join(words), "s1", 0, 0))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), part=part)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert got == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect() if r.doc_id is not None)


def test_very_long_near_copies_are_cut_by_bytes(spark):
    """A bucket of long texts is compared in parts that hold few of them."""
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for i in range(6):
        near = list(long)
        for k in range(i * 60):
            near[(k * 331 + i * 17) % len(near)] = f"x{i}_{k}"
        rows.append((i, " ".join(near)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, part_bytes=100_000).collect()}
    assert got == root and len(set(root.values())) > 1


def test_near_duplicates_of_nothing(nothing):
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 260)] + [(7, 7)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(200, 260))
    assert all(got[u] == got[v] for u, v in edges if u != v)


# ---- quality ----


def test_quality_rules_equal_brute_force(docs):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs, sample_rows=40).collect()}
    for doc_id, text, *_ in corpus():
        words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
        seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for j in (i, i + 1, i + 2)}
        r = got[doc_id, len(words)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_rules_do_not_depend_on_their_order(docs):
    table = quality_rules.measured(docs).filter(~quality_rules.base_failed())
    one, two = (table.filter(quality_rules.cascade(rules).isNull()).count() for rules in (quality_rules.DEFAULT_RULES, quality_rules.DEFAULT_RULES[::-1]))
    assert one == two
    worth = [quality_rules.Estimate(r, s, n) for r, s, n in zip(quality_rules.DEFAULT_RULES, (1.0, 0.1, 1.0), (5, 5, 50), strict=False)]
    assert [r.name for r in quality_rules.ordered(worth)] == ["many_symbols", "repeated_lines", "words_long_or_short"]


def test_quality_rules_count_what_is_left(spark, docs):
    rules = quality_rules.DEFAULT_RULES[:3]
    cost = [quality_rules.Estimate(r, s, n) for r, s, n in zip(rules, (1.0, 1.0, 1.0), (60, 59, 20), strict=True)]
    together = {0b000: 900, 0b011: 59, 0b001: 1, 0b100: 20}
    assert [r.name for r in quality_rules.ordered(cost, together)] == ["words_long_or_short", "repeated_lines", "many_symbols"]
    assert [r.name for r in quality_rules.ordered(cost)] == ["words_long_or_short", "many_symbols", "repeated_lines"]
    estimates, sets = quality_rules.estimate(docs, quality_rules.DEFAULT_RULES, sample_rows=10**9)
    table = quality_rules.measured(docs).filter(~quality_rules.base_failed())
    assert sum(sets.values()) == table.count()
    for e in estimates:
        assert e.rejected == table.filter(e.rule.rejects()).count() and e.seconds > 0
    large = quality_rules.estimate(docs, rules, sample_rows=5)[1]
    assert sum(large.values()) < sum(sets.values()), "a sample below the table"


def test_quality_rules_and_classifier_of_nothing(spark, nothing, docs):
    assert quality_rules.judge(nothing).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.scored(nothing, labels).collect() == []
    assert {r.score for r in quality_classifier.scored(docs, labels).collect()} == {0.5}


def test_quality_classifier_learns_and_holds_out(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "***" if bad and rng.random() < 0.8 else w for w in words), 0 if bad else 1))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, score int")
    out = quality_classifier.scored(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= 0.3) for r in out) and len(out) == 602
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, len(quality_classifier.FEATURES)))
    y = ((x[:, 2] > 0.5) & (x[:, 6] < 0.7)).astype(float)
    model = quality_classifier.fit(np.c_[x, y])
    score = model.intercept + sum(w * quality_classifier.holds(x, list(p)) for w, p in model.rules)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{f} double" for f in quality_classifier.FEATURES))
    got = np.array([r.s for r in table.orderBy("i").select(model.column().alias("s")).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-score)))


# ---- mixing ----


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        rate = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if rate * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: rate * weight[s] for s in rest}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing_meets_targets(spark, docs):
    rows = corpus(200)
    rng = random.Random(8)
    rows += [(7000 + i, " ".join(["w"] * rng.randrange(1, 90)), "big", 0, 0) for i in range(300)]  # one source above all
    table = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(table).collect()
    sizes = collections.Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(words_of(text))
    want = brute_targets(dict(sizes))
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert len(out) == len(rows)
    # A source of one great document and a few words cannot come nearer than that document.
    assert {s: (taken[s], want[s]) for s in sizes if abs(taken[s] - want[s]) > (largest[s] if s == "s9" else max(0.02 * want[s], 130))} == {}
    again = mixing.mixed(table).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixing_of_nothing_and_of_empty_texts(spark, nothing):
    assert mixing.mixed(nothing).collect() == []
    empty = spark.createDataFrame([(1, None, "a", 0, 0), (2, " ", None, 0, 0)], DOCS)
    assert [(r.size, r.target, r.copies) for r in mixing.mixed(empty).collect()] == [(0, 0.0, 0)] * 2


# ---- secrets ----

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secret_spans_equal_the_expressions(spark):
    rng = random.Random(6)
    parts = ["token", "Password", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "é", "secret", "x/+_.", "q", "token=token : abcdefgh", "ghp_" + "a1B2" * 9]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "é" * 3000 + " token = 'abcdef123' " + "z" * 5000 + "AKIA" + "Q" * 3000), (903, "a" * 2040 + "0123456789abcdef01234567" + " x"), (None, "secret: abcdef")]
    got = {r.doc_id: list(zip(r.kinds, r.starts, r.ends, strict=True)) for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        text = text or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]
        assert [s for s in got[doc_id] if s[0] in ("assign", "access", "hex")] == base, text
    assert any(k == "github" for spans in got.values() for k, _, _ in spans)


def test_automaton_finds_all_ends():
    rng = random.Random(7)
    machine, own = automaton.compiled([r"ab+c|b{2,3}", r"[^a-c\n]x?", r"(?:ca)+"], [False, True, True])
    texts = ["".join(rng.choice("abcxCA\n") for _ in range(rng.choice([0, 5, 30, 5000]))).encode() for _ in range(30)]
    offsets = np.cumsum([0, *map(len, texts)])
    found = collections.defaultdict(int)
    for text, end, mask in machine.scan(np.frombuffer(b"".join(texts), np.uint8), offsets):
        found[text, end] |= mask
    patterns = [re.compile(p, f) for p, f in ((r"ab+c|b{2,3}", 0), (r"[^a-c\n]x?", re.I), (r"(?:ca)+", re.I))]
    for t, text in enumerate(texts):
        for end in range(1, min(len(text), 60) + 1):
            mask = sum(1 << i for i, p in enumerate(patterns) if any(p.fullmatch(text[a:end].decode()) for a in range(max(0, end - 40), end)))
            if t < 20 and len(text) < 60:
                assert found.get((t, end), 0) == mask, (text[:end], end)
    assert own[2].longest(b"xcacaca", 1) == 7 and own[2].longest(b"xc", 1) == -1


# ---- urls ----


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "x.example.com/fr/", None, "http://de.com/de/?a", "ftp://org?x", "http://badorg/de/", "s://a.com/fr/b://c", "http://u:p@h.com:80/fr/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(99, urls[0], "x"), (None, "http://q.com/x", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == got[99] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][:3] == got[3][:3] == ("", "", None) and got[3][3] == "allow"
    assert got[4][:3] == ("de.com", "/de/", "com/de/")
    assert got[5] == ("org", "", None, "allow") and got[6][:3] == ("badorg", "/de/", None)
    assert got[7][:3] == ("a.com", "/fr/b://c", "com/fr/") and got[8][0] == "u:p@h.com:80"


def test_trust_and_distrust_spread(spark):
    """Ranks against a dense power iteration; linking to blocked hosts blocks, being linked from trusted ones allows."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    pages = [(1, "http://good.org/a", link("fine.net", "good2.org")), (2, "http://good2.org/a", link("good.org", "fine.net")), (3, "http://bad.com/de/", link("bad2.com")), (4, "http://spam.net/", link("bad.com", "bad.com")), (5, "http://fine.net/", None), (6, "http://alone.net/", link("alone.net"))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge(table).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"good.org": "allow", "good2.org": "allow", "bad.com": "block", "spam.net": "block", "fine.net": "allow", "alone.net": "allow"}
    rank, edges, seed = collections.Counter(), {"good.org": ["fine.net", "good2.org"], "good2.org": ["good.org", "fine.net"]}, {"good.org": 0.5, "good2.org": 0.5}
    for _ in range(200):
        new = collections.Counter({h: 0.15 * s for h, s in seed.items()})
        for src, out in edges.items():
            for dst in out:
                new[dst] += 0.85 * rank[src] / len(out)
        rank = new
    assert all(got[h].trust == pytest.approx(rank[h], abs=1e-5) for h in ("good.org", "good2.org", "fine.net"))
    assert url_filter.judge(table.limit(0)).collect() == []


def test_hosts_far_from_every_seed_get_their_verdict(spark):
    """A chain of 45 links to a blocked host: all of it is suspect, with the rank of its distance."""
    hosts = [f"h{i}.net" for i in range(45)] + ["bad.com"]
    pages = [(i, f"http://{h}/", f'<a href="http://{hosts[i + 1]}/de/">l</a>') for i, h in enumerate(hosts[:-1])] + [(99, "http://bad.com/de/", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(r.verdict == "block" for r in got.values())
    assert all(got[i].distrust == pytest.approx(0.15 * 0.85 ** (45 - i), rel=1e-4) for i in range(45))


# ---- benchmark ----

ITEM = "Alice walked slowly 12 km from Paris to Lyon and then bought 30 apples for 5 dollars before the long winter came again to the quiet river town"


def test_leaks_and_reworded_numbers(spark):
    changed = ITEM.replace("12", "47").replace("30", "81").replace("Paris", "Oslo")
    mixed = " ".join(reversed(ITEM.split()))
    docs = [(1, "before. " + ITEM + " after"), (2, changed), (3, mixed), (4, None), (5, ""), (6, "A clean text of its own with 12 km in it and nothing more to say of Paris at all"), (7, ITEM.upper()[:20]), (None, ITEM), (8, ITEM + "\n" + ITEM), (8, ITEM + "\n" + ITEM)]
    bench = [(10, ITEM), (11, None), (12, ""), (13, "what is seven"), (14, ITEM), (None, "a null id item of at least eight words to be found by no one")]
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(d, i): v for d, v in ((1, True), (2, False), (None, True), (8, True)) for i in (10, 14)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontamination.leaks(empty, spark.createDataFrame(bench, "item_id long, text string")).collect() == []
    assert decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_inconsistent_slots_do_not_count(spark):
    item = "take 3 red stones and 4 blue stones then add 3 green stones to 4 grey stones and count them all"
    same = item.replace("3", "8").replace("4", "9")
    odd = "take 1 red stones and 2 blue stones then add 5 green stones to 6 grey stones and count them all"
    docs = spark.createDataFrame([(1, same), (2, odd)], "doc_id long, text string")
    out = decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    found = {r.doc_id: r.windows for r in out}
    assert found[1] > found.get(2, 0)


def leaked(spark, docs, items):
    frames = [spark.createDataFrame(x, f"{k} long, text string") for k, x in (("doc_id", docs), ("item_id", items))]
    return {(r.doc_id, r.item_id): r for r in decontamination.leaks(*frames).collect()}


def test_copies_of_an_item_are_judged_apart(spark):
    shape = "Tom has {} apples and buys {} more at the shop"
    items = [(i, shape.format(12 + i, 30 + 2 * i)) for i in range(20)]
    docs = [(i, shape.format(12 + i, 30 + 2 * i) + ". " + shape.format(115 + 7 * i, 245 + 3 * i)) for i in range(20)]
    docs += [(100 + i, ". ".join(shape.format(500 + 31 * i + k, 700 + 17 * i - k) for k in range(3))) for i in range(20)]
    got = leaked(spark, docs, items)
    assert all(got[i, i].verbatim for i in range(20))
    assert all(not got[100 + i, 0].verbatim for i in range(20))


def test_slot_dense_items_are_found_with_other_values(spark):
    train = "A train travels {} km in {} hours and {} km in {} hours"
    mean = "compute the mean of these values: " + " ".join(["{}"] * 24)
    items = [(1, train.format(120, 2, 90, 3)), (2, "what is 7 plus 5"), (3, mean.format(*range(3, 51, 2))), (4, " ".join(map(str, range(60, 90))))]
    docs = [(1, "Before. " + train.format(77, 4, 65, 5) + " and so on"), (2, "what is 9 plus 4"), (3, mean.format(*range(100, 196, 4)))]
    docs += [(4, train.format(77, 4, 77, 9)[:21] + "s"), (5, " ".join(map(str, range(500, 560)))), (6, " ".join(map(str, range(65, 85))))]
    assert {k: r.verbatim for k, r in leaked(spark, docs, items).items()} == {(1, 1): False, (2, 2): False, (3, 3): False, (6, 4): True}


def test_short_items_are_found_inside_long_texts(spark):
    filler = "the river ran on past the old stone harbor until winter came and went again"
    items = [(1, "what is seven"), (2, "what is 7 plus 5"), (3, "seven"), (4, "harbor winter")]
    docs = [(1, f"{filler} what is seven {filler}"), (2, f"{filler} what is 9 plus 4"), (3, filler), (4, "is seven"), (5, "what is")]
    docs += [(6, "end with what is"), (7, "seven begins here and goes on for a while")]
    got = {k: r.verbatim for k, r in leaked(spark, docs, items).items()}
    assert got == {(1, 1): True, (1, 3): True, (2, 2): False, (4, 3): True, (7, 3): True}


def test_filter_comes_in_packed_ranges(spark, monkeypatch):
    """The driver gets a row for each range of the filter, not for each of its bytes, and the same bits."""
    rng = random.Random(4)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    seen, iterate = [], DataFrame.toLocalIterator

    def counted(frame, *args, **kwargs):
        for row in iterate(frame, *args, **kwargs):
            seen.append(1)
            yield row

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", counted)
    bits = decontamination.bit_filter(spark.createDataFrame([(c,) for c in codes], "window long"), 40_000)
    hashes = np.array(codes, np.int64).view(np.uint64)
    size = np.uint64(len(bits) * 8 - 1)
    expected = np.zeros(len(bits) * 8, np.uint8)
    expected[hashes & size] = expected[(hashes >> np.uint64(32)) & size] = 1
    assert (np.packbits(expected, bitorder="little") == bits).all() and len(seen) <= 2


# ---- licenses ----


def test_license_templates(spark, docs):
    rng = random.Random(3)
    filler = [f"w{rng.randrange(9999)}" for _ in range(3000)]
    mit = license_scan.TEMPLATES[1][1].split()
    edited = list(mit)
    edited[30] = "edited"
    rows = [(1, " ".join(filler[:700] + mit + filler[700:])), (2, " ".join(filler[:1203] + edited)), (3, "Released under the MIT License."), (4, " ".join(filler)), (5, None), (6, ""), (7, " ".join(mit[:20])), (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.templates for k, r in got.items()} == {1: ["mit"], 2: ["mit"], 3: ["mit"], 4: [], 5: [], 6: [], 7: [], 8: ["cc-by-nc-4.0", "apache-2.0"]}
    assert (got[1].first_words, got[1].last_words) == ([700], [700 + len(mit) - 1])
    assert all(len(r.templates) == 0 for r in license_scan.scan(docs).collect())


def test_statements_with_other_marks_and_other_licenses(spark):
    filler = "some words before the notice"
    said = [("Released under the MIT License", "mit"), ("(released under the MIT License), as said", "mit"), ('"Licensed under CC BY-NC 4.0"', "cc-by-nc-4.0"), ("Licensed under the Apache License, version 2.0, and", "apache-2.0"), ("under the GNU Lesser General Public License v2.1", "lgpl-2.1"), ("GNU Affero General Public License, version 3", "agpl-3.0"), ("under the ISC license", "isc"), ("CC0 1.0 Universal", "cc0-1.0"), ("licensed under CC BY-SA 4.0!", "cc-by-sa-4.0"), ("released under the Unlicense.", "unlicense"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0")]
    rows = [(i, f"{filler} {text} {filler}") for i, (text, _) in enumerate(said)]
    rows.append((100, "x\n" + "\n".join(" * " + line for line in license_scan.TEMPLATES[1][1].split(", "))))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].templates for i in range(len(said))} == {i: [name] for i, (_, name) in enumerate(said)}
    assert got[100].templates == ["mit"] and got[12].first_words == [5] and got[12].last_words == [16]


def test_band_settings_keep_their_bound():
    for similarity in (0.1, 0.2, 0.5, 0.9):
        rows = license_scan.band_rows(similarity)
        if rows:
            assert (1 - similarity**rows) ** (license_scan.HASHES // rows) <= license_scan.MISS
    assert license_scan.band_rows(0.01) == 0


def test_license_windows_equal_brute_force():
    """Every text and template by all windows, on random texts of few words."""
    rng = random.Random(12)
    templates = [(f"t{i}", " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate((3, 5, 9, 14, 30))]
    held = license_scan.compiled(templates)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))) + " " + rng.choice(templates)[1] for _ in range(120)]
    raw = [t.encode() for t in texts]
    run, heads = license_scan._shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    got = license_scan.search(held, run, heads, 0.8, license_scan.HASHES)
    for i in range(len(texts)):
        part = run[heads[i] : heads[i + 1]]
        found = {t.name for t in held for a in license_scan.window_starts(len(part), t.block) if len(set(part[a : a + 2 * t.block].tolist()) & set(t.shingles.tolist())) >= 0.8 * len(t.shingles)}
        assert {h[0] for h in got.get(i, [])} == found


# ---- chat ----


def test_escaping_is_reversible():
    rng, escape = random.Random(2), chat_format.escaper()
    parts = [*chat_format.CONTROLS, "\\", "<", "|", "[", "x", "\n", "</", "<|", "/s>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        escaped = escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(c in escaped for c in chat_format.CONTROLS)


@pytest.mark.parametrize(("budget", "section"), [(20, 64), (7, 4), (1000, 8)])
def test_chat_windows(spark, budget, section):
    rng = random.Random(budget)
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in range(rng.choice([1, 8, 21])):
            role = "system" if turn == 0 and conv != 2 else ("assistant" if turn % 2 else "user")
            rows.append((conv, turn, role, " ".join(["w"] * rng.randrange(9)) + rng.choice(["", chat_format.CLOSE, "</s>", "\\"])))
    rows += [(4, None, None, None), (4, 1, "assistant", None), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, "user", "y" * 30_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq long")
    windows = chat_format.chat_windows(table, budget=budget, history_turns=2, history_tokens=12, section=section)
    found = windows.collect()
    for w in found:
        new = [s for s in w.spans if not s.repeated]
        assert len(new) == w.turns and [s.seq for s in w.spans] == sorted(s.seq for s in w.spans)
        texts = {s.seq: chat_format.unescape(w.text[s.start : s.end]) for s in w.spans}
        assert sum(len(words_of(texts[s.seq])) for s in new) <= budget or len(new) == 1
        assert sum(len(words_of(t)) for t in texts.values()) <= budget or (len(new) == 1 and sum(s.repeated for s in w.spans) <= 1)
        assert sum(s.repeated for s in w.spans) <= 3
        assert {(x.start, x.end) for x in w.loss} <= {(s.start, s.end) for s in new}
    convs = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[conv].append((role or "", text or ""))
    back = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    assert set(back) == set(convs)
    for conv, turns in convs.items():
        r, target = back[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(target))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(target.encode()).hexdigest()
    assert chat_format.chat_windows(table.filter(F.lit(False))).collect() == []


def test_chat_budget_holds_the_system_turn_and_history(spark):
    turns = [(1, 0, "system", "s " * 40)] + [(1, i, "assistant" if i % 2 == 0 else "user", "w " * (3 + i % 5)) for i in range(1, 60)]
    turns += [(2, 0, "system", "s " * 300)] + [(2, i, "user", "w " * 20) for i in range(1, 5)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = chat_format.chat_windows(table, budget=100, history_turns=3, history_tokens=30).collect()
    first = [w for w in found if w.conv_id == 1]
    assert all(w.tokens <= 100 for w in first) and all(w.spans[0].seq == 1 for w in first), "the system turn is in every window"
    assert sum(w.turns for w in first) == 60 and any(s.repeated and s.seq > 1 for w in first for s in w.spans)
    # A system turn above the budget leaves room for one turn a window and for no history.
    second = sorted((w.first_seq, w.tokens, len(w.spans)) for w in found if w.conv_id == 2)
    assert second == [(1, 300, 1), (2, 320, 2), (3, 320, 2), (4, 320, 2), (5, 320, 2)]
