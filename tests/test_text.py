import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import instants as T
from lodestone.functions import text as X
from lodestone.functions.paths import file_matches, path_ancestors, path_suffixes
from lodestone.functions.secrets import session_label_text
from lodestone.operators import predicates as P


def value(spark, column, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(column.alias("v")).first().v


WORD_CASES = [
    ("authored auth authorization", "auth", [10]),
    ("user_authorization", "auth", []),
    ("重建auth索引", "auth", [3]),
    ("the .specs dir", ".spec", []),
    ("the .spec file", ".spec", [5]),
    ("我们需要重建投影缓存", "投影", [7]),
    ("İauth", "auth", [2]),
    ("Auth AUTH", "auth", [1, 6]),
    ("Kauth", "auth", [2]),
    ("maKe it", "make", [1]),
    ("a.b a.b", "a.b", [1, 5]),
    ("a$1 b", "$1", [2]),
]


@pytest.mark.parametrize("text,term,starts", WORD_CASES)
def test_word_mode(spark, text, term, starts):
    t = F.col("t")
    assert value(spark, X.term_positions(t, term, True), t=text) == starts
    assert value(spark, X.occurrences(t, term, True), t=text) == len(starts)
    assert value(spark, X.word_bounded(t, term), t=text) is bool(starts)


def test_substring_occurrences_overlap(spark):
    t = F.col("t")
    assert value(spark, X.occurrences(t, "aa"), t="aAaa b aa") == 4
    assert value(spark, X.term_positions(t, "ana"), t="banana") == [2, 4]
    assert value(spark, X.occurrences(t, "i"), t="İi") == 1
    assert value(spark, P.contains_all("100% _x", "t"), t="x 100% a _X") is True
    assert value(spark, P.contains_all("a%b", "t"), t="axb") is False
    assert value(spark, P.contains_all("É", "t"), t="é") is False  # short terms fold ASCII only


def py_excerpt(text, terms, word=False):
    """Brute force on ASCII text."""
    line = " ".join(text.split())
    low, hits = line.lower(), []
    for t in terms:
        at = low.find(t.lower())
        while at >= 0:
            w = lambda i: 0 <= i < len(line) and (line[i].isalnum() or line[i] == "_")
            if not word or not (w(at - 1) or w(at + len(t))):
                hits.append((at, at + len(t)))
            at = low.find(t.lower(), at + 1)
    marked = [any(a <= i < b for a, b in hits) for i in range(len(line))]
    if len(line) <= 120:
        s, e = 0, len(line)
    else:
        s = max(0, (min(h[0] for h in hits) if hits else 0) - 24)
        e = min(len(line), s + 120)
        s = max(0, e - 120)
    out = ""
    for i in range(s, e):
        if marked[i] and (i == s or not marked[i - 1]):
            out += "«"
        out += line[i]
        if marked[i] and (i == e - 1 or not marked[i + 1]):
            out += "»"
    return ("…" if s else "") + out + ("…" if e < len(line) else "")


EXCERPTS = [
    ("short  lease\n here", ["lease"], False),
    ("x" * 100 + " lease " + "y" * 200, ["lease"], False),
    ("lease " + "z " * 100 + "lease", ["lease", "ease z"], False),
    ("pad " * 40 + "releases lease leasers " + "pad " * 40, ["lease"], True),
    ("a" * 118 + "lease", ["lease"], False),
    ("needle " * 30, ["needle", "le ne"], False),
    ("b" * 95 + " aaaa" + "b" * 300, ["aaa"], False),
]


@pytest.mark.parametrize("text,terms,word", EXCERPTS)
def test_excerpt_against_brute_force(spark, text, terms, word):
    assert value(spark, X.excerpt(F.col("t"), terms, word), t=text) == py_excerpt(text, terms, word)


def test_line_forms(spark):
    t = F.col("t")
    assert value(spark, X.one_line(t), t="  a　﻿b \n\t c ") == "a b c"
    assert value(spark, X.truncate(t, 5), t="abc  def") == "abc…"
    assert value(spark, X.truncate(t, 8), t="abc  def") == "abc  def"
    assert value(spark, X.display_width(t), t="ab重建😀") == 2 + 4 + 2
    assert value(spark, X.truncate_width(t, 6), t="重建投影") == "重建…"
    assert value(spark, X.truncate_width(t, 5), t="重建投影") == "重建…"
    assert value(spark, X.truncate_width(t, 4), t="重建投影") == "重…"
    assert value(spark, X.truncate_width(t, 8), t="重建投影") == "重建投影"
    assert value(spark, X.pad_width(t, 6), t="重建") == "重建  "
    fake = "sk-ant-" + "a1" * 12
    assert value(spark, session_label_text(t), t=f"use {fake} now") == "use sk-ant-… now"
    assert value(spark, session_label_text(t), t=" \n ") is None


def test_merge_ranges(spark):
    r = F.transform(F.split("t", ","), lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("int").alias("start"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int").alias("end")))
    got = value(spark, F.to_json(X.merge_ranges(r)), t="5-9,1-3,3-4,20-22,6-7")
    assert got == '[{"start":1,"end":4},{"start":5,"end":9},{"start":20,"end":22}]'


SINCE = [
    ("2026-07-15T10:00:00.000Z", "2026-07-15", True),
    ("2026-07-15T10:00:00.000Z", "2026-07-15T10:00:00Z", True),
    ("2026-07-15T10:00:00.000Z", "2026-07-15T10:00:00.000000Z", True),
    ("2026-07-15T10:00:00.000Z", "2026-07-15T17:00:00+08:00", True),
    ("2026-07-15T10:00:00.000Z", "2026-07-15T18:00:00+0800", True),
    ("2026-07-15T10:00:00.000Z", "2026-07-15 10:00", True),
    ("2026-07-15T10:00:00.000Z", "2026-07-15 11:00:00Z", False),
    ("2026-07-15T10:00:00.000Z", "2026-07-15T10:00:00.001Z", False),
    ("2026-07-15T10:00:00.000001Z", "2026-07-15T18:00:00.000001000+0800", True),
    ("2026-07-15T10:00:00.000001Z", "2026-07-15T18:00:00.000002+08:00", False),
    ("2026-07-15T10:00:00.999999Z", "2026-07-15T10:00:01Z", False),
    ("2026-07-15T18:00:00.000000002+08:00", "2026-07-15T10:00:00.000000001Z", True),
    ("2026-07-15T18:00:00.000000001+08:00", "2026-07-15T10:00:00.000000002Z", False),
    ("not a time", "2026-07-15", False),
    (None, "2026-07-15", False),
]


@pytest.mark.parametrize("stamp,bound,kept", SINCE)
def test_since(spark, stamp, bound, kept):
    df = spark.createDataFrame([(stamp,)], "timestamp string").filter(P.since(bound))
    assert (df.count() == 1) is kept


def test_since_refuses_other_forms():
    for bad in ("yesterday", "2026-07", "2026-07-15T10"):
        with pytest.raises(ValueError):
            T.check_since(bad)


def test_ages_and_ranges(spark):
    now = F.lit("2026-07-30 12:00:00").cast("timestamp")
    t = F.col("t")
    assert value(spark, T.age_days(t, now), t="2026-07-15T12:00:00Z") == 15
    assert value(spark, T.age_days(t, now), t="2026-07-15T12:00:00.000001Z") == 14
    assert value(spark, T.age_days(t, now), t="2027-01-01") == 0
    assert value(spark, T.age_days(t, now), t="?") == 0
    r = T.date_range(F.col("a"), F.col("b"))
    assert value(spark, r, a="2026-01-01T1", b="2026-01-02T1") == "2026-01-01 → 2026-01-02"
    assert value(spark, r, a="2026-01-01T1", b="2026-01-01T2") == "2026-01-01"
    assert value(spark, r, a=None, b="2026-01-01T2") == "2026-01-01"


def test_file_suffix_is_literal(spark):
    none = F.lit(None).cast("string")
    for wanted in ("foo_bar.ts", "foo%bar.ts", "foo\\bar.ts"):
        assert value(spark, file_matches(F.col("p"), none, wanted), p="src/fooXbar.ts") is False
        assert value(spark, file_matches(F.col("p"), none, wanted), p=f"src/{wanted}") is True
    assert value(spark, file_matches(F.col("p"), none, "bar.ts"), p="src/foobar.ts") is False
    assert value(spark, path_suffixes(F.col("p")), p="a/b/c") == ["a/b/c", "b/c", "c"]
    assert value(spark, path_ancestors(F.col("p")), p="/a/b/") == ["/", "/a", "/a/b"]


def test_filter_words():
    with pytest.raises(ValueError):
        P.event_filter(["nope"])
    with pytest.raises(ValueError):
        P.split_query(" 　")
    assert P.split_query("ab 投影 abc")[1:] == (["abc"], ["ab", "投影"])


def test_final_sigma_is_sigma(spark):
    """A capital sigma lowers by its place, so terms and texts fold it one way."""
    rows = spark.createDataFrame([("ΟΔΟΣΑ",), ("ΟΔΟΣ Α",), ("οδος",)], "t string")
    got = [(r.c, r.o) for r in rows.select(X.contains_term(F.col("t"), "ΟΔΟΣ").alias("c"), X.occurrences(F.col("t"), "οδος").alias("o")).collect()]
    assert got == [(True, 1)] * 3


def test_positions_and_ranges_of_a_long_text(spark):
    """A megabyte takes seconds, and nothing is lost where windows meet."""
    text = "äna" * 341 + "ana" + "ba-Nana ana" * 40_000
    low = text.lower()
    ana = [i + 1 for i in range(len(low)) if low.startswith("ana", i)]
    whole = [i for i in ana if (i == 1 or not low[i - 2].isalnum()) and not low[i + 2 : i + 3].isalnum()]
    positions = F.concat(X.term_positions(F.col("t"), "ana"), X.term_positions(F.col("t"), "na "))
    spans = X.merge_ranges(F.transform(positions, lambda s: F.struct(s.alias("start"), (s + 3).alias("end"))))
    began = time.monotonic()
    row = spark.createDataFrame([(text,)], "t string").select(
        X.term_positions(F.col("t"), "ana").alias("a"), X.term_positions(F.col("t"), "ana", True).alias("w"), spans.alias("r")
    ).first()
    assert row.a == ana and row.w == whole
    want = []
    for s in sorted(ana + [i + 1 for i in range(len(low)) if low.startswith("na ", i)]):
        if want and s <= want[-1][1]:
            want[-1][1] = s + 3
        else:
            want.append([s, s + 3])
    assert [[r.start, r.end] for r in row.r] == want
    assert time.monotonic() - began < 60
