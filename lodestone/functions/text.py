"""Text scalars as column expressions: folding, occurrences, excerpts, widths, BM25.

Lengths and positions count code points. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WORD = "[0-9A-Za-z_]"
# The white space of ECMAScript, for one-line collapsing and query splitting.
SPACE = (
    r"[\t\n\x{B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B))
)
EXCERPT_WIDTH = 120
EXCERPT_LEAD = 24
LABEL_WIDTH = 120
# Code points that take two terminal columns.
WIDE = (
    r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}"
    r"\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
)
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
NGRAM = 3

DOTTED_I = "\u0130"
KELVIN = "\u212a"
FINAL_SIGMA, SIGMA = "\u03c2", "\u03c3"
# Noncharacters of Unicode, standing in for the two while ``lower`` runs.
HELD = "\ufdd0\ufdd1"


# ---- query terms (driver side: the query string is an argument, not data) ----


def split_terms(query: str) -> list[str]:
    out, word = [], ""
    for ch in query:
        if ch in SPACE_CHARS:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    if word:
        out.append(word)
    if not out:
        raise ValueError("search query must not be empty")
    return out


def fold_term(term: str) -> str:
    return "".join(c if len(c.lower()) != 1 else c.lower() for c in term).replace(FINAL_SIGMA, SIGMA)


def _overlaps_itself(term: str) -> bool:
    return any(term[:k] == term[-k:] for k in range(1, len(term)))


def _quote(term: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):X}}}" for c in term)


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


# ---- folding and matching ----


def fold_case(text: Column) -> Column:
    """Lower case that keeps length: a character whose lower case is longer stays.

    There is one such character; it waits out ``lower`` as a code point that is
    never assigned. No lambda, so scans keep whole-stage code generation.
    """
    return F.translate(F.lower(F.translate(text, DOTTED_I, HELD[0])), HELD[0] + FINAL_SIGMA, DOTTED_I + SIGMA)


def _fold_word(text: Column) -> Column:
    # The Kelvin sign folds to an ASCII letter but is no word character itself, so
    # it stays too and the pattern admits it for k.
    kept = DOTTED_I + KELVIN
    return F.translate(F.lower(F.translate(text, kept, HELD)), HELD + FINAL_SIGMA, kept + SIGMA)


def word_pattern(term: str) -> str:
    """Zero-width pattern standing at each word-bounded occurrence in folded text."""
    body = "".join(
        f"[k{KELVIN}]" if c == "k" else _quote(c) for c in fold_term(term)
    )
    left = f"(?<!{WORD})" if _is_word(term[0]) else ""
    right = f"(?!{WORD})" if _is_word(term[-1]) else ""
    return f"{left}(?={body}{right})"


def contains_term(text: Column, term: str) -> Column:
    """Indexed-term match: case-insensitive literal substring."""
    return F.contains(_one_sigma(F.lower(text)), F.lit(term.lower().replace(FINAL_SIGMA, SIGMA)))


def _one_sigma(lowered: Column) -> Column:
    """A capital sigma lowers by its place in a word; both small forms count as one."""
    return F.translate(lowered, FINAL_SIGMA, SIGMA)


def ascii_fold(text: Column) -> Column:
    # The two ASCII alphabets.
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_short(text: Column, term: str) -> Column:
    """Short-term match: literal substring, only ASCII letters fold."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
    return F.contains(ascii_fold(text), F.lit(low))


def word_bounded(text: Column, term: str) -> Column:
    return _fold_word(text).rlike(word_pattern(term))


def occurrences(text: Column, term: str, word: bool = False) -> Column:
    """Number of occurrences, overlapping ones included."""
    if word:
        return F.regexp_count(_fold_word(text), F.lit(word_pattern(term)))
    folded, needle = fold_case(text), fold_term(term)
    if _overlaps_itself(needle):
        return F.regexp_count(folded, F.lit(f"(?={_quote(needle)})"))
    gone = F.replace(folded, F.lit(needle), F.lit(""))
    return ((F.length(folded) - F.length(gone)) / F.lit(len(needle))).cast("int")


# Characters of a text that are looked at as one array.
WINDOW_CHARS = 1024


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where a function over an array would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def term_positions(text: Column, term: str, word: bool = False) -> Column:
    """1-based starts of all occurrences. The work grows with the text: it is cut into windows of characters."""
    folded = _fold_word(text) if word else fold_case(text)
    k, needle = len(term), fold_term(term).replace(KELVIN, "k") if word else fold_term(term)
    # A window begins with the character before its first start and holds what an occurrence at its last one and the character after it take.
    cut = f"(?s)(?=(.{{1,{WINDOW_CHARS + k + 1}}})).{{1,{WINDOW_CHARS}}}"
    windows = lambda c: F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(c, F.lit(""))), F.lit(cut), 1)
    plain = lambda c: F.replace(c, F.lit(KELVIN), F.lit("k")) if word else c

    def starts(window: Column, own: Column | None, j: Column) -> Column:
        def in_window(chars: Column) -> Column:
            def stands(i: Column) -> Column:
                # a term whose lower case is longer matches nowhere
                hit = F.lit(len(needle) == k)
                for n, c in enumerate(needle[:k]):
                    hit = hit & (chars[i + n] == F.lit(c))
                if word and _is_word(term[0]):
                    hit = hit & ~F.substring(own, i, F.lit(1)).rlike(WORD)
                if word and _is_word(term[-1]):
                    hit = hit & ~F.substring(own, i + k + 1, F.lit(1)).rlike(WORD)
                return hit

            last = F.least(F.lit(WINDOW_CHARS), F.size(chars) - k)
            return F.transform(F.filter(F.sequence(F.lit(1), last), stands), lambda i: j * WINDOW_CHARS + i)

        held = F.contains(plain(window), F.lit(needle))
        return F.when(held & (F.length(window) > k), _let(F.split(plain(window), ""), in_window)).otherwise(F.array().cast("array<int>"))

    if not word:
        return F.flatten(F.transform(windows(folded), lambda w, j: starts(w, None, j)))
    both = F.arrays_zip(windows(folded).alias("folded"), windows(text).alias("own"))
    return F.flatten(F.transform(both, lambda w, j: starts(w["folded"], w["own"], j)))


def _stands_at(text: Column, folded: Column, term: str, i: Column, word: bool) -> Column:
    k, needle = len(term), fold_term(term)
    here = F.substring(folded, i, F.lit(k))
    hit = (F.replace(here, F.lit(KELVIN), F.lit("k")) if word else here) == F.lit(
        needle.replace(KELVIN, "k") if word else needle
    )
    if word and _is_word(term[0]):
        hit = hit & ((i == 1) | ~F.substring(text, i - 1, F.lit(1)).rlike(WORD))
    if word and _is_word(term[-1]):
        hit = hit & ~F.substring(text, i + k, F.lit(1)).rlike(WORD)
    return hit


def merge_ranges(ranges: Column) -> Column:
    """Union of overlapping or touching ``struct<start,end>`` ranges, in order.

    With starts and ends sorted each for itself, a union begins where a start lies behind all ends of the ranges begun before,
    and ends with the end before the next such place.
    """

    def merged(starts: Column, ends: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (i == 0) | (starts[i] > ends[F.greatest(i - 1, F.lit(0))]))
        bound = lambda f: F.transform(f, lambda i, j: F.struct(
            starts[i].alias("start"), ends[F.coalesce(F.get(f, j + 1), F.size(ends)) - 1].alias("end")
        ))
        return _let(firsts, bound)

    part = lambda name: F.array_sort(F.transform(ranges, lambda r: r[name]))
    found = _let(part("start"), lambda starts: _let(part("end"), lambda ends: merged(starts, ends)))
    return F.when(F.size(ranges) > 0, found).when(ranges.isNotNull(), F.array().cast("array<struct<start:int,end:int>>"))


# ---- one-line forms ----


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def truncate(text: Column, width: int) -> Column:
    if width <= 0:
        return F.lit("")
    if width == 1:
        return F.when(F.length(text) > 1, F.lit("…")).otherwise(text)
    cut = F.regexp_replace(F.substring(text, 1, width - 1), SPACE + "+$", "")
    return F.when(F.length(text) > width, F.concat(cut, F.lit("…"))).otherwise(text)


def display_width(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def pad_width(text: Column, width: int) -> Column:
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - display_width(text))))


def truncate_width(text: Column, width: int) -> Column:
    """Clip to terminal columns, an ellipsis taking one."""
    if width <= 0:
        return F.lit("")
    if width == 1:
        return F.when(display_width(text) > 1, F.lit("…")).otherwise(text)
    # At most width - 1 characters can fit, so only those are walked.
    chars = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(text), F.lit(width - 1)))),
        lambda i: F.substring(text, i, F.lit(1)),
    )
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, ch: Column) -> Column:
        cols = F.when(ch.rlike(WIDE), F.lit(2)).otherwise(F.lit(1))
        stop = acc["full"] | (acc["used"] + cols > width - 1)
        return F.struct(
            F.when(stop, acc["used"]).otherwise(acc["used"] + cols).alias("used"),
            F.when(stop, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
            stop.alias("full"),
        )

    kept = F.aggregate(chars, start, step)["kept"]
    cut = F.regexp_replace(F.substring(text, F.lit(1), kept), SPACE + "+$", "")
    return F.when(display_width(text) > width, F.concat(cut, F.lit("…"))).otherwise(text)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def excerpt(text: Column, terms: Sequence[str], word: bool = False, width: int = EXCERPT_WIDTH) -> Column:
    """One bounded line around the first match, every match in view in «».

    Built to run after the limit. The first match is searched in the whole line;
    marks are then decided per character of the window alone.
    """
    fold = _fold_word if word else fold_case
    reach = max(len(t) for t in terms) + 1

    def first(folded: Column) -> Column:
        at = [
            F.regexp_instr(folded, F.lit(word_pattern(t))) if word else F.instr(folded, fold_term(t))
            for t in terms
        ]
        return F.coalesce(F.array_min(F.filter(F.array(*at), lambda p: p > 0)) - 1, F.lit(0))

    def placed(line: Column) -> Column:
        n = F.length(line)
        fits = n <= width
        end = F.when(fits, n).otherwise(F.least(n, F.greatest(F.lit(0), first(fold(line)) - EXCERPT_LEAD) + width))
        return F.struct(line.alias("line"), n.alias("n"), end.alias("end"))

    def cut(p: Column) -> Column:
        start = F.greatest(F.lit(0), p["end"] - width)
        base = F.greatest(F.lit(0), start - reach)
        part = F.substring(p["line"], base + 1, p["end"] - base + reach)
        return F.struct(
            part.alias("part"),
            fold(part).alias("folded"),
            (start - base).alias("from"),
            (p["end"] - base).alias("to"),
            (start > 0).alias("more_left"),
            (p["end"] < p["n"]).alias("more_right"),
        )

    def covers(w: Column, term: str, i: Column) -> Column:
        starts = F.sequence(F.greatest(F.lit(1), i - len(term) + 1), i)
        return F.exists(starts, lambda s: _stands_at(w["part"], w["folded"], term, s, word))

    def render(w: Column) -> Column:
        cells = F.transform(
            F.sequence(w["from"] + 1, F.greatest(w["from"] + 1, w["to"])),
            lambda i: F.struct(
                F.substring(w["part"], i, F.lit(1)).alias("c"), reduce(or_, [covers(w, t, i) for t in terms]).alias("m")
            ),
        )
        marked = F.aggregate(
            cells,
            F.struct(F.lit("").alias("s"), F.lit(False).alias("m")),
            lambda acc, c: F.struct(
                F.concat(
                    acc["s"],
                    F.when(acc["m"] & ~c["m"], F.lit("»")).when(~acc["m"] & c["m"], F.lit("«")).otherwise(F.lit("")),
                    c["c"],
                ).alias("s"),
                c["m"].alias("m"),
            ),
            lambda acc: F.concat(acc["s"], F.when(acc["m"], F.lit("»")).otherwise(F.lit(""))),
        )
        dots = lambda more: F.when(more, F.lit("…")).otherwise(F.lit(""))
        return F.concat(dots(w["more_left"]), marked, dots(w["more_right"]))

    shown = _let(_let(_let(one_line(text), placed), cut), render)
    return F.when(text.isNotNull(), shown)


# ---- relevance ----


def token_count(text: Column) -> Column:
    return F.greatest(F.length(text) - (NGRAM - 1), F.lit(0))


def bm25(text: Column, terms: Sequence[str], stats: Column) -> Column:
    """Relevance over trigram tokens; lower is better.

    ``stats`` is ``struct<n, tokens, df0, df1, …>`` over every row with text.
    """
    n, avg = stats["n"].cast("double"), stats["tokens"] / stats["n"]
    dl = token_count(text)
    score = F.lit(0.0)
    low = _one_sigma(F.lower(text))
    for i, term in enumerate(terms):
        df = stats[f"df{i}"]
        raw = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, F.lit(BM25_IDF_FLOOR)).otherwise(raw)
        tf = occurrences(low, term.lower()).cast("double")
        score = score + idf * (tf * (BM25_K1 + 1)) / (
            tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avg)
        )
    return -score


def bm25_stats(text: Column, terms: Sequence[str]) -> Column:
    """Aggregate column feeding :func:`bm25`."""
    return F.struct(
        F.count(text).alias("n"),
        F.sum(token_count(text)).alias("tokens"),
        *[F.count_if(contains_term(text, t)).alias(f"df{i}") for i, t in enumerate(terms)],
    )


def word_rank(text: Column, terms: Sequence[str]) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + occurrences(text, t, True)
    return (-total).cast("double")


def line_text(text: Column, width: int = EXCERPT_WIDTH) -> Column:
    """An excerpt without terms: the start of the one-line form."""
    line = one_line(text)
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("…"))).otherwise(line)
