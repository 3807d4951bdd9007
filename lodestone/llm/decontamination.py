"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units stand as typed
placeholders. Windows of tokens are hashed; a document's windows that a filter of
the benchmark's window hashes lets through are joined to the benchmark's windows by
hash in Spark. What matched is then held against the item slot by slot: within one
occurrence of an item one value of the item must always meet one value of the document
and the other way round, so a question with its numbers changed throughout is
caught and text that merely has the same shape is not. Windows whose values equal the
item's always count, and copies of an item with different values are judged apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import slices, stage
from lodestone.llm.words import LOWER, hash_spans, linear, stream, word_spans

WINDOW = 8
# So many words of the item (all, if it has fewer) must be met by an occurrence for windows with other slots to count.
LEAST_WORDS = 5
# Part of an item's windows that must be found in a document.
COVERAGE = 0.3
# Bits of the filter per benchmark window (a power of two in all), and the most bits that are sent to a task.
FILTER_BITS, MOST_BITS = 64, 1 << 30
# Bytes of the filter that a task packs into one row.
PACKED = 1 << 20
FOUND = "doc_id long, row long, at int, window long, slots array<long>, words array<int>"
# Units that count as such after a number; fixed values of this library.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec ms min h hr hrs hours minutes seconds days weeks months years "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres dollars euros cents percent % $ € £"
).split()

WORD_KIND, NUMBER, NAME, UNIT = 0, 1, 2, 3
_TYPES = stream(23, 4)
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_ALNUM = _IS_DIGIT.copy()
_IS_ALNUM[65:91] = _IS_ALNUM[97:123] = True
_IS_ALNUM[128:] = True  # bytes of letters beyond ASCII
_IS_ALNUM[[36, 37]] = True  # $ and % are units
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63, 34, 40]] = True  # ! . : ? " ( end or open a sentence


def _upper_first(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a capital letter stands at each position: A-Z and the capitals of Latin-1."""
    first = data[at]
    second = data[np.minimum(at + 1, len(data) - 1)]
    latin = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    return ((first >= 65) & (first <= 90)) | latin


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, value hashes and kinds of the tokens of all texts, and each text's first token.

    Tokens are words without marks at their ends. A token of digits (with marks inside) is a number, a known unit right
    after a number a unit, a capitalised word that does not begin a sentence or line a name; all else stands as its
    lower-case form.
    """
    starts, ends, first = word_spans(data, offsets)
    if len(starts) == 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int8), first)
    # Trim marks: the first and last byte of each word that is a letter, digit or unit sign.
    good = np.flatnonzero(_IS_ALNUM[data])
    lo, hi = np.searchsorted(good, starts), np.searchsorted(good, ends)
    kept = hi > lo
    a, b = good[lo[kept]], good[hi[kept] - 1] + 1
    words_before = np.concatenate([[0], np.cumsum(kept)])
    first = words_before[first]
    lowered = LOWER[data]
    # Capitals of Latin-1 fold like A-Z.
    two = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    caps = two[(data[two] >= 0x80) & (data[two] <= 0x9E) & (data[two] != 0x97)]
    lowered[caps] += 0x20
    value = hash_spans(lowered, a, b)
    digits = np.concatenate([[0], np.cumsum(_IS_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_IS_ALNUM[data] & ~_IS_DIGIT[data])])
    number = (digits[b] > digits[a]) & (letters[b] - letters[a] == _signs(data, a, b))
    kinds = np.where(number, NUMBER, WORD_KIND).astype(np.int8)
    after_number = np.concatenate([[False], number[:-1]])
    begins = np.zeros(len(a), bool)
    begins[first[:-1][first[:-1] < len(a)]] = True
    kinds[after_number & ~begins & np.isin(value, _unit_hashes())] = UNIT
    # A sentence begins after a mark that ends one, at a line's start and where an opening mark leads the word.
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    prior = np.concatenate([[0], b[:-1]])
    begins |= (stops[a] > stops[prior]) | (breaks[a] > breaks[prior])
    kinds[_upper_first(data, a) & ~begins & (kinds == WORD_KIND)] = NAME
    return np.where(kinds == WORD_KIND, value, _TYPES[kinds]), value, kinds, first


def _signs(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit signs at the ends of spans, as in $5 or 5%, which leave a number a number."""
    sign = (data == 36) | (data == 37)
    return sign[a].astype(np.int64) + (sign[b - 1] & (b - a > 1))


_UNIT_HASHES: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_HASHES:
        raw = [u.encode() for u in UNITS]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        _UNIT_HASHES.append(hash_spans(data, ends - [len(r) for r in raw], ends))
    return _UNIT_HASHES[0]


def window_rows(table: DataFrame, key: str, n: int = WINDOW, passing: Broadcast | None = None, short: Sequence[int] = ()) -> DataFrame:
    """``doc_id, row, at, window, slots, words`` for the windows of every text that ``passing`` (a bit filter) lets through.

    Without a filter a text of fewer than ``n`` tokens is one window of its own width. With one, windows have ``n`` tokens
    and, for items that are shorter, the widths in ``short``.

    ``slots`` are the values of the window's placeholders, in order, and ``words`` the places of its words in the
    text. ``row`` numbers the rows of the table, so that repeated ids stay apart.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value if passing is not None else None
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for at, _, data, offsets in slices(batch):
                template, value, kinds, first = canonical(data, offsets)
                out: list[list] = [[], [], [], [], [], []]
                for width in [*(short if bits is not None else range(1, n)), n]:
                    codes = linear(template, width)
                    found = np.flatnonzero(passes(bits, codes)) if bits is not None else np.arange(len(codes))
                    # Windows within one text, and without a filter short ones only of texts that have just so many tokens.
                    text = np.searchsorted(first, found, side="right") - 1
                    inside = found + width <= first[text + 1]
                    if bits is None and width < n:
                        inside &= first[text + 1] - first[text] == width
                    found, text = found[inside], text[inside]
                    for w, i, code in zip(found.tolist(), text.tolist(), codes[found].view(np.int64).tolist(), strict=True):
                        k, begin = kinds[w : w + width] != WORD_KIND, int(first[i])
                        out[0].append(ids[at + i].as_py())
                        out[1].append(rows[at + i].as_py())
                        out[2].append(w - begin)
                        out[3].append(code)
                        out[4].append(value[w : w + width][k].view(np.int64).tolist())
                        out[5].append((np.flatnonzero(~k) + (w - begin)).tolist())
                kinds_of = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds_of, strict=True)], names=["doc_id", "row", "at", "window", "slots", "words"]
                )

    named = table.select(
        F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    return named.mapInArrow(emit, FOUND)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    size = np.uint64(len(bits) * 8 - 1)
    i, j = hashes & size, (hashes >> np.uint64(32)) & size
    one = np.uint64(1)

    def on(k: np.ndarray) -> np.ndarray:
        return (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & one.astype(np.uint8)

    out = on(i).astype(bool)
    if out.any():
        where = np.flatnonzero(out)
        out[where] = on(j[where]).astype(bool)
    return out


def bit_filter(items: DataFrame, windows_count: int) -> np.ndarray:
    """A filter of the benchmark's window hashes, or-ed together in the tasks' partial filters.

    Its size follows the number of windows up to ``MOST_BITS``; a fuller filter lets more through to the join and loses nothing.
    """
    bits = 1 << 16
    while bits < min(FILTER_BITS * windows_count, MOST_BITS):
        bits <<= 1
    # Set bits come as distinct byte positions with their bytes or-ed, a table no larger than the filter.
    size = F.lit(bits - 1).cast("long")
    both = F.explode(F.array(F.col("window").bitwiseAND(size), F.shiftrightunsigned("window", 32).bitwiseAND(size)))
    set_ = items.select(both.alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bit").bitwiseAND(F.lit(7).cast("long")).cast("int"))).alias("value")
    )
    # Tasks pack ranges of bytes; the driver puts whole ranges in place.
    held = min(bits // 8, PACKED)

    def pack(table: pa.Table) -> pa.Table:
        part = np.zeros(held, np.uint8)
        part[table.column("byte").to_numpy() % held] = table.column("value").to_numpy()
        return pa.table({"nth": table.column("nth").slice(0, 1), "part": pa.array([part.tobytes()], pa.binary())})

    packed = set_.withColumn("nth", F.expr(f"byte div {held}")).groupBy("nth").applyInArrow(pack, "nth long, part binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in packed.toLocalIterator(prefetchPartitions=True):
        out[row.nth * held : (row.nth + 1) * held] = np.frombuffer(row.part, np.uint8)
    return out


def occurrences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``row, item, at, item_at``) once for each ``group`` of matches that may be one copy of the item.

    Groups are the matches of one alignment (``at - item_at``), those of a run in which the item's places do not fall
    back (so a copy with insertions stays whole and the next copy begins another), and those of the whole document.
    """
    places = Window.partitionBy("row", "item").orderBy("at", "item_at")
    back = F.coalesce((F.col("item_at") < F.lag("item_at").over(places)).cast("int"), F.lit(0))
    run = F.sum("back").over(places.rowsBetween(Window.unboundedPreceding, 0))
    groups = [(0, F.col("at") - F.col("item_at")), (1, run), (2, F.lit(0))]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), g.cast("long").alias("nth")) for k, g in groups])
    return pairs.withColumn("back", back).withColumn("groups", kinds).drop("back").withColumn("group", F.explode("groups")).drop("groups")


def consistent(pairs: DataFrame) -> DataFrame:
    """Matches whose slots equal the item's or pair one to one within their group.

    ``pairs`` has ``row, item, group, slots, item_slots``. Values pair by kind of position; a value that meets two others
    within (row, item, group) makes the windows that hold the rarer pairing inconsistent.
    """
    keys = ["row", "item", "group"]
    own = F.xxhash64("row", "item", "group", "at", "item_at")
    pairs = pairs.withColumn("match", own)
    flat = pairs.select(*keys, "match", (F.col("slots") == F.col("item_slots")).alias("same"), F.explode(F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("b"))).alias("s"))
    flat = flat.select(*keys, "match", "same", F.col("s.d").alias("d"), F.col("s.b").alias("b"))
    counted = flat.groupBy(*keys, "d", "b").agg(F.count("*").alias("n"))
    best_d = counted.groupBy(*keys, "d").agg(F.max(F.struct("n", "b")).alias("x")).select(*keys, "d", F.col("x.b").alias("b_of_d"))
    best_b = counted.groupBy(*keys, "b").agg(F.max(F.struct("n", "d")).alias("x")).select(*keys, "b", F.col("x.d").alias("d_of_b"))
    bad = (
        flat.filter(~F.col("same"))
        .join(best_d, [*keys, "d"])
        .join(best_b, [*keys, "b"])
        .filter((F.col("b") != F.col("b_of_d")) | (F.col("d") != F.col("d_of_b")))
        .select("match")
        .distinct()
    )
    return pairs.join(bad, "match", "left_anti")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, windows, item_windows, verbatim`` for every document that holds a benchmark item.

    An item counts as held if at least ``coverage`` of its distinct windows (two of them, where it has so many) are found with
    consistent slots: those with the item's own, and those of the occurrence that adds most to them; ``verbatim`` says that it
    adds none. An occurrence whose slots differ must meet ``least_words`` words of the item, or all it has. Items shorter than a window are one window,
    looked for at every place of a document. Null and empty
    texts hold nothing and are held by nothing; items of equal text are reported each; rows of one ``doc_id`` are judged
    apart and reported once.
    """
    met_words = F.size(F.array_distinct(F.flatten(F.collect_set("words"))))
    tests = stage(window_rows(benchmark, "item_id", n), "item_windows")
    sizes = tests.groupBy("row").agg(F.first("doc_id").alias("item_id"), F.countDistinct("window").alias("item_windows"), met_words.alias("item_words"))
    slim = tests.select(F.col("row").alias("item"), F.col("at").alias("item_at"), "window", F.col("slots").alias("item_slots"), "words")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(tests, tests.count()))
    # An item of fewer than n tokens is one window without gaps, as wide as its slots and words.
    widths = tests.select((F.size("slots") + F.size("words")).alias("width")).distinct().filter(F.col("width") < n)
    found = stage(window_rows(docs, "doc_id", n, bits, sorted(r.width for r in widths.collect())), "doc_windows")
    bits.destroy()
    # Windows with equal slots always count, however often a document or an item repeats them.
    once = found.select("doc_id", "row", "window", F.col("slots").alias("item_slots")).distinct()
    equal = stage(once.join(slim.select("item", "window", "item_slots").distinct(), ["window", "item_slots"]).select("doc_id", "row", "item", "window").distinct(), "equal")
    slotted = found.filter(F.size("slots") > 0).select("doc_id", "row", "at", "window", "slots")
    kept = ["doc_id", "row", "item", "at", "item_at", "window", "slots", "item_slots", "words"]
    alike = F.size("slots") == F.size("item_slots")
    worded = slim.filter((F.size("item_slots") > 0) & (F.size("words") > 0))
    pairs = stage(slotted.join(worded, "window").filter(alike).select(kept), "matches")
    # Windows without words are met only along alignments that others found: rows of numbers would match everywhere.
    aligned = pairs.select("doc_id", "row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    bare = aligned.join(slim.filter(F.size("words") == 0), "item").withColumn("at", F.col("shift") + F.col("item_at")).drop("doc_id")
    bare = slotted.join(bare, ["row", "at", "window"]).filter(alike).select(kept)
    pairs = stage(pairs.unionByName(bare), "aligned")
    # Only where a slot differs is there anything to judge.
    differ = pairs.filter(F.col("slots") != F.col("item_slots")).select("row", "item").distinct()
    good = consistent(stage(occurrences(pairs.join(differ, ["row", "item"], "left_semi")), "occurrences"))
    good = stage(good, "consistent")
    # A whole match needs words, not each of its windows.
    words = good.groupBy("row", "item", "group").agg(met_words.alias("met")).join(sizes.select(F.col("row").alias("item"), "item_words"), "item")
    worded = words.filter(F.col("met") >= F.least(F.lit(least_words), "item_words")).select("row", "item", "group")
    more = good.join(worded, ["row", "item", "group"], "left_semi").join(equal, ["row", "item", "window"], "left_anti").groupBy("doc_id", "row", "item", "group").agg(F.countDistinct("window").alias("n"))
    counts = equal.groupBy("doc_id", "row", "item").agg(F.count("*").alias("same"), F.lit(0).cast("long").alias("changed")).unionByName(
        more.groupBy("doc_id", "row", "item").agg(F.lit(0).cast("long").alias("same"), F.max("n").alias("changed"))
    )
    held = counts.groupBy("doc_id", "row", "item").agg(F.sum(F.col("same") + F.col("changed")).alias("windows"), (F.sum("changed") == 0).alias("verbatim"))
    sizes = sizes.withColumnRenamed("row", "item")
    enough = F.col("windows") >= F.greatest(F.ceil(F.col("item_windows") * F.lit(coverage)), F.least(F.lit(2), F.col("item_windows")))
    return (
        held.join(sizes, "item")
        .filter(enough)
        .groupBy("doc_id", "item_id")
        .agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.max("verbatim").alias("verbatim"))
    )
