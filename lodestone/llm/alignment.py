"""Which ids of two tokenizers stand for the same bytes, and how often, over a whole corpus.

A space and a text are encoded by a byte-level model (A) and by a piece model (B,
which puts the space itself). Byte offsets where tokens of both end cut the tokens
into groups; a link is a pair of an A and a B token whose bytes overlap.

Two passes over the documents. The first counts links by pair of ids: a task emits each
distinct pair once with its count. Distinct pairs are dealt by hash to buckets of
bounded size, each with a minimal perfect hash; counts go into one dense vector a
bucket and task group, which are added up as a tree, and stand beside the keys that
verify a lookup. The second pass aligns the documents again and looks the counts up.

Both models cut a text wherever a single space or line break stands between other
characters, so pieces between cuts are aligned once a task and then looked up. What
holds irregular white space is aligned as it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stage, texts
from lodestone.llm.perfect_hash import PerfectHash
from lodestone.llm.token_store import _byte_chars
from lodestone.llm.words import mix

LANES = 1 << 16
BUCKET_KEYS = 1 << 16
# Rows of partial counts a group of the first step of the tree takes about, and vectors a group of the others takes at most.
GROUP_ROWS = 1 << 20
FAN_IN = 16
# Pairs whose counts every task of the second pass gets (16 bytes each); rarer pairs beyond are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
# Characters of pieces a task keeps, and of texts it aligns at a time.
KEPT_CHARS = 1 << 22
RUN_CHARS = 1 << 20

PARTS = "key long, lane int, n long, task int"
TABLE = "bucket int, sizes binary, bits binary, keys binary"
VECTOR = "bucket int, node int, counts binary"
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, "
    "rest array<struct<key:long,n:long>>"
)


class Aligner:
    """Both tokenizers: cuts texts to pieces and aligns many pieces at once."""

    # Both models cut before a single space or line break between other characters, and between a Latin letter and a mark.
    _cuts = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])")
    # What B's pieces must not run over for texts to be cut there.
    _crossed = re.compile(r"[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]")
    # In texts with single spaces and line breaks alone, the pieces between cuts (those that do not begin with letters are left whole).
    _irregular = re.compile(r"[ \n](?:\s|\Z)|[^\S \n]")
    _runs = re.compile(r"[ \n]?(?:[A-Za-zÀ-ÖØ-öø-ɏ]++(?:(?=[.,;:!?])|[^ \n]*+)|[^ \n]++)")
    _letters = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.spelling = _byte_chars()
        back = {c: b for b, c in self.spelling.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(back[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # <0xHH> spells a byte, control pieces spell nothing.
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.cut = not any(self._crossed.search(p) for p in names)
        self.lead = self.b.encode("\n")
        # An id with what follows it: a comma, or the end of its side of a group.
        self.written = [f"{i}{m}" for i in range(len(self.bytes_a)) for m in ",|"] + [f"{i}{m}" for i in range(len(names)) for m in ",;"]

    def pieces(self, text: str) -> list[str]:
        """What a space and ``text`` (not empty) are cut into."""
        text = " " + text
        if not self.cut:
            return [text]
        return self._cuts.split(text) if self._irregular.search(text) else self._runs.findall(text)

    def ids_a(self, pieces: list[str]) -> list[list[int]]:
        """The splitter leaves a space and letters whole, so the model alone is asked for those."""
        out: list[list[int]] = []
        other = []
        for i, p in enumerate(pieces):
            if self._letters.fullmatch(p):
                out.append([t.id for t in self.a.model.tokenize(p.encode().decode("latin-1").translate(self.spelling))])
            else:
                out.append([])
                other.append(i)
        for i, e in zip(other, self.a.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def ids_b(self, pieces: list[str]) -> list[list[int]]:
        """B puts a space before what it encodes: pieces with one give theirs up, others hide behind a line break."""
        found = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        return [ids if p[0] == " " else ids[len(self.lead) :] for p, ids in zip(pieces, found, strict=True)]

    def align(self, pieces: list[str], with_groups: bool) -> Aligned:
        spelled = [p.encode() for p in pieces]
        ids_a, ids_b = self.ids_a(pieces), self.ids_b(pieces)
        spelt = np.array(
            [
                b"".join([self.bytes_a[i] for i in a]) == x == b"".join([self.bytes_b[i] for i in b])
                for x, a, b in zip(spelled, ids_a, ids_b, strict=True)
            ],
            dtype=bool,
        )
        if not spelt.all():
            ids_a, ids_b = ([v if ok else [] for v, ok in zip(ids, spelt.tolist(), strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(pieces)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        size_a, size_b = self.size_a[a], self.size_b[b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        ends = np.cumsum(np.where(spelt, [len(x) for x in spelled], 0))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_groups = np.diff(np.searchsorted(common, ends, side="right"), prepend=0)
        # B tokens that end after an A token's start and start before its end.
        first, last = np.searchsorted(ends_b, ends_a - size_a, side="right"), np.searchsorted(ends_b - size_b, ends_a, side="left")
        many = last - first
        links_a = np.repeat(np.arange(len(a)), many)
        links_b = np.arange(len(links_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        owner = np.repeat(np.arange(len(pieces)), n_a)[links_a]
        figures = np.stack([n_a, n_b, n_groups, np.bincount(owner, minlength=len(pieces))], axis=1)
        groups = self._written(a, b, ends_a, ends_b, common, n_a + n_b) if with_groups else []
        return Aligned(spelt, figures, owner, a[links_a] << 32 | b[links_b], groups)

    def _written(self, a, b, ends_a, ends_b, common, sizes) -> list[str]:
        """Groups of every piece, each ended by a semicolon."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        written = np.concatenate([a * 2 + np.isin(ends_a, common), (b + len(self.bytes_a)) * 2 + np.isin(ends_b, common)])
        flat = [self.written[i] for i in written[order].tolist()]
        cuts = [0, *np.cumsum(sizes).tolist()]
        return ["".join(flat[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Aligned:
    """Of some pieces: whether both models spell them, ``n_a, n_b, n_groups, n_links``, their links (piece and pair: A id above B id), groups."""

    spelt: np.ndarray
    figures: np.ndarray
    owner: np.ndarray
    keys: np.ndarray
    groups: list[str]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process, kept for its later tasks."""
    return Aligner(path_a, path_b)


class Pieces(dict):
    """Number of each piece met; emptied between texts once it holds ``KEPT_CHARS``. ``new`` are those not yet aligned."""

    def __init__(self, by: Aligner):
        super().__init__()
        self.by, self.new, self.chars = by, [], 0

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        self.chars += len(piece)
        return number

    def numbers(self, text: str) -> np.ndarray:
        pieces = self.by.pieces(text) if text else []
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def align_new(self, with_groups: bool = False) -> Aligned:
        new, self.new = self.new, []
        return self.by.align(new, with_groups)

    def full(self) -> bool:
        return self.chars > KEPT_CHARS

    def empty(self) -> None:
        self.clear()
        self.new, self.chars = [], 0


def runs_of(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and whole texts of a batch (``doc_id, text``), some ``chars`` characters at a time."""
    ids, out, held = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        out.append(text.as_py())
        held += len(out[-1])
        if held > chars:
            yield ids, out
            ids, out, held = [], [], 0
    if ids:
        yield ids, out


def lanes(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(48)).astype(np.int32)


def count_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """First pass: ``key, lane, n, task``; a task lists each of its pairs once or, its memory filled, a few times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = Pieces(aligner(path_a, path_b)), TaskContext.get().partitionId()
        made: list[Aligned] = []
        used = np.zeros(0, np.int64)

        def totals() -> pa.RecordBatch:
            """Links of the pieces times their use; a text that is not spelled was not counted."""
            heads = np.cumsum([0, *[len(m.spelt) for m in made]])
            keys = np.concatenate([m.keys for m in made] or [used])
            times = used[np.concatenate([m.owner + h for m, h in zip(made, heads[:-1], strict=True)] or [used])]
            distinct, place = np.unique(keys, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            np.add.at(n, place, times)
            distinct, n = distinct[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(lanes(distinct)), pa.array(n), pa.array(np.full(len(n), task, np.int32))],
                names=["key", "lane", "n", "task"],
            )

        spelt = np.zeros(0, bool)
        for batch in batches:
            for _, run in runs_of(batch, RUN_CHARS):
                numbers = [pieces.numbers(text) for text in run]
                if pieces.new:
                    made.append(pieces.align_new())
                    spelt = np.concatenate([spelt, made[-1].spelt])
                    used = np.concatenate([used, np.zeros(len(made[-1].spelt), np.int64)])
                if not spelt.all():
                    numbers = [x for x in numbers if spelt[x].all()]
                if numbers:
                    used += np.bincount(np.concatenate(numbers), minlength=len(used))
                if pieces.full():
                    yield totals()
                    pieces.empty()
                    made, used, spelt = [], np.zeros(0, np.int64), np.zeros(0, bool)
        yield totals()

    return docs.mapInArrow(count, PARTS)


def hashed_keys(keys: DataFrame, buckets: int) -> DataFrame:
    """``bucket, sizes, bits, keys``: each bucket's perfect hash and its keys by hash. ``keys`` has distinct ``key, lane``."""

    def build(group: pa.Table) -> pa.Table:
        found = group.column("key").to_numpy()
        made = PerfectHash.build(found.view(np.uint64))
        placed = np.zeros_like(found)
        placed[made.lookup(found.view(np.uint64))] = found
        row = [group.column("bucket")[0].as_py(), made.sizes.tobytes(), made.bits.tobytes(), placed.tobytes()]
        return pa.table([pa.array([v], k) for v, k in zip(row, [pa.int32(), *[pa.binary()] * 3], strict=True)], names=["bucket", "sizes", "bits", "keys"])

    return keys.select("key", _bucket(buckets)).groupBy("bucket").applyInArrow(build, TABLE)


def _bucket(buckets: int):
    return F.floor(F.col("lane") * F.lit(buckets) / F.lit(LANES)).cast("int").alias("bucket")


def hash_of(row: dict) -> PerfectHash:
    return PerfectHash.of(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))


def counted(parts: DataFrame, table: DataFrame, buckets: int, rows: int) -> DataFrame:
    """``bucket, counts``: the dense counts of each bucket, ``rows`` partial counts summed as a tree."""
    nodes = max(1, -(-rows // (buckets * GROUP_ROWS)))
    dealt = parts.select(_bucket(buckets), F.pmod(F.hash("task"), F.lit(nodes)).alias("node"), "key", "n")
    tables = table.select("bucket", "sizes", "bits", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))

    def fill(links: pa.Table, tables: pa.Table) -> pa.Table:
        row = tables.to_pylist()[0]
        made = hash_of(row)
        out = np.zeros(int(made.before[-1]) + int(made.bits[-1]).bit_count(), np.int64)
        np.add.at(out, made.lookup(links.column("key").to_numpy().view(np.uint64)), links.column("n").to_numpy())
        return _vector(row["bucket"], row["node"], out)

    vectors = dealt.groupBy("bucket", "node").cogroup(tables.groupBy("bucket", "node")).applyInArrow(fill, VECTOR)

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        return _vector(rows[0]["bucket"], rows[0]["node"], sum(np.frombuffer(r["counts"], np.int64) for r in rows))

    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int")).groupBy("bucket", "node").applyInArrow(add, VECTOR)
    return vectors.select("bucket", "counts")


def _vector(bucket: int, node: int, counts: np.ndarray) -> pa.Table:
    return pa.table([pa.array([bucket], pa.int32()), pa.array([node], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["bucket", "node", "counts"])


def listed(table: DataFrame) -> DataFrame:
    """``key, lane, n`` of every pair of ``table`` (with ``counts``)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                k = np.frombuffer(keys.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(lanes(k)), pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["key", "lane", "n"])

    return table.select("keys", "counts").mapInArrow(spread, "key long, lane int, n long")


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, int, int]:
    """A staged table ``bucket, sizes, bits, keys, counts`` of all pairs, their number, and the number of buckets."""
    parts = stage(count_links(texts(docs), path_a, path_b), "links")
    rows = parts.count()
    keys = stage(parts.select("key", "lane").distinct(), "pairs")
    pairs = keys.count()
    buckets = min(LANES, max(1, -(-pairs // BUCKET_KEYS)))
    table = stage(hashed_keys(keys, buckets), "hashed")
    return stage(table.join(counted(parts, table, buckets, rows), "bucket"), "counted"), pairs, buckets


class Counts:
    """Looks up the counts of pairs in the buckets given."""

    def __init__(self, rows: list[dict], buckets: int):
        self.buckets = buckets
        self.by = {r["bucket"]: (hash_of(r), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in rows}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Count of every key, 0 for one that is not there: the key stored under its hash is another."""
        out = np.zeros(len(keys), np.int64)
        bucket = lanes(keys).astype(np.int64) * self.buckets // LANES
        for b in np.unique(bucket).tolist():
            if b in self.by:
                made, stored, counts = self.by[b]
                at = np.flatnonzero(bucket == b)
                place = made.lookup(keys[at].view(np.uint64))
                known = np.flatnonzero(place >= 0)
                known = known[stored[place[known]] == keys[at[known]]]
                out[at[known]] = counts[place[known]]
        return out


def _most_frequent(table: DataFrame, buckets: int, pairs: int, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Table of at most ``limit`` pairs, the others as ``key, n`` (None if there are none), and buckets of the table.

    Pairs are parted by a power of two, so all of a larger count than the others are in the table.
    """
    if pairs <= limit:
        return table, None, buckets
    every = stage(listed(table), "counts")
    sizes = sorted(every.groupBy(F.floor(F.log2("n")).alias("p")).count().collect(), reverse=True)
    total, least = 0, int(sizes[0].p) + 1
    for power, n in sizes:
        if total + n > limit:
            break
        total, least = total + n, int(power)
    head, rest = every.filter(F.floor(F.log2("n")) >= least), every.filter(F.floor(F.log2("n")) < least).select("key", "n")
    buckets = max(1, -(-total // BUCKET_KEYS))
    made = hashed_keys(head, buckets)
    return made.join(counted(head.withColumn("task", F.lit(0)), made, buckets, total), "bucket"), rest, buckets


def aligned(
    docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row of ``docs``.

    ``groups`` lists ids as ``a1,a2|b1;a3|b2``. ``count_sum`` adds the corpus-wide counts of the row's links, ``n_best`` counts links
    whose pair has the highest count of its B id, ties included. A text that is null, empty or not spelled by both models
    has no tokens: zeros and empty groups. Equal rows give equal rows; an empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    table, pairs, buckets = link_counts(docs, path_a, path_b)
    # One row a B id, at most the size of B's vocabulary.
    best = listed(table).groupBy(F.col("key").bitwiseAND((1 << 32) - 1).alias("b")).agg(F.max("n").alias("n")).collect()
    highest = np.zeros(max((r.b for r in best), default=0) + 1, np.int64)
    for r in best:
        highest[r.b] = r.n
    head, rest, buckets = _most_frequent(table, buckets, pairs, broadcast_pairs)
    counts = spark.sparkContext.broadcast(([r.asDict() for r in head.collect()], buckets, highest))
    found = texts(docs).mapInArrow(_second_pass(counts, path_a, path_b, rest is not None), ALIGNED)
    if rest is None:
        return found.drop("rest")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    places = spark.createDataFrame([(i, int(n)) for i, n in enumerate(highest.tolist())], "b long, highest long")
    rare = rest.join(F.broadcast(places), F.col("key").bitwiseAND((1 << 32) - 1) == F.col("b")).select("key", F.col("n").alias("count"), "highest")
    late = (
        found.select("row", F.inline("rest"))
        .join(rare, "key")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("count")).alias("more"), F.sum(F.when(F.col("count") == F.col("highest"), F.col("n")).otherwise(0)).alias("more_best"))
    )
    more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return found.join(late, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more"), "groups"
    )


def _second_pass(shared: Broadcast, path_a: str, path_b: str, with_rest: bool):
    kinds = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        + [("groups", pa.string()), ("rest", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))]
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, buckets, highest = shared.value
        counts, pieces = Counts(rows, buckets), Pieces(aligner(path_a, path_b))
        figures, spelt, groups = np.zeros((0, 6), np.int64), np.zeros(0, bool), []
        missing: dict[int, list[int]] = {}

        def extend() -> None:
            """Figures of the pieces met since: their sizes, and their counts by one lookup."""
            nonlocal figures, spelt
            made = pieces.align_new(with_groups=True)
            n = counts.of(made.keys)
            # Only links of texts that are not spelled as a whole are in no table.
            more = np.zeros((len(made.spelt), 6), np.int64)
            more[:, :4] = made.figures
            np.add.at(more[:, 4], made.owner, (n > 0) & (n == highest[np.minimum(made.keys & 0xFFFFFFFF, len(highest) - 1)]))
            np.add.at(more[:, 5], made.owner, n)
            for i in np.flatnonzero(n == 0).tolist() if with_rest else ():
                missing.setdefault(len(figures) + int(made.owner[i]), []).append(int(made.keys[i]))
            figures, spelt = np.concatenate([figures, more]), np.concatenate([spelt, made.spelt])
            groups.extend(made.groups)

        for batch in batches:
            for ids, run in runs_of(batch, RUN_CHARS):
                numbers = [pieces.numbers(text) for text in run]
                if pieces.new:
                    extend()
                out = []
                for doc_id, x in zip(ids, numbers, strict=True):
                    if len(x) == 0 or not spelt[x].all():
                        out.append([doc_id, 0, 0, 0, 0, 0, 0, "", []])
                        continue
                    listed_groups = "".join([groups[n] for n in x.tolist()])[:-1]
                    rest = Counter(key for n in x.tolist() for key in missing.get(n, ())) if missing else {}
                    out.append([doc_id, *figures[x].sum(axis=0).tolist(), listed_groups, [{"key": k, "n": n} for k, n in rest.items()]])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                if pieces.full():
                    pieces.empty()
                    missing.clear()
                    figures, spelt, groups = np.zeros((0, 6), np.int64), np.zeros(0, bool), []

    return look_up
