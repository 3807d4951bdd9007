"""Product codes of vectors: each part of a vector is replaced by the nearest entry of that part's codebook.

Components become integers, so distances are exact. The nearest entry is found with a
GNAT over the entries of a codebook: a node has a few entries as split points, every
other entry belongs to its nearest one, and for each split point the range of its
distances to each child's entries is stored. A query that knows its distance to a
split point leaves out a child whose whole range is further from that distance than the best
entry so far. Ranges and radii are rounded outwards and a child goes only if it is
strictly further; what is left is compared by squared integers, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SPLITS = 8
LEAF = 8
# Labels with their sums are sent to every task up to this many; more are joined by a shuffle, each label dealt in so many pieces.
BROADCAST_LABELS = 100_000
LABEL_PIECES = 32

SUMS = "part int, entry int, n long, sums array<long>"
ASSIGNED = "code string, error long"


def _outwards(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of integers as doubles that are surely not below (``up``) or not above the true ones."""
    roots = np.sqrt(squares.astype(np.float64))
    return np.nextafter(np.nextafter(roots, np.inf), np.inf) if up else np.maximum(0.0, np.nextafter(np.nextafter(roots, -np.inf), -np.inf))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` from every row of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        out += np.square(a[:, i : i + 1] - b[None, :, i])
    return out


@dataclass(frozen=True)
class Node:
    """Split points (indexes of entries), each one's child or None, and the least and greatest distance from split point i to child j's entries."""

    splits: np.ndarray
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


def gnat(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """Tree over the rows of ``entries`` (at least one). Split points are picked far from each other, starting from the least index."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= LEAF:
        return Node(members, [None] * len(members), np.zeros((len(members), 0)), np.zeros((len(members), 0)))
    chosen = [0]
    apart = _squares(entries[members], entries[members[:1]])[:, 0]
    while len(chosen) < SPLITS and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _squares(entries[members], entries[members[chosen[-1:]]])[:, 0])
    if len(chosen) == 1:  # all equal: the least index wins every tie
        return Node(members[:1], [None], np.zeros((1, 0)), np.zeros((1, 0)))
    splits, others = members[chosen], np.delete(members, chosen)
    squares = _squares(entries[splits], entries[others])
    owner = squares.argmin(axis=0)
    children: list[Node | None] = []
    low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
    for j in range(len(splits)):
        mine = np.flatnonzero(owner == j)
        children.append(gnat(entries, others[mine]) if len(mine) else None)
        if len(mine):
            low[:, j] = _outwards(squares[:, mine].min(axis=1), up=False)
            high[:, j] = _outwards(squares[:, mine].max(axis=1), up=True)
    return Node(splits, children, low, high)


def nearest(entries: np.ndarray, tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every query, the lower one of ties, and its squared distance."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    index = np.full(len(queries), len(entries))
    _search(entries, tree, queries, np.arange(len(queries)), best, index)
    return index, best


def _search(entries: np.ndarray, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
    """Look for something better in ``node`` for these rows of ``queries``; ``best`` and ``index`` are improved in place."""
    squares = _squares(queries[rows], entries[node.splits])
    for i, entry in enumerate(node.splits.tolist()):
        found = squares[:, i]
        better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], entry
    if all(c is None for c in node.children):
        return
    least, most = _outwards(squares, up=False), _outwards(squares, up=True)
    own = squares.argmin(axis=1)
    # A query's own child comes first: it most often holds the nearest entry, and then leaves the others out.
    for mine in (True, False):
        for j, child in enumerate(node.children):
            if child is None:
                continue
            at = np.flatnonzero((own == j) == mine)
            radius = _outwards(best[rows[at]], up=True)[:, None]
            # Sums and differences are rounded outwards too: a bound must hold by more than their own rounding.
            far = (np.nextafter(most[at] + radius, np.inf) < node.low[None, :, j]) | (np.nextafter(least[at] - radius, -np.inf) > node.high[None, :, j])
            at = at[~far.any(axis=1)]
            if len(at):
                _search(entries, child, queries, rows[at], best, index)


def largest(length: int) -> int:
    """Bound on components so that a vector's squared distance fits 63 bits; larger ones count as the bound."""
    return int((2**62 / max(1, length)) ** 0.5) // 2


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), within ``largest``."""
    bound = largest(values.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of rows whose vector is not null and holds no null or non-finite component.

    Vectors of another length than the first kept one's (by ``vec_id``, null last, then by components) have no place in the codebooks and go
    too, as do those whose length no 16 equal parts of one component or more make up.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("embedding"))
    return kept.filter(x.isNotNull() & finite & (F.size(x) > 0) & (F.size(x) % PARTS == 0))


def _first(kept: DataFrame) -> np.ndarray:
    """Components of the ``ENTRIES`` smallest kept ids' vectors, ascending, as integers."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    rows = kept.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not rows:
        return np.zeros((0, 0), np.int64)
    same = kept.filter(F.size("embedding") == len(rows[0].embedding))
    rows = same.select("vec_id", "embedding").orderBy(*order).limit(ENTRIES).collect()
    return integers(np.array([r.embedding for r in rows], np.float64))


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix of integers; all vectors have this length."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
            yield batch, integers(flat.reshape(-1, length))


def _parts(codebooks: np.ndarray, length: int) -> list[tuple[slice, np.ndarray, Node]]:
    width = length // PARTS
    cuts = [slice(p * width, (p + 1) * width) for p in range(PARTS)]
    return [(c, np.ascontiguousarray(codebooks[:, c]), gnat(codebooks[:, c])) for c in cuts]


def _moved(kept: DataFrame, codebooks: np.ndarray, length: int) -> np.ndarray:
    """Codebooks whose used entries are replaced by the floored mean of the parts assigned to them."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(codebooks, length)
        n = np.zeros((PARTS, len(codebooks)), np.int64)
        sums = np.zeros((PARTS, len(codebooks), length // PARTS), np.int64)
        held = 0

        def flush() -> pa.RecordBatch:
            p, e = np.nonzero(n)
            columns = [p.astype(np.int32), e.astype(np.int32), n[p, e]]
            out = [*map(pa.array, columns), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))]
            n[:], sums[:] = 0, 0
            return pa.RecordBatch.from_arrays(out, names=["part", "entry", "n", "sums"])

        # Partial sums are handed on before they could leave 63 bits.
        most = (1 << 62) // largest(length)
        for batch, matrix in _matrices(batches, length):
            if held + batch.num_rows > most:
                yield flush()
                held = 0
            held += batch.num_rows
            for p, (cut, entries, tree) in enumerate(parts):
                index, _ = nearest(entries, tree, matrix[:, cut])
                np.add.at(n[p], index, 1)
                np.add.at(sums[p], index, matrix[:, cut])
        yield flush()

    # At most PARTS * ENTRIES entries, however many vectors.
    partial = kept.select("embedding").mapInArrow(add_up, SUMS)
    places = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(length // PARTS)]
    out = codebooks.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():
        at = row.part * (length // PARTS)
        out[row.entry, at : at + length // PARTS] = [int(row[f"s{i}"]) // row.n for i in range(length // PARTS)]
    return out


def train(kept: DataFrame) -> tuple[np.ndarray, int]:
    """Codebooks of all parts side by side (entries by components), after all rounds over all kept vectors; and the length of vectors."""
    codebooks = _first(kept)
    length = codebooks.shape[1]
    if length:
        same = kept.filter(F.size("embedding") == length)
        for _ in range(ROUNDS):
            codebooks = _moved(same, codebooks, length)
    return codebooks, length


def digest(codebooks: np.ndarray, length: int) -> str:
    width = length // PARTS
    listed = [codebooks[:, p * width : (p + 1) * width].ravel() for p in range(PARTS)] if length else []
    return hashlib.sha256(",".join(str(x) for part in listed for x in part.tolist()).encode()).hexdigest()


def encode(kept: DataFrame, codebooks: np.ndarray, length: int) -> DataFrame:
    """``vec_id, label, code, error`` of kept vectors of this length; none where there are no codebooks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(codebooks, length)
        for batch, matrix in _matrices(batches, length):
            codes, error = np.zeros((len(matrix), PARTS), np.uint8), np.zeros(len(matrix), np.int64)
            for p, (cut, entries, tree) in enumerate(parts):
                index, squares = nearest(entries, tree, matrix[:, cut])
                codes[:, p] = index
                error += squares
            text = codes.tobytes().hex()
            step = 2 * PARTS
            out = [pa.array([text[i : i + step] for i in range(0, len(text), step)]), pa.array(error)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    same = kept.filter(F.size("embedding") == length) if length else kept.limit(0)
    return same.select("vec_id", "label", "embedding").mapInArrow(assign, f"vec_id long, label {label}, {ASSIGNED}")


def compressed(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row of ``vectors`` (vec_id, embedding, label).

    Repeated rows are coded each and count each in the means; a null ``vec_id`` or label is a value like others. Fewer than 64
    kept vectors give as many entries, equal ones included; none give no rows. Components beyond ``largest`` count as that bound.
    """
    kept = kept_vectors(vectors)
    codebooks, length = train(kept)
    coded = stage(encode(kept, codebooks, length), "codes")
    errors = coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error"))
    small = stage(errors, "label_errors")
    sent = bounded(small, BROADCAST_LABELS)
    if sent is not small:
        joined = coded.join(sent, F.col("label").eqNullSafe(F.col("its_label")))
    else:
        pieces = small.withColumn("its_piece", F.explode(F.sequence(F.lit(0), F.lit(LABEL_PIECES - 1))))
        dealt = coded.withColumn("piece", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_PIECES)).cast("int"))
        joined = dealt.join(pieces, F.col("label").eqNullSafe(F.col("its_label")) & (F.col("piece") == F.col("its_piece")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks, length)).alias("codebooks_sha256"))
