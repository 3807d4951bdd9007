"""Near-duplicate documents by MinHash.

One pass over the texts takes each document's set of five-word shingles, a digest
of the set and many universal hash minima of it. Documents of equal sets are one
*class*. Classes that agree in a band of minima are candidates: in every bucket
each member is paired with the bucket's least member, pairs whose signatures agree
too little are dropped, and the rest are confirmed on full sets. Components are
found by large-star and small-star. Buckets whose members then still lie in several
components are cut into parts of a few hundred members, and full sets are compared
for every two parts (and within each) between members of different components, so
no pair of a bucket goes untested unless its classes are already linked. A pair of
parts gives back only links that join components, never its pairs.

A pair at the threshold of 0.85 misses every one of the 32 bands of 6 minima with
a chance of 3e-7, and falls under the signature bound with one of about as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, slices, stage, texts
from lodestone.llm.components import components
from lodestone.llm.words import shingle_sets, stream

BANDS, ROWS = 32, 6
# Candidates must agree in so large a part of their minima before sets are compared.
SIGNATURE_FLOOR = 0.72
# Members of a part of a bucket, and bytes of their shingles, on average.
PART, PART_BYTES = 512, 32 << 20
# Columns of shingles that two parts are compared over at a time.
COLUMNS = 4096
# Up to so many ids, some 20 MB, are sent to every task when texts are looked up; beyond, texts are shuffled.
BROADCAST_IDS = 200_000
SIGNED = "doc_id long, n_shingles long, digest binary, signature binary"


def minima(values: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """Minima of ``hashes`` universal hashes over runs of ``values`` that begin at ``starts``; one row a run."""
    a, b = stream(17, hashes) | np.uint64(1), stream(19, hashes)
    out = np.empty((hashes, len(starts)), np.uint32)
    for j in range(hashes):
        h = values * a[j]
        h += b[j]
        h >>= np.uint64(32)
        out[j] = np.minimum.reduceat(h.astype(np.uint32), starts)
    return out.T.copy()


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = 5) -> DataFrame:
    """``doc_id, n_shingles, digest, signature`` of every document; without words the last two are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offsets in slices(batch):
                sets = shingle_sets(data, offsets, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                digests: list[bytes | None] = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signatures: list[bytes | None] = [None] * len(sets)
                if len(full):
                    kept = sizes[full]
                    found = minima(np.concatenate([sets[i] for i in full.tolist()]), np.cumsum(kept) - kept, bands * rows)
                    for i, row in zip(full.tolist(), found, strict=True):
                        signatures[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )

    return texts(docs).mapInArrow(sign, SIGNED)


def band_rows(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``node, n_shingles, bucket``: a bucket is the hash of a band's number and minima, two hashes wide."""
    width = 4 * rows
    keys = F.array(
        *[
            F.struct(F.xxhash64(part, F.lit(b)).alias("h"), F.hash(part, F.lit(b)).alias("g"))
            for b in range(bands)
            for part in [F.substring("signature", 1 + b * width, width)]
        ]
    )
    return nodes.select("node", "n_shingles", F.explode(keys).alias("bucket"))


def agreeing(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose signatures agree in at least ``floor`` of their minima."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                batch = batch.filter(pa.array((x == y).mean(axis=1) >= floor))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a binary, b binary")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles``: the full sets (sorted hashes as bytes) of the classes in ``wanted`` (``node``), from the texts."""
    needed = stage(wanted.select("node").distinct().join(nodes.select("node", "doc_id"), "node"), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                found = [s.tobytes() for s in shingle_sets(data, offsets, shingle)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())], names=["node", "shingles"]
                )

    # A doc_id may stand for several texts: the digest of what was read decides. A null id is looked up by the null-safe join.
    ids = bounded(needed.select(F.col("doc_id").alias("_id")).distinct(), BROADCAST_IDS)
    held = texts(docs)
    held = held.join(ids, held["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text").mapInArrow(sets, "node binary, shingles binary")
    return stage(held.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` of their full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    left = held.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = held.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def joining_links(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different sides (all, if there is one side) and roots, so many as join their roots."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(code)
    place = np.cumsum(seen > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = seen[code] > 1  # a shingle of one set alone is in no intersection
    code, owner = place[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[a:b], code[a:b] - low] = 1
        common += grid @ grid.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= root[:, None] < root[None, :]
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    x, y = np.nonzero(linked)
    # One link for each two roots, then only those that join what is apart.
    _, first = np.unique(root[x] * (root.max() + 1) + root[y], return_index=True) if len(x) else (None, [])
    up = list(range(int(root.max()) + 1))

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    out = []
    for i in first:
        a, b = top(int(root[x[i]])), top(int(root[y[i]]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(x[i]), int(y[i])))
    return out


def links_between(rest: DataFrame, held: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """``a, b``: links that join the roots of ``rest`` (``bucket, node, root, parts``), each bucket compared part by part."""
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))
    spread = rest.select("bucket", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    spread = spread.select("bucket", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        _, root = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)
        out: list[tuple[int, int]] = []
        if len(nodes) > 1 and root.max() > 0:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            out = joining_links(sets, table.column("own").to_numpy(), root.astype(np.int64), percent)
        return pa.table({k: pa.array([nodes[p[c]] for p in out], pa.binary()) for c, k in enumerate(("a", "b"))})

    return spread.join(held, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    floor: float = SIGNATURE_FLOOR,
    part: int = PART,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Rows are what is linked: a ``doc_id`` that stands on several rows gives as many results. Null or wordless texts
    have no shingles and are linked with nothing, so they are kept. A component is named by its least ``doc_id``;
    a null id is never least unless it is alone, and such a row counts as kept. An empty table gives no rows.
    """
    table = stage(signed(docs, bands, rows, shingle), "signed")
    one = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "n_shingles", "signature")).alias("one")
    nodes = table.filter("digest is not null").groupBy(F.col("digest").alias("node")).agg(one)
    nodes = stage(nodes.select("node", "one.doc_id", "one.n_shingles", "one.signature"), "classes")
    members = band_rows(nodes, bands, rows)
    shared = stage(
        members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").select("bucket", "least"), "buckets"
    )
    placed = stage(members.join(shared, "bucket"), "placed")
    stars = placed.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    pairs = stage(agreeing(stars, nodes, floor), "pairs")
    held = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), nodes, docs, shingle)
    links = stage(confirmed(pairs, held, percent), "links")
    roots = stage(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")

    # Buckets that still hold several components.
    rooted = placed.select("bucket", "node", "n_shingles").join(roots, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    parts = F.greatest(F.ceil(F.count("*") / F.lit(part)), F.ceil(F.sum("n_shingles") * 8 / F.lit(part_bytes)))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), parts.alias("parts"))
    rest = stage(rooted.drop("n_shingles").join(split.filter("lo <> hi").select("bucket", "parts"), "bucket"), "rest")
    more = stage(links_between(rest, sets_of(rest, nodes, docs, shingle), percent, part), "more")
    if not more.isEmpty():
        roots = stage(components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")

    # Names: the least id of a component, looked up through its classes.
    named = nodes.select("node", "doc_id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("digest"), "component_id")
    own = nodes.select(F.col("node").alias("digest"), F.col("doc_id").alias("class_id"))
    return (
        table.select("doc_id", "n_shingles", "digest")
        .join(own, "digest", "left")
        .join(linked, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "class_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
