"""Token ids in compressed blocks with one shared dictionary.

Texts are dealt to shards by range of ``doc_id``, encoded, and every document's
ids become one zstandard frame under a dictionary that was trained on the ids of
a bounded sample. Frames of neighbours lie together in blocks; a block row holds
the dictionary's hash and, for each of its documents, the offset of its frame, so
one short document is read by slicing its frame out of one block.

Files, under one folder, all written and read by Spark::

    dictionary/   dict_hash, dictionary, width (bytes of an id)
    blocks/       shard, block, dict_hash, payload, and the index: doc_id[], offset[] (bytes), start[] (ids before, in the block), n_tokens[]

Order is by ``doc_id`` (null first), then text; rows that agree in both are alike.
A null text is empty and has the end id alone. An empty table gives no blocks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, parts_for, texts

BLOCK_BYTES = 1 << 20
SHARD_ROWS = 20_000
BLOCKS = (
    "shard int, block int, dict_hash long, payload binary, doc_id array<long>, offset array<long>, start array<long>, n_tokens array<long>"
)
SAMPLE = "raw binary"
IDS = "doc_id long, shard int, block int, pos int, n_tokens long, ids_crc32 long"


def _byte_chars() -> dict[int, str]:
    """The characters by which a byte-level model spells bytes: printable ones themselves, others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()
_SPACE = _BYTE_CHARS[32]
_LATIN = re.compile("[\0-\u024f]+")
_MARKS = ".,;:!?*#$%&|"


class Encoder:
    """Ids of whole texts through a tokenizer file, with a cache of pieces.

    The byte-level splitter always cuts between a character that is not white
    space and a single space or line break before another such character, so
    texts are cut there and pieces encoded once; what holds irregular white space
    is encoded as it stands. Each piece goes through the tokenizers library; two
    generations bound the cache.
    """

    CACHED = 340_000  # what a dictionary of 2^19 slots holds; more would double it
    LONGEST = 64
    _cuts = re.compile(r"(?<=\S)(?=[ \n]\S)")
    _plain = re.compile(r"[ \n]\S+")
    _stem = re.compile(r"([^\W\d_]+)([.,;:!?*#$%&|]+)")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        # Cutting into pieces is known to be exact for this form alone; others encode whole texts.
        self.cut = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.code = "H" if self.width == 2 else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.model = self.tokenizer.model
        self.cache = _Pieces(self)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def spelled(self, text: str) -> bytes:
        """Bytes of one piece of the splitter, spelled in the model's characters: the model alone is asked."""
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def letters(self, lead: str, rest: str) -> bytes | None:
        """Bytes of a space or nothing and Latin letters, which the splitter leaves whole; ``None`` of anything else."""
        if not rest.isalpha():
            return None
        if rest.isascii():
            return self.spelled(_SPACE + rest if lead else rest)
        if not _LATIN.fullmatch(rest):
            return None
        return self.spelled((lead + rest).encode().decode("latin-1").translate(_BYTE_CHARS))

    def piece(self, piece: str) -> bytes:
        """Bytes of a piece after a space, or of one that begins with a line break; not looked up."""
        broken = piece[0] == "\n"
        rest = piece[1:] if broken else piece
        found = self.letters("" if broken else " ", rest)
        if found is not None:
            return self.cache["\n\n\n"] + found if broken else found
        stem = rest.rstrip(_MARKS)
        if not stem.isalpha():
            m = self._stem.fullmatch(rest)
            stem = m[1] if m else ""
        if stem and len(stem) < len(rest):  # letters and a run of marks are split between them
            return self.cache["\n" + stem if broken else stem] + self.cache["\n\n" + rest[len(stem) :]]
        return self.whole(piece if broken else " " + piece)

    def encode(self, text: str) -> bytes:
        if not self.cut or not text:
            return (self.whole(text) if text else b"") + self.end
        head, *rest = text.replace("\n", " \n").split(" ")
        if not head or head.split() == [head]:
            try:
                return b"".join((self.whole(head), *map(self.cache.__getitem__, rest), self.end))
            except IrregularSpaceError:
                pass
        head, *rest = self._cuts.split(text)
        out = [self.whole(head)]
        for piece in rest:
            if self._plain.fullmatch(piece):
                out.append(self.cache[piece if piece[0] == "\n" else piece[1:]])
            else:
                out.append(self.whole(piece))
        out.append(self.end)
        return b"".join(out)


class IrregularSpaceError(ValueError):
    """A piece is empty or holds white space."""


class _Pieces(dict):
    """Bytes of pieces by piece; a run of marks in a text's middle stands under two line breaks and itself.

    Two generations of bounded size: what the older one has moves on when met again. Long pieces are not kept.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def asked(self, piece: str) -> bytes:
        enc = self.encoder
        if piece.isalpha() or piece[1:].isalpha() and not piece[0].isspace():  # no white space to look for
            return enc.piece(piece)
        if piece == "\n\n\n":
            return enc.whole("\n")
        bare = piece.lstrip("\n")
        if bare.split() != [bare]:
            raise IrregularSpaceError(piece)
        return enc.whole(piece[2:]) if piece.startswith("\n\n") else enc.piece(piece)

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.asked(piece)
        if len(piece) <= Encoder.LONGEST:
            if len(self) >= Encoder.CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a worker process, kept for its later tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def train_dictionary(
    docs: DataFrame, path: str, end_id: int, documents: int = 1000, bytes_each: int = 16_384, size: int = 65_536
) -> tuple[int, bytes]:
    """Dictionary trained on the ids of at most ``documents`` documents, ``bytes_each`` of the ids of each.

    The bound concerns the dictionary alone, which changes sizes and never ids. Too small a sample gives an empty one.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for batch in batches:
            raw = [enc.encode(t)[:bytes_each] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    chosen = bounded(
        docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).distinct(), documents
    )
    part = docs.join(chosen, "doc_id", "left_semi").select("text")
    if documents > 0:
        part = part.limit(documents)
    raw = sorted(bytes(r.raw) for r in part.mapInArrow(sample, SAMPLE).collect())
    try:
        made = zstandard.train_dictionary(size, raw).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        made = b""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(made)))), made


def _width(spark: SparkSession, path: str, end_id: int) -> int:
    """Bytes of an id, asked of a task: the driver holds no tokenizer."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder(path, end_id).width], pa.int32())], names=["width"])

    return spark.range(1).repartition(1).mapInArrow(ask, "width int").first().width


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    if dictionary:
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
    return zstandard.ZstdCompressor(level=level)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    if dictionary:
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return zstandard.ZstdDecompressor()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, level: int = 1, dictionary_documents: int = 1000
) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write ``folder``."""
    spark = docs.sparkSession
    docs = texts(docs)
    dict_hash, dictionary = train_dictionary(docs, tokenizer, end_id, dictionary_documents)
    width = _width(spark, tokenizer, end_id)
    spark.createDataFrame(
        [(dict_hash, bytearray(dictionary), width)], "dict_hash long, dictionary binary, width int"
    ).write.parquet(f"{folder}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, comp = encoder(tokenizer, end_id), compressor(dictionary, level)
        shard, block = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        offsets: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            starts = np.cumsum([0, *counts[:-1]]).tolist()
            row = [[shard], [block], [dict_hash], [b"".join(frames)], [ids], [offsets], [starts], [counts]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)

        kinds = pa.schema(
            [("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.int64()), ("payload", pa.binary())]
            + [(k, pa.list_(pa.int64())) for k in ("doc_id", "offset", "start", "n_tokens")]
        )
        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(doc_ids):
                raw = enc.encode(column[i].as_py())
                frame = comp.compress(raw)
                ids.append(doc_id)
                offsets.append(held)
                counts.append(len(raw) // enc.width)
                frames.append(frame)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield flush()
                    ids, offsets, counts, frames, held, block = [], [], [], [], 0, block + 1
        if ids:
            yield flush()

    (
        docs.repartitionByRange(parts_for(docs, SHARD_ROWS), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(pack, BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{folder}/blocks")
    )


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, shard, block, pos, start, n_tokens`` of every document, without touching payloads.

    ``start`` counts the ids of all documents before. Sums run within a shard, whose blocks are few, and over one row per shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("shard", "block", "doc_id", "start", "n_tokens")
    sized = blocks.select("shard", "block", (F.element_at("start", -1) + F.element_at("n_tokens", -1)).alias("_t"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sized.groupBy("shard").agg(F.sum("_t").alias("_t"))
    shards = shards.select("shard", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("_in", F.coalesce(F.sum("_t").over(inside), F.lit(0)))
        .join(shards, "shard")
        .select("shard", "block", (F.col("_in") + F.col("_shard_start")).alias("_block_start"))
    )
    return (
        blocks.join(placed, ["shard", "block"])
        .select("shard", "block", "_block_start", F.posexplode(F.arrays_zip("doc_id", "start", "n_tokens")).alias("pos", "_d"))
        .select(
            F.col("_d.doc_id").alias("doc_id"), "shard", "block", "pos",
            (F.col("_d.start") + F.col("_block_start")).alias("start"), F.col("_d.n_tokens").alias("n_tokens"),
        )
    )


def read_dictionary(spark: SparkSession, folder: str) -> tuple[int, bytes, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return row.dict_hash, bytes(row.dictionary), row.width


def map_ids(blocks: DataFrame, folder: str, schema: str, fn: Callable[[dict, Iterator[np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """Decode ``blocks``; ``fn`` takes a block's row and its documents' ids (``<u4``) and returns rows of ``schema``."""
    dict_hash, dictionary, width = read_dictionary(blocks.sparkSession, folder)
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        de = decompressor(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError(f"block {row['shard']}/{row['block']} was written under another dictionary")
                payload, cuts = row["payload"], [*row["offset"], len(row["payload"])]
                arrays = (
                    np.frombuffer(de.decompress(payload[a:b]), kind).astype("<u4")
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                )
                yield fn(row, arrays)

    return blocks.mapInArrow(decode, schema)


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per stored document, from its decoded ids: ``doc_id, start, n_tokens, ids_crc32``."""
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("pos", pa.int32()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def digest(row: dict, arrays: Iterator[np.ndarray]) -> pa.RecordBatch:
        n, crc = [], []
        for ids in arrays:
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        k = len(n)
        cols = [row["doc_id"], [row["shard"]] * k, [row["block"]] * k, range(k), n, crc]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, kinds, strict=True)], schema=kinds)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    read = map_ids(blocks, folder, IDS, digest).drop("doc_id", "n_tokens")
    return index(spark, folder).join(read, ["shard", "block", "pos"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of a few documents: only their blocks are read, only their frames decoded."""
    wanted = set(doc_ids)
    dict_hash, dictionary, width = read_dictionary(spark, folder)
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        de = decompressor(dictionary)
        for batch in batches:
            ids, found = [], []
            for row in batch.to_pylist():
                cuts = [*row["offset"], len(row["payload"])]
                for i, doc_id in enumerate(row["doc_id"]):
                    if doc_id in wanted:
                        ids.append(doc_id)
                        found.append(np.frombuffer(de.decompress(row["payload"][cuts[i] : cuts[i + 1]]), kind).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    near = blocks.filter(F.arrays_overlap("doc_id", F.array(*[F.lit(d).cast("long") for d in doc_ids])))
    return near.mapInArrow(pick, "doc_id long, ids array<long>")
