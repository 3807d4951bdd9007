"""JSONL transcripts as rows, files of any size, physical line numbers kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.digests import revision_digest
from lodestone.functions.json import bracketed, json_object
from lodestone.functions.text import SPACE


# Files up to so many bytes are digested as one value; the format holds 2 GB.
WHOLE_FILE_BYTES = 1 << 30


def plain_path(uri: Column) -> Column:
    """A file path without scheme and percent escapes."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(file, block, line, raw): every physical line, blank ones included.

    Files are split as usual. Within one split rows come in file order and have
    consecutive ids, so a line's number is its distance from the split's least id
    plus the lines of earlier splits, both from a table with one row per split.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("value").alias("raw"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("file", "block")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
        .select("file", "block", "_least", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    line = F.col("_before") + F.col("_id") - F.col("_least") + 1
    return rows.join(before, ["file", "block"]).select("file", "block", line.alias("line"), "raw")


def parsed(lines: DataFrame) -> DataFrame:
    """Nonblank lines with ``value``: the line as a JSON object, NULL if it is none."""
    blank = F.regexp_replace("raw", f"^{SPACE}+", "") == ""
    listed = lines.filter(~blank).withColumn("_listed", bracketed(F.col("raw")))
    return listed.withColumn("value", json_object(F.col("raw"), F.col("_listed"))).drop("_listed")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], glob: str | None = "*.jsonl") -> DataFrame:
    return parsed(read_lines(spark, paths, glob))


def event_seq(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Dense 1-based ``seq`` over a session's files in ``order``, then by line.

    ``lines`` needs session_id, file, block and line. Ranks are per split; what
    lies before comes from a table with one row per split.
    """
    inside = Window.partitionBy("session_id", "file", "block").orderBy("line")
    earlier = (
        Window.partitionBy("session_id").orderBy(*order, "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        lines.groupBy("session_id", *order, "file", "block")
        .agg(F.count("*").alias("_n"))
        .select("session_id", "file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        lines.withColumn("_rank", F.row_number().over(inside))
        .join(before, ["session_id", "file", "block"])
        .withColumn("seq", (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_before", "_rank")
    )


def joined_parts(lines: DataFrame) -> DataFrame:
    """Lines of the part files of a folder as lines of one file: those of a later part, by name, follow the earlier ones.

    A file written by several tasks has several parts. A part should end in a line that ``lines`` holds, not in blank ones.
    """
    earlier = Window.partitionBy("_folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("_folder"), "file").agg(F.max("line").alias("_end"))
    before = ends.select("file", F.coalesce(F.sum("_end").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(before, "file").withColumn("line", F.col("line") + F.col("_before")).drop("_before")


def fingerprint_files(
    spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, whole_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """(file, size, sha256) of files of any size; empty files are not listed, since no reader brings them.

    Files up to ``whole_bytes`` are one binary value each, digested where they are read. Larger ones are read in splits,
    dealt by file and ordered, and pass through one running digest a file, a batch at a time.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    # A file of no more than a byte order mark has no lines to go by.
    whole_bytes = max(whole_bytes, len(_MARK))

    def reader(kind: str):
        out = spark.read.format(kind).option("recursiveFileLookup", "true")
        return out if glob is None else out.option("pathGlobFilter", glob)

    small = reader("binaryFile").load(paths).filter(F.col("length") <= whole_bytes)
    small = small.select(plain_path(F.col("path")).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    split = reader("text").option("lineSep", "\n").load(paths).filter(F.col("_metadata.file_size") > whole_bytes)
    ranges = split.select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("raw"),
    )
    dealt = ranges.repartition("file").sortWithinPartitions("file", "block", "place").drop("block", "place")
    return small.unionByName(dealt.mapInArrow(_running_digests, "file string, size long, sha256 string"))


_MARK = b"\xef\xbb\xbf"


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files whose lines come in order. Their bytes are the lines with a line break between them.

    What the reader leaves out, a break at the end and a byte order mark at the start, shows in the file's size; two digests run,
    with the mark and without. Any other size means that lines are not the file's bytes, as in a compressed file.
    """
    file, size, seen, digests = None, 0, 0, ()

    def finished() -> pa.RecordBatch:
        marked, ended = divmod(size - seen, len(_MARK))
        if marked not in (0, 1) or ended not in (0, 1):
            raise ValueError(f"{file} has {size} bytes, its lines {seen}: it cannot be digested by lines")
        digests[marked].update(b"\n" * ended)
        columns = [pa.array([file]), pa.array([size], pa.int64()), pa.array([digests[marked].hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=["file", "size", "sha256"])

    for batch in batches:
        for name, length, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
            if name.as_py() != file:
                if file is not None:
                    yield finished()
                file, size, seen, digests = name.as_py(), length.as_py(), -1, (hashlib.sha256(), hashlib.sha256(_MARK))
            line = raw.as_buffer()
            for d in digests:
                if seen >= 0:
                    d.update(b"\n")
                d.update(line)
            seen += len(line) + 1
    if file is not None:
        yield finished()


def revisions(files: DataFrame) -> DataFrame:
    """Digest, file count and bytes of each session's bundle of (path, size, sha256).

    The digest is that of the digests, in order, of sorted lists cut by a hash of
    the path: one definition for bundles of any size, and no list of a whole bundle.
    """
    cut = F.substring(F.sha2("path", 256), 1, 3)
    parts = files.groupBy("session_id", cut.alias("cut")).agg(
        revision_digest(F.collect_list(F.struct("path", "size", "sha256"))).alias("d"), F.count("*").alias("n"), F.sum("size").alias("b")
    )
    # at most 4,096 parts a session
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cut", "d"))), lambda p: p["d"])
    return parts.groupBy("session_id").agg(
        F.sha2(F.array_join(listed, "\n"), 256).alias("revision_digest"), F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes")
    )
