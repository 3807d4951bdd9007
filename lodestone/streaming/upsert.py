"""Keyed replacement of session rows, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.session import stage
from lodestone.sources.jsonl import parsed, read_lines

BUCKETS = 256
# Files of a batch at most, when batches have grown: their names pass through the driver.
BATCH_FILES = 10_000


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_sessions(spark: SparkSession, table: str, rows: DataFrame, removed: DataFrame | None = None,
                     buckets: int = BUCKETS) -> None:
    """Replace the sessions of ``rows`` in a bucketed table and drop ``removed`` ones.

    Only the buckets a batch touches are rewritten. Running a batch again gives
    the same table, so a retried batch is harmless.
    """
    fresh = _bucketed(rows, buckets)
    keys = fresh.select("session_id", "bucket").distinct()
    if removed is not None:
        keys = keys.union(_bucketed(removed.select("session_id"), buckets).select("session_id", "bucket")).distinct()
    # used again after the write, when the table that ``rows`` may come from has changed
    keys = stage(keys, "keys")
    new = fresh
    if _exists(spark, table):
        # at most ``buckets`` rows
        touched = F.broadcast(keys.select("bucket").distinct())
        old = spark.read.parquet(table).join(touched, "bucket", "left_semi").join(keys.select("session_id"), "session_id", "left_anti")
        new = old.select(*fresh.columns).unionByName(fresh)
    staged = stage(new, "replace")
    # the last key lets a large session spread over tasks
    inside = "seq" if "seq" in staged.columns else F.xxhash64(*[c for c in staged.columns if c != "bucket"])
    staged.repartitionByRange("bucket", "session_id", inside).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(table)
    # A dynamic overwrite leaves alone a bucket that lost its last session.
    filled = staged.select("bucket").distinct()
    for row in keys.select("bucket").distinct().join(filled, "bucket", "left_anti").collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket={row.bucket}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish(spark: SparkSession, table: str, rows: DataFrame, version: str, batch: int) -> None:
    """Add a batch of session versions to a versioned table; writing the same batch again changes nothing.

    Rows are appended under ``rows/batch=N``; one row per session and version under ``versions/batch=N`` makes
    them visible, so readers see all of a batch or none. The work follows the batch, not the table.
    """
    rows.write.mode("overwrite").parquet(f"{table}/rows/batch={batch}")
    keys = spark.read.parquet(f"{table}/rows/batch={batch}").groupBy("session_id").agg(F.max(version).alias(version))
    keys.write.mode("overwrite").parquet(f"{table}/versions/batch={batch}")


def current(spark: SparkSession, table: str, version: str) -> DataFrame:
    """Every published row of the newest version of each session, whichever batches brought them."""
    listed = spark.read.parquet(f"{table}/versions")
    newest = listed.groupBy("session_id").agg(F.max(version).alias(version))
    rows = spark.read.parquet(f"{table}/rows")
    return rows.join(newest, ["session_id", version], "left_semi").join(listed.select("batch").distinct(), "batch", "left_semi").drop("batch")


def compact(spark: SparkSession, table: str, version: str, out: str) -> None:
    """Write what :func:`current` gives as a table of one batch at ``out``."""
    publish(spark, out, current(spark, table, version), version, 0)


def stream_upsert(stream: DataFrame, table: str, checkpoint: str, version: str = "modified_at") -> StreamingQuery:
    """Keep a versioned table of sessions; :func:`current` reads their newest versions.

    Late older versions change nothing, and rows of one version may come in any number of batches.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, n: publish(batch.sparkSession, table, batch, version, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---- transcripts ----

# A main transcript and its subagent files are one session: the path without what follows its stem.
SESSION_FILES = r"(/subagents/[^/]+|\.[^/.]+)$"
GENERATION = "_generation"


def listed_files(spark: SparkSession, folder: str, glob: str, session_files: str = SESSION_FILES) -> DataFrame:
    """``key, path, mark`` of the files there are: a file's mark changes with its size and time, its key names the session."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
        .select("path", "modificationTime", "length")
    )
    return files.select(F.regexp_replace("path", session_files, "").alias("key"), "path", F.xxhash64("path", "length", "modificationTime").alias("mark"))


def ingest_transcripts(spark: SparkSession, folder: str, table: str, state: str, normalize, files_per_batch: int = 1000,
                       glob: str = "*.jsonl", session_files: str = SESSION_FILES) -> int:
    """Bring the versioned ``table`` up to the transcripts in ``folder``; returns how many sessions had changed.

    The listing is compared with the one kept in ``state``: sessions with a new, grown, changed or missing file are read
    again whole, all their files in one batch, so the table does not depend on how files fell into batches. The first
    batch has about ``files_per_batch`` files, each further one twice as many as the one before, up to ``BATCH_FILES``: a
    batch takes seconds whatever it holds, so their number must not follow that of the files. The state is written after a
    batch is published; a broken run repeats it, which is no more than was done before or that bound. A session all of
    whose files are gone keeps its last version.
    """
    # a scan of small files has a task for a few of them each, and would stage as many files again
    files = stage(listed_files(spark, folder, glob, session_files).hint("rebalance"), "listing")
    now = files.groupBy("key").agg(F.count("*").alias("files"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("marks"))
    last = -1
    if _exists(spark, state):
        known = spark.read.parquet(state)
        last = known.agg(F.max("batch")).first()[0]
        kept = known.groupBy("key").agg(F.max(F.struct("batch", "files", "marks")).alias("k")).select("key", "k.files", "k.marks")
        now = now.join(kept, ["key", "files", "marks"], "left_anti")
    changed = stage(now, "changed")
    found, total = changed.agg(F.count("*"), F.sum("files")).first()
    # one share of the sessions has about files_per_batch files
    shares, done, taken = -(-(total or 0) // files_per_batch), 0, 1
    while done < shares:
        share = F.pmod(F.xxhash64("key"), F.lit(shares))
        part = changed.filter((share >= done) & (share < done + taken))
        done, taken = done + taken, min(2 * taken, max(1, BATCH_FILES // files_per_batch))
        paths = [r.path for r in files.join(part, "key", "left_semi").select("path").collect()]
        if not paths:
            continue
        last += 1
        # small files are opened here, and not again wherever their lines are needed
        lines = stage(read_lines(spark, paths, glob).hint("rebalance"), "lines")
        rows = normalize(parsed(lines)).withColumn(GENERATION, F.lit(last).cast("long"))
        publish(spark, table, rows, GENERATION, last)
        part.write.mode("overwrite").parquet(f"{state}/batch={last}")
    return found


def transcripts(spark: SparkSession, table: str) -> DataFrame:
    """The sessions of a table that :func:`ingest_transcripts` keeps."""
    return current(spark, table, GENERATION).drop(GENERATION)


def stream_transcripts(spark: SparkSession, folder: str, table: str, checkpoint: str, normalize, every: str = "1 minute", **options) -> StreamingQuery:
    """Run :func:`ingest_transcripts` again and again; the stream is a clock, the listing tells what changed."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(lambda batch, n: ingest_transcripts(batch.sparkSession, folder, table, f"{checkpoint}/listing", normalize, **options))
        .option("checkpointLocation", f"{checkpoint}/clock").trigger(processingTime=every).start()
    )
