"""Publishing projected tables under a version, and exporting sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECTION_VERSION = 1
POINTER = "store_commit string, projection_version int, path string, published_at timestamp, generation long"


def write_projection(tables: Mapping[str, DataFrame], root: str, commit: str, spark: SparkSession) -> str:
    """Write every table under ``v=<commit>`` and then publish it.

    Publishing appends one pointer row; readers take the newest, so they see the
    old version or the complete new one. Events lie partitioned by harness and
    sorted by session, so a session's rows share few row groups.
    """
    path = f"{root.rstrip('/')}/v={commit}"
    for name, df in tables.items():
        writer = df
        keys = [c for c in ("session_id", "seq") if c in df.columns]
        if keys:
            writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        out = writer.write.mode("overwrite")
        if "harness_id" in df.columns:
            out = out.partitionBy("harness_id")
        out.parquet(f"{path}/{name}")
    generation = _generation(spark, root) + 1
    row = spark.range(1).select(
        F.lit(commit).alias("store_commit"),
        F.lit(PROJECTION_VERSION).alias("projection_version"),
        F.lit(path).alias("path"),
        F.current_timestamp().alias("published_at"),
        F.lit(generation).cast("long").alias("generation"),
    )
    row.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/pointers")
    return path


def pointers(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root.rstrip('/')}/pointers"
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).json(folder)


def current_pointer(spark: SparkSession, root: str) -> DataFrame:
    """The newest pointer, one row or none."""
    return pointers(spark, root).orderBy(F.desc("generation")).limit(1)


def _generation(spark: SparkSession, root: str) -> int:
    return pointers(spark, root).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]


def read_projection(spark: SparkSession, root: str, name: str) -> DataFrame:
    row = current_pointer(spark, root).first()
    if row is None:
        raise FileNotFoundError(f"no projection published under {root}")
    return spark.read.parquet(f"{row.path}/{name}")


def freshness(pointer: DataFrame, head: str | Column) -> DataFrame:
    """fresh where commit and projection version match, else stale."""
    head = F.lit(head) if isinstance(head, str) else head
    fresh = (F.col("store_commit") == head) & (F.col("projection_version") == PROJECTION_VERSION)
    return pointer.select("store_commit", F.when(fresh, F.lit("fresh")).otherwise(F.lit("stale")).alias("state"))


def prune_versions(spark: SparkSession, root: str) -> None:
    """Drop the versions no longer pointed to; best effort, they are only a cache."""
    row = current_pointer(spark, root).first()
    if row is None:
        return
    fs, path = _fs(spark, root)
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and not row.path.endswith("/" + name):
            fs.delete(status.getPath(), True)


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def session_documents(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, document): the JSON document an export writes beside the source rows.

    ``files`` is (session_id, path, size, media_type, sha256); a document lists all files of its session.
    """
    listed = files.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "size", F.col("media_type").alias("mediaType"), "sha256"))).alias("files")
    )
    doc = F.struct(
        F.lit(1).alias("formatVersion"),
        F.col("session_id").alias("sessionId"),
        F.col("revision_digest").alias("revision"),
        F.struct(F.col("harness_id").alias("harnessId"), F.col("source_session_id").alias("sourceSessionId")).alias("sourceIdentity"),
        F.struct(F.col("association_mode").alias("association"), F.col("opening_path").alias("openingPath")).alias("project"),
        F.when(F.col("continuation_parent").isNotNull(), F.struct(F.col("continuation_parent").alias("parentSessionId"))).alias("continuation"),
        F.when(
            F.col("subagent_origin"), F.struct(F.col("subagent_kind").alias("kind"), F.col("subagent_parent").alias("parentSourceSessionId"))
        ).alias("subagent"),
        F.col("archive_state").alias("archiveState"),
        F.col("accepted_at").alias("acceptedAt"),
        "files",
    )
    return sessions.join(listed, "session_id", "left").select(
        "session_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document")
    )


def export_sessions(lines: DataFrame, documents: DataFrame, ids: DataFrame, out: str) -> None:
    """Write the source lines and the document of chosen sessions, one folder per session.

    Lines are range-partitioned, so a large session is written by many tasks as
    consecutive part files.
    """
    wanted = ids.select("session_id").distinct()
    order = ["session_id", "file", "line"]
    chosen = lines.join(wanted, "session_id", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    chosen.select("session_id", "file", F.col("raw").alias("value")).withColumn(
        "file", F.regexp_replace("file", "/", "~")
    ).write.mode("overwrite").partitionBy("session_id", "file").text(f"{out}/source")
    docs = documents.join(wanted, "session_id", "left_semi").select("session_id", F.col("document").alias("value"))
    docs.write.mode("overwrite").partitionBy("session_id").text(f"{out}/session")
