"""Driver tables bound to the canonical event columns.

An adapter is any function ``DataFrame -> DataFrame`` returning these columns;
columns a source does not state are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.digests import identity_key
from lodestone.operators.blocks import dense_seq

EVENT_COLUMNS = {
    "harness_id": "string",
    "session_id": "string",
    "source_session_id": "string",
    "seq": "bigint",
    "kind": "string",
    "role": "string",
    "source_event_id": "string",
    "identity_key": "string",
    "source_file": "string",
    "source_cursor": "string",
    "timestamp": "string",
    "text": "string",
    "payload_json": "string",
    "tool_names": "array<string>",
    "file_touches": "array<struct<operation:string,source_path:string,normalized_path:string>>",
    "subagent_id": "string",
    "subagent_type": "string",
    "harness_injected": "boolean",
    "label_source": "string",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def canonical(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as canonical events; unstated columns are NULL (arrays empty)."""
    out = []
    for name, kind in EVENT_COLUMNS.items():
        if name in columns:
            col = columns[name]
        elif kind.startswith("array"):
            col = F.array()
        elif kind == "boolean":
            col = F.lit(False)
        else:
            col = F.lit(None)
        out.append(col.cast(kind).alias(name))
    return df.select(*out)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A turn is an event; system turns are system events, others messages."""
    sid = F.col("conv_id").cast("string")
    return canonical(
        conversations,
        harness_id=F.lit("chat"),
        session_id=sid,
        source_session_id=sid,
        seq=F.col("turn") + 1,
        kind=F.when(F.col("role") == "system", F.lit("system")).otherwise(F.lit("message")),
        role=F.col("role"),
        source_file=F.concat(F.lit("conversations/"), sid),
        source_cursor=F.concat(F.lit("line:"), (F.col("turn") + 1).cast("string")),
        text=F.nullif(F.col("text"), F.lit("")),
    )


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def log_events(events: DataFrame) -> DataFrame:
    """The event log, a user being a session; text and kind are the event type."""
    numbered = dense_seq(
        events.select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id", "event_type", "props"),
        ["session_id"],
        ["ts", "event_id"],
    )
    return canonical(
        numbered,
        harness_id=F.lit("log"),
        session_id=F.col("session_id"),
        source_session_id=F.col("session_id"),
        seq=F.col("seq"),
        kind=F.col("event_type"),
        source_event_id=F.col("event_id").cast("string"),
        source_file=F.concat(F.lit("events/"), F.col("session_id")),
        source_cursor=F.concat(F.lit("line:"), F.col("seq").cast("string")),
        timestamp=iso_micros(F.col("ts")),
        text=F.col("event_type"),
        payload_json=F.col("props"),
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """A document is a session of harness ``lang``, its lines are the events."""
    sid = F.col("doc_id").cast("string")
    lines = documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return canonical(
        lines,
        harness_id=F.col("lang"),
        session_id=sid,
        source_session_id=sid,
        seq=F.col("pos") + 1,
        kind=F.lit("message"),
        source_event_id=F.when(F.col("line") != "", F.sha2("line", 256)),
        identity_key=F.when(
            F.col("line") != "", identity_key(F.sha2("line", 256), F.lit(None).cast("string"), F.col("line"))
        ),
        source_file=F.concat(F.col("source"), F.lit("/"), sid),
        source_cursor=F.concat(F.lit("line:"), (F.col("pos") + 1).cast("string")),
        text=F.nullif(F.col("line"), F.lit("")),
    )


def whole_documents(documents: DataFrame) -> DataFrame:
    """A document is a one-event session, its identity the digest of its text."""
    sid = F.col("doc_id").cast("string")
    return canonical(
        documents,
        harness_id=F.col("lang"),
        session_id=sid,
        source_session_id=sid,
        seq=F.lit(1),
        kind=F.lit("message"),
        role=F.lit("user"),
        source_event_id=F.sha2("text", 256),
        identity_key=identity_key(F.sha2("text", 256), F.lit(None).cast("string"), F.col("text")),
        source_file=F.concat(F.col("source"), F.lit("/"), sid),
        source_cursor=F.lit("line:1"),
        text=F.nullif(F.col("text"), F.lit("")),
    )
