"""Transcripts of the ``claude-code`` harness as canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.digests import identity_key, session_id
from lodestone.functions.json import items_at, object_at, text_at, true_at
from lodestone.functions.paths import SUBAGENT_DIR, TRANSCRIPT, basename, normalized_path, sidecar_path
from lodestone.functions.secrets import session_label_text
from lodestone.sources.jsonl import event_seq, plain_path, read_jsonl
from lodestone.sources.tables import canonical

HARNESS = "claude-code"
# Record types of the format.
SYSTEM_TYPES = ("system", "attachment")
LIFECYCLE_TYPES = ("summary", "file-history-snapshot", "last-prompt", "custom-title", "ai-title", "queue-operation")
TITLES = {
    "custom-title": ("customTitle", "custom_title"),
    "ai-title": ("aiTitle", "ai_title"),
    "summary": ("summary", "summary"),
}
_MAIN = r"/projects/[^/]+/([^/]+)\.jsonl$"
_SUB = r"/projects/[^/]+/([^/]+)/subagents/(agent-[^/]*)\.jsonl$"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Main and subagent transcripts: lines with ``stem``, ``bundle_path`` and ``is_sub``."""
    lines = read_jsonl(spark, f"{root.rstrip('/')}/projects")
    sub = F.regexp_extract("file", _SUB, 1)
    main = F.regexp_extract("file", _MAIN, 1)
    is_sub = sub != ""
    return (
        lines.withColumn("is_sub", is_sub)
        .withColumn("stem", F.when(is_sub, sub).otherwise(main))
        .withColumn(
            "bundle_path",
            F.when(is_sub, F.concat(F.lit(SUBAGENT_DIR), basename(F.col("file")))).otherwise(F.lit(TRANSCRIPT)),
        )
        .withColumn("folder", F.regexp_extract("file", r"/projects/([^/]+)/", 1))
        .filter("stem <> ''")
    )


def scan_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(folder, stem, bundle_path of the sidecar, subagent_type)."""
    reader = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "agent-*.meta.json")
    )
    docs = reader.text(f"{root.rstrip('/')}/projects").select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.try_parse_json("value").alias("doc")
    )
    return docs.select(
        F.regexp_extract("file", r"/projects/([^/]+)/", 1).alias("folder"),
        F.regexp_extract("file", r"/([^/]+)/subagents/[^/]+$", 1).alias("stem"),
        F.concat(F.lit(SUBAGENT_DIR), basename(F.col("file"))).alias("sidecar"),
        text_at(F.col("doc"), "$.agentType").alias("subagent_type"),
    )


# ---- record rules; ``value`` is one transcript record, ``message`` its message ----


def blocks(message: Column) -> Column:
    return F.coalesce(items_at(message, "$.content"), F.array().cast("array<variant>"))


def has_block(message: Column, kind: str) -> Column:
    return F.exists(blocks(message), lambda b: F.coalesce(text_at(b, "$.type") == kind, F.lit(False)))


def record_kind(value: Column, message: Column) -> Column:
    kind = text_at(value, "$.type")
    return (
        F.when(kind == "user", F.when(has_block(message, "tool_result"), F.lit("tool_result")).otherwise(F.lit("message")))
        .when(kind == "assistant", F.when(has_block(message, "tool_use"), F.lit("tool_call")).otherwise(F.lit("message")))
        .when(kind.isin(*SYSTEM_TYPES), F.lit("system"))
        .when(kind.isin(*LIFECYCLE_TYPES), F.lit("lifecycle"))
        .otherwise(F.lit("unknown"))
    )


def message_text(message: Column) -> Column:
    """String content, else the texts and string tool results of its blocks, one per line."""

    def texts(block: Column) -> Column:
        result = F.when(text_at(block, "$.type") == "tool_result", text_at(block, "$.content"))
        return F.filter(F.array(text_at(block, "$.text"), result), lambda t: t.isNotNull())

    joined = F.nullif(F.array_join(F.flatten(F.transform(blocks(message), texts)), "\n"), F.lit(""))
    return F.coalesce(text_at(message, "$.content"), joined)


def title(value: Column) -> tuple[Column, Column]:
    """Title text and label source of a title record."""
    kind = text_at(value, "$.type")
    text = F.coalesce(*[F.when(kind == t, text_at(value, f"$.{field}")) for t, (field, _) in TITLES.items()])
    source = F.coalesce(*[F.when(kind == t, F.lit(label)) for t, (_, label) in TITLES.items()])
    return text, F.when(text.isNotNull(), source)


def tool_names(message: Column) -> Column:
    uses = F.filter(blocks(message), lambda b: text_at(b, "$.type") == "tool_use")
    return F.filter(F.transform(uses, lambda b: text_at(b, "$.name")), lambda n: n.isNotNull())


def touch(operation: Column, path: Column) -> Column:
    return F.struct(
        operation.alias("operation"), path.alias("source_path"), normalized_path(path).alias("normalized_path")
    )


def file_touches(value: Column, message: Column) -> Column:
    """Reads of the Read tool, then the file a tool result says it wrote."""
    reads = F.transform(
        F.filter(
            blocks(message),
            lambda b: (text_at(b, "$.type") == "tool_use")
            & (text_at(b, "$.name") == "Read")
            & text_at(b, "$.input.file_path").isNotNull(),
        ),
        lambda b: touch(F.lit("read"), text_at(b, "$.input.file_path")),
    )
    written = text_at(value, "$.toolUseResult.filePath")
    how = F.when(text_at(value, "$.toolUseResult.type") == "create", F.lit("created")).otherwise(F.lit("modified"))
    return F.concat(reads, F.filter(F.array(touch(how, written)), lambda t: t["source_path"].isNotNull()))


def inline_subagent(value: Column) -> Column:
    """Agent of a sidechain record in a main transcript; '' where it is not named."""
    return F.when(true_at(value, "$.isSidechain"), F.coalesce(text_at(value, "$.agentId"), F.lit("")))


def normalize(lines: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Canonical events of scanned lines.

    The session is the one its main transcript names, or its file stem.
    """
    value = F.col("value")
    named = (
        lines.filter(~F.col("is_sub"))
        .groupBy("folder", "stem")
        .agg(F.min_by(text_at(value, "$.sessionId"), F.when(text_at(value, "$.sessionId").isNotNull(), F.col("line"))).alias("_named"))
    )
    located = lines.join(named, ["folder", "stem"], "left").withColumn(
        "source_session_id", F.coalesce("_named", "stem")
    )
    located = located.withColumn("session_id", session_id(F.lit(HARNESS), F.col("source_session_id")))
    if sidecars is not None:
        located = located.withColumn("sidecar", F.when(F.col("is_sub"), sidecar_path(F.col("bundle_path")))).join(
            sidecars, ["folder", "stem", "sidecar"], "left"
        )
    else:
        located = located.withColumn("subagent_type", F.lit(None).cast("string"))
    numbered = event_seq(located, ["is_sub", "bundle_path"]).withColumn("message", object_at(value, "$.message"))
    message = F.col("message")
    title_text, label_source = title(value)
    agent = F.when(
        F.col("is_sub"), F.regexp_extract("file", r"/agent-([^/]*)\.jsonl$", 1)
    ).otherwise(inline_subagent(value))
    numbered = numbered.withColumn("_kind", F.when(value.isNull(), F.lit("unknown")).otherwise(record_kind(value, message)))
    kind = F.col("_kind")
    user = text_at(value, "$.type") == "user"
    source_event_id, stamp = text_at(value, "$.uuid"), text_at(value, "$.timestamp")
    text = F.coalesce(title_text, message_text(message))
    # records that did not parse carry only their place
    whole = value.isNotNull()
    return canonical(
        numbered,
        harness_id=F.lit(HARNESS),
        session_id=F.col("session_id"),
        source_session_id=F.col("source_session_id"),
        seq=F.col("seq"),
        kind=kind,
        role=text_at(message, "$.role"),
        source_event_id=source_event_id,
        identity_key=identity_key(source_event_id, stamp, text),
        source_file=F.col("bundle_path"),
        source_cursor=F.concat(F.lit("line:"), F.col("line").cast("string")),
        timestamp=stamp,
        text=text,
        tool_names=F.when(kind == "tool_call", tool_names(message)).otherwise(F.array().cast("array<string>")),
        file_touches=F.when(whole, file_touches(value, message)).otherwise(
            F.array().cast("array<struct<operation:string,source_path:string,normalized_path:string>>")
        ),
        subagent_id=F.when(whole, agent),
        subagent_type=F.when(whole, F.col("subagent_type")),
        harness_injected=F.coalesce(user & (agent.isNotNull() | true_at(value, "$.isMeta")), F.lit(False)),
        label_source=label_source,
    )


def candidates(lines: DataFrame) -> DataFrame:
    """One discovered session per main transcript: identity, opening path, parent, time, label."""
    value, line = F.col("value"), F.col("line")
    message = object_at(value, "$.message")
    spoken = F.when(
        (text_at(value, "$.type") == "user") & ~true_at(value, "$.isMeta") & ~has_block(message, "tool_result"),
        message_text(message),
    )
    first = lambda c, name: F.min_by(c, F.when(c.isNotNull(), line)).alias(name)
    last = lambda c, name: F.max_by(c, F.when(c.isNotNull(), line)).alias(name)
    titled = lambda t: F.when(text_at(value, "$.type") == t, text_at(value, f"$.{TITLES[t][0]}"))
    facts = (
        lines.filter(~F.col("is_sub"))
        .groupBy("file", "stem")
        .agg(
            first(text_at(value, "$.sessionId"), "named"),
            first(text_at(value, "$.cwd"), "opening_path"),
            first(text_at(value, "$.parentSessionId"), "continuation_parent"),
            first(text_at(value, "$.timestamp"), "session_time"),
            last(titled("custom-title"), "custom_title"),
            last(titled("ai-title"), "ai_title"),
            last(titled("summary"), "summary"),
            first(spoken, "spoken"),
        )
    )
    source = F.coalesce("named", "stem")
    found = facts.select(
        session_id(F.lit(HARNESS), source).alias("candidate_id"),
        F.lit(HARNESS).alias("harness_id"),
        source.alias("source_session_id"),
        "file",
        "opening_path",
        "continuation_parent",
        "session_time",
        session_label_text(F.coalesce("custom_title", "ai_title", "summary", "spoken")).alias("label"),
    )
    return first_candidates(found)


def first_candidates(found: DataFrame) -> DataFrame:
    """One row per candidate id: the first in discovery (path) order."""
    rest = [c for c in found.columns if c not in ("candidate_id", "file")]
    return (
        found.groupBy("candidate_id")
        .agg(F.min(F.struct("file", *rest)).alias("_f"))
        .select("candidate_id", "_f.*")
    )
