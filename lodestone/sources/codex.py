"""Rollouts of the ``codex`` harness as canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.digests import identity_key, session_id
from lodestone.functions.json import items_at, kind_of, object_at, text_at
from lodestone.functions.paths import TRANSCRIPT, basename
from lodestone.functions.secrets import session_label_text
from lodestone.functions.text import SPACE
from lodestone.operators.mirror import mirrored
from lodestone.session import stage
from lodestone.sources.claude import first_candidates, touch
from lodestone.sources.jsonl import event_seq, read_jsonl
from lodestone.sources.tables import canonical

HARNESS = "codex"
# Record types of the format and the tags of its own preamble.
LIFECYCLE_RECORDS = ("session_meta", "turn_context", "world_state", "compacted", "inter_agent_communication_metadata")
LIFECYCLE_MESSAGES = (
    "task_started",
    "task_complete",
    "thread_settings_applied",
    "turn_aborted",
    "context_compacted",
    "thread_rolled_back",
    "sub_agent_activity",
    "token_count",
)
PREAMBLE_TAGS = ("<environment_context>", "<user_instructions>")
_UUID = "(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def scan(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root.rstrip('/')}/sessions").withColumn("bundle_path", F.lit(TRANSCRIPT))


# ---- record rules ----


def content_text(value: Column, path: str) -> Column:
    items = items_at(value, path)
    texts = F.filter(F.transform(items, lambda i: text_at(i, "$.text")), lambda t: t.isNotNull())
    return F.nullif(F.array_join(texts, "\n"), F.lit(""))


def command_text(payload: Column) -> Column:
    """A command string, or the strings of a command list joined by blanks."""
    words = F.filter(items_at(payload, "$.command"), lambda c: F.schema_of_variant(c) == "STRING")
    listed = F.array_join(F.transform(words, lambda c: F.try_variant_get(c, "$", "string")), " ")
    return F.coalesce(text_at(payload, "$.command"), F.when(F.size(words) > 0, listed))


def injected_preamble(text: Column) -> Column:
    head = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+", "")
    out = F.lit(False)
    for tag in PREAMBLE_TAGS:
        out = out | F.startswith(head, F.lit(tag))
    return out


def patch_touches(payload: Column) -> Column:
    """Touches of a patch, in path order; the kind is a ``type`` or a nested key."""
    changes = F.try_variant_get(object_at(payload, "$.changes"), "$", "map<string,variant>")

    def operation(change: Column) -> Column:
        kind = text_at(change, "$.type")
        is_kind = lambda k: F.coalesce(kind == k, F.lit(False)) | kind_of(change, f"$.{k}").isNotNull()
        moved = F.when(kind == "update", text_at(change, "$.move_path")).otherwise(
            text_at(change, "$.update.move_path")
        )
        return (
            F.when(~F.startswith(F.schema_of_variant(change), F.lit("OBJECT")), F.lit(None))
            .when(is_kind("add"), F.lit("created"))
            .when(is_kind("delete"), F.lit("deleted"))
            .when(is_kind("update"), F.when(moved.isNotNull(), F.lit("renamed")).otherwise(F.lit("modified")))
        )

    touches = F.transform(F.map_entries(changes), lambda e: touch(operation(e["value"]), e["key"]))
    return F.coalesce(
        F.filter(touches, lambda t: t["operation"].isNotNull()),
        F.array().cast("array<struct<operation:string,source_path:string,normalized_path:string>>"),
    )


def opened(lines: DataFrame) -> DataFrame:
    """Lines with their payload and the two type names as columns, read once."""
    return (
        lines.withColumn("payload", object_at(F.col("value"), "$.payload"))
        .withColumn("record", text_at(F.col("value"), "$.type"))
        .withColumn("item", text_at(F.col("payload"), "$.type"))
    )


def record_columns() -> dict[str, Column]:
    """Kind, role, text, id, tools, touches and arguments of an opened record."""
    value, payload = F.col("value"), F.col("payload")
    record, item = F.col("record"), F.col("item")
    response = (record == "response_item") & payload.isNotNull()
    message = (record == "event_msg") & payload.isNotNull()
    is_item = lambda *t: response & item.isin(*t)
    is_msg = lambda *t: message & item.isin(*t)
    call = is_item("function_call", "custom_tool_call")
    kind = (
        F.when(record.isin(*LIFECYCLE_RECORDS), F.lit("lifecycle"))
        .when(is_item("message", "agent_message", "reasoning"), F.lit("message"))
        .when(call, F.lit("tool_call"))
        .when(is_item("function_call_output", "custom_tool_call_output"), F.lit("tool_result"))
        .when(is_msg("user_message", "agent_message", "agent_reasoning"), F.lit("message"))
        .when(is_msg("patch_apply_begin", "exec_command_begin"), F.lit("tool_call"))
        .when(is_msg("patch_apply_end", "web_search_end", "exec_command_end"), F.lit("tool_result"))
        .when(is_msg(*LIFECYCLE_MESSAGES), F.lit("lifecycle"))
        .otherwise(F.lit("unknown"))
    )
    role = (
        F.when(is_item("message"), text_at(payload, "$.role"))
        .when(call | is_item("agent_message", "reasoning"), F.lit("assistant"))
        .when(is_msg("user_message"), F.lit("user"))
        .when(
            is_msg("agent_message", "agent_reasoning", "patch_apply_begin", "patch_apply_end", "exec_command_begin"),
            F.lit("assistant"),
        )
    )
    text = (
        F.when(is_item("message", "agent_message"), content_text(payload, "$.content"))
        .when(call, text_at(payload, "$.name"))
        .when(
            is_item("function_call_output", "custom_tool_call_output"),
            F.coalesce(text_at(payload, "$.output"), content_text(payload, "$.output")),
        )
        .when(is_msg("user_message", "agent_message"), text_at(payload, "$.message"))
        .when(is_msg("agent_reasoning"), text_at(payload, "$.text"))
        .when(is_msg("patch_apply_begin", "patch_apply_end"), F.lit("apply_patch"))
        .when(is_msg("web_search_end"), text_at(payload, "$.query"))
        .when(is_msg("exec_command_begin"), command_text(payload))
    )
    tools = (
        F.when(call, F.filter(F.array(text_at(payload, "$.name")), lambda n: n.isNotNull()))
        .when(is_msg("patch_apply_begin"), F.array(F.lit("apply_patch")))
        .when(is_msg("exec_command_begin"), F.array(F.lit("shell")))
        .otherwise(F.array().cast("array<string>"))
    )
    touches = F.when(is_msg("patch_apply_begin", "patch_apply_end"), patch_touches(payload)).otherwise(
        F.array().cast("array<struct<operation:string,source_path:string,normalized_path:string>>")
    )
    given = lambda path: F.to_json(F.struct(F.try_variant_get(payload, path, "variant").alias("arguments")))
    arguments = F.when(is_item("function_call"), given("$.arguments")).when(
        is_item("custom_tool_call"), given("$.input")
    )
    return {
        "kind": F.when(value.isNull(), F.lit("unknown")).otherwise(kind),
        "role": role,
        "text": text,
        "source_event_id": F.when(response, text_at(payload, "$.id")),
        "timestamp": text_at(value, "$.timestamp"),
        "tool_names": tools,
        "file_touches": touches,
        "payload_json": arguments,
        "is_response_user": F.coalesce(
            is_item("message") & (text_at(payload, "$.role") == "user") & text.isNotNull(), F.lit(False)
        ),
        "is_user_message": F.coalesce(is_msg("user_message"), F.lit(False)),
    }


def rollout_meta(lines: DataFrame) -> DataFrame:
    """Facts of each file's first session_meta record."""
    value = F.col("value")
    payload = object_at(value, "$.payload")
    spawned = (text_at(payload, "$.thread_source") == "subagent") | (
        object_at(payload, "$.source").isNotNull() & kind_of(payload, "$.source.subagent").isNotNull()
    )
    spawned = F.coalesce(spawned, F.lit(False))
    facts = F.struct(
        "line",
        text_at(payload, "$.id").alias("id"),
        text_at(payload, "$.cwd").alias("opening_path"),
        text_at(payload, "$.resumed_from").alias("continuation_parent"),
        F.coalesce(text_at(value, "$.timestamp"), text_at(payload, "$.timestamp")).alias("session_time"),
        spawned.alias("subagent_origin"),
        F.when(
            spawned, F.coalesce(text_at(payload, "$.source.subagent"), text_at(payload, "$.source.subagent.other"))
        ).alias("subagent_kind"),
        F.when(spawned, text_at(payload, "$.parent_thread_id")).alias("subagent_parent"),
    )
    return (
        lines.groupBy("file")
        .agg(F.min(F.when(text_at(value, "$.type") == "session_meta", facts)).alias("m"))
        .select(
            "file",
            F.coalesce("m.id", F.nullif(F.regexp_extract(basename(F.col("file")), _UUID, 1), F.lit(""))).alias(
                "source_session_id"
            ),
            "m.opening_path",
            "m.continuation_parent",
            "m.session_time",
            F.coalesce("m.subagent_origin", F.lit(False)).alias("subagent_origin"),
            "m.subagent_kind",
            "m.subagent_parent",
        )
        .filter("source_session_id is not null")
    )


def normalize(lines: DataFrame) -> DataFrame:
    """Canonical events of scanned rollouts.

    A user-role response item is the user's only if the rollout also reports it
    as a user message; rollouts without such reports fall back to the preamble
    tags, and in a subagent's rollout the harness speaks for the user.
    """
    meta = rollout_meta(lines)
    located = lines.join(meta.select("file", "source_session_id", "subagent_origin"), "file").withColumn(
        "session_id", session_id(F.lit(HARNESS), F.col("source_session_id"))
    )
    cols = record_columns()
    rows = opened(event_seq(located, ["bundle_path"])).select(
        "session_id", "source_session_id", "subagent_origin", "bundle_path", "line", "seq",
        *[c.alias(n) for n, c in cols.items()],
    )
    # read four times below; records are parsed once
    rows = stage(rows, "rollout")
    asked = rows.filter("is_response_user").select("session_id", "seq", "timestamp", "text")
    said = rows.filter("is_user_message and text is not null").select("session_id", "timestamp", "text")
    echo = mirrored(asked, said).select("session_id", "seq", "mirrored")
    talks = said.groupBy("session_id").agg(F.lit(True).alias("reports"))
    judged = rows.join(echo, ["session_id", "seq"], "left").join(talks, "session_id", "left")
    injected = F.when(
        F.col("is_response_user"),
        F.col("subagent_origin")
        | F.when(F.coalesce("reports", F.lit(False)), ~F.col("mirrored")).otherwise(injected_preamble(F.col("text"))),
    ).otherwise(F.col("is_user_message") & F.col("subagent_origin"))
    return canonical(
        judged,
        harness_id=F.lit(HARNESS),
        session_id=F.col("session_id"),
        source_session_id=F.col("source_session_id"),
        seq=F.col("seq"),
        source_file=F.col("bundle_path"),
        source_cursor=F.concat(F.lit("line:"), F.col("line").cast("string")),
        identity_key=identity_key(F.col("source_event_id"), F.col("timestamp"), F.col("text")),
        harness_injected=injected,
        **{c: F.col(c) for c in ("kind", "role", "text", "source_event_id", "timestamp", "tool_names", "file_touches", "payload_json")},
    )


def candidates(lines: DataFrame) -> DataFrame:
    """One discovered session per rollout with an identity."""
    cols = record_columns()
    rows = opened(lines).select("file", "line", *[cols[c].alias(c) for c in ("text", "is_response_user", "is_user_message")])
    reported = F.when(F.col("is_user_message"), F.col("text"))
    legacy = F.when(F.col("is_response_user") & ~injected_preamble(F.col("text")), F.col("text"))
    first = lambda c, name: F.min_by(c, F.when(c.isNotNull(), F.col("line"))).alias(name)
    said = rows.groupBy("file").agg(first(reported, "reported"), first(legacy, "legacy"))
    found = rollout_meta(lines).join(said, "file", "left")
    label = F.when(~F.col("subagent_origin"), F.coalesce("reported", "legacy"))
    return first_candidates(
        found.select(
            session_id(F.lit(HARNESS), F.col("source_session_id")).alias("candidate_id"),
            F.lit(HARNESS).alias("harness_id"),
            "source_session_id",
            "file",
            "opening_path",
            "continuation_parent",
            "session_time",
            session_label_text(label).alias("label"),
            "subagent_origin",
            "subagent_kind",
            "subagent_parent",
        )
    )
