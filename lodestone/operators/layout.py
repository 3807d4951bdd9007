"""Result documents: flat matches, the lossless grouped form, and its inverse.

A document holds at most the rows a search shows, so one row may carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import line_text
from lodestone.operators.runs import member_seqs

_LOCATOR = "struct<sourceFile:string,sourceCursor:string,sourceEventId:string>"
GROUPS = (
    "layout string, groups array<struct<sessionId:string,harnessId:string,archiveState:string,sourceFile:string,"
    f"matches:array<struct<eventSeq:bigint,eventKind:string,role:string,timestamp:string,excerpt:string,locator:{_LOCATOR},"
    "subagentId:string,subagentType:string,memberSeqs:array<bigint>,contextSeqs:array<bigint>>>,"
    f"context:array<struct<seq:bigint,line:string,memberSeqs:array<bigint>,locator:{_LOCATOR}>>>>"
)


def quoted(value: Column) -> Column:
    """A string as JSON text, NULL for NULL."""
    text = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def _or_null(value: Column) -> Column:
    return F.coalesce(value, F.lit("null"))


def listed(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def document(fields: dict[str, Column]) -> Column:
    """A JSON object of JSON texts; NULL members are left out."""
    parts = F.array(*[F.concat(F.lit(f'"{name}":'), text) for name, text in fields.items()])
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ","), F.lit("}"))


def locator(file: Column, cursor: Column, event_id: Column) -> Column:
    """Evidence locator; an inherited file is left out, the other members never."""
    return document({"sourceFile": file, "sourceCursor": _or_null(quoted(cursor)), "sourceEventId": _or_null(quoted(event_id))})


def _numbers(values: Column) -> Column:
    return F.when(values.isNotNull(), listed(F.transform(values, lambda n: n.cast("string"))))


def _match_fields(m: dict[str, Column], where: Column) -> dict[str, Column]:
    """Members of one match; identity and citation always stand, defaults do not."""
    return {
        "eventSeq": m["seq"].cast("string"),
        "eventKind": _or_null(quoted(m["kind"])),
        "role": quoted(m["role"]),
        "timestamp": _or_null(quoted(m["timestamp"])),
        "excerpt": _or_null(quoted(m["excerpt"])),
        "locator": where,
        "subagentId": quoted(m["subagent_id"]),
        "subagentType": quoted(m["subagent_type"]),
        "memberSeqs": _numbers(m["members"]),
    }


def _head(session: Column, harness: Column, archive: Column) -> dict[str, Column]:
    return {
        "sessionId": quoted(session),
        "harnessId": quoted(harness),
        "archiveState": F.when(archive == "archived", quoted(archive)),
    }


def _context_json(c: Column, file: Column) -> Column:
    return document(
        {
            "seq": c["seq"].cast("string"),
            "line": F.when(c["line"] != "", quoted(c["line"])),
            "memberSeqs": _numbers(c["members"]),
            "locator": locator(file, c["source_cursor"], c["source_event_id"]),
        }
    )


def result_rows(shown: DataFrame, order: str, context: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Shown matches with their context entries, in display ``order`` (an integer column).

    ``context`` is (session_id, match_seq, seq) of :func:`context_window`.
    """
    rows = shown.withColumn("_ord", F.col(order)).withColumn("members", member_seqs(F.col("seq"), F.col("run_last_seq")))
    if "archive_state" not in rows.columns:
        rows = rows.withColumn("archive_state", F.lit("active"))
    if context is None:
        return rows.withColumn("context", F.lit(None))
    entries = context.join(events, ["session_id", "seq"]).select(
        "session_id",
        "match_seq",
        F.struct(
            "seq",
            F.coalesce(line_text(F.col("text")), F.lit("")).alias("line"),
            member_seqs(F.col("run_first_seq"), F.col("run_last_seq")).alias("members"),
            "source_file",
            "source_cursor",
            "source_event_id",
        ).alias("e"),
    )
    # at most 2n entries around each of the shown matches
    around = entries.groupBy("session_id", F.col("match_seq").alias("seq")).agg(
        F.array_sort(F.collect_list("e")).alias("context")
    )
    empty = around.schema["context"].dataType
    return rows.join(around, ["session_id", "seq"], "left").withColumn(
        "context", F.coalesce("context", F.array().cast(empty))
    )


def flat_json(rows: DataFrame) -> DataFrame:
    """(_ord, json) of the flat layout."""
    m = {c: F.col(c) for c in ("seq", "kind", "role", "timestamp", "excerpt", "subagent_id", "subagent_type", "members")}
    where = locator(quoted(F.col("source_file")), F.col("source_cursor"), F.col("source_event_id"))
    fields = _head(F.col("session_id"), F.col("harness_id"), F.col("archive_state")) | _match_fields(m, where)
    if str(rows.schema["context"].dataType.typeName()) == "array":
        fields["context"] = F.when(
            F.col("context").isNotNull(),
            listed(F.transform("context", lambda c: _context_json(c, quoted(c["source_file"])))),
        )
    return rows.select("_ord", document(fields).alias("json"))


def grouped_json(rows: DataFrame) -> DataFrame:
    """(_ord, json) per session; files and identity are stated once, context entries shared."""
    has_context = str(rows.schema["context"].dataType.typeName()) == "array"
    cols = ["_ord", "seq", "kind", "role", "timestamp", "excerpt", "subagent_id", "subagent_type", "members",
            "source_file", "source_cursor", "source_event_id"] + (["context"] if has_context else [])
    groups = rows.groupBy("session_id").agg(
        F.first("harness_id").alias("harness_id"),
        F.first("archive_state").alias("archive_state"),
        F.array_sort(F.collect_list(F.struct(*cols))).alias("ms"),
    )
    groups = groups.withColumn("file", F.col("ms")[0]["source_file"])
    inherit = lambda f: F.when(f != F.col("file"), quoted(f))

    def match(x: Column) -> Column:
        fields = _match_fields({c: x[c] for c in cols}, locator(inherit(x["source_file"]), x["source_cursor"], x["source_event_id"]))
        if has_context:
            fields["contextSeqs"] = _numbers(F.transform(x["context"], lambda c: c["seq"]))
        return document(fields)

    fields = _head(F.col("session_id"), F.col("harness_id"), F.col("archive_state"))
    fields["sourceFile"] = quoted(F.col("file"))
    fields["matches"] = listed(F.transform("ms", match))
    if has_context:
        shared = F.array_sort(F.array_distinct(F.flatten(F.transform("ms", lambda x: x["context"]))))
        fields["context"] = listed(F.transform(shared, lambda c: _context_json(c, inherit(c["source_file"]))))
    return groups.select(F.col("ms")[0]["_ord"].alias("_ord"), document(fields).alias("json"))


def _whole(parts: DataFrame, name: str, extra: dict[str, Column]) -> DataFrame:
    inOrder = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "json"))), lambda p: p["json"])
    return parts.agg(listed(inOrder).alias("l")).select(document(extra | {name: F.col("l")}).alias("doc"))


def result_documents(rows: DataFrame) -> DataFrame:
    """One row: both documents, their UTF-8 bytes, and the smaller (flat unless grouped is smaller)."""
    flat = _whole(flat_json(rows), "matches", {})
    grouped = _whole(grouped_json(rows), "groups", {"layout": quoted(F.lit("grouped"))})
    both = flat.select(F.col("doc").alias("flat"), grouped.scalar().alias("grouped"))
    size = lambda c: F.octet_length(c)
    smaller = size("grouped") < size("flat")
    return both.select(
        "flat",
        "grouped",
        size("flat").alias("flat_bytes"),
        size("grouped").alias("grouped_bytes"),
        F.when(smaller, F.lit("grouped")).otherwise(F.lit("flat")).alias("layout"),
        F.when(smaller, F.col("grouped")).otherwise(F.col("flat")).alias("document"),
    )


def expand_groups(documents: DataFrame, column: str = "grouped") -> DataFrame:
    """(pos, json) of the flat layout rebuilt from a grouped document, in order."""
    g = documents.select(F.posexplode(F.from_json(column, GROUPS)["groups"]).alias("gpos", "g"))
    m = g.select("gpos", "g", F.posexplode("g.matches").alias("mpos", "m"))
    file = lambda loc: quoted(F.coalesce(loc["sourceFile"], F.col("g.sourceFile")))
    where = locator(file(F.col("m.locator")), F.col("m.locator.sourceCursor"), F.col("m.locator.sourceEventId"))
    names = {"seq": "eventSeq", "kind": "eventKind", "role": "role", "timestamp": "timestamp", "excerpt": "excerpt",
             "subagent_id": "subagentId", "subagent_type": "subagentType", "members": "memberSeqs"}
    fields = _head(F.col("g.sessionId"), F.col("g.harnessId"), F.col("g.archiveState"))
    fields |= _match_fields({k: F.col(f"m.{v}") for k, v in names.items()}, where)

    def entry(c: Column) -> Column:
        return document(
            {
                "seq": c["seq"].cast("string"),
                "line": quoted(c["line"]),
                "memberSeqs": _numbers(c["memberSeqs"]),
                "locator": locator(file(c["locator"]), c["locator"]["sourceCursor"], c["locator"]["sourceEventId"]),
            }
        )

    wanted = F.transform(
        F.col("m.contextSeqs"), lambda s: F.filter(F.col("g.context"), lambda c: c["seq"] == s)[0]
    )
    fields["context"] = F.when(F.col("m.contextSeqs").isNotNull(), listed(F.transform(wanted, entry)))
    return m.select("gpos", "mpos", document(fields).alias("json")).orderBy("gpos", "mpos")
