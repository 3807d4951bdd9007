"""Incremental upkeep of the projected tables and the overlay of local on saved evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import lookup


def source_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, change): added, changed or removed by (session_id, fingerprint)."""
    old = previous.select("session_id", F.col("fingerprint").alias("_old"))
    new = current.select("session_id", F.col("fingerprint").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("_old") != F.col("_new"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return old.join(new, "session_id", "full").select("session_id", change.alias("change"))


def upsert_projection(projected: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``projected`` with changed and removed sessions dropped and the re-projected rows of ``fresh`` added."""
    touched = changes.filter("change <> 'unchanged'").select("session_id")
    wanted = changes.filter("change in ('added', 'changed')").select("session_id")
    kept = projected.join(touched, "session_id", "left_anti")
    return kept.unionByName(fresh.join(wanted, "session_id", "left_semi").select(*projected.columns))


def overlay_saved_local(saved: DataFrame, local: DataFrame) -> DataFrame:
    """Which evidence each session shows.

    Both are (session_id, path, content, digest) rows, ``digest`` being the
    bundle's. Saved wins where every local file is a prefix of its saved file;
    else local. ``saved_version_behind`` says the shown bytes differ from saved.
    """
    s = saved.select("session_id", "path", F.col("content").alias("_saved"))
    files = local.select("session_id", "path", F.col("content").alias("_local")).join(s, ["session_id", "path"], "left")
    prefix = files.groupBy("session_id").agg(
        F.bool_and(F.coalesce(F.startswith("_saved", F.col("_local")), F.lit(False))).alias("is_prefix")
    )
    one = lambda df, name: df.groupBy("session_id").agg(F.max("digest").alias(name))
    both = one(saved, "saved_digest").join(one(local, "local_digest"), "session_id", "full").join(prefix, "session_id", "left")
    has_saved, has_local = F.col("saved_digest").isNotNull(), F.col("local_digest").isNotNull()
    from_store = has_saved & (
        ~has_local | (F.col("saved_digest") == F.col("local_digest")) | F.coalesce("is_prefix", F.lit(False))
    )
    from_store = F.coalesce(from_store, F.lit(False))
    return both.select(
        "session_id",
        F.when(from_store, F.lit("store")).otherwise(F.lit("local")).alias("source"),
        has_saved.alias("saved"),
        F.when(from_store, F.col("saved_digest")).otherwise(F.col("local_digest")).alias("revision_digest"),
        "saved_digest",
        (has_saved & ~from_store).alias("saved_version_behind"),
    )


def partial_issues(lines: DataFrame, failed: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Per session: unparseable records, failed source, changed while reading; partial if any."""
    out = lines.groupBy("session_id").agg(F.count_if(F.col("value").isNull()).alias("unparseable"))
    for name, table in (("failed", failed), ("changed", changed)):
        if table is None:
            out = out.withColumn(name, F.lit(False))
        else:
            hit = table.select("session_id", F.lit(True).alias(name)).distinct()
            out = out.join(hit, "session_id", "full").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.withColumn("unparseable", F.coalesce("unparseable", F.lit(0)))
    return out.withColumn("partial", (F.col("unparseable") > 0) | F.col("failed") | F.col("changed"))


def latest_versions(versions: DataFrame, key: str = "session_id", stamp: str = "modified_at") -> DataFrame:
    """Rows of the newest version of each source; a late older version changes nothing."""
    newest = versions.groupBy(key).agg(F.max(stamp).alias(stamp))
    return versions.join(newest, [key, stamp], "left_semi")


def secret_hits(lines: DataFrame, text: Column) -> DataFrame:
    """(session_id, source_file, source_cursor, rule_id, preview) for every rule a line breaks."""
    from lodestone.functions.secrets import preview, secret_rules

    hits = lines.withColumn("_t", text).withColumn("rule_id", F.explode(secret_rules(F.col("_t"))))
    return hits.select(
        "session_id", "source_file", "source_cursor", "rule_id", preview(F.col("_t"), F.col("rule_id")).alias("preview")
    )


def withheld_sessions(hits: DataFrame, unscanned: DataFrame | None = None) -> DataFrame:
    """Sessions withheld from acceptance: any hit, or any file that could not be scanned."""
    counted = hits.groupBy("session_id").agg(F.count("*").alias("hits"))
    if unscanned is None:
        return counted.withColumn("unscanned", F.lit(0).cast("long"))
    skipped = unscanned.groupBy("session_id").agg(F.count("*").alias("unscanned"))
    return counted.join(skipped, "session_id", "full").na.fill(0, ["hits", "unscanned"])


def touch_table(events: DataFrame) -> DataFrame:
    """One row per file touch."""
    return events.select("session_id", "seq", F.explode("file_touches").alias("t")).select("session_id", "seq", "t.*")


def events_with_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events beside their session's columns; the event side splits where a session is large."""
    extra = [c for c in sessions.columns if c == "session_id" or c not in events.columns]
    return lookup(events, sessions.select(*extra), ["session_id"], "inner")
