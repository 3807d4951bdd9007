"""Identities and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_id(harness: Column, source_session_id: Column) -> Column:
    return F.concat(
        F.lit("ses_"), F.substring(F.sha2(F.concat_ws("\n", harness, source_session_id), 256), 1, 32)
    )


def identity_key(source_event_id: Column, timestamp: Column, text: Column) -> Column:
    """Shared event identity; NULL without a source event id."""
    framed = F.to_json(F.array(source_event_id, timestamp, text))
    return F.when(source_event_id.isNotNull(), F.substring(F.sha2(framed, 256), 1, 32))


def candidate_key(meta_json: Column) -> Column:
    return F.substring(F.sha2(meta_json, 256), 1, 16)


def revision_digest(files: Column) -> Column:
    """Digest of an ``array<struct<path,size,sha256>>``, independent of its order."""
    lines = F.transform(
        F.array_sort(files),
        lambda f: F.concat_ws("\n", f["path"], f["size"].cast("string"), f["sha256"]),
    )
    return F.sha2(F.array_join(lines, "\n---\n"), 256)
