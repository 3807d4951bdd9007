"""Path scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: where subagent transcripts sit in a bundle.
SUBAGENT_DIR = "source/subagents/"
TRANSCRIPT = "source/transcript.jsonl"


def normalized_path(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffixes(path: Column) -> Column:
    """Every run of whole trailing segments, the path itself first."""
    segs = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(segs)),
        lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "/"),
    )


def path_ancestors(path: Column) -> Column:
    """The path and every directory above it, without trailing slashes."""
    clean = F.when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise(path)
    segs = F.split(clean, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(segs)),
        lambda i: F.when(
            (i == 1) & F.startswith(clean, F.lit("/")), F.lit("/")
        ).otherwise(F.array_join(F.slice(segs, F.lit(1), i), "/")),
    )


def is_subagent_transcript(path: Column) -> Column:
    return F.startswith(path, F.lit(SUBAGENT_DIR)) & F.endswith(path, F.lit(".jsonl"))


def subagent_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(basename(path), r"\.jsonl$", ""), "^agent-", "")


def sidecar_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.jsonl$", ".meta.json")


def short_id(agent: Column) -> Column:
    return F.split_part(agent, F.lit("-"), F.lit(1))


def file_matches(source: Column, normalized: Column, wanted: str) -> Column:
    """Equal to, or whole trailing segments of, either path; nothing is a wildcard."""
    tail = "/" + wanted
    hit = lambda p: (p == F.lit(wanted)) | F.endswith(p, F.lit(tail))
    return F.coalesce(hit(source), F.lit(False)) | F.coalesce(hit(normalized), F.lit(False))
