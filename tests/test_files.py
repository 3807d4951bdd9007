"""Fingerprints of files read whole and in ranges."""

from __future__ import annotations

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from lodestone.sources.jsonl import fingerprint_files, joined_parts, read_jsonl


@pytest.mark.parametrize("whole", [0, 40, 1 << 30])
def test_fingerprints_do_not_depend_on_how_files_are_read(spark, tmp_path, whole):
    rng = random.Random(1)
    contents = {
        "empty": b"", "break": b"\n", "breaks": b"\n\n\n", "line": b"one line", "ended": b"one line\n", "two": b"a\nb\n\nc", "crlf": b"a\r\nb\r\n",
        "bytes": bytes(rng.randrange(256) for _ in range(5000)), "mark": b"\xef\xbb\xbfafter a mark\nx", "marked end": b"\xef\xbb\xbf\n", "mark alone": b"\xef\xbb\xbf",
        "bad": b"\xff\xfe\n\x80\n", "long": b"".join(b"%d " % i * 50 + b"\n" for i in range(9000)), "sp ace+é": b"x\ny",
    }
    for name, raw in contents.items():
        (tmp_path / f"{name}.jsonl").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        got = {r.file.rsplit("/", 1)[1]: (r.size, r.sha256) for r in fingerprint_files(spark, str(tmp_path), "*.jsonl", whole).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"{n}.jsonl": (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}


def test_compressed_files_are_refused_by_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(gzip.compress(b"line\n" * 100))
    with pytest.raises(Exception, match="cannot be digested by lines"):
        fingerprint_files(spark, str(tmp_path), whole_bytes=0).collect()
    assert fingerprint_files(spark, str(tmp_path)).count() == 1


def test_parts_of_a_transcript_are_one(spark, tmp_path):
    """Lines are numbered through the parts that tasks wrote of one file."""
    for conv, part, names in (("a", 0, "xy"), ("a", 1, "z"), ("a", 2, "vw"), ("b", 1, "q")):
        folder = tmp_path / f"conv={conv}"
        folder.mkdir(exist_ok=True)
        (folder / f"part-0000{part}-u.txt").write_text("".join(f'{{"uuid":"{n}"}}\n' for n in names))
    got = joined_parts(read_jsonl(spark, str(tmp_path), "*.txt")).select("file", "line", F.try_variant_get("value", "$.uuid", "string").alias("u"))
    assert sorted((r.file.split("conv=")[1][0], r.line, r.u) for r in got.collect()) == [
        ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("a", 4, "v"), ("a", 5, "w"), ("b", 1, "q")
    ]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.txt").write_text("x\n")
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    assert fingerprint_files(spark, str(tmp_path), "*.txt").select("sha256").distinct().count() == 1
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) <= 64
