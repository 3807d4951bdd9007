import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators.runs import adjacent_runs
from lodestone.operators.sessions import session_labels, session_summary
from lodestone.sources import claude, codex
from lodestone.sources.jsonl import fingerprint_files, read_jsonl, read_lines, revisions

SID = "11111111-2222-3333-4444-555555555555"


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n")


def test_lines_keep_numbers_across_splits(spark, tmp_path):
    rows = [json.dumps({"n": i}) if i % 3 else "" for i in range(1, 4001)]
    write(tmp_path / "a.jsonl", rows)
    write(tmp_path / "b.jsonl", ["{}"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_jsonl(spark, str(tmp_path))
        assert read_lines(spark, str(tmp_path)).select("block").distinct().count() > 3
        got = {
            (r.file.split("/")[-1], r.line, r.n)
            for r in lines.select("file", "line", F.try_variant_get("value", "$.n", "long").alias("n")).collect()
        }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("a.jsonl", i, i) for i in range(1, 4001) if i % 3} | {("b.jsonl", 1, None)}
    assert got == want


@pytest.mark.parametrize(
    "raw,ok",
    [
        ('{"a":1}', True),
        ('  {"a":1}\r', True),
        ('{"a":1} x', False),
        ('{"a":1} {"b":2}', False),
        ('{"a":1},{"b":2}', False),
        ('{"a":1}] x', False),
        ('{"a":1}} x', False),
        ('{"a":[{"b":1}]}', True),
        ("[1]", False),
        ("5", False),
        ("this is not json", False),
    ],
)
def test_only_whole_objects_parse(spark, raw, ok):
    from lodestone.functions.json import json_object

    row = spark.createDataFrame([(raw,)], "raw string").select(json_object(F.col("raw")).isNotNull().alias("ok"))
    assert row.first().ok is ok


def test_repeated_key_keeps_the_last(spark):
    from lodestone.functions.json import json_object, text_at

    df = spark.createDataFrame([('{"a":"x","a":"y","n":5,"e":""}',)], "raw string")
    v = json_object(F.col("raw"))
    row = df.select(text_at(v, "$.a").alias("a"), text_at(v, "$.n").alias("n"), text_at(v, "$.e").alias("e")).first()
    assert (row.a, row.n, row.e) == ("y", None, None)


def claude_session(tmp_path):
    write(
        tmp_path / "projects" / "-w" / f"{SID}.jsonl",
        [
            {"type": "user", "uuid": "u1", "sessionId": SID, "cwd": "/w", "timestamp": "2026-07-15T10:00:00Z",
             "message": {"role": "user", "content": "fix  the\nlease"}},
            {"type": "assistant", "uuid": "u2", "timestamp": "2026-07-15T10:00:05Z",
             "message": {"role": "assistant", "content": [
                 {"type": "text", "text": "looking"},
                 {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/w/a.ts"}},
                 {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "cat /etc/x"}}, 5]}},
            {"type": "user", "uuid": "u3", "timestamp": "2026-07-15T10:00:09Z",
             "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]},
             "toolUseResult": {"type": "update", "filePath": "src/a.ts"}},
            "this is not json",
            {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
            {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "side"}},
            {"type": "ai-title", "aiTitle": "Old title"},
            {"type": "ai-title", "aiTitle": "New title"},
            {"type": "brand-new", "uuid": "u9"},
        ],
    )
    sub = tmp_path / "projects" / "-w" / SID / "subagents"
    write(sub / "agent-a7.jsonl", [
        {"type": "user", "uuid": "s1", "timestamp": "2026-07-15T09:59:00Z", "message": {"role": "user", "content": "go"}},
        {"type": "user", "uuid": "s1", "timestamp": "2026-07-15T09:59:00Z", "message": {"role": "user", "content": "go"}},
    ])
    (sub / "agent-a7.meta.json").write_text('{"agentType": "Explore"}')
    return str(tmp_path)


def test_claude_events(spark, tmp_path):
    root = claude_session(tmp_path)
    ev = claude.normalize(claude.scan(spark, root), claude.scan_sidecars(spark, root)).cache()
    rows = ev.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 12))
    assert [r.kind for r in rows] == [
        "message", "tool_call", "tool_result", "unknown", "message", "message", "lifecycle", "lifecycle", "unknown",
        "message", "message",
    ]
    assert [r.text for r in rows[:4]] == ["fix  the\nlease", "looking", "done", None]
    assert rows[1].tool_names == ["Read", "Bash"] and rows[2].tool_names == []
    assert [tuple(t) for t in rows[1].file_touches] == [("read", "/w/a.ts", "/w/a.ts")]
    assert [tuple(t) for t in rows[2].file_touches] == [("modified", "src/a.ts", None)]
    assert rows[3].source_cursor == "line:4"
    assert [r.harness_injected for r in rows] == [False, False, False, False, True, True, False, False, False, True, True]
    assert [r.subagent_id for r in rows] == [None] * 5 + [""] + [None] * 3 + ["a7", "a7"]
    assert rows[9].subagent_type == "Explore" and rows[9].source_file == "source/subagents/agent-a7.jsonl"
    assert len({r.session_id for r in rows}) == 1 and rows[0].session_id.startswith("ses_")
    label = session_labels(ev).first()
    assert (label.label, label.label_source, label.label_seq) == ("New title", "ai_title", 8)
    s = session_summary(ev).first()
    assert (s.event_count, s.first_timestamp, s.last_timestamp) == (11, "2026-07-15T09:59:00Z", "2026-07-15T10:00:09Z")
    runs = {r.seq: (r.run_first_seq, r.run_last_seq) for r in adjacent_runs(ev).collect()}
    assert runs[10] == runs[11] == (10, 11) and runs[1] == (1, 1)
    found = claude.candidates(claude.scan(spark, root)).first()
    assert (found.source_session_id, found.opening_path, found.label) == (SID, "/w", "New title")


def test_codex_events(spark, tmp_path):
    sid = "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
    at = "2026-07-15T10:00:0{}Z".format

    def item(i, **p):
        return {"timestamp": at(i), "type": "response_item", "payload": p}

    def msg(i, **p):
        return {"timestamp": at(i), "type": "event_msg", "payload": p}

    write(
        tmp_path / "sessions" / "2026" / "07" / "15" / f"rollout-x-{sid}.jsonl",
        [
            {"timestamp": at(0), "type": "session_meta", "payload": {"id": sid, "cwd": "/w", "resumed_from": "old"}},
            item(0, type="message", role="user", content=[{"type": "input_text", "text": "<environment_context>"}]),
            item(1, type="message", role="user", id="m1", content=[{"type": "input_text", "text": "hello"}]),
            msg(2, type="user_message", message="hello"),
            item(9, type="message", role="user", content=[{"type": "input_text", "text": "hello"}]),
            item(3, type="function_call", name="exec", arguments='{"x":1}', id="c1"),
            item(3, type="function_call_output", output="out"),
            msg(4, type="exec_command_begin", command=["ls", 5, "-l"]),
            msg(5, type="patch_apply_begin", changes={
                "/a": {"type": "add"}, "/b": {"type": "update", "move_path": "/c"}, "/d": {"update": {}},
                "e": {"delete": {}}, "f": 3}),
            msg(6, type="token_count"),
            {"timestamp": at(7), "type": "novel", "payload": {}},
            item(8, type="reasoning"),
        ],
    )
    lines = codex.scan(spark, str(tmp_path))
    rows = codex.normalize(lines).orderBy("seq").collect()
    assert [r.kind for r in rows] == [
        "lifecycle", "message", "message", "message", "message", "tool_call", "tool_result", "tool_call", "tool_call",
        "lifecycle", "unknown", "message",
    ]
    assert [r.harness_injected for r in rows][:5] == [False, True, False, False, True]
    assert rows[5].text == "exec" and json.loads(rows[5].payload_json) == {"arguments": '{"x":1}'}
    assert rows[5].tool_names == ["exec"] and rows[5].source_event_id == "c1"
    assert rows[7].text == "ls -l" and rows[7].tool_names == ["shell"] and rows[7].file_touches == []
    assert [tuple(t) for t in rows[8].file_touches] == [
        ("created", "/a", "/a"), ("renamed", "/b", "/b"), ("modified", "/d", "/d"), ("deleted", "e", None)]
    found = codex.candidates(lines).first()
    assert (found.source_session_id, found.continuation_parent, found.label) == (sid, "old", "hello")
    assert found.subagent_origin is False


def test_codex_subagent_and_legacy(spark, tmp_path):
    write(
        tmp_path / "sessions" / "r-aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee.jsonl",
        [
            {"type": "session_meta", "payload": {"id": "s", "source": {"subagent": {"other": "memory"}}, "parent_thread_id": "p"}},
            {"type": "event_msg", "payload": {"type": "user_message", "message": "do"}},
        ],
    )
    write(
        tmp_path / "sessions" / "r-aaaaaaaa-bbbb-cccc-dddd-ffffffffffff.jsonl",
        [
            {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": " <user_instructions>x"}]}},
            {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "real"}]}},
        ],
    )
    lines = codex.scan(spark, str(tmp_path))
    found = {r.source_session_id: r for r in codex.candidates(lines).collect()}
    assert found["s"].subagent_origin and found["s"].subagent_kind == "memory" and found["s"].subagent_parent == "p"
    assert found["s"].label is None
    assert found["aaaaaaaa-bbbb-cccc-dddd-ffffffffffff"].label == "real"
    injected = {(r.source_session_id, r.seq): r.harness_injected for r in codex.normalize(lines).collect()}
    assert injected[("s", 2)] is True
    assert injected[("aaaaaaaa-bbbb-cccc-dddd-ffffffffffff", 1)] is True
    assert injected[("aaaaaaaa-bbbb-cccc-dddd-ffffffffffff", 2)] is False


def test_revision_digest_ignores_order(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"one")
    (tmp_path / "y").write_bytes(b"two!")
    files = fingerprint_files(spark, str(tmp_path)).withColumn("session_id", F.lit("s")).withColumnRenamed("file", "path")
    a = revisions(files).first()
    b = revisions(files.orderBy(F.desc("path"))).first()
    assert a == b and a.file_count == 2 and a.total_bytes == 7
