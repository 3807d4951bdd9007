"""Chat formatting in budgeted windows.

Turns are numbered within their conversation and carry their number of tokens.
Prefix sums of tokens choose spans of whole turns that fit a budget; every window
repeats the conversation's system turn and a limited tail of the turns before its
span as context. An assistant turn is a target (under the loss mask) in the one
window whose span holds it and plain context where it is repeated, so each target
counts once. A template marks turns; control strings inside texts are escaped in a
way that can be undone.

Work is dealt by (conversation, section of ``SECTION`` turns), so a conversation of
any length never meets in one task; a section gets the tail of the section before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.operators.blocks import dense_seq

SECTION = 64
BUDGET = 1024
HISTORY_TURNS, HISTORY_TOKENS = 4, 256
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of this template and of public ones: fixed values.
CONTROLS = (
    OPEN, MIDDLE, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<|begin_of_text|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>",
)
WINDOWS = (
    "conv_id long, section long, window int, first_seq long, turns int, tokens long, text string, "
    "loss array<struct<start:long,end:long>>, spans array<struct<seq:long,start:long,end:long,repeated:boolean>>"
)


def escaper(controls: Sequence[str] = CONTROLS) -> Callable[[str], str]:
    r"""Doubles backslashes and puts one after the first character wherever a control string begins."""
    rests: dict[str, list[str]] = {}
    for c in controls:
        if "\\" in c or len(c) < 2:
            raise ValueError(f"a control string needs two characters and no backslash: {c!r}")
        rests.setdefault(c[0], []).append(re.escape(c[1:]))
    marks = re.compile("|".join(f"{re.escape(h)}(?={'|'.join(r)})" for h, r in rests.items()))

    def escape(text: str) -> str:
        # Controls hold no backslash, so doubling those first neither makes nor breaks one.
        return marks.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    return escape


_ESCAPED = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    """Undoes :func:`escaper`: two backslashes are one, a single one is nothing."""
    return _ESCAPED.sub(lambda m: m[1], text)


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)


def parse_window(text: str) -> list[tuple[str, str, int, int]]:
    """``role, text, start, end`` of the turns of a formatted window; the places are those of the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


def counted(turns: DataFrame, tokenizer: str | None) -> DataFrame:
    """``turns`` with ``tokens`` of each text by a tokenizer file; without one, its words."""
    if tokenizer is None:
        return turns.withColumn("tokens", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long"))

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        from lodestone.llm.token_store import encoder

        enc = encoder(tokenizer, 0)
        return text.map(lambda t: len(enc.encode(t)) // enc.width - 1)

    return turns.withColumn("tokens", tokens("text"))


def _spans(rows: Sequence[dict], skip: int, budget: int, history: tuple[int, int], system: dict | None) -> Iterator[tuple[int, int, int]]:
    """``(held, first, end)`` of each window over ``rows[skip:]``: the new turns are ``first`` up to ``end``, ``held`` up to ``first`` come again.

    The system turn is paid first where it comes before the first new turn, then that turn, then the history, and prefix
    sums of tokens tell how far the new turns go with the rest. The history ends before the system turn.
    """
    sums = np.concatenate([[0], np.cumsum([r["tokens"] for r in rows])])
    at = skip
    while at < len(rows):
        before = system is not None and system["seq"] < rows[at]["seq"]
        room = budget - (system["tokens"] if before else 0)
        spare = min(history[1], room - rows[at]["tokens"])
        held = at
        while held > 0 and at - held < history[0] and sums[at] - sums[held - 1] <= spare:
            if before and rows[held - 1]["seq"] <= system["seq"]:
                break
            held -= 1
        end = max(at + 1, int(np.searchsorted(sums, sums[held] + room, side="right")) - 1)
        yield held, at, end
        at = end


def chat_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    tokenizer: str | None = None,
    controls: Sequence[str] = CONTROLS,
    section: int = SECTION,
) -> DataFrame:
    """Formatted windows of ``conversations`` (conv_id, turn, role, text), as :data:`WINDOWS`.

    The budget is for all turns of a window: the system turn, at most ``history_turns`` turns of at most ``history_tokens``
    in all, and the new turns. The history gives way before the first new turn does. Turns are never cut, so a window
    of one new turn, alone or after the system turn, may be above the budget; no other is. Marks of the template are not
    counted. Windows begin anew every ``section`` turns, so a task holds no more than a section. Turns go by ``turn`` (null first), then role and text, so repeated turn numbers and
    repeated rows have a place each. Null roles and texts are empty; rows of a null ``conv_id`` are a conversation.
    The system turn is the first of that role; it is repeated only in windows after the one that holds it.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("_conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    seq = stage(counted(dense_seq(stage(rows, "turns"), ["_conv"], ["turn", "role", "text"]), tokenizer), "numbered")
    seq = seq.withColumn("section", F.floor((F.col("seq") - 1) / section).cast("long"))
    # The last turns of a section also go to the next one, as context alone.
    tail = (F.col("seq") - 1) % section >= section - min(history_turns, section)
    dealt = seq.withColumn("_to", F.explode(F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dealt = dealt.withColumn("section", F.col("section") + F.col("_to"))
    system = seq.filter("role = 'system'").groupBy("_conv").agg(F.min(F.struct("seq", "text", "tokens")).alias("system"))
    # Only sections after the system turn's own need it sent along: one row a section.
    heads = dealt.filter("_to = 0").select("_conv", "section").distinct()
    sent = heads.join(system, "_conv").select(
        F.lit(None).cast("long").alias("conv_id"), "_conv", F.lit(None).cast("long").alias("turn"), F.lit("system").alias("role"),
        F.col("system.text").alias("text"), F.col("system.seq").alias("seq"), F.col("system.tokens").alias("tokens"), "section", F.lit(2).alias("_to"),
    )
    columns = ["conv_id", "_conv", "role", "text", "seq", "tokens", "section", "_to"]
    everything = dealt.select(columns).unionByName(sent.select(columns))
    escape = escaper(controls)

    names = [c.split()[0] for c in _columns(WINDOWS)]

    def build(before: list[dict], own: list[dict], system: dict | None) -> Iterator[tuple]:
        """The windows of one section's turns, in order."""
        rows, skip = [*before, *own], len(before)
        for number, (held, a, b) in enumerate(_spans(rows, skip, budget, (history_turns, history_tokens), system)):
            shown = [(r, True) for r in rows[held:a]] + [(r, False) for r in rows[a:b]]
            if system is not None and system["seq"] < shown[0][0]["seq"]:
                shown.insert(0, (system, True))
            text, at, loss, spans = [], 0, [], []
            for r, repeated in shown:
                head, body = f"{OPEN}{escape(r['role'])}{MIDDLE}", escape(r["text"])
                start = at + len(head)
                end = start + len(body)
                text += [head, body, CLOSE]
                at = end + len(CLOSE)
                spans.append({"seq": r["seq"], "start": start, "end": end, "repeated": repeated})
                if r["role"] == "assistant" and not repeated:
                    loss.append({"start": start, "end": end})
            first = rows[a]
            yield first["conv_id"], first["section"], number, first["seq"], b - a, sum(r["tokens"] for r, _ in shown), "".join(text), loss, spans

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(n, t) for n, t in zip(names, _TYPES, strict=True)])

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

        key, part, out = None, ([], [], []), []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["_conv"], r["section"]) != key:
                    out += _built(build, part)
                    key, part = (r["_conv"], r["section"]), ([], [], [])
                part[r["_to"]].append(r)
            if len(out) >= 256:
                yield packed(out)
                out = []
        yield packed(out + _built(build, part))

    dealt = everything.repartition("_conv", "section").sortWithinPartitions("_conv", "section", "_to", "seq")
    return dealt.mapInArrow(sections, WINDOWS)


_SPAN = [("start", pa.int64()), ("end", pa.int64())]
_TYPES = (
    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct(_SPAN)),
    pa.list_(pa.struct([("seq", pa.int64()), *_SPAN, ("repeated", pa.bool_())])),
)


def _columns(schema: str) -> list[str]:
    return [c.strip() for c in re.sub("<.*?>+", "", schema).split(",")]


def _built(build: Callable, part: tuple[list[dict], list[dict], list[dict]]) -> list[tuple]:
    """Windows of a section from its own turns, the tail before them and the system turn; a tail alone gives none."""
    own, before, system = part
    return list(build(before, own, system[0] if system else None)) if own else []


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, from their formatted text and masks alone:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows``.

    Windows of a conversation come in order to one task, which keeps running digests and no texts.
    """
    import hashlib

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list | None = None

        def closed() -> list:
            conv, n, turns, chars, loss, formatted, count = open_
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count]

        for frame in frames:
            out = []
            for r in frame.itertuples():
                conv = None if pd.isna(r.conv_id) else int(r.conv_id)
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        out.append(closed())
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                under_loss = {(s["start"], s["end"]) for s in r.loss}
                repeated = {s["start"]: s["repeated"] for s in r.spans}
                for role, text, start, end in parse_window(r.text):
                    if not repeated[start]:
                        open_[1] += 1
                        open_[2].update(f"{role}\n{text}\n".encode())
                    if (start, end) in under_loss:
                        open_[3] += len(text)
                        open_[4].update(text.encode())
                open_[5] += len(r.text)
                open_[6] += 1
            frame = pd.DataFrame(out, columns=names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame
        if open_ is not None:
            frame = pd.DataFrame([closed()], columns=names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "first_seq")
    return dealt.select("conv_id", "text", "loss", "spans").mapInPandas(digest, schema)
