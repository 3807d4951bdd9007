"""Secret scans with one automaton for all rules.

The combined automaton passes over the bytes of every text once and says where which
rule ends. Texts without an end, which is most, are done. In the others a rule's
spans are read off with its own anchored automaton from the places where it may
begin up to its last end, leftmost first, longest, not overlapping; spans shorter
than the rule asks for are dropped, and what they covered stays used up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.automaton import Automaton, compiled
from lodestone.llm.common import slices, texts


@dataclass(frozen=True)
class SecretRule:
    """``value`` gives the part of a span whose length must reach ``least``; by default the whole span."""

    kind: str
    expression: str
    least: int = 1
    fold: bool = False
    value: str = ""


# The base kinds in their order, then kinds of this library (public forms of well-known tokens).
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""",
        least=6,
        fold=True,
        value=r"""[^:=]*[:=]\x20*["']?""",
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", r"[0-9a-f]{24}[0-9a-f]*", least=24),
)
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=20),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_.\-]+", least=40),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
FOUND = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


@dataclass(frozen=True)
class Machines:
    """Automata of some rules, the bytes that can begin each, and what precedes its measured part."""

    rules: tuple[SecretRule, ...]
    combined: Automaton
    own: list[Automaton]
    heads: list[np.ndarray]
    before: list[re.Pattern | None]


@cache
def machines(rules: tuple[SecretRule, ...]) -> Machines:
    """Compiled once, on the driver; tasks get the arrays."""
    combined, own = compiled([r.expression for r in rules], [r.fold for r in rules])
    heads = [a.alive[a.step.reshape(a.states, a.classes)[0, a.byte_class]] for a in own]
    return Machines(rules, combined, own, heads, [re.compile(r.value.encode()) if r.value else None for r in rules])


def spans_of(m: Machines, text: bytes, last: dict[int, int]) -> list[tuple[int, int, int]]:
    """``start, rule, end`` of every span in bytes; ``last`` has the rules found and where each ends last."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for r, bound in last.items():
        at = 0
        for start in np.flatnonzero(m.heads[r][data[:bound]]).tolist():
            if start < at:
                continue
            end = m.own[r].longest(text, start)
            if end < 0:
                continue
            at = end
            lead = m.before[r].match(text, start, end) if m.before[r] else None
            if end - (lead.end() if lead else start) >= m.rules[r].least:
                out.append((start, r, end))
    return sorted(out)


def find_secrets(docs: DataFrame, rules: Sequence[SecretRule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``doc_id, kinds, starts, ends`` of every row of ``docs``: its spans in code points, end exclusive.

    Spans come by start, then in the order of the rules. Kinds are independent of each other and may overlap. Null and empty
    texts, and texts without secrets, have empty lists.
    """
    m = machines(tuple(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offsets in slices(batch, bytes_each=4 << 20):
                ends: dict[int, dict[int, int]] = {}
                for text, place, mask in m.combined.scan(data, offsets):
                    last = ends.setdefault(text, {})
                    while mask:
                        r = (mask & -mask).bit_length() - 1
                        last[r] = max(last.get(r, 0), place)
                        mask &= mask - 1
                lists: list[list[list]] = [[[] for _ in range(end - at)] for _ in range(3)]
                for i, last in ends.items():
                    raw = data[offsets[i] : offsets[i + 1]]
                    found = spans_of(m, raw.tobytes(), last)
                    # Code points before a byte: the bytes that continue none.
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    lists[0][i] = [m.rules[r].kind for _, r, _ in found]
                    lists[1][i] = [int(points[s]) for s, _, _ in found]
                    lists[2][i] = [int(points[e]) for _, _, e in found]
                kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), *[pa.array(x, k) for x, k in zip(lists, kinds, strict=True)]],
                    names=["doc_id", "kinds", "starts", "ends"],
                )

    return texts(docs).mapInArrow(scan, FOUND)
