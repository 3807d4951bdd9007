"""One deterministic automaton for many regular expressions over bytes.

Expressions (literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m,n}``) become one
nondeterministic automaton whose ends carry their rule's number. Subset construction
makes it deterministic and partition refinement minimal; transitions are a flat
array over classes of bytes that no expression tells apart.

:meth:`Automaton.scan` runs all rules in one pass over the bytes of many texts. The
texts are cut into chunks that advance side by side, one array step per byte; a
chunk starts in the initial state, and where the state its predecessor ended in says
otherwise its head is run again until both runs agree, which is soon.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

Node = tuple
CHUNK = 2048
MAX_STATES = 60_000


# ---- expressions ----


def _class_set(body: str, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    negate, i = body.startswith("^"), int(body.startswith("^"))
    chars: list[tuple[int, bool]] = []
    while i < len(body):
        if body[i] == "\\":
            code, i = _escape(body, i)
            chars.append((code, True))
        else:
            chars.append((ord(body[i]), False))
            i += 1
    i = 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == (ord("-"), False):
            out.update(range(chars[i][0], chars[i + 2][0] + 1))
            i += 3
        else:
            out.add(chars[i][0])
            i += 1
    if fold:
        out |= {ord(chr(c).swapcase()) for c in out if c < 128 and chr(c).isalpha()}
    return frozenset(range(256)) - out if negate else frozenset(out)


def _escape(text: str, i: int) -> tuple[int, int]:
    if text[i + 1] == "x":
        return int(text[i + 2 : i + 4], 16), i + 4
    return ord({"n": "\n", "t": "\t", "r": "\r"}.get(text[i + 1], text[i + 1])), i + 2


def parse(text: str, fold: bool = False) -> Node:
    """The tree of an expression; with ``fold`` ASCII letters match in either case."""
    at = 0

    def alternatives() -> Node:
        nonlocal at
        parts = [sequence()]
        while at < len(text) and text[at] == "|":
            at += 1
            parts.append(sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence() -> Node:
        nonlocal at
        parts = []
        while at < len(text) and text[at] not in "|)":
            parts.append(repeated(atom()))
        return ("seq", parts)

    def atom() -> Node:
        nonlocal at
        c = text[at]
        if c == "(":
            at += 3 if text.startswith("(?:", at) else 1
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            end = at + 1 + (text[at + 1] == "^") + 1
            while text[end] != "]" or text[end - 1] == "\\":
                end += 1
            body, at = text[at + 1 : end], end + 1
            return ("set", _class_set(body, fold))
        if c == "\\":
            code, at = _escape(text, at)
            return ("set", frozenset([code]))
        at += 1
        return ("set", _class_set("\\" + c if c in "^-\\" else c, fold))

    def repeated(node: Node) -> Node:
        nonlocal at
        while at < len(text) and text[at] in "?*+{":
            c = text[at]
            if c == "{":
                end = text.index("}", at)
                low, _, high = text[at + 1 : end].partition(",")
                bounds = (int(low), int(low) if "," not in text[at:end] else (int(high) if high else None))
                at = end + 1
            else:
                bounds, at = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c], at + 1
            node = ("rep", node, *bounds)
        return node

    tree = alternatives()
    if at != len(text):
        raise ValueError(f"expression not understood at {at}: {text}")
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1

    def build(self, node: Node, end: int) -> int:
        """The state from which ``node`` leads to ``end``."""
        kind = node[0]
        if kind == "set":
            s = self.state()
            self.steps[s] = (node[1], end)
            return s
        if kind == "seq":
            for part in reversed(node[1]):
                end = self.build(part, end)
            return end
        if kind == "or":
            s = self.state()
            self.empty[s] += [self.build(p, end) for p in node[1]]
            return s
        _, inner, low, high = node
        if high is None:
            loop = self.state()
            self.empty[loop] += [self.build(inner, loop), end]
            end = loop
        else:
            for _ in range(high - low):
                s = self.state()
                self.empty[s] += [self.build(inner, end), end]
                end = s
        for _ in range(low):
            end = self.build(inner, end)
        return end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """``step[state * classes + byte_class[byte]]`` is the next state; ``accepts[state]`` has a bit for each rule that ends there.

    State 0 is the initial one; the accepting states are the last ones, from ``accepting`` on.
    """

    def __init__(self, trees: Sequence[Node], anywhere: bool):
        nfa = _Nfa()
        ends = [nfa.state() for _ in trees]
        start = frozenset(nfa.build(tree, end) for tree, end in zip(trees, ends, strict=True))
        rule_of = {e: i for i, e in enumerate(ends)}
        # Bytes that every set holds or lacks together are one class.
        sets = {s[0] for s in nfa.steps if s is not None}
        signature = {b: tuple(b in s for s in sets) for b in range(256)}
        classes = {sig: i for i, sig in enumerate(dict.fromkeys(signature.values()))}
        self.byte_class = np.array([classes[signature[b]] for b in range(256)], np.uint16)
        self.classes = len(classes)
        sample = {classes[signature[b]]: b for b in range(255, -1, -1)}

        first = nfa.closure(start)
        numbers, todo, table, masks = {first: 0}, [first], [], []
        while todo:
            new = []
            for states in todo:
                masks.append(sum(1 << rule_of[s] for s in states if s in rule_of))
                row = []
                for c in range(self.classes):
                    moved = frozenset(t for s in states if nfa.steps[s] is not None for on, t in [nfa.steps[s]] if sample[c] in on)
                    after = nfa.closure(moved | start) if anywhere else nfa.closure(moved)
                    if after not in numbers:
                        numbers[after] = len(numbers)
                        new.append(after)
                        if len(numbers) > MAX_STATES:
                            raise ValueError("the combined automaton is too large; split the rules")
                    row.append(numbers[after])
                table.append(row)
            todo = new
        self._minimise(np.array(table, np.int64), np.array(masks, np.int64))

    def _minimise(self, table: np.ndarray, masks: np.ndarray) -> None:
        """Merge states that no input tells apart, refining blocks until none splits."""
        block = np.unique(masks, return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.c_[block, block[table]], axis=0, return_inverse=True)
            if finer.max() == block.max():
                break
            block = finer
        n = int(block.max()) + 1
        member = np.zeros(n, np.int64)
        member[block[::-1]] = np.arange(len(block))[::-1]
        # The initial state first, accepting states last.
        mask_of = masks[member]
        order = np.lexsort((np.arange(n), np.arange(n) != block[0], mask_of > 0))
        if mask_of[block[0]]:
            raise ValueError("a rule matches the empty text")
        rank = np.argsort(order)
        self.states = n
        self.step = rank[block[table[member[order]]]].astype(np.uint16).ravel()
        self.accepts = mask_of[order]
        self.accepting = int((mask_of == 0).sum())
        alive = self.accepts > 0
        while True:
            grown = alive | alive[self.step.reshape(n, -1)].any(axis=1)
            if (grown == alive).all():
                break
            alive = grown
        self.alive = alive

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``text, end, mask`` wherever rules end in a text (``end`` is the place after the last byte), in no order; of an ``anywhere`` automaton."""
        lengths = np.diff(offsets)
        per_text = -(-lengths // CHUNK)
        text = np.repeat(np.arange(len(lengths)), per_text)
        if not len(text):
            return
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = offsets[text] + nth * CHUNK
        size = np.minimum(CHUNK, offsets[text + 1] - begin)
        order = np.argsort(-size, kind="stable")
        text, begin, size, nth = text[order], begin[order], size[order], nth[order]
        codes = self.byte_class[data]
        classes = np.uint32(self.classes)
        state = np.zeros(len(text), np.uint16)
        # Lanes are sorted by length, so those still running are a prefix.
        running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        for i, k in enumerate(running.tolist()):
            at = begin[:k] + i
            new = self.step[state[:k] * classes + codes[at]]
            state[:k] = new
            if self.accepting < self.states and int(new.max()) >= self.accepting:
                for lane in np.flatnonzero(new >= self.accepting).tolist():
                    yield int(text[lane]), int(at[lane]) + 1 - int(offsets[text[lane]]), int(self.accepts[new[lane]])
        # Heads of later chunks, in text order: run on from the true state until it meets the assumed run.
        if (nth > 0).any():
            where = np.lexsort((nth, text))
            step, byte_class, width = self.step, self.byte_class, self.classes
            true = 0
            for lane in where.tolist():
                if nth[lane] == 0:
                    true = int(state[lane])
                    continue
                assumed, carried = 0, true
                at, end = int(begin[lane]), int(begin[lane] + size[lane])
                while at < end and carried != assumed:
                    c = int(byte_class[data[at]])
                    carried, assumed = int(step[carried * width + c]), int(step[assumed * width + c])
                    at += 1
                    mask = int(self.accepts[carried])
                    if mask:
                        yield int(text[lane]), at - int(offsets[text[lane]]), mask
                true = carried if at == end and carried != assumed else int(state[lane])

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at ``at``, or -1; of an anchored automaton."""
        state, found, step = 0, -1, self._rows
        for i in range(at, len(data)):
            state = step[state][data[i]]
            if not self._live[state]:
                break
            if state >= self.accepting:
                found = i + 1
        return found

    @property
    def _rows(self) -> list[list[int]]:
        if not hasattr(self, "_row_list"):
            full = self.step.reshape(self.states, self.classes)[:, self.byte_class]
            self._row_list, self._live = full.tolist(), self.alive.tolist()
        return self._row_list


def compiled(expressions: Sequence[str], fold: Sequence[bool]) -> tuple[Automaton, list[Automaton]]:
    """The combined automaton that finds ends anywhere, and each rule's own anchored one."""
    trees = [parse(e, f) for e, f in zip(expressions, fold, strict=True)]
    return Automaton(trees, anywhere=True), [Automaton([t], anywhere=False) for t in trees]
