"""License scans by MinHash over overlapping windows of text.

A template of ``m`` shingles is looked for in windows of ``2 g`` shingles that begin
every ``g`` shingles, ``g`` being ``m`` rounded up to whole blocks, so any stretch of
``m`` shingles lies in a window whole. Minima are taken once per block of shingles;
those of a window are minima of its blocks. A window that holds the wanted part of a
template has a similarity bounded from below, and each template's bands are the
widest that such a window misses with a chance of at most ``MISS``. Windows that
agree with a template in a band are candidates, decided by exact containment.

Words are compared without marks at their ends, and words of marks alone (those that
begin lines of comments) are left out. A template of so few words that containment
asks for all of them is looked up as one shingle of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, texts
from lodestone.llm.words import LOWER, hash_spans, linear, stream, word_spans

SHINGLE = 5
HASHES = 96
BLOCK = 4
CONTAINMENT = 0.8
MISS = 1e-5
# Words of a statement of one line, at most.
STATEMENT = 20
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = _IS_ALNUM[128:] = True
FOUND = "doc_id long, templates array<string>, containments array<double>, first_words array<long>, last_words array<long>"

# Opening notices of public licenses and usual one-line statements.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    *[(name, f"{lead} {words}") for name, words in (
        ("mit", "MIT License"), ("isc", "ISC License"), ("unlicense", "Unlicense"), ("zlib", "zlib License"), ("bsl-1.0", "Boost Software License"),
        ("apache-2.0", "Apache License 2.0"), ("apache-2.0", "Apache License, Version 2.0"), ("apache-2.0", "Apache 2.0 License"),
        ("bsd", "BSD License"), ("bsd", "2-Clause BSD License"), ("bsd", "3-Clause BSD License"), ("bsd", "BSD 2-Clause License"), ("bsd", "BSD 3-Clause License"),
        ("mpl-2.0", "Mozilla Public License 2.0"), ("epl-2.0", "Eclipse Public License 2.0"),
    ) for lead in ("under the",)],
    *[(f"{name}-{n}", f"GNU {kind} Public License{mark} {v}{n}") for name, kind, versions in (
        ("gpl", "General", ("1.0", "2.0", "3.0", "2", "3")), ("lgpl", "Lesser General", ("2.1", "3.0", "3")), ("lgpl", "Library General", ("2.0", "2")), ("agpl", "Affero General", ("3.0", "3")),
    ) for n in versions for mark, v in ((",", "version "), ("", "v"), ("", ""))],
    *[(f"cc-{kind}-{n}", f"{lead} {kind.upper()} {n}") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for n in ("2.0", "2.5", "3.0", "4.0") for lead in ("CC",)],
    *[(f"cc-{kind}-{n}", f"Creative Commons {words} {n}") for n in ("2.0", "2.5", "3.0", "4.0") for kind, words in (
        ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
        ("by-nd", "Attribution-NoDerivs"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivs"),
    )],
    ("cc0-1.0", "CC0 1.0"), ("cc0-1.0", "Creative Commons Zero"),
    *[(name, f"SPDX-License-Identifier: {tag}{tail}") for name, tags in (
        ("mit", ("MIT",)), ("isc", ("ISC",)), ("apache-2.0", ("Apache-2.0",)), ("bsd", ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "BSD-4-Clause")), ("mpl-2.0", ("MPL-2.0",)), ("unlicense", ("Unlicense",)),
        ("zlib", ("Zlib",)), ("bsl-1.0", ("BSL-1.0",)), ("cc0-1.0", ("CC0-1.0",)), ("epl-2.0", ("EPL-2.0",)),
        ("gpl-2.0", ("GPL-2.0",)), ("gpl-3.0", ("GPL-3.0",)), ("lgpl-2.1", ("LGPL-2.1",)), ("lgpl-3.0", ("LGPL-3.0",)), ("agpl-3.0", ("AGPL-3.0",)),
        *[(f"cc-{k}-{n}", (f"CC-{k.upper()}-{n}",)) for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for n in ("3.0", "4.0")],
    ) for tag in tags for tail in (("", "-only", "-or-later") if "GPL" in tag else ("",))],
)
# One license under two numbers.
SAME = {"gpl-2": "gpl-2.0", "gpl-3": "gpl-3.0", "lgpl-2": "lgpl-2.0", "lgpl-3": "lgpl-3.0", "agpl-3": "agpl-3.0"}
TEMPLATES = tuple((SAME.get(name, name), text) for name, text in TEMPLATES)


@dataclass(frozen=True)
class Template:
    name: str
    shingles: np.ndarray  # sorted distinct hashes
    block: int  # shingles in half a window
    rows: int
    bands: np.ndarray  # one hash per band
    minima: np.ndarray


def similarity_bound(m: int, block: int, containment: float) -> float:
    """Least Jaccard similarity of a window of ``2 * block`` shingles that holds ``containment`` of a template of ``m``."""
    shared = np.ceil(containment * m)
    return float(shared / (2 * block + m - shared))


def band_rows(similarity: float, hashes: int = HASHES, miss: float = MISS) -> int:
    """Most rows in a band such that a pair of that similarity misses all bands with a chance of at most ``miss``; 0 if one row is too many."""
    rows = 0
    while (1 - similarity ** (rows + 1)) ** (hashes // (rows + 1)) <= miss:
        rows += 1
    return rows


def _minima(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: int) -> np.ndarray:
    """Minima of ``hashes`` universal hashes over blocks of ``values``: a row for each hash, a column for each block."""
    a, b = stream(29, hashes) | np.uint64(1), stream(31, hashes)
    # A block's values stand in a column, its last one repeated to the common length.
    grid = values[starts + np.minimum(np.arange(int(sizes.max()))[:, None], sizes - 1)]
    out = np.empty((hashes, len(starts)), np.uint32)
    held = np.empty_like(grid)
    for j in range(hashes):
        np.multiply(grid, a[j], out=held)
        held += b[j]
        out[j] = held.min(axis=0) >> np.uint64(32)
    return out


def _bands(minima: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band (row) and window (column)."""
    n = len(minima) // rows
    parts = minima[: n * rows].reshape(n, rows, -1).astype(np.uint64)
    out = np.zeros((n, parts.shape[2]), np.uint64)
    for j in range(rows):
        out = out * np.uint64(0x9E3779B97F4A7C15) + parts[:, j] + np.uint64(1)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts without marks at their ends, each text's first, and each word's number in its text.

    Words of marks alone are left out, but counted.
    """
    starts, ends, first = word_spans(data, offsets)
    good = np.flatnonzero(_IS_ALNUM[data])
    lo, hi = np.searchsorted(good, starts), np.searchsorted(good, ends)
    kept = hi > lo
    numbers = (np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first)))[kept]
    first = np.concatenate([[0], np.cumsum(kept)])[first]
    return hash_spans(LOWER[data], good[lo[kept]], good[hi[kept] - 1] + 1), first, numbers


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts in order and the first of each text; shorter texts have one of their own length."""
    return _runs(*_words(data, offsets)[:2], n)


def _runs(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of words, ``first`` being each text's first word."""
    runs = linear(words, n)
    counts = np.diff(first)
    if not len(counts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    sizes = np.where(counts >= n, counts - n + 1, counts > 0)
    out = np.empty(int(sizes.sum()), np.uint64)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    long = np.flatnonzero(counts >= n)
    pick = np.arange(int(sizes[long].sum())) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
    out[pick + np.repeat(heads[long], sizes[long])] = runs[pick + np.repeat(first[long], sizes[long])]
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        out[heads[i]] = linear(words[first[i] : first[i + 1]], int(counts[i]))[0]
    return out, heads


def phrases(templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> tuple[dict[int, dict[int, list[str]]], list[tuple[str, str]]]:
    """Names of short templates by width and hash, and the templates that are left.

    A template is short if containment asks for all its shingles, so only the whole phrase holds it.
    """
    short: dict[int, dict[int, list[str]]] = {}
    rest = []
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = _words(raw, np.array([0, len(raw)]))[0]
        shingles = max(1, len(words) - SHINGLE + 1)
        if len(words) and np.ceil(containment * shingles) == shingles:
            names = short.setdefault(len(words), {}).setdefault(int(linear(words, len(words))[0]), [])
            names.extend([name] if name not in names else [])
        else:
            rest.append((name, text))
    return short, rest


def spoken(short: dict[int, dict[int, list[str]]], words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[str, float, int, int]]]:
    """Per text the first place of each name in ``short``, of the widest phrase that begins there, as :func:`search` lists them."""
    found: dict[tuple[int, str], tuple[int, int]] = {}
    for width in sorted(short, reverse=True):
        runs = linear(words, width)
        for w in np.flatnonzero(np.isin(runs, np.array(list(short[width]), np.uint64))).tolist():
            i = int(np.searchsorted(first, w, side="right")) - 1
            if w + width <= first[i + 1]:
                at = w - int(first[i])
                for name in short[width][int(runs[w])]:
                    old = found.get((i, name))
                    # A phrase inside a wider one of its name is the same statement.
                    if old is None or at < old[0]:
                        found[i, name] = (at, at + width - 1)
    out: dict[int, list[tuple[str, float, int, int]]] = {}
    for (i, name), (a, b) in found.items():
        out.setdefault(i, []).append((name, 1.0, a, b))
    return out


def merged(whole: list[tuple[str, float, int, int]], parts: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Phrases and windows of one text by place, then name; of equals by name the longer one.

    A part of a statement in which a whole phrase of another license stands (its version is another) is that other license.
    """
    best: dict[str, tuple[str, float, int, int]] = {}
    for hit in [*whole, *parts]:
        name, share, a, b = hit
        if share < 1 and b - a < STATEMENT and any(p[0] != name and p[2] <= b + 1 and p[3] >= a for p in whole):
            continue
        old = best.get(name)
        if old is None or (share, b - a) > (old[1], old[3] - old[2]):
            best[name] = hit
    return sorted(best.values(), key=lambda h: (h[2], h[0]))


def compiled(templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, hashes: int = HASHES) -> list[Template]:
    """Templates with their windows and bands. A template without words is left out."""
    out = []
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        run, _ = _shingles(raw, np.array([0, len(raw)]), SHINGLE)
        if not len(run):
            continue
        block = -(-len(run) // BLOCK) * BLOCK
        distinct = np.unique(run)
        rows = band_rows(similarity_bound(len(distinct), block, containment), hashes)
        minima = _minima(distinct, np.array([0]), np.array([len(distinct)]), hashes)
        out.append(Template(name, distinct, block, rows, _bands(minima, max(rows, 1))[:, 0], minima[:, 0]))
    return out


def window_starts(n: int, block: int) -> np.ndarray:
    """Where the windows of a text of ``n`` shingles begin: every block, but no window inside another's tail."""
    return np.arange(0, max(1, n - block), block) if n else np.zeros(0, np.int64)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, hashes: int = HASHES) -> DataFrame:
    """``doc_id, templates, containments, first_words, last_words`` for every row of ``docs``.

    A template's name is listed once, with its best window (the first of equals): the part of the template's distinct shingles
    found there, and the words from the first to the last of those. Names come in order of place, then name. Null and empty
    texts list nothing. The templates are a parameter, sent to every task.
    """
    short, rest = phrases(templates, containment)
    held = compiled(rest, containment, hashes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offsets in slices(batch):
                words, first, numbers = _words(data, offsets)
                whole = spoken(short, words, first)
                parts = search(held, *_runs(words, first, SHINGLE), containment, hashes)
                best = {}
                for i in whole.keys() | parts.keys():
                    own = numbers[first[i] : first[i + 1]]
                    hits = merged(whole.get(i, []), parts.get(i, []))
                    best[i] = [(name, share, int(own[a]), int(own[min(b, len(own) - 1)])) for name, share, a, b in hits]
                lists = [[[h[c] for h in best.get(i, [])] for i in range(end - at)] for c in range(4)]
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), *[pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]],
                    names=["doc_id", "templates", "containments", "first_words", "last_words"],
                )

    return texts(docs).mapInArrow(find, FOUND)


def search(
    templates: list[Template], run: np.ndarray, heads: np.ndarray, containment: float, hashes: int
) -> dict[int, list[tuple[str, float, int, int]]]:
    """Per text with templates, what :func:`scan` lists; ``run`` has all shingles and ``heads`` each text's first."""
    sizes = np.diff(heads)
    full = np.flatnonzero(sizes)
    if not len(full) or not templates:
        return {}
    # Blocks of BLOCK shingles, none over two texts.
    per_text = -(-sizes // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(per_text)])
    nth = np.arange(first_block[-1]) - np.repeat(first_block[:-1], per_text)
    starts = nth * BLOCK + np.repeat(heads[:-1], per_text)
    minima = _minima(run, starts, np.minimum(BLOCK, np.repeat(heads[1:], per_text) - starts), hashes)
    # A window agrees with a template in a band only if one of its blocks has a minimum of that template.
    known = np.stack([t.minima for t in templates])
    near = np.zeros(len(starts), bool)
    for j in range(hashes):
        near |= (minima[j] == known[:, j, None]).any(axis=0)
    near_before = np.concatenate([[0], np.cumsum(near)])
    found: dict[tuple[int, str], tuple[float, int, int]] = {}
    for g in sorted({t.block for t in templates}):
        k = g // BLOCK
        # A window is 2k blocks from every k-th on; those at a text's end have fewer.
        windows = np.maximum(1, -(-(sizes - g) // g)) * (sizes > 0)
        text = np.repeat(np.arange(len(sizes)), windows)
        w = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        lo = first_block[text] + w * k
        hi = np.minimum(lo + 2 * k, first_block[text + 1])
        if all(t.rows for t in templates if t.block == g):
            chosen = np.flatnonzero(near_before[hi] > near_before[lo])
            text, w, lo, hi = text[chosen], w[chosen], lo[chosen], hi[chosen]
        if not len(text):
            continue
        own = np.stack([minima[:, x:y].min(axis=1) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], axis=1)
        banded = {r: _bands(own, r) for r in {max(t.rows, 1) for t in templates if t.block == g}}
        for t in templates:
            if t.block != g:
                continue
            # With no band wide enough for the bound every window is compared.
            hit = (banded[max(t.rows, 1)] == t.bands[:, None]).any(axis=0) if t.rows else np.ones(len(text), bool)
            for j in np.flatnonzero(hit).tolist():
                i = int(text[j])
                a = int(heads[i] + w[j] * g)
                part = run[a : min(a + 2 * g, int(heads[i + 1]))]
                inside = np.isin(part, t.shingles)
                share = len(np.unique(part[inside])) / len(t.shingles)
                if share >= containment and share > found.get((i, t.name), (0.0,))[0]:
                    where = np.flatnonzero(inside) + a - int(heads[i])
                    found[i, t.name] = (share, int(where[0]), int(where[-1]) + SHINGLE - 1)
    out: dict[int, list[tuple[str, float, int, int]]] = {}
    for (i, name), (share, first, last) in sorted(found.items(), key=lambda x: (x[0][0], x[1][1], x[0][1])):
        out.setdefault(i, []).append((name, share, first, last))
    return out
