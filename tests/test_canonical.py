"""Canonical documents against Python's own writer."""

from __future__ import annotations

import json
import random

from lodestone.operators.canonical import canonical_documents

REGISTRY = ["schemaVersion", "store"]


def canonical(raw):
    try:
        found = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    top = {k: found[k] for k in [*[k for k in REGISTRY if k in found], *sorted(set(found) - set(REGISTRY))]}

    def in_order(v):
        if isinstance(v, dict):
            return {k: in_order(v[k]) for k in sorted(v)}
        return [in_order(x) for x in v] if isinstance(v, list) else v

    return json.dumps({k: in_order(v) for k, v in top.items()}, indent=2, ensure_ascii=False) + "\n"


def test_nested_documents(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(7 if depth < 5 else 4)
        if kind < 4:
            return [None, True, rng.randrange(-99, 99), rng.choice(["", "a b", 'q"uo\\te', "é中", "tab\t\n", "/"])][kind]
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        keys = rng.sample(["z", "a", "B", "_", "é", "k 1", 'q"', "schemaVersion", "10", "9", ""], rng.randrange(6))
        return {k: value(depth + 1) for k in keys}

    raws = []
    while len(raws) < 60:
        made = value(0)
        if isinstance(made, dict):
            raws.append(json.dumps({**made, **({"store": value(1)} if rng.random() < 0.5 else {})}, ensure_ascii=rng.random() < 0.5))
    raws += [None, "", "[]", "[1]", "1", "{", "{} {}", "null", "{}", '{"a":1,"a":{"y":2,"x":1}}', raws[0], '{"d":' * 30 + "1" + "}" * 30]
    docs = spark.createDataFrame([(i, r, "kept") for i, r in enumerate(raws)], "id int, raw string, path string")
    got = {r.id: r for r in canonical_documents(docs, "raw", REGISTRY).collect()}
    assert len(got) == len(raws) and all(r.path == "kept" for r in got.values())
    for i, raw in enumerate(raws):
        assert got[i].canonical == canonical(raw), raw


def test_no_documents(spark):
    assert canonical_documents(spark.createDataFrame([], "raw string"), "raw").collect() == []
