"""Reading and writing dynamic JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(value: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def text_at(value: Column, path: str) -> Column:
    """The nonempty string at ``path``; numbers and other values are NULL."""
    return F.when(kind_of(value, path) == "STRING", F.nullif(F.try_variant_get(value, path, "string"), F.lit("")))


def object_at(value: Column, path: str) -> Column:
    # only an object casts to a map; its schema would be read to the last leaf
    is_map = F.try_variant_get(value, path, "map<string,variant>").isNotNull()
    return F.when(is_map, F.try_variant_get(value, path, "variant"))


def items_at(value: Column, path: str) -> Column:
    """The array at ``path`` as ``array<variant>``, NULL for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


def true_at(value: Column, path: str) -> Column:
    return F.coalesce(
        (kind_of(value, path) == "BOOLEAN") & F.try_variant_get(value, path, "boolean"), F.lit(False)
    )


def bracketed(raw: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))


def json_object(raw: Column, listed: Column | None = None) -> Column:
    """A whole line as a JSON object, NULL if it is anything else.

    The variant parser stops after the first value. Inside brackets whatever
    follows is an error or a second element; the one string that still slips
    through, a value followed by ``]``, is caught by braces instead.
    """
    listed = bracketed(raw) if listed is None else listed
    first = F.try_variant_get(listed, "$[0]", "variant")
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    whole = F.when(raw.rlike(r"\}\s*\]"), braced).otherwise(F.lit(True))
    return F.when(alone & whole & raw.rlike(r"^\s*\{"), first)


def unless_default(value: Column, default) -> Column:
    """NULL where ``value`` equals its default, so that ``to_json`` leaves it out."""
    return F.when(value != F.lit(default), value)


def sparse_json(fields: Mapping[str, Column | tuple[Column, object]], always: Sequence[str] = ()) -> Column:
    """JSON object that omits NULL, empty and default values, except ``always``.

    A field is a column, or (column, default).
    """
    cols = []
    for name, spec in fields.items():
        col, default = spec if isinstance(spec, tuple) else (spec, None)
        if default is not None and name not in always:
            col = unless_default(col, default)
        cols.append(col.alias(name))
    return F.to_json(F.struct(*cols))


def canonical_json(entries: Column, registry: Sequence[str] = ()) -> Column:
    """A string map as JSON text: registry keys first, in order, then the rest sorted.

    Values are JSON texts; nested maps are canonical already when built with this.
    """
    keys = F.map_keys(entries)
    known = F.filter(F.array(*[F.lit(k) for k in registry]) if registry else F.array().cast("array<string>"),
                     lambda k: F.array_contains(keys, k))
    rest = F.array_sort(F.array_except(keys, known))
    parts = F.transform(
        F.concat(known, rest),
        lambda k: F.concat(
            # a one-element list renders the key as a JSON string
            F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1),
            F.lit(":"),
            F.element_at(entries, k),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
