"""Canonical JSON documents: keys sorted at every depth, arrays in order, two-space indentation and a line break at the end.

Documents are taken apart level by level: the values of all containers of one depth are rows of a table, and those that
are containers themselves make the next level. Then levels are put together again from the deepest up, each container from
the texts of its own values alone. There are as many rounds as the deepest document has levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.json import bracketed, json_object
from lodestone.session import stage


def _quoted(key: Column) -> Column:
    """A string as JSON; a one-element list renders it."""
    return F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _level(values: DataFrame) -> DataFrame:
    """``row, path, parent, key, pos, form, text, value``: what the values are; only containers keep ``value``."""
    form = F.when(_fields(F.col("value")).isNotNull(), "object").when(_items(F.col("value")).isNotNull(), "array").otherwise("leaf")
    leaf = F.col("form") == "leaf"
    # The value of null is a variant that holds null.
    text = F.when(leaf, F.coalesce(F.to_json("value"), F.lit("null")))
    told = values.withColumn("form", form)
    return told.withColumn("text", text).withColumn("value", F.when(~leaf, F.col("value")))


def canonical_documents(docs: DataFrame, column: str, registry: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``canonical``: the JSON object in ``column`` in canonical form, null where it is no object.

    Top-level keys of ``registry`` come first, in its order; all others, and all keys further down, by code point. Of a key
    that stands twice the last value counts. Rows may repeat; other columns stay.
    """
    docs = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    parsed = docs.select(F.col("_row").alias("row"), json_object(F.col(column), bracketed(F.col(column))).alias("value"))
    top = parsed.filter("value is not null").select(
        "row", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"), "value"
    )
    levels = [stage(_level(top), "level")]
    while True:
        held = levels[-1].filter("value is not null").select("row", "path", "value")
        fields = held.select("row", "path", F.posexplode(_fields(F.col("value"))).alias("pos", "key", "value"))
        items = held.select("row", "path", F.posexplode(_items(F.col("value"))).alias("pos", "value")).withColumn("key", F.lit(None).cast("string"))
        values = fields.unionByName(items).withColumn("path", F.concat("path", F.array("pos")))
        below = stage(_level(values.select("row", "path", "key", "pos", "value")), "level")
        if below.isEmpty():
            break
        levels.append(below)

    made = None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].select("row", "path", "key", "pos", "form", "text")
        if made is not None:
            here = here.join(made, ["row", "path"], "left")
        else:
            here = here.withColumn("parts", F.lit(None).cast("array<string>"))
        inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
        body = F.when(F.size("parts") > 0, F.concat(F.lit(inner), F.array_join("parts", "," + inner), F.lit(outer))).otherwise("")
        marks = F.when(F.col("form") == "object", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        done = here.select("row", "path", "key", "pos", F.coalesce("text", marks).alias("text"))
        if depth == 0:
            made = done.select(F.col("row").alias("_row"), F.concat("text", F.lit("\n")).alias("canonical"))
            break
        ranks = F.array_position(F.array(*[F.lit(k) for k in registry]), F.col("key")) if registry and depth == 1 else F.lit(0).cast("long")
        # Registered keys by rank, then others by key; items by place.
        order = F.struct(F.when(ranks > 0, ranks).otherwise(F.lit(1 << 40)).alias("rank"), F.coalesce("key", F.lit("")).alias("key"), "pos")
        shown = F.when(F.col("key").isNotNull(), F.concat(_quoted(F.col("key")), F.lit(": "), "text")).otherwise(F.col("text"))
        made = (
            done.select("row", F.slice("path", 1, depth - 1).alias("path"), order.alias("order"), shown.alias("shown"))
            .groupBy("row", "path")
            .agg(F.array_sort(F.collect_list(F.struct("order", "shown"))).alias("listed"))
            .select("row", "path", F.transform("listed", lambda x: x["shown"]).alias("parts"))
        )
        made = stage(made, "parts")
    return docs.join(made, "_row", "left").drop("_row")
