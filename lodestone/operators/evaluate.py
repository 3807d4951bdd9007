"""Batched literal queries, retrieval quality, citations and output cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import lookup


def phrase_matches(queries: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, session_id, seq) of every event whose text contains a query text verbatim.

    No query meets every event: each is looked up by its rarest anchor. Anchors
    are the words strictly inside the phrase, which a containing text must have
    as whole words; a phrase of fewer than three words uses its three-character
    pieces, a shorter one itself. An empty phrase matches nothing. The text itself
    decides last.
    """
    # copies of a phrase are looked up once
    asked = queries.select(F.col("query_id").alias("_asked"), F.sha2("text", 256).alias("query_id"))
    queries = queries.select(F.sha2("text", 256).alias("query_id"), "text").distinct()
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    inner = F.when(F.size("_w") >= 3, F.slice("_w", F.lit(2), F.size("_w") - 2))
    q = queries.filter(F.length("text") > 0).withColumn("_w", F.split("text", r"\s+")).withColumn("_inner", inner)
    by_word = q.filter("_inner is not null").select("query_id", "text", F.explode(F.array_distinct("_inner")).alias("anchor"))
    # The piece path is planned only where some phrase needs it.
    short = q.filter("_inner is null")

    def matched(anchors: DataFrame, postings: DataFrame) -> DataFrame:
        wanted = anchors.select("anchor").distinct()
        held = postings.join(wanted, "anchor", "left_semi")
        df = held.groupBy("anchor").agg(F.count("*").alias("df"))
        rare = (
            lookup(anchors, df, ["anchor"])
            .groupBy("query_id")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("r"))
            .filter("r.df > 0")
            .select("query_id", F.col("r.anchor").alias("anchor"))
        )
        pairs = held.join(rare, "anchor").select("query_id", "session_id", "seq")
        texts = events.select("session_id", "seq", F.col("text").alias("_text"))
        return (
            pairs.join(queries.select("query_id", "text"), "query_id")
            .join(texts, ["session_id", "seq"])
            .filter(F.contains("_text", F.col("text")))
            .select("query_id", "session_id", "seq")
        )

    word_postings = events.select("session_id", "seq", F.explode(F.array_distinct(words(F.col("text")))).alias("anchor"))
    found = matched(by_word, word_postings)
    named = lambda df: df.join(asked, "query_id").drop("query_id").withColumnRenamed("_asked", "query_id")
    if short.isEmpty():
        return named(found)
    pieces = lambda c, n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n))
    )
    text = F.col("text")
    by_piece = short.select("query_id", "text", F.explode(F.array_distinct(pieces(text, 3))).alias("anchor"))
    every = F.array_distinct(F.concat(*[pieces(text, n) for n in (1, 2, 3)]))
    piece_postings = events.select("session_id", "seq", F.explode(every).alias("anchor"))
    return named(found.unionByName(matched(by_piece, piece_postings)))


def retrieval_eval(expected: DataFrame, returned: DataFrame, queries: DataFrame) -> DataFrame:
    """Expected, returned, true positives, precision and recall of every query.

    Both sides are (query_id, event_id). Nothing returned is precise where
    nothing was expected; nothing expected is fully recalled.
    """
    e = expected.select("query_id", "event_id").distinct().withColumn("_e", F.lit(1))
    r = returned.select("query_id", "event_id").distinct().withColumn("_r", F.lit(1))
    counts = e.join(r, ["query_id", "event_id"], "full").groupBy("query_id").agg(
        F.count("_e").alias("expected"),
        F.count("_r").alias("returned"),
        F.count_if(F.col("_e").isNotNull() & F.col("_r").isNotNull()).alias("true_positives"),
    )
    every = queries.select("query_id").distinct().join(counts, "query_id", "left").na.fill(
        0, ["expected", "returned", "true_positives"]
    )
    tp = F.col("true_positives")
    return every.select(
        "query_id",
        "expected",
        "returned",
        "true_positives",
        F.when(F.col("returned") > 0, tp / F.col("returned"))
        .otherwise(F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .alias("precision"),
        F.when(F.col("expected") > 0, tp / F.col("expected")).otherwise(F.lit(1.0)).alias("recall"),
    )


def verify_citations(cited: DataFrame, source: DataFrame) -> DataFrame:
    """Check cited events against the source lines they point to.

    ``cited`` has session_id, seq, source_file, line, text, timestamp and
    source_event_id; ``source`` is (source_file, line, text, timestamp,
    source_event_id) read from the transcripts again.
    """
    there = source.select(
        "source_file",
        "line",
        F.col("text").alias("_text"),
        F.col("timestamp").alias("_timestamp"),
        F.col("source_event_id").alias("_id"),
        F.lit(True).alias("_there"),
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) & F.col("_there").isNotNull()
    return cited.join(there, ["source_file", "line"], "left").select(
        "session_id",
        "seq",
        same("text", "_text").alias("text_exact"),
        same("timestamp", "_timestamp").alias("timestamp_exact"),
        same("source_event_id", "_id").alias("locator_exact"),
    )


def terms_visible(matches: DataFrame, terms: list[str]) -> DataFrame:
    """Matches whose excerpt shows every term."""
    low = F.lower(F.regexp_replace("excerpt", "[«»]", ""))
    shown = F.lit(True)
    for t in terms:
        shown = shown & F.contains(low, F.lit(t.lower()))
    return matches.agg(F.count("*").alias("matches"), F.count_if(shown).alias("all_terms_visible"))


def output_cost(outputs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Totals and means of output measures per product, mode and suite."""
    aggs = [F.count("*").alias("queries")]
    for m in measures:
        aggs += [F.sum(m).alias(m), F.avg(m).alias(f"mean_{m}")]
    return outputs.groupBy(*by).agg(*aggs)
