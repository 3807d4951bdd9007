"""The registered queries of this folder: each operator over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import (
    alignment,
    chat_format,
    decontamination,
    license_scan,
    mixing,
    near_dedup,
    personal_data,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_store,
    url_filter,
    vector_codes,
)
from lodestone.llm.common import configure, read, stage
from lodestone.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(configure(spark), root)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_token_output")
def op1_token_output(spark: SparkSession, root: str) -> DataFrame:
    """Ids of all documents, written to the token format and read back from it."""
    folder = fresh_path(spark, "tokens")
    token_store.write_tokens(read(spark, root, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.stored_documents(spark, folder)


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, root, "documents"), percent=85)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.judge(read(spark, root, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality_classifier.scored(read(spark, root, "documents"), read(spark, root, "labels"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, root: str) -> DataFrame:
    mix = mixing.mixed(read(spark, root, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """The documents that hold a benchmark item, one row for each item they hold."""
    return decontamination.leaks(read(spark, root, "documents"), read(spark, root, "benchmark"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return _span_digest(secret_scan.find_secrets(read(spark, root, "documents")), [r.kind for r in secret_scan.BASE_RULES])


def _span_digest(found: DataFrame, base: list[str], *more: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of ``found`` (kinds, starts, ends)."""
    spans = F.arrays_zip(F.col("kinds").alias("k"), F.col("starts").alias("s"), F.col("ends").alias("e"))

    def joined(x):
        return F.array_join(F.transform(x, lambda v: F.concat_ws(":", v["k"], v["s"].cast("string"), v["e"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter(spans, lambda v: v["k"].isin(base))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        *more,
    )


@query("op12_pii")
def op12_pii(spark: SparkSession, root: str) -> DataFrame:
    """Personal data of every document; ``scores`` go with ``spans``."""
    found = personal_data.find_personal_data(read(spark, root, "documents"))
    scored = found.withColumn("scores", F.array_join(F.transform("scores", lambda x: x.cast("string")), ","))
    return _span_digest(scored, [k.name for k in personal_data.BASE_KINDS], "scores")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Every document aligned by two tokenizers, with the corpus-wide counts of its pairs of ids."""
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    found = alignment.aligned(read(spark, root, "documents"), *[public_tokenizers.path(n) for n in names])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


@query("op13_vector_codes")
def op13_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    return vector_codes.compressed(read(spark, root, "embeddings"))


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.judge(read(spark, root, "pages"))


@query("op2_chat_format")
def op2_chat_format(spark: SparkSession, root: str) -> DataFrame:
    """All conversations and one, numbered -1, whose texts are control strings; formatted, written, and read back."""
    spoof = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    turns = read(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(spoof)
    windows = stage(chat_format.chat_windows(turns, tokenizer=public_tokenizers.path("byte_bpe_50k.json")), "windows")
    return chat_format.read_back(windows)


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the licenses found in it, by place."""
    found = license_scan.scan(read(spark, root, "documents"))
    return found.select(
        "doc_id",
        F.size("templates").cast("long").alias("n_licenses"),
        F.array_join("templates", ",").alias("licenses"),
        F.array_join(F.transform("first_words", lambda x: x.cast("string")), ",").alias("first_words"),
        F.array_join(F.transform("last_words", lambda x: x.cast("string")), ",").alias("last_words"),
    )
