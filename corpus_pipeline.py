"""From raw documents to token blocks: five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``, whatever those are.

A ``doc_id`` names a document. Where it stands on several rows, the quality and benchmark stages drop all of them if
one is rejected, and the near-duplicate stage keeps equal rows once. Null ids are an id like others. Null and empty
texts are scored as empty, are no near-duplicates of anything, and have no words to mix: no copy of them is taken.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, near_dedup, quality_classifier, token_store
from lodestone.llm.common import configure, read, stage
from lodestone.session import fresh_path

# Up to so many ids, some 10 MB, are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 200_000
# The stage has no contract of its own: near-duplicates agree in four fifths of their shingles. Such a pair misses all 40 bands
# of 5 minima with a chance of 1e-7, and the signature floor with about as much.
NEAR = {"percent": 80, "bands": 40, "rows": 5, "floor": 0.64}
# SQL cannot state the stages; a test holds three of them against brute force, quality and benchmark against their operators.
ORACLE_SQL = None


def _sent(ids: DataFrame) -> tuple[DataFrame, bool]:
    """The ids (``_id``, staged, distinct) that are not null, to be broadcast if they are few; and whether null is one."""
    rows, named = ids.agg(F.count("*"), F.count("_id")).first()
    some = ids.filter("_id is not null")
    return F.broadcast(some) if named <= BROADCAST_IDS else some, rows > named


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or is not (``left_anti``) among ``ids``; null is an id."""
    ids, null_too = _sent(stage(ids.select(F.col("doc_id").alias("_id")).distinct(), "ids"))
    found = docs.join(ids, docs["doc_id"] == ids["_id"], how)
    if how == "left_semi":
        return found.unionByName(docs.filter(docs["doc_id"].isNull())) if null_too else found
    return found.filter(docs["doc_id"].isNotNull()) if null_too else found


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality_classifier.scored(docs, read(configure(spark), sf_dir, "labels"))
    return _by_id(docs, scored.filter("predicted = 0"), "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    configure(spark)
    found = near_dedup.near_duplicates(docs, **NEAR)
    rows = stage(found.groupBy("doc_id").agg(F.count_if("kept").alias("n")).filter("n <> 1"), "not_once")
    docs = _by_id(docs, rows.filter("n = 0"), "left_anti")
    repeated = rows.filter("n > 1")
    if repeated.isEmpty():
        return docs
    return _by_id(docs, repeated, "left_anti").unionByName(_by_id(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _by_id(docs, decontamination.leaks(docs, read(configure(spark), sf_dir, "benchmark")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Columns travel in a struct, so their names meet no others."""
    configure(spark)
    taken = mixing.mixed(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("copies"))
    taken = stage(taken.filter("copies > 0"), "copies")
    some, null_too = _sent(taken)
    rows = docs.select(F.struct("*").alias("row"))
    found = rows.join(some, F.col("row.doc_id") == F.col("_id")).select("row", "copies")
    if null_too:
        unnamed = taken.filter("_id is null").select("copies")
        found = found.unionByName(rows.filter("row.doc_id is null").join(F.broadcast(unnamed)).select("row", "copies"))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token blocks, and per stored document what was read back from them."""
    folder = fresh_path(configure(spark), "tokens")
    token_store.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.stored_documents(spark, folder)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = read(configure(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return docs
