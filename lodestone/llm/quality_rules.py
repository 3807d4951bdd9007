"""Quality rules as a short-circuit cascade of column expressions.

A rule is a condition that rejects a text. Rules are timed and counted on a
bounded sample: a cost is the median of a few runs less that of an empty job, and
no less than what such jobs differ by, so rules that the clock can't tell apart are
ordered by rejections alone. Rules are then put in order of rejections per second,
counting only rows that no rule before rejects, and evaluated in that order by one
CASE whose later branches are not reached once an earlier one holds. The order
changes cost and which rule is named first, never whether a text is kept.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text_stats as S
from lodestone.llm.common import stage, texts


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the columns that :func:`measured` gives (and ``text``)."""

    name: str
    rejects: Callable[[], Column]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``; a null text has none."""
    text, words = F.col("text"), F.col("_words")
    return (
        texts(docs)
        .withColumn("_words", S.words_of(text))
        .select(
            "doc_id",
            "text",
            F.size(words).cast("long").alias("n_words"),
            S.word_chars(text).alias("word_chars"),
            S.count_of(text, S.SYMBOLS).alias("n_symbols"),
            S.let(S.lines_of(text), S.repeats).alias("n_dup_lines"),
            S.repeat_words(words).alias("n_repeat_words"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _upper() -> Column:
    return F.length(F.regexp_replace("text", r"\P{Lu}+", ""))


def _with_letter() -> Column:
    return F.size(F.filter(S.words_of(F.col("text")), lambda w: w.rlike(r"\p{L}")))


# Thresholds of the default rules: fixed values of this library.
DEFAULT_RULES = (
    Rule("words_long_or_short", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))),
    Rule("many_symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule("repeated_lines", lambda: (F.col("n_dup_lines") > 1) & (100 * F.col("n_dup_lines") > 40 * F.size(S.lines_of(F.col("text"))))),
    Rule("upper_case", lambda: 100 * _upper() > 30 * F.col("word_chars")),
    Rule("exclamations", lambda: 100 * S.count_of(F.col("text"), "!") > 20 * F.col("n_words")),
    Rule("few_letters", lambda: 100 * _with_letter() < 70 * F.col("n_words")),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


# Runs of each rule over the sample, and how often a run goes over it, so that work outweighs the start of a job.
RUNS, PASSES = 3, 8


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000) -> tuple[list[Estimate], dict[int, int]]:
    """Seconds and rejections of each rule over a staged sample of about ``sample_rows`` rows that pass the base rule.

    Also how many of the sample's rows each set of rules rejects, bit ``i`` for the ``i``-th rule; there are no more sets
    than rows. Rows are picked by a hash of their id, so repeated ids come or stay together; the sample decides order only.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 40)) < F.lit(share * (1 << 40)))
    sample = stage(measured(stage(chosen.select("doc_id", "text"), "rule_texts")).filter(~base_failed()), "rule_sample")
    verdicts = [F.coalesce(rule.rejects(), F.lit(False)) for rule in rules]
    bits = sum((F.when(v, F.lit(1 << i)).otherwise(0) for i, v in enumerate(verdicts)), F.lit(0)).cast("long")
    together = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
    again = sample.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))

    def seconds(condition: Column) -> list[float]:
        job, spent = again.agg(F.count_if(condition)), []
        job.first()  # compiles
        for _ in range(RUNS):
            began = time.perf_counter()
            job.first()
            spent.append(time.perf_counter() - began)
        return spent

    # The empty job reads the same columns.
    empty = seconds((F.length("text") + F.col("n_words") + F.col("word_chars") + F.col("n_symbols") + F.col("n_dup_lines")) < 0)
    start, least = statistics.median(empty), max(empty) - min(empty)
    costs = [max(statistics.median(seconds(v)) - start, least) for v in verdicts]
    rejected = [sum(n for mask, n in together.items() if mask >> i & 1) for i in range(len(rules))]
    return [Estimate(*e) for e in zip(rules, costs, rejected, strict=True)], together


def ordered(estimates: Sequence[Estimate], together: dict[int, int] | None = None) -> list[Rule]:
    """Rules by rejections per second, most first; ties keep the given order.

    With ``together`` (rows by the set of rules that reject them) a rule counts only rows that no rule before it rejects.
    """
    if together is None:
        return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]
    left, out = list(range(len(estimates))), []
    while left:
        counts = {i: sum(n for mask, n in together.items() if mask >> i & 1) for i in left}
        best = max(left, key=lambda i: (Estimate(estimates[i].rule, estimates[i].seconds, counts[i]).worth, -i))
        out.append(estimates[best].rule)
        left.remove(best)
        together = {mask: n for mask, n in together.items() if not mask >> best & 1}
    return out


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 2000) -> DataFrame:
    """Statistics of every row of ``docs`` with ``base_failed, rejected_by, kept``; one row for each input row.

    Empty and null texts fail the base rule. ``rejected_by`` is ``base`` or the first rule of the estimated order.
    """
    table = measured(docs).withColumn("base_failed", base_failed())
    plan = ordered(*estimate(docs, rules, sample_rows))
    return (
        table.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(plan)))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("text")
    )
