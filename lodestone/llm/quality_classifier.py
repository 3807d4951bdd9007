"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions over whole texts, written once without the
texts. Small trees are grown by gradient boosting on a bounded sample of labelled
rows; every path from a root becomes a conjunctive rule, lasso logistic regression
keeps few of them, and the rules are compiled into one Spark column that scores
every row. Neither ids, labels, language nor source enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text_stats as S
from lodestone.llm.common import bounded, stage, texts

Condition = tuple[int, bool, float]  # feature, greater than?, threshold
# Labelled rows that a model may learn from, whatever the size of the table.
MAX_LABELLED = 12_000

FEATURES = (
    "log_words", "word_length", "symbols", "bangs", "pipes", "marks", "upper", "digits", "distinct", "dup_lines", "line_words",
)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and :data:`FEATURES` of every row; ratios of an empty text are 0."""
    text, n = F.col("text"), F.col("_n")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    counted = (
        texts(docs)
        .withColumn("_words", S.words_of(text))
        .select(
            "doc_id",
            F.size("_words").alias("_n"),
            F.size(F.array_distinct("_words")).alias("_distinct"),
            S.word_chars(text).alias("_chars"),
            S.let(S.lines_of(text), lambda x: F.struct(F.size(x).alias("n"), S.repeats(x).alias("dup"))).alias("_lines"),
            *[S.count_of(text, c).alias(f"_{k}") for k, c in {"symbols": "#*$%&<>", "bangs": "!", "pipes": "|", "marks": ".,;:?", "digits": "0123456789"}.items()],
            F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("_upper"),
        )
    )
    return counted.select(
        "doc_id",
        F.log1p(n).alias("log_words"),
        ratio(F.col("_chars"), n).alias("word_length"),
        *[ratio(F.col(f"_{k}"), n).alias(k) for k in ("symbols", "bangs", "pipes", "marks")],
        *[ratio(F.col(f"_{k}"), F.col("_chars")).alias(k) for k in ("upper", "digits")],
        ratio(F.col("_distinct"), n).alias("distinct"),
        ratio(F.col("_lines.dup"), F.col("_lines.n")).alias("dup_lines"),
        ratio(n, F.col("_lines.n")).alias("line_words"),
    )


def held_out() -> Column:
    """Rows that are never learnt from: every fifth id by the checksum of its decimal form."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


# ---- fitting, on the bounded sample ----


def grow(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[list[Condition]], np.ndarray]:
    """A boosting tree: the paths to all its nodes but the root, and its value for each row."""
    paths: list[list[Condition]] = []
    value = np.zeros(len(grad))

    def split(rows: np.ndarray, path: list[Condition], left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        value[rows] = g / (h + 1.0)
        if not left or len(rows) < 2 * least:
            return
        best, where = 1e-6 + g * g / (h + 1.0), None
        for f, c in enumerate(cuts):
            k = len(c) + 1
            if k < 2:
                continue
            code = codes[rows, f]
            gs = np.cumsum(np.bincount(code, grad[rows], k))[:-1]
            hs = np.cumsum(np.bincount(code, hess[rows], k))[:-1]
            ns = np.cumsum(np.bincount(code, minlength=k))[:-1]
            gain = gs * gs / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0)
            gain[(ns < least) | (len(rows) - ns < least)] = -1.0
            j = int(np.argmax(gain))
            if gain[j] > best:
                best, where = gain[j], (f, j)
        if where is None:
            return
        f, j = where
        high = codes[rows, f] > j
        for side in (False, True):
            step = [*path, (f, side, float(cuts[f][j]))]
            paths.append(step)
            split(rows[high] if side else rows[~high], step, left - 1)

    split(np.arange(len(grad)), [], depth)
    return paths, value


def boosted_paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 48) -> list[list[Condition]]:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    # A value equal to a cut lies below it, as "greater than" in the rules.
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        paths, value = grow(codes, cuts, y - p, p * (1 - p), depth, least=max(5, len(y) // 500))
        score += 0.5 * value
        for path in paths:
            found[tuple(sorted(path))] = path
    return list(found.values())


def holds(x: np.ndarray, path: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in path:
        out &= (x[:, f] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, strength: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, k = z.shape
    step = 4.0 / max(np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2 / n, 1e-9)
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v[0] + z @ v[1:], -35, 35)))
        new = v - step * np.r_[np.mean(p - y), z.T @ (p - y) / n]
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (was - 1) / t * (new - w), new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        """The score of a row of :data:`FEATURES`, in 0 to 1."""
        total = F.lit(self.intercept)
        for weight, path in self.rules:
            condition = F.lit(True)
            for f, above, cut in path:
                condition &= (F.col(FEATURES[f]) > cut) if above else (F.col(FEATURES[f]) <= cut)
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        def text(path):
            return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {cut:.6g}" for f, above, cut in path)

        return [f"{w:+.3f} if {text(p)}" for w, p in sorted(self.rules, key=lambda r: -abs(r[0]))]


def fit(rows: np.ndarray, trees: int = 12, depth: int = 3, strength: float = 5e-4) -> Model:
    """A model from rows of features with the label last. Without both labels it is their (smoothed) share."""
    x, y = rows[:, :-1], rows[:, -1]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Model(base, ())
    paths = boosted_paths(x, y, trees, depth)
    z = np.stack([holds(x, p) for p in paths], axis=1).astype(float) if paths else np.zeros((len(y), 0))
    if not paths:
        return Model(base, ())
    intercept, weights = lasso(z, y, strength)
    return Model(intercept, tuple((float(w), tuple(p)) for w, p in zip(weights, paths, strict=True) if abs(w) > 1e-6))


def labelled(table: DataFrame, labels: DataFrame, label: str, limit: int) -> np.ndarray:
    """Features and label of at most ``limit`` labelled rows that may be learnt from, in an order of their own."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("double")).alias("_y"))
        .filter(~held_out())
    )
    chosen = bounded(stage(known.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(limit), "labelled"), limit)
    rows = table.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", *FEATURES).limit(limit)
    got = rows.select(*FEATURES, "_y").collect()
    return np.array([[float(v) for v in r] for r in got]).reshape(len(got), len(FEATURES) + 1)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null texts score as empty ones. Labels with a null id or label are left out; of several labels of an id the
    greatest counts. Without labels every score is one half; with labels of one kind, near that kind.
    """
    table = stage(features(docs), "features")
    model = fit(labelled(table, labels, label, max_labelled))
    score = table.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return score.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
