"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow regression trees are grown on residuals over bootstrap samples; every path from a root to a node is a
conjunction of thresholds, a candidate rule. A logistic model with an L1 penalty weighs the rules and most weights
become zero. What is left is compiled into a Spark column over the statistics, so scoring runs without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, WORD, crc_mod, table, without

MAX_LABELS = 20_000  # labelled rows to learn from, at most: those of the smallest hash of the id
TREES, DEPTH, BINS, PENALTY, RATE, SEED = 40, 3, 32, 0.004, 0.3, 7
THRESHOLD = 0.3
STATISTICS = ("log_words", "word_length", "symbols", "shouts", "capitals", "digits", "distinct", "ended_lines", "bars", "line_words", "commas", "line_repeats")


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the statistics (doubles) of each whole text; a null text counts as empty, all zero."""
    whole = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("double")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(x) > 0)
    raw = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.length(whole).cast("double").alias("c"), count(WORD).alias("w"), count(r"[\x20\x09-\x0D]").alias("s"),
        count(r"[#*$%&|<>]").alias("sy"), count(r"[!?]{2,}").alias("sh"), count(r"\p{Lu}").alias("up"), count(r"[0-9]").alias("di"),
        F.size(F.array_distinct(F.split(whole, SPACE))).cast("double").alias("ds"), count(r"[.!?][\x20\x09\x0D]*(?:\n|\z)").alias("en"),
        count(r"[\x20\x09][|][\x20\x09]").alias("ba"), count(r",").alias("co"), F.size(lines).cast("double").alias("li"), F.size(F.array_distinct(lines)).cast("double").alias("dl"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    letters = F.greatest(F.col("c") - F.col("s"), F.lit(0.0))
    return raw.select(
        *[F.col(f"`{c}`") for c in keep], F.log1p("w").alias("log_words"), F.when(F.col("w") > 0, letters / F.col("w")).otherwise(0.0).alias("word_length"),
        per("sy", "w").alias("symbols"), per("sh", "w").alias("shouts"), F.when(letters > 0, F.col("up") / letters).otherwise(0.0).alias("capitals"), F.when(letters > 0, F.col("di") / letters).otherwise(0.0).alias("digits"),
        F.when(F.col("w") > 0, F.col("ds") / F.col("w")).otherwise(0.0).alias("distinct"), per("en", "li").alias("ended_lines"), per("ba", "w").alias("bars"), per("w", "li").alias("line_words"), per("co", "w").alias("commas"),
        F.when(F.col("li") > 0, 1 - F.col("dl") / F.col("li")).otherwise(0.0).alias("line_repeats"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) each; above: value > threshold, else <=


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score of a row of statistics, 0 to 1."""
        terms = [F.when(reduce(Column.__and__, [F.col(STATISTICS[s]) > t if up else F.col(STATISTICS[s]) <= t for s, up, t in rule]), F.lit(w)).otherwise(0.0) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(self.intercept))))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * covers(rule, x)
        return 1 / (1 + np.exp(-z))


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [x[:, s] > t if up else x[:, s] <= t for s, up, t in rule])


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], r: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule], pred: np.ndarray) -> None:
    if path:
        out.append(path)
    best, n, total = (1e-9, -1, -1), len(rows), r[rows].sum()
    if depth and n >= 10:
        for s in range(codes.shape[1]):
            k = len(cuts[s])
            if not k:
                continue
            c = codes[rows, s]
            left_n = np.cumsum(np.bincount(c, minlength=k + 1))[:k]
            left = np.cumsum(np.bincount(c, weights=r[rows], minlength=k + 1))[:k]
            ok = (left_n >= 3) & (n - left_n >= 3)
            gain = np.where(ok, left**2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, -1)
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), s, j)
    _, s, j = best
    if s < 0:
        pred[rows] = total / max(n, 1)
        return
    up = codes[rows, s] > j
    for side, flag in ((rows[~up], False), (rows[up], True)):
        _grow(x, codes, cuts, r, side, depth - 1, (*path, (s, flag, float(cuts[s][j]))), out, pred)


def candidate_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of TREES trees of depth DEPTH, each grown on the residuals of a random half."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(np.unique(np.quantile(middle, np.linspace(0, 1, BINS), method="nearest")) if len(middle) else middle)
    codes = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1)
    rng, f, rules = np.random.default_rng(SEED), np.full(len(y), y.mean()), []
    for _ in range(TREES):
        rows, pred = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)]), np.zeros(len(y))
        found: list[Rule] = []
        _grow(x, codes, cuts, y - f, rows, DEPTH, (), found, pred)
        f[rows] += RATE * pred[rows]
        rules += found
    return list(dict.fromkeys(rules))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 800) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient steps."""
    n = len(y)
    a = np.hstack([np.ones((n, 1)), z]).astype(np.float64)
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(a.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rows(x: np.ndarray, y: np.ndarray) -> Model:
    """A single class, or no row: a constant score."""
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else 4.0 if y[0] else -4.0)
    rules = candidate_rules(x, y)
    keep, seen = [], set()
    for rule in rules:  # rules that cover the same rows say the same
        z = covers(rule, x)
        key = z.tobytes()
        if 0 < z.sum() < len(z) and key not in seen:
            seen.add(key)
            keep.append((rule, z))
    b, w = lasso(np.stack([z for _, z in keep], axis=1) if keep else np.zeros((len(y), 0)), y)
    return Model(b, [(rule, float(v)) for (rule, _), v in zip(keep, w) if abs(v) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learns from labelled rows whose crc32(doc_id) modulo 5 is not 0, MAX_LABELS at most; null labels teach nothing.

    Of documents that share a doc_id and a label one teaches, that of the smallest statistics, so at most MAX_LABELS rows
    come to the driver. Empty tables give a constant score. Runs jobs when called."""
    known = labels.where(F.col(label).isNotNull() & (crc_mod("doc_id", 5) != 0)).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(MAX_LABELS).distinct()
    # At most MAX_LABELS rows of two numbers: small enough to broadcast.
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    one = statistics(joined, keep=("id", "y")).groupBy("id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("id", "y", "s.*")
    rows = one.toPandas().sort_values(["id", "y", *STATISTICS])
    return fit_rows(rows[list(STATISTICS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score (double, 0 to 1) and predicted (1 from THRESHOLD on) of every row.

    Null and empty texts are scored by their all-zero statistics. Repeated rows are scored alike; an empty table
    gives no rows. Only the kept columns and the text are read; kept columns named like a result are replaced.
    """
    names = tuple(without(docs.select(*[F.col(f"`{c}`") for c in keep]), ["score", "predicted", *STATISTICS]).columns)
    scored = statistics(docs, text, names).withColumn("score", model.column())
    return scored.select(*names, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """score of all documents; null doc_ids are not held out. Runs jobs when called."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.coalesce(crc_mod("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), "score", "predicted")
