"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are Spark columns. Shallow trees are boosted on a bounded sample of labelled documents;
every path from a root to a node is a conjunctive rule; a lasso logistic regression keeps a few rules, and those
are compiled back into one Spark column: no Python runs where documents are scored.

Edge cases: null and empty texts have all statistics zero and are scored by them; statistics are never null;
without labels, with labels of one kind, or with too few to split, the score is the smoothed share of label 1; a
statistic equal to a rule's limit is below it, and a score equal to the threshold is predicted 1; very long texts are
taken whole by Spark's own functions; repeated rows keep their rows; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labelled import SAMPLE, held_out, sample

TREES = 30
DEPTH = 3
BINS = 24
PENALTY = 0.002
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a double that is never null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t)
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    tokens = F.split(t, r"[\x20\x09-\x0D]+")
    count = lambda chars: n - F.length(F.translate(t, chars, ""))
    share = lambda a, b: F.coalesce(a.cast("double") / F.when(b > 0, b), F.lit(0.0))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "n_words": F.log1p(words.cast("double")),
        "word_length": share(n, words),
        "upper": share(count(upper), n),
        "lower": share(count(lower), n),
        "digits": share(count("0123456789"), n),
        "symbols": share(count("#*$%&<>{}[]\\^~=+@_"), words),
        "bars": share(count("|"), words),
        "shouts": share(count("!?"), words),
        "stops": share(count(".,;:"), words),
        "line_feeds": share(count("\n"), words),
        "distinct_words": share(F.size(F.array_distinct(tokens)), F.size(tokens)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


class _Tree:
    """Regression tree on binned statistics, by squared error of the gradients."""

    def __init__(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int):
        self.nodes: list[tuple] = []  # (feature, bin) conditions of each node's path, its value
        self._grow(x, g, h, np.arange(len(x)), (), depth, least)

    def _grow(self, x, g, h, rows, path, depth, least):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if path:
            self.nodes.append(path)
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                own = x[rows, f]
                cg = np.cumsum(np.bincount(own, g[rows], BINS + 1))[:-1]
                ch = np.cumsum(np.bincount(own, h[rows], BINS + 1))[:-1]
                cn = np.cumsum(np.bincount(own, minlength=BINS + 1))[:-1]
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                gain[(cn < least) | (len(rows) - cn < least)] = 0
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (gain[b], f, b)
        if best[1] is None:
            self.fit = getattr(self, "fit", np.zeros(len(x)))
            self.fit[rows] = -total_g / (total_h + 1)
            return
        _, f, b = best
        left = x[rows, f] <= b
        self._grow(x, g, h, rows[left], (*path, (f, b, True)), depth - 1, least)
        self._grow(x, g, h, rows[~left], (*path, (f, b, False)), depth - 1, least)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Rules as tuples of (statistic, bin, at most), from boosted trees on binned statistics."""
    f, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = _Tree(x, p - y, np.maximum(p * (1 - p), 1e-6), depth, max(5, len(y) // 500))
        rules += tree.nodes
        f += 0.3 * tree.fit
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient: weights (most of them zero) and an unpenalised intercept."""
    n, k = z.shape
    step = 4 / max(np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n, 1e-9)
    w = np.zeros(k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(z @ v[:-1] + v[-1], -30, 30))) - y
        new = v - step * np.append(z.T @ r, r.sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


class RuleEnsemble:
    """rules: (((statistic, limit, at most), ...), weight) and an intercept."""

    def __init__(self, rules: list[tuple], intercept: float):
        self.rules, self.intercept = rules, intercept

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> RuleEnsemble:
        picked = sample(docs, labels, label, rows)
        stats = statistics(F.col("text"))
        table = picked.select("label", *(c.alias(k) for k, c in stats.items())).toArrow()  # of the sample, some numbers a row
        y = table["label"].to_numpy().astype(float) if table.num_rows else np.zeros(0)
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1)
            return cls([], float(np.log(share / (1 - share))))
        names = list(stats)
        x = np.column_stack([table[k].to_numpy() for k in names])
        limits = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(q, c, side="left") for q, c in zip(limits, x.T)])
        found = [r for r in grow_rules(binned, y) if all(b < len(limits[f]) for f, b, _ in r)]
        if not found:  # too few rows to split
            return cls([], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
        z = np.column_stack([np.logical_and.reduce([(binned[:, f] <= b) == low for f, b, low in r]) for r in found]).astype(float)
        weights, intercept = lasso_logistic(z, y)
        kept = [(tuple((names[f], float(limits[f][b]), low) for f, b, low in r), float(w)) for r, w in zip(found, weights) if abs(w) > 1e-4]
        return cls(kept, intercept)

    def column(self, columns: dict[str, Column] | None = None) -> Column:
        """The score as one Spark column over columns named like the statistics (or those given)."""
        at = columns or {}
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for name, limit, low in rule:
                c = at.get(name, F.col(name))
                one = c <= limit if low else c > limit
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, statistics, score) of every document."""
    stats = statistics(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *(c.alias(k) for k, c in stats.items()))
    return rows.withColumn("score", model.column())


def op9_rule_ensemble_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = RuleEnsemble.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
