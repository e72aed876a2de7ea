"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most. The sample is the rows of least hash.
SAMPLE = 20_000


def remainder(doc_id, by: int):
    """crc32 of the doc_id as text, modulo by; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def held_out(doc_id):
    """Whether labels of this doc_id may not be learned from; null doc_ids have no label and aren't held out."""
    return F.coalesce(remainder(doc_id, 4) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label int, fold int 0 to 9) of at most ``rows`` labelled documents to learn from.

    Labels that contradict each other count as 1; null labels and labels without a document are left out.
    Equal texts count once, under the least doc_id. The sample's ids are few enough to broadcast.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    picked = picked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = picked.collect()  # at most ``rows`` pairs
    few = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.join(F.broadcast(few), "doc_id")
    first = F.min_by(F.struct("doc_id", "text", "label"), "doc_id").alias("x")
    return own.groupBy(F.xxhash64("text"), F.length("text")).agg(first).select("x.*", F.pmod(F.xxhash64(F.col("x.doc_id"), F.lit(7)), F.lit(10)).cast("int").alias("fold"))


def logistic(x, y, ridge: float = 1e-3, rounds: int = 60):
    """Newton's method: (weights, intercept) of a ridge logistic regression."""
    import numpy as np

    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
