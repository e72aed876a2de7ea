"""A multinomial naive Bayes categoriser over words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize


class NaiveBayes:
    """priors (label, prior) and totals (label, total), both one row a label; weights (token, label, w); v words in all."""

    def __init__(self, train: DataFrame, text: str = "text", label: str = "label"):
        rows = train.select(F.col(label).alias("label"), tokenize(F.col(text)).alias("tokens"))
        every = Window.partitionBy(F.lit(0))
        docs = rows.groupBy("label").count()
        self.priors = docs.select("label", F.ln(F.col("count") / F.sum("count").over(every)).alias("prior"))
        counts = rows.select("label", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count("*").alias("c"))
        self.vocabulary = counts.select("token").distinct()
        v = self.vocabulary.agg(F.count("*").alias("v"))
        totals = counts.groupBy("label").agg(F.sum("c").alias("total"))
        self.labels = self.priors.join(totals, "label", "left").crossJoin(F.broadcast(v)).select("label", "prior", F.ln(1 / (F.coalesce("total", F.lit(0)) + F.col("v"))).alias("floor"))
        # what a counted word adds over an unseen one
        self.weights = counts.select("token", "label", F.ln(F.col("c") + F.lit(1.0)).alias("gain"))

    def scores(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, label, score): log posterior up to a constant; unknown words are dropped.

        A word scores floor(label) wherever it is known, plus its gain where the label has it: so only counted
        (word, label) pairs are joined, and no row is made for all labels of all words.
        """
        words = df.select(key, F.explode_outer(tokenize(F.col(text))).alias("token"))
        known = words.join(self.vocabulary.withColumn("known", F.lit(1)), "token", "left")
        n = known.groupBy(key).agg(F.count("known").alias("n"))
        gains = words.join(self.weights, "token").groupBy(key, "label").agg(F.sum("gain").alias("gain"))
        every = n.crossJoin(F.broadcast(self.labels))  # labels: a small fixed vocabulary
        return every.join(gains, [key, "label"], "left").select(key, "label", (F.col("prior") + F.col("n") * F.col("floor") + F.coalesce("gain", F.lit(0.0))).alias("score"))

    def predict(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, label, score, runner_up); ties go to the label first in the alphabet."""
        order = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "label")))
        best = self.scores(df, key, text).groupBy(key).agg(order.alias("x"))
        return best.select(key, F.col("x")[0]["label"].alias("label"), (-F.col("x")[0]["s"]).alias("score"), F.get("x", F.lit(1))["label"].alias("runner_up"))
