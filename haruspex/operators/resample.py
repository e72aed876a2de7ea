"""Clustered and paired resampling, paired differences, and the event gate."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 20260822


def clusters(df: DataFrame, value: str | Column, cluster: str) -> DataFrame:
    """(cluster, s, n): all that a clustered resample needs."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(v).alias("s"), F.count("*").alias("n"))


def hash_bootstrap(df: DataFrame, value: str | Column, cluster: str, *, level: float = 0.95, resamples: int = 200, salt: str = "boot", draws: str = "sha256") -> DataFrame:
    """Percentile interval of the mean; each cluster enters a resample as often as a Poisson(1) draw by hash says.

    Draws come from a hash of salt, resample and cluster (sha256, or xxhash, which is ten times as fast), so there is
    no generator state: every cluster is expanded to its resamples where it lies, and partial sums by resample are
    all that is shuffled.
    """
    # cluster sums are small, the work on them isn't: a stated number of partitions keeps all cores busy
    spread = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = clusters(df, value, cluster).repartition(spread, "cluster")
    # a draw's first 32 bits are held against the cuts as they are, in hexadecimal or as a number
    if draws == "sha256":
        u, cut = F.sha2(F.concat_ws(":", F.lit(salt), F.col("b").cast("string"), F.col("cluster").cast("string")), 256), lambda c: F.lit(f"{c:08x}")
    elif draws == "xxhash":
        u, cut = F.xxhash64(F.lit(salt), "b", "cluster").bitwiseAND(F.lit((1 << 32) - 1)), F.lit
    else:
        raise ValueError(f"no such draws: {draws}")
    tail, cuts = 0.0, []
    for k in range(8):
        tail += math.exp(-1) / math.factorial(k)
        cuts.append(math.ceil(tail * 2**32))
    # compiled projections one after the other: what is named more than once is computed once, and clusters not drawn add nothing
    times = F.when(F.col("u") < cut(cuts[0]), F.lit(None).cast("int"))
    for k, c in enumerate(cuts[1:], 1):
        times = times.when(F.col("u") < cut(c), k)
    drawn = grouped.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).select("b", "s", "n", u.alias("u")).select("b", "s", "n", times.otherwise(len(cuts)).alias("k"))
    means = drawn.groupBy("b").agg(F.sum(F.col("k") * F.col("s")).alias("s"), F.sum(F.col("k") * F.col("n")).alias("n")).where("n is not null").select(F.try_divide("s", "n").alias("mean"))
    lo = (1 - level) / 2
    point = grouped.agg((F.sum("s") / F.sum("n")).alias("point"), F.count("*").alias("n_clusters"), F.sum("n").alias("n_observations"))
    return means.agg(F.percentile("mean", lo).alias("lower"), F.percentile("mean", 1 - lo).alias("upper"), F.count("*").alias("n_resamples")).crossJoin(point)


def vector_bootstrap(df: DataFrame, value: str | Column, cluster: str, *, level: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """hash_bootstrap for many resamples: a task adds its clusters' draws to one vector of sums, and only vectors move.

    A cluster enters resample b as often as a Poisson(1) draw by a 64-bit mix of seed, cluster and b says.
    """
    import numpy as np

    grouped = clusters(df, value, cluster)
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    limits = (cuts * 2.0**32).astype(np.uint64)

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    def sums(batches):
        total = np.zeros((2, resamples))
        steps = mix(np.arange(resamples, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B9))
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                h, s, n = (pdf[c].to_numpy()[lo : lo + 64] for c in ("h", "s", "n"))
                u = mix(h.astype(np.int64).view(np.uint64)[:, None] ^ steps[None, :]) >> np.uint64(32)
                times = np.searchsorted(limits, u.ravel(), side="right").reshape(u.shape)
                total += np.stack([s.astype(float), n.astype(float)]) @ times
        yield pd.DataFrame({"b": np.arange(resamples), "s": total[0], "n": total[1]})

    spread = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = grouped.select(F.xxhash64("cluster").alias("h"), F.col("s").cast("double").alias("s"), "n").repartition(spread, "h").mapInPandas(sums, "b long, s double, n double")
    means = drawn.groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    lo = (1 - level) / 2
    point = grouped.agg((F.sum("s") / F.sum("n")).alias("point"), F.count("*").alias("n_clusters"), F.sum("n").alias("n_observations"))
    return means.agg(F.percentile("mean", lo).alias("lower"), F.percentile("mean", 1 - lo).alias("upper"), F.count("mean").alias("n_resamples")).crossJoin(point)


def exact_bootstrap(rows: list[tuple[float, int]], *, level: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float, float]:
    """(point, lower, upper) from cluster sums in order of first appearance, with the serial generator and its seed.

    The generator is serial by nature, so this runs on the driver over one pair of numbers a cluster.
    """
    rng, m = random.Random(seed), len(rows)
    means = []
    for _ in range(resamples):
        s = n = 0
        for _ in range(m):
            x = rows[rng.randrange(m)]
            s, n = s + x[0], n + x[1]
        means.append(s / n)
    means.sort()

    def quantile(q: float) -> float:
        at = q * (len(means) - 1)
        lo = int(at)
        hi = min(lo + 1, len(means) - 1)
        return means[lo] + (at - lo) * (means[hi] - means[lo])

    tail = (1 - level) / 2
    return sum(s for s, _ in rows) / sum(n for _, n in rows), quantile(tail), quantile(1 - tail)


def paired_delta(df: DataFrame, arm: str, baseline: str, y: str = "y", z: float = 1.96, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, n, mean, lower, upper) of the difference of squared errors on the same rows."""
    sq = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    d = sq(arm) - sq(baseline)
    half = z * F.sqrt(F.var_samp(d) / F.count(d))
    n, mean = F.count(d), F.coalesce(F.avg(d), F.lit(0.0))
    inf = F.lit(float("inf"))
    edge = F.when(n == 0, F.lit(0.0)).when(n == 1, inf).otherwise(half)
    return df.groupBy(*group).agg(n.alias("n"), mean.alias("mean"), F.when(n == 1, -inf).otherwise(mean - edge).alias("lower"), F.when(n == 1, inf).otherwise(mean + edge).alias("upper"))


def event_gate(df: DataFrame, arm: str, baseline: str, mechanism: str, *, minimum_event_questions: int, y: str = "y", z: float = 1.96) -> DataFrame:
    """One row: differences overall, on event and on threshold questions, and the verdict."""
    if minimum_event_questions < 1:
        raise ValueError("minimum_event_questions is 1 or more")
    sq = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    rows = df.withColumn("d", sq(arm) - sq(baseline))
    parts = {"all": F.lit(True), "event": F.col(mechanism) == "event", "threshold": F.col(mechanism) == "threshold"}
    cols = []
    for k, c in parts.items():
        d = F.when(c, F.col("d"))
        half = F.when(F.count(d) == 1, F.lit(float("inf"))).otherwise(F.coalesce(z * F.sqrt(F.var_samp(d) / F.count(d)), F.lit(0.0)))
        mean = F.coalesce(F.avg(d), F.lit(0.0))
        cols += [F.count(d).alias(f"n_{k}"), mean.alias(f"mean_{k}"), (mean - half).alias(f"lower_{k}"), (mean + half).alias(f"upper_{k}")]
    out = rows.agg(*cols)
    verdict = (
        F.when(F.col("n_event") < minimum_event_questions, "underpowered").when(F.col("lower_event") > 0, "event_slice_degraded")
        .when((F.col("upper_all") < 0) & ~(F.col("upper_event") < 0), "trained_distribution_only").otherwise("pass")
    )
    return out.withColumn("verdict", verdict)
