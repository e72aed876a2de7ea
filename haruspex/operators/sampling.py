"""Deterministic samples and training sets, by hash order instead of random draws."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import banker_round
from .ingest import drop_nonpredictive
from .rules import require_columns


class Infeasible(ValueError):
    pass


def sha_order(key: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)


def blake_order(key: Column, salt: str) -> Column:
    """blake2b-64 of salt:key, in hexadecimal; a Python island."""

    @F.pandas_udf("string")
    def h(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.blake2b(f"{salt}:{x}".encode(), digest_size=8).hexdigest())

    return h(key.cast("string"))


#: Leading hexadecimal digits of a hash by which rows are counted to find a cut.
PREFIX = 4


def _cut(rows: DataFrame, order: str, n: int) -> tuple[str | None, int]:
    """(the prefix of hash in which the n-th row in order lies, how many of its rows are among the n).

    The counts, 65,536 at most, say where the cut is, so that no task sorts more than one prefix's rows.
    """
    left = n
    for r in sorted(rows.groupBy(F.substring(order, 1, PREFIX).alias("prefix")).count().collect()):
        if left <= r["count"]:
            return r.prefix, left
        left -= r["count"]
    return None, 0


def hash_first(df: DataFrame, key: str, n: int, salt: str, hasher=sha_order) -> DataFrame:
    """The n rows first in hash order."""
    rows = df.withColumn("_h", hasher(F.col(key), salt))
    if n <= 0:
        return df.limit(0)
    prefix, rest = _cut(rows, "_h", n)
    if prefix is None:
        return df
    own = F.substring("_h", 1, PREFIX)
    return rows.where(own < prefix).unionByName(rows.where(own == prefix).orderBy("_h", key).limit(rest)).drop("_h")


def bankers(x: float) -> int:
    return round(x)


def max_synthetic_share(n_real: int, n_synthetic: int) -> float:
    total = n_real + n_synthetic
    return n_synthetic / total if total else 0.0


def mixture_plan(n_real: int, n_syn: int, share: float, size: int | None = None, tolerance: float = 0.005) -> tuple[int, int]:
    """(real, synthetic) rows to take; an error where the share can't be met."""
    if not 0 <= share < 1 or (size is not None and size < 1):
        raise ValueError("share lies in [0, 1) and size is positive")
    if size is not None:
        real = bankers(size * (1 - share))
        syn = size - real
    elif share == 0:
        return n_real, 0
    else:
        real, syn = n_real, bankers(n_real * share / (1 - share))
        if syn > n_syn:
            real, syn = bankers(n_syn * (1 - share) / share), n_syn
    if real > n_real or syn > n_syn:
        raise Infeasible(f"{real} real of {n_real} and {syn} synthetic of {n_syn}; at most {max_synthetic_share(n_real, n_syn):.3f}")
    if abs(syn / max(real + syn, 1) - share) > tolerance:
        raise Infeasible(f"share {share} asked, {syn / max(real + syn, 1):.3f} met")
    return real, syn


def mixture(real: DataFrame, synthetic: DataFrame, key: str, *, share: float, drop_policy: str, size: int | None = None, salt: str = "mixture", hasher=sha_order) -> DataFrame:
    """Rows of both at an exact share of synthetic ones, with a column origin."""
    pool = drop_nonpredictive(real, policy=drop_policy)
    n_real, n_syn = pool.count(), synthetic.count()
    want_real, want_syn = mixture_plan(n_real, n_syn, share, size)
    a = pool if want_real == n_real else hash_first(pool, key, want_real, salt, hasher)
    b = synthetic if want_syn == n_syn else hash_first(synthetic, key, want_syn, salt, hasher)
    return a.select(key, F.lit("real").alias("origin")).unionByName(b.select(key, F.lit("synthetic").alias("origin")))


def trace_class(p: Column, y: Column, base_rate: float, margin: float) -> Column:
    up = p > base_rate
    right = F.when(y == 1, up).otherwise(~up)
    return F.when(right, "correct_side").when(F.abs(p - base_rate) >= margin, "confidently_wrong").otherwise("hedged_wrong")


def _ranked(df: DataFrame, flag: Column, key: str, n: Column | None, fraction: float, salt: str, hasher, name: str) -> DataFrame:
    """df with a boolean: the first round(count * fraction) flagged rows in hash order.

    The cut is the hash at that rank, found from counts, so neither a window nor a sort holds all rows.
    """
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_h", F.when(F.col("_f"), F.concat(hasher(F.col(key), salt), F.lit(":"), F.col(key).cast("string"))))
    want = int(rows.agg(banker_round((n if n is not None else F.count_if("_f")) * F.lit(fraction)).alias("w")).first().w)
    flagged = rows.where("_f")
    prefix, rest = _cut(flagged, "_h", want) if want > 0 else ("", 0)
    if want <= 0:
        picked = F.lit(False)
    elif prefix is None:
        picked = F.col("_f")
    else:
        cut = flagged.where(F.substring("_h", 1, PREFIX) == prefix).select("_h").orderBy("_h").limit(rest).agg(F.max("_h")).first()[0]
        picked = F.coalesce(F.col("_h") <= cut, F.lit(False))
    return rows.withColumn(name, picked).drop("_f", "_h")


def select_traces(df: DataFrame, key: str, *, base_rate: float, margin: float, wrong_fraction: float, p: str = "p", y: str = "y", salt: str = "trace", hasher=sha_order) -> DataFrame:
    """Traces with their class and whether they are kept: all on the correct side, a share of confident misses."""
    if not 0 <= wrong_fraction <= 1:
        raise ValueError("wrong_fraction lies in [0, 1]")
    rows = require_columns(df, key, p, y).withColumn("class", trace_class(F.col(p), F.col(y), base_rate, margin))
    rows = _ranked(rows, F.col("class") == "confidently_wrong", key, None, wrong_fraction, salt, hasher, "_wrong")
    return rows.withColumn("kept", (F.col("class") == "correct_side") | F.col("_wrong")).drop("_wrong")


def training_targets(traces: DataFrame, soft: DataFrame, key: str, *, soft_fraction: float, y: str = "y", salt: str = "sft", hasher=sha_order) -> DataFrame:
    """Traces with target, kind and provenance: round(n * soft_fraction) of those with a soft target use it."""
    if not 0 <= soft_fraction <= 1:
        raise ValueError("soft_fraction lies in [0, 1]")
    require_columns(traces, key, y)
    rows = traces.join(require_columns(soft, key, "target", "provenance").select(key, F.col("target").alias("_soft"), F.col("provenance").alias("_p")), key, "left")
    state = rows.agg(banker_round(F.count("*") * F.lit(soft_fraction)).alias("w"), F.count("_soft").alias("have")).first()
    if state.w > state.have:
        raise Infeasible(f"{state.w} soft targets asked, {state.have} there")
    rows = _ranked(rows, F.col("_soft").isNotNull(), key, F.count("*"), soft_fraction, salt, hasher, "_use")
    return rows.withColumn("target", F.when(F.col("_use"), F.col("_soft")).otherwise(F.col(y).cast("double"))).withColumn("kind", F.when(F.col("_use"), "soft").otherwise("terminal")).withColumn("provenance", F.when(F.col("_use"), F.col("_p"))).drop("_soft", "_p", "_use")


def require_few_extremes(df: DataFrame, target: str = "target", most: float = 0.02) -> None:
    share = df.agg(F.avg(((F.col(target) <= 0) | (F.col(target) >= 1)).cast("int"))).first()[0] or 0.0
    if share > most:
        raise ValueError(f"{share:.3f} of targets are extreme; at most {most} may be")
