"""Column functions on probabilities, outcomes and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def valid_probability(p: Column) -> Column:
    """Whether p is a number within [0, 1]; false for null and NaN."""
    return F.coalesce((p >= 0) & (p <= 1) & ~F.isnan(p), F.lit(False))


def checked(p: Column, y: Column) -> Column:
    """p, or an error if p isn't a probability or y isn't 0 or 1."""
    ok = valid_probability(p) & F.coalesce(y.isin(0, 1), F.lit(False))
    return F.when(ok, p).otherwise(F.raise_error(F.concat(F.lit("not a forecast: "), F.coalesce(p.cast("string"), F.lit("null")))))


def equal_width_bin(p: Column, n_bins: int) -> Column:
    """Bin of p among n_bins of equal width; edges k / n_bins compare exactly, the last bin is closed."""
    k = F.least(F.floor(p * n_bins).cast("int"), F.lit(n_bins - 1))
    up = (k < n_bins - 1) & (p >= (k + 1) / F.lit(float(n_bins)))
    down = (k > 0) & (p < k / F.lit(float(n_bins)))
    return F.when(up, k + 1).when(down, k - 1).otherwise(k)


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def clamp_price(v: Column, tolerance: float = 1e-9) -> Column:
    """v within [0, 1]; an error if it is further out than the tolerance."""
    near = (v >= -tolerance) & (v <= 1 + tolerance)
    return F.when(near, F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))).otherwise(F.raise_error(F.concat(F.lit("implausible price "), F.coalesce(v.cast("string"), F.lit("null")))))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone (the session's zone is UTC)."""
    return F.unix_micros(t.cast("timestamp"))


def toward_truth(p: Column, y: Column) -> Column:
    return F.when(y == 1, p).otherwise(1 - p)


def banker_round(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(x, 0).cast("long")
