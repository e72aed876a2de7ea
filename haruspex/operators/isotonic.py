"""Isotonic fits, the bin-free decomposition, and cross-fitted calibration maps.

A fit at x is the greatest, over a <= x, of the least mean over a..b with b >= x. Points are pooled to distinct
forecasts first. The quadratic form runs in the JVM and is meant for few distinct values; above ``FEW`` of them in
a group, pools go group by group through the linear stack algorithm in Arrow-fed Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 2000


def _window_fit(points: DataFrame, group: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("p")
    c = points.withColumn("cs", F.sum("sy").over(w)).withColumn("cn", F.sum("n").over(w))
    a = c.select(*group, F.col("p").alias("a"), (F.col("cs") - F.col("sy")).alias("as"), (F.col("cn") - F.col("n")).alias("an"))
    pairs = c.join(a, list(group)).where("p >= a") if group else c.join(a, F.col("p") >= F.col("a"))  # at most FEW on either side
    mean = (F.col("cs") - F.col("as")) / (F.col("cn") - F.col("an"))
    down = Window.partitionBy(*group, "a").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumn("least", F.min(mean).over(down)).groupBy(*group, "p").agg(F.max("least").alias("fit"))


def pool_adjacent(values: Sequence[float], sums: Sequence[float], counts: Sequence[float]) -> list[float]:
    """Fitted value of each point, points in ascending order."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [s / n for s, n, k in blocks for _ in range(int(k))]


def _stack_fit(points: DataFrame, group: Sequence[str]) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        return pdf.assign(fit=pool_adjacent(pdf["p"], pdf["sy"], pdf["n"]))[[*group, "p", "fit"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name in (*group, "p"))
    return points.groupBy(*group).applyInPandas(fit, f"{kinds}, fit double")


def isotonic(points: DataFrame, group: Sequence[str] = (), few: int | None = None) -> DataFrame:
    """points (group, p, n, sy): (group, p, n, sy, fit).

    few: the most distinct values a group has, if the caller knows it; else they are counted.
    """
    if few is None:
        few = points.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    fits = _window_fit(points, group) if few <= FEW else _stack_fit(points, group)
    return points.join(fits, [*group, "p"])


def corp(points: DataFrame, group: Sequence[str] = (), few: int | None = None) -> DataFrame:
    """Score = miscalibration - discrimination + uncertainty, without bins."""
    fitted = isotonic(points, group, few)
    se = lambda x: F.sum(F.col("n") * x * x - 2 * x * F.col("sy") + F.col("sy"))
    out = fitted.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("sy").alias("_sy"), se(F.col("p")).alias("_s"), se(F.col("fit")).alias("_r"))
    base = F.col("_sy") / F.col("n")
    out = out.select(*group, "n", (F.col("_s") / F.col("n")).alias("score"), (F.col("_r") / F.col("n")).alias("_rec"), (base * (1 - base)).alias("unc"))
    return out.select(*group, "n", "score", (F.col("score") - F.col("_rec")).alias("mcb"), (F.col("unc") - F.col("_rec")).alias("dsc"), "unc")


def blocks(points: DataFrame, group: Sequence[str] = (), few: int | None = None) -> DataFrame:
    """An isotonic map as its blocks: (group, edge: the block's greatest forecast, value, n)."""
    return isotonic(points, group, few).groupBy(*group, "fit").agg(F.max("p").alias("edge"), F.sum("n").alias("n")).withColumnRenamed("fit", "value")


def as_map(block_rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, edges, values): one row for each map, the last block's edge left out."""
    listed = block_rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("edge", "value"))).alias("b"))
    return listed.select(*group, F.slice("b.edge", F.lit(1), F.size("b") - 1).alias("edges"), F.col("b.value").alias("values"))


def apply_map(price: Column, edges: Column, values: Column) -> Column:
    """The value of the first block whose edge is at least the price, else of the last block."""
    return F.element_at(values, F.size(F.filter(edges, lambda e: e < price)) + 1)


def fold_exact(ids: Column, k: int) -> Column:
    """blake2b-64 of the id, big-endian, modulo k; a Python island, as Spark has no blake2b."""

    @F.pandas_udf("int")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") % k)

    return fold(ids.cast("string"))


def fold_sha(ids: Column, k: int) -> Column:
    """The first 32 bits of sha256 of the id, modulo k; in the JVM."""
    return (F.conv(F.substring(F.sha2(ids.cast("string"), 256), 1, 8), 16, 10).cast("long") % k).cast("int")


def fold_points(df: DataFrame, question: str, p: str, y: str, k: int = 5, stratum: str | None = None, fold: Callable[[Column, int], Column] = fold_sha) -> DataFrame:
    """(fold, stratum, p, n, sy): all that cross-fitting needs."""
    s = F.col(stratum) if stratum else F.lit(None).cast("string")
    return df.select(fold(F.col(question), k).alias("fold"), s.alias("stratum"), F.col(p).alias("p"), F.col(y).cast("long").alias("y")).groupBy("fold", "stratum", "p").agg(F.count("*").alias("n"), F.sum("y").alias("sy"))


def isotonic_maps(few: int | None = None) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A fitter: points (group, p, n, sy) to one map (group, edges, values) a group."""
    return lambda points, group: as_map(blocks(points, group, few), group)


def beta_maps(points: DataFrame, group: list[str]) -> DataFrame:
    """A fitter by beta calibration; its map is tabulated at the group's own forecasts."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("p")
        a, b, c = fit_beta(pdf["p"], pdf["sy"], pdf["n"])
        p = np.clip(pdf["p"].to_numpy(), 1e-4, 1 - 1e-4)
        q = 1 / (1 + np.exp(-np.clip(a * np.log(p) - b * np.log(1 - p) + c, -30, 30)))
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "edges": [pdf["p"].tolist()[:-1]], "values": [q.tolist()]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name in group)
    return points.groupBy(*group).applyInPandas(fit, f"{kinds}, edges array<double>, values array<double>")


def cross_fit(points: DataFrame, k: int = 5, minimum_stratum: int = 10_000, few: int | None = None, fitter: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """(fold, stratum, p, n, sy, fit): each fold corrected by maps fitted on all others.

    A stratum with at least minimum_stratum training rows has maps of its own; others use the fold's. Both are
    fitted by the fitter, isotonic unless another is given.
    """
    fitter = fitter or isotonic_maps(few)
    held = points.sparkSession.range(k).select(F.col("id").cast("int").alias("held"))
    rest = points.crossJoin(F.broadcast(held)).where("fold != held")
    whole = rest.groupBy("held", "p").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    maps = fitter(whole, ["held"])
    each = rest.where("stratum is not null").groupBy("held", "stratum", "p").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    big = each.groupBy("held", "stratum").agg(F.sum("n").alias("t")).where(F.col("t") >= minimum_stratum).select("held", "stratum")
    own = fitter(each.join(big, ["held", "stratum"]), ["held", "stratum"]).select("held", "stratum", F.col("edges").alias("own_edges"), F.col("values").alias("own_values"))
    rows = points.select(F.col("fold").alias("held"), "stratum", "p", "n", "sy").join(maps, "held").join(own, ["held", "stratum"], "left")
    fit = F.coalesce(apply_map(F.col("p"), F.col("own_edges"), F.col("own_values")), apply_map(F.col("p"), F.col("edges"), F.col("values")))
    return rows.select(F.col("held").alias("fold"), "stratum", "p", "n", "sy", fit.alias("fit"))


def _newton(sums: Callable, rounds: int, ridge: float, tolerance: float) -> tuple[float, float, float]:
    """Weights from sums(used, w): Newton's matrix and gradient over the points, for the columns in use."""
    import numpy as np

    used = [0, 1, 2]
    while True:
        w = np.zeros(len(used))
        for _ in range(rounds):
            h, g = sums(used, w)
            step = np.linalg.solve(h + ridge * np.eye(len(used)), g)  # the ridge steadies the matrix alone
            w = w + step
            if np.abs(step).max() < tolerance:
                break
        bad = [u for u, v in zip(used, w) if u < 2 and v < 0]
        if not bad:
            out = [0.0, 0.0, 0.0]
            for u, v in zip(used, w):
                out[u] = float(v)
            return tuple(out)
        used.remove(min(bad, key=lambda u: w[used.index(u)]))


def fit_beta(prices: Sequence[float], sums: Sequence[float], counts: Sequence[float], rounds: int = 50, ridge: float = 1e-6, clip: float = 1e-4, tolerance: float = 1e-10) -> tuple[float, float, float]:
    """(a, b, c) of logit q = a ln p - b ln(1 - p) + c by weighted least squares, from pooled bins.

    A negative slope is left out and the rest fitted anew, so the map never decreases.
    """
    import numpy as np

    p = np.clip(np.asarray(prices, float), clip, 1 - clip)
    s, n = np.asarray(sums, float), np.asarray(counts, float)
    full = np.column_stack([np.log(p), -np.log(1 - p), np.ones_like(p)])

    def over(used, w):
        x = full[:, used]
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return (x * (n * q * (1 - q))[:, None]).T @ x, x.T @ (s - n * q)

    return _newton(over, rounds, ridge, tolerance)


def fit_beta_rows(points: DataFrame, rounds: int = 50, ridge: float = 1e-6, clip: float = 1e-4, tolerance: float = 1e-10) -> tuple[float, float, float]:
    """fit_beta of all points (p, n, sy), however many: a round's sums are Spark's, the driver gets nine numbers at most.

    points are read once a round, so they should be materialised.
    """
    import numpy as np

    p = F.least(F.greatest("p", F.lit(clip)), F.lit(1 - clip))
    full = points.select(F.ln(p).alias("x0"), (-F.ln(1 - p)).alias("x1"), F.lit(1.0).alias("x2"), F.col("sy").cast("double").alias("s"), F.col("n").cast("double").alias("n"))

    def over(used, w):
        z = sum((F.lit(float(v)) * F.col(f"x{u}") for u, v in zip(used, w)), F.lit(0.0))
        q = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
        pairs = [(i, j) for i in used for j in used if i <= j]
        h = [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("n") * F.col("q") * (1 - F.col("q"))) for i, j in pairs]
        found = full.withColumn("q", q).agg(*h, *[F.sum(F.col(f"x{u}") * (F.col("s") - F.col("n") * F.col("q"))) for u in used]).first()
        found = [x or 0.0 for x in found]  # null without points
        matrix = np.zeros((3, 3))
        for (i, j), x in zip(pairs, found):
            matrix[i, j] = matrix[j, i] = x
        return matrix[np.ix_(used, used)], np.array(found[len(pairs) :])

    return _newton(over, rounds, ridge, tolerance)


def apply_beta(price: Column, a: float, b: float, c: float, clip: float = 1e-4) -> Column:
    from ..functions.probability import sigmoid

    p = F.least(F.greatest(price, F.lit(clip)), F.lit(1 - clip))
    return sigmoid(F.lit(a) * F.ln(p) - F.lit(b) * F.ln(1 - p) + F.lit(c))
