"""Scores of probability forecasts.

Every operator pools rows to (group, probability) with exact integer counts before any floating arithmetic, so
results don't depend on partitioning, and the shuffle holds distinct forecasts instead of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import EPSILON, checked, equal_width_bin


def pooled(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """(group, p, n, sy): rows and positive outcomes of each distinct forecast."""
    return df.select(*group, checked(F.col(p), F.col(y)).alias("p"), F.col(y).cast("long").alias("_y")).groupBy(*group, "p").agg(F.count("*").alias("n"), F.sum("_y").alias("sy"))


def _equal_mass(points: DataFrame, n_bins: int, group: Sequence[str]) -> DataFrame:
    """Bins of about equal counts that never split ties; the target is planned anew for each bin."""
    listed = points.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("p", "n", "sy"))).alias("_x"), F.sum("n").alias("_total"))
    start = F.struct(F.array().cast("array<int>").alias("bins"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("placed"))

    def step(acc: Column, x: Column) -> Column:
        target = F.ceil((F.col("_total") - acc["placed"]) / (n_bins - acc["bin"]))
        close = (acc["held"] > 0) & (acc["bin"] < n_bins - 1) & (acc["held"] >= target)
        bin_ = acc["bin"] + F.when(close, 1).otherwise(0)
        return F.struct(
            F.concat(acc["bins"], F.array(bin_)).alias("bins"), bin_.alias("bin"),
            (F.when(close, F.lit(0)).otherwise(acc["held"]) + x["n"]).alias("held"),
            (acc["placed"] + F.when(close, acc["held"]).otherwise(0)).alias("placed"),
        )

    folded = listed.withColumn("_b", F.aggregate("_x", start, step)["bins"])
    out = folded.select(*group, F.explode(F.arrays_zip("_x", "_b")).alias("z"))
    return out.select(*group, F.col("z._x.p").alias("p"), F.col("z._x.n").alias("n"), F.col("z._x.sy").alias("sy"), F.col("z._b").alias("bin"))


def with_bins(points: DataFrame, n_bins: int = 10, scheme: str = "equal_width", group: Sequence[str] = ()) -> DataFrame:
    if n_bins < 1:
        raise ValueError("n_bins must be 1 or more")
    if scheme == "equal_width":
        return points.withColumn("bin", equal_width_bin(F.col("p"), n_bins))
    if scheme == "equal_mass":
        return _equal_mass(points, n_bins, group)
    raise ValueError(f"no such scheme: {scheme}")


def bins(points: DataFrame, n_bins: int = 10, scheme: str = "equal_width", group: Sequence[str] = ()) -> DataFrame:
    """(group, bin, lower, upper, n, mean_forecast, observed_frequency); equal-width bins that are empty stay, with nulls."""
    own = with_bins(points, n_bins, scheme, group).groupBy(*group, "bin").agg(F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("sp"), F.sum("sy").alias("sy"), F.min("p").alias("lower"), F.max("p").alias("upper"))
    means = (F.col("sp") / F.col("n")).alias("mean_forecast"), (F.col("sy") / F.col("n")).alias("observed_frequency")
    if scheme == "equal_mass":
        return own.select(*group, "bin", "lower", "upper", "n", *means)
    spark = points.sparkSession
    every = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    every = points.select(*group).distinct().crossJoin(F.broadcast(every)) if group else every
    width = float(n_bins)
    return every.join(own.drop("lower", "upper"), [*group, "bin"], "left").select(*group, "bin", (F.col("bin") / width).alias("lower"), ((F.col("bin") + 1) / width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), *means)


def brier(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (), n_bins: int = 10, scheme: str = "equal_width") -> DataFrame:
    """Brier score with Murphy's decomposition; coarse if binning explains less than 95 percent."""
    points = pooled(df, p, y, group)
    binned = with_bins(points, n_bins, scheme, group)
    square = F.col("n") * F.col("p") * F.col("p") - 2 * F.col("p") * F.col("sy") + F.col("sy")
    per = binned.groupBy(*group, "bin").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum(F.col("p") * F.col("n")).alias("sp"), F.sum(square).alias("se"))
    m, o = F.col("sp") / F.col("n"), F.col("sy") / F.col("n")
    # resolution = sum n (o - base)^2 / N = (sum n o^2 - N base^2) / N
    out = per.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("sy").alias("_sy"), F.sum("se").alias("_se"), F.sum(F.col("n") * (m - o) * (m - o)).alias("_c"), F.sum(F.col("n") * o * o).alias("_r"))
    base = F.col("_sy") / F.col("n")
    out = out.select(*group, "n", base.alias("base_rate"), (F.col("_se") / F.col("n")).alias("score"), (F.col("_c") / F.col("n")).alias("calibration"), (F.col("_r") / F.col("n") - base * base).alias("resolution"), (base * (1 - base)).alias("uncertainty"))
    residual = F.col("score") - (F.col("calibration") - F.col("resolution") + F.col("uncertainty"))
    return out.withColumn("residual", residual).withColumn("coarse", F.abs("residual") > 0.05 * F.col("score"))


def ece(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (), n_bins: int = 10, scheme: str = "equal_width") -> DataFrame:
    """(group, ece, mce, populated, smallest_bin) under one scheme."""
    per = bins(pooled(df, p, y, group), n_bins, scheme, group).where("n > 0")
    gap = F.abs(F.col("mean_forecast") - F.col("observed_frequency"))
    return per.groupBy(*group).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.count("*").alias("populated"), F.min("n").alias("smallest_bin"))


def ece_both(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Calibration error under both schemes, and their spread."""
    w = ece(df, p, y, group, n_bins, "equal_width").select(*group, F.col("ece").alias("ece_width"), F.col("mce").alias("mce_width"), F.col("populated").alias("bins_width"))
    m = ece(df, p, y, group, n_bins, "equal_mass").select(*group, F.col("ece").alias("ece_mass"), F.col("mce").alias("mce_mass"), F.col("populated").alias("bins_mass"))
    both = w.join(m, list(group)) if group else w.crossJoin(m)
    return both.withColumn("spread", F.abs(F.col("ece_width") - F.col("ece_mass")))


def log_score(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (), epsilon: float = EPSILON) -> DataFrame:
    """Mean negative log likelihood of forecasts clipped to [epsilon, 1 - epsilon], and how many were clipped."""
    points = pooled(df, p, y, group)
    c = F.least(F.greatest(F.col("p"), F.lit(epsilon)), F.lit(1 - epsilon))
    loss = -(F.col("sy") * F.ln(c) + (F.col("n") - F.col("sy")) * F.ln(1 - c))
    return points.groupBy(*group).agg(F.sum("n").alias("n"), (F.sum(loss) / F.sum("n")).alias("log_score"), F.sum(F.when(c != F.col("p"), F.col("n")).otherwise(0)).alias("n_clipped"))


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log2(n / total))


def output_histogram(df: DataFrame, p: str = "p", group: Sequence[str] = (), n_bins: int = 10, places: int = 2, half_width: float = 0.05, top_k: int = 5) -> DataFrame:
    """Distinct rounded outputs, entropies in bits, mass about one half, most frequent values; outcomes aren't needed."""
    values = df.select(*group, F.round(p, places).alias("value")).groupBy(*group, "value").count()
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    values = values.withColumn("total", F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "value")))
    hundredth = 10**-places / 2
    center = F.abs(F.col("value") - 0.5) <= half_width + hundredth / 1e6
    head = values.groupBy(*group).agg(
        F.max("total").alias("n"), F.count("*").alias("distinct_values"), _entropy(F.col("count"), F.col("total")).alias("value_entropy"),
        (F.sum(F.when(center, F.col("count")).otherwise(0)) / F.max("total")).alias("center_mass"), F.min("value").alias("least"), F.max("value").alias("most"), (F.sum(F.col("value") * F.col("count")) / F.max("total")).alias("mean"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top_k, F.struct("rank", "value", "count")))), lambda x: F.concat_ws(":", F.format_string("%.2f", x["value"]), x["count"])), " ").alias("top"),
    )
    per = values.withColumn("bin", equal_width_bin(F.col("value"), n_bins)).groupBy(*group, "bin").agg(F.sum("count").alias("count"), F.max("total").alias("total"))
    tail = per.groupBy(*group).agg(_entropy(F.col("count"), F.col("total")).alias("bin_entropy"))
    return head.join(tail, list(group)) if group else head.crossJoin(tail)


def soft_target_score(df: DataFrame, p: str = "p", target: str = "target", group: Sequence[str] = ()) -> DataFrame:
    e = F.col(p) - F.col(target)
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_signed"))


def breakdown(df: DataFrame, key: Column | str, p: str = "p", y: str = "y", *, minimum_group: int) -> DataFrame:
    """Scores by group; unresolved rows (null outcome) are left out, and groups under the minimum have counts alone."""
    label = F.col(key) if isinstance(key, str) else key
    rows = df.where(F.col(y).isNotNull()).withColumn("label", label)
    per = pooled(rows, p, y, ["label"])
    square = F.col("n") * F.col("p") * F.col("p") - 2 * F.col("p") * F.col("sy") + F.col("sy")
    out = per.groupBy("label").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum(square).alias("se"))
    out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a group
    enough = F.col("n") >= minimum_group
    return out.select("label", "n", "share", enough.alias("reported"), F.when(enough, F.col("se") / F.col("n")).alias("brier"), F.when(enough, F.col("sy") / F.col("n")).alias("base_rate"))


def strata_report(df: DataFrame, strata: dict[str, Column], p: str = "p", y: str = "y") -> DataFrame:
    """Brier and skill of overlapping strata in one pass; strata with fewer than two rows or one outcome are left out."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in strata.items()]))
    rows = df.withColumn("stratum", F.explode(labels))
    out = brier(rows, p, y, ["stratum"])
    return out.where((F.col("n") >= 2) & (F.col("base_rate") > 0) & (F.col("base_rate") < 1)).withColumn("skill", 1 - F.col("score") / F.col("uncertainty"))
