"""Threshold questions from time series: contexts, return distributions, thresholds and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import first_reason


def contexts(series: DataFrame, as_ofs: DataFrame, horizon_us: int, *, min_history: int = 30, max_staleness_us: int | None = None) -> DataFrame:
    """For each (series_id, as_of): last, realized, decision_us, sorted horizon returns, and a reason where there is none.

    series: series_id, us, value. as_ofs: series_id, as_of_us. Observations of a series are listed once in order;
    what an as_of may know is a slice of that list, so no observation is joined to every later as_of.
    """
    listed = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("us", "value"))).alias("s"))
    rows = as_ofs.join(listed, "series_id")
    rows = rows.withColumn("h", F.filter("s", lambda x: x["us"] < F.col("as_of_us")))
    n = F.size("h")
    rows = rows.withColumn("n", n)
    rows = rows.withColumn("first_us", F.get("h", F.lit(0))["us"]).withColumn("last_us", F.get("h", F.col("n") - 1)["us"]).withColumn("last", F.get("h", F.col("n") - 1)["value"])
    rows = rows.withColumn("span", F.round((F.col("last_us") - F.col("first_us")) / F.greatest(F.col("n") - 1, F.lit(1))).cast("long"))
    rows = rows.withColumn("steps", F.when(F.col("span") > 0, F.greatest(F.floor(F.lit(horizon_us) / F.col("span")).cast("int"), F.lit(1))))
    until = F.filter("s", lambda x: x["us"] <= F.col("as_of_us") + horizon_us)
    rows = rows.withColumn("d", F.get(until, F.size(until) - 1))
    v = F.transform("h", lambda x: x["value"])
    pairs = F.zip_with(F.slice(v, 1, F.greatest(F.col("n") - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.col("n") - 1, F.lit(0))), lambda a, b: F.when((a > 0) & (b > 0), F.ln(b / a)))
    rows = rows.withColumn("r", F.filter(pairs, lambda x: x.isNotNull()))
    # rolling sums of `steps` returns as differences of running sums
    running = F.aggregate("r", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn("c", running).withColumn("windows", F.greatest(F.size("r") - F.col("steps") + 1, F.lit(1)))
    top = F.size("r")
    sums = F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.get("c", F.least(i + F.col("steps"), top)) - F.get("c", i))
    stale = F.lit(max_staleness_us).cast("long") if max_staleness_us is not None else F.col("span")
    reason = first_reason([
        ("short_history", F.col("n") < min_history), ("no_span", F.coalesce(F.col("span") <= 0, F.lit(True))), ("stale", F.col("as_of_us") - F.col("last_us") > stale),
        ("no_decision", F.coalesce(F.col("d.us") < F.col("as_of_us"), F.lit(True))), ("ends_early", F.col("as_of_us") + horizon_us - F.col("d.us") > F.col("span")),
        ("few_returns", F.size("r") < min_history // 2), ("not_positive", F.coalesce(F.col("last") <= 0, F.lit(True))),
    ])
    rows = rows.withColumn("reason", reason)
    keep = F.col("reason").isNull()
    return rows.select("series_id", "as_of_us", "n", "steps", "last", F.when(keep, F.col("d.value")).alias("realized"), F.when(keep, F.col("d.us")).alias("decision_us"), F.when(keep, F.array_sort(sums)).alias("returns"), "reason")


def questions(context_rows: DataFrame, targets: list[float], direction: str = "above") -> DataFrame:
    """(series_id, as_of_us, target, threshold, implied, outcome, decision_us) of each context and target."""
    above = direction == "above"
    rows = context_rows.where("reason is null").withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    q = 1 - F.col("target") if above else F.col("target")
    m = F.size("returns")
    pos = F.least(F.greatest(q * (m - 1), F.lit(0.0)), (m - 1).cast("double"))
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, m - 1)
    a, b = F.get("returns", lo), F.get("returns", hi)
    rows = rows.withColumn("threshold", F.col("last") * F.exp(a + (pos - lo) * (b - a)))
    share = F.size(F.filter("returns", lambda r: F.col("last") * F.exp(r) > F.col("threshold"))) / F.size("returns")
    hit = F.col("realized") > F.col("threshold") if above else F.col("realized") < F.col("threshold")
    return rows.select("series_id", "as_of_us", "target", "threshold", (share if above else 1 - share).alias("implied"), hit.cast("int").alias("outcome"), "decision_us")


def looks_ahead(question_rows: DataFrame) -> DataFrame:
    """Questions decided no later than they are asked; there may be none."""
    return question_rows.where("decision_us <= as_of_us")


def log_returns(series: DataFrame) -> DataFrame:
    """(series_id, us, ret) of adjacent observations that are both positive."""
    w = Window.partitionBy("series_id").orderBy("us")
    before = F.lag("value").over(w)
    return series.withColumn("before", before).where((F.col("before") > 0) & (F.col("value") > 0)).select("series_id", "us", F.ln(F.col("value") / F.col("before")).alias("ret"))


POLICIES = ("never_revised", "vintaged", "revised_in_place")


def evidence_of(series: DataFrame, source: str, policy: str, window: int | None = None) -> DataFrame:
    """Observations as evidence documents, the last ``window`` of each series; a series revised in place is refused."""
    from .asof import trailing

    if policy not in POLICIES or policy == "revised_in_place":
        raise ValueError(f"a series that is {policy} can't be evidence")
    rows = series if window is None else trailing(series, ["series_id"], "us", window)
    at = F.timestamp_micros("us")
    return rows.select(
        "series_id", F.concat_ws(":", "series_id", "us").alias("doc_id"), F.concat(F.col("series_id"), F.lit(" = "), F.col("value").cast("string")).alias("snippet"), F.lit(source).alias("source"), at.alias("timestamp"),
        F.lit("publisher_verified").alias("provenance"), F.lit(None).cast("timestamp").alias("last_modified"), F.lit(None).cast("timestamp").alias("retrieved_at"), F.lit(None).cast("string").alias("url"),
    )
