"""Temporal splits, lifetimes and horizons, the census, and guards of evaluation slices."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import micros

DAY = 86_400_000_000
FREEZE = datetime(2026, 8, 15)
DEV_START = FREEZE - timedelta(days=365)
SPLITS = ("train", "dev", "published", "open")
BUCKETS = ("<30d", "30-180d", "180d+")


def supervision_time() -> Column:
    return F.greatest("resolved_at", "soft_target_at")


def split(at: Column, freeze: datetime = FREEZE, dev_start: datetime = DEV_START) -> Column:
    """open without supervision, published after the freeze, dev from dev_start to it (both included), else train."""
    return F.when(at.isNull(), "open").when(at > F.lit(freeze).cast("timestamp"), "published").when(at >= F.lit(dev_start).cast("timestamp"), "dev").otherwise("train")


def lifetime(end: Column, start: Column) -> Column:
    """Microseconds between two instants."""
    return micros(end) - micros(start)


def bucket(us: Column) -> Column:
    return F.when(us < 30 * DAY, BUCKETS[0]).when(us < 180 * DAY, BUCKETS[1]).when(us.isNotNull(), BUCKETS[2])


def floor_days(us: Column) -> Column:
    return F.floor(us / F.lit(DAY)).cast("long")


def total_days(us: Column) -> Column:
    """Whole days in a group's microseconds, an aggregate; their sum is a decimal, as a long holds no more than 107 million days."""
    return F.call_function("div", F.sum(us.cast("decimal(20,0)")), F.lit(DAY).cast("decimal(20,0)"))


def census(df: DataFrame, split_col: str = "split", lifetime_us: str = "lifetime_us") -> DataFrame:
    """(split, n, no_lifetime, one count a bucket); every split has its row."""
    us = F.col(lifetime_us)
    counts = df.groupBy(F.col(split_col).alias("split")).agg(F.count("*").alias("n"), F.count_if(us.isNull()).alias("no_lifetime"), *[F.count_if(bucket(us) == b).alias(f"bucket_{i}") for i, b in enumerate(BUCKETS)])
    every = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return F.broadcast(every).join(counts, "split", "left").na.fill(0)


def census_table(df: DataFrame) -> DataFrame:
    """The census as lines of a Markdown table, in order of splits."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    line = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    return census(df).select(rank.alias("line"), line("split", "n", "bucket_0", "bucket_1", "bucket_2", "no_lifetime").alias("text"))


def slice_state(df: DataFrame, split_col: str = "split") -> DataFrame:
    """One row of what a slice must meet: rows, splits, unresolved ones, forecasts made no earlier than the answer."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(split_col).alias("splits"), F.min(split_col).alias("split"), F.count_if(F.col("outcome").isNull()).alias("unresolved"), F.count_if(F.col("as_of") >= F.col("resolved_at")).alias("late"), F.count_if(F.col("as_of").isNull()).alias("without_as_of"))


class NotPublishable(ValueError):
    pass


def require_publishable(df: DataFrame, split_col: str = "split") -> None:
    """Refuse a slice that isn't published before complaining of its forecast times; there is no override."""
    s = slice_state(df, split_col).first()
    if s.n == 0 or s.unresolved or s.splits != 1:
        raise NotPublishable(f"{s.n} rows, {s.unresolved} unresolved, {s.splits} splits")
    if s.split != "published":
        raise NotPublishable(f"the slice is {s.split}")
    if s.without_as_of:
        raise NotPublishable(f"{s.without_as_of} rows without a forecast time")
    if s.late:
        raise NotPublishable(f"{s.late} forecasts no earlier than their answer")


def horizon_scores(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Brier of all rows (bucket 'all') and of each horizon bucket, by grouping sets over pooled forecasts."""
    us = lifetime(F.col("resolved_at"), F.col("as_of"))
    rows = df.where(us > 0).withColumn("bucket", bucket(us))
    per = rows.groupBy("bucket", p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("sy"))
    se = F.sum(F.col("n") * F.col(p) * F.col(p) - 2 * F.col(p) * F.col("sy") + F.col("sy"))
    out = per.groupingSets([[], ["bucket"]], "bucket").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), se.alias("se"), F.grouping("bucket").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), "n", (F.col("se") / F.col("n")).alias("brier"), (F.col("sy") / F.col("n")).alias("base_rate"))


class BaseRates:
    """Mean outcome by class where it has enough resolved rows, else overall; fitted on resolved training rows alone.

    Rows without outcome say nothing and are left out before anything else is asked of them.
    """

    def __init__(self, train: DataFrame, group: str, y: str = "y", minimum: int = 30, split_col: str | None = "split"):
        resolved = train.where(F.col(y).isNotNull())
        if split_col and not resolved.where(~F.col(split_col).eqNullSafe("train")).isEmpty():
            raise ValueError("base rates are fitted on training rows alone")
        if resolved.isEmpty():
            raise ValueError("no resolved training rows to fit base rates on")
        per = resolved.groupBy(group).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
        every = Window.partitionBy(F.lit(0))  # one row a class
        self.rates = per.select(group, (F.sum("s").over(every) / F.sum("n").over(every)).alias("overall"), F.when(F.col("n") >= minimum, F.col("s") / F.col("n")).alias("own"))
        self.group = group

    def forecast(self, df: DataFrame) -> DataFrame:
        """df with base_rate and covered (whether its class has a rate of its own)."""
        overall = self.rates.agg(F.max("overall").alias("_all"))
        out = df.join(self.rates.select(self.group, "own"), self.group, "left").crossJoin(F.broadcast(overall))
        return out.withColumn("base_rate", F.coalesce("own", "_all")).withColumn("covered", F.col("own").isNotNull()).drop("own", "_all")
