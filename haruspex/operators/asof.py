"""As-of lookups on irregular series, duplicate instants, and lagged supervision points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import micros
from .rules import first_reason

HOUR = 3_600_000_000


def as_of(probes: DataFrame, series: DataFrame, key: Sequence[str], probe_ts: str, series_ts: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """probes with the values of the latest series row at or before (strict: before) probe_ts; null where there is none.

    Both sides are united and sorted once by key and instant; at equal instants probes come after series rows, or
    before them if strict. One shuffle by key, no join and no pairs.
    """
    names = list(probes.columns)
    left = probes.select(F.struct(*names).alias("_probe"), *key, F.col(probe_ts).alias("_ts"), F.lit(0 if strict else 2).alias("_side"), F.lit(None).cast(series.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    right = series.select(F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), *key, F.col(series_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*key).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_probe is not null")
    return found.select("_probe.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def validate_prices(prices: DataFrame, key: str = "question_id", terminal_us: int = HOUR) -> DataFrame:
    """Price rows with a reason; exact repeats of an instant are dropped uncounted, after ambiguous instants are named.

    prices: key, ts, price, open_date, resolved_at.
    """
    at = Window.partitionBy(key, "ts")
    rows = prices.withColumn("_many", F.min("price").over(at) != F.max("price").over(at)).withColumn("_k", F.row_number().over(at.orderBy("price")))
    rows = rows.where(F.col("_many") | (F.col("_k") == 1))
    end = micros(F.col("resolved_at"))
    reason = first_reason([
        ("ambiguous_at_timestamp", F.col("_many")), ("out_of_range", (F.col("price") < 0) | (F.col("price") > 1) | F.isnan("price")), ("before_market_opened", F.col("ts") < F.col("open_date")),
        ("after_resolution", F.col("ts") > F.col("resolved_at")), ("in_terminal_window", micros(F.col("ts")) >= end - terminal_us),
    ])
    return rows.withColumn("reason", reason).drop("_many", "_k")


def supervision_points(validated: DataFrame, key: str = "question_id", lam: float = 0.5, minimum_us: int = 6 * HOUR) -> DataFrame:
    """Kept prices with target and target_at, the latest price lam of the way to resolution; or with a reason."""
    if not 0 < lam < 1:
        raise ValueError("lam must lie between 0 and 1")
    usable = validated.where("reason is null").drop("reason").withColumn("us", micros(F.col("ts")))
    wanted = F.col("us") + F.rint((micros(F.col("resolved_at")) - F.col("us")) * F.lit(lam)).cast("long")
    probes = usable.withColumn("wanted", wanted)
    series = usable.select(key, F.col("us").alias("target_us"), F.col("price").alias("target"))
    found = as_of(probes, series, [key], "wanted", "target_us", ["target", "target_us"])
    reason = first_reason([("no_later_observation", F.coalesce(F.col("target_us") <= F.col("us"), F.lit(True))), ("separation_too_small", F.col("target_us") - F.col("us") < minimum_us)])
    return found.withColumn("reason", reason)


def out_of_order(prices: DataFrame, key: str, position: str, ts: str = "ts") -> DataFrame:
    """(key, n): how many rows of each series are earlier than the row before them."""
    w = Window.partitionBy(key).orderBy(position)
    return prices.withColumn("_before", F.lag(ts).over(w)).groupBy(key).agg(F.count_if(F.col(ts) < F.col("_before")).alias("n"))


def trailing(rows: DataFrame, key: Sequence[str], ts: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
