"""Streaming forms of the operators whose state merges: counts, sums and keyed upserts.

Isotonic fits, equal-mass bins and quantiles don't merge; they run in foreachBatch over pooled state instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.leakage import VERSION, screen


def pooled_stream(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Running (group, p, n, sy): every score follows from it, at any time."""
    return rows.groupBy(*(group or []), "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("sy"))


def histogram_stream(rows: DataFrame, places: int = 2) -> DataFrame:
    """Running counts of rounded outputs; needs no outcomes, so it runs on batches not yet resolved."""
    return rows.groupBy(F.round("p", places).alias("value")).count()


def leak_stats_stream(evidence: DataFrame, tiers: DataFrame) -> DataFrame:
    """Running counts by reason of documents screened as they come."""
    seen = screen(evidence, tiers).select(F.explode_outer("reasons").alias("reason"))
    return seen.groupBy("reason").agg(F.count("*").alias("count"), F.lit(VERSION).alias("version"))


def windowed_scores(rows: DataFrame, at: str, every: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Brier sums by event-time window; rows later than the watermark are dropped, and late_rows counts them."""
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    out = rows.withWatermark(at, lateness).groupBy(F.window(at, every).alias("w")).agg(F.count("*").alias("n"), F.sum(e).alias("se"))
    return out.select(F.col("w.start").alias("start"), "n", (F.col("se") / F.col("n")).alias("brier"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped as later than its watermark, over the progress that it still remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"])


def unscored_stream(requests: DataFrame, at: str, lateness: str = "1 day") -> DataFrame:
    """Each question once, however often a resumed run sends it."""
    return requests.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["question_id"])


def accrue(stream: DataFrame, path: str, checkpoint: str, published: Column, trigger: dict | None = None) -> StreamingQuery:
    """Append rows that become published to a table, each id once; a batch that runs twice adds nothing."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where(published).dropDuplicates(["question_id"])
        try:
            have = spark.read.parquet(path).select("question_id")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            have = None
        if have is not None:
            new = new.join(have, "question_id", "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the streaming engine into memory: for tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
