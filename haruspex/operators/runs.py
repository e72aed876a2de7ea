"""Accounting of evaluation runs: parsed responses, transport and content failures, coverage and compliance."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_forecast


def forecast_with(df: DataFrame, forecaster: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """df with response and transport_error, which names the exception of a row whose forecast failed.

    The forecaster gets a batch of rows; if it raises, the batch's rows are asked for one by one, so that a failure is
    its own row's alone.
    """

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(response=forecaster(pdf).astype(object), transport_error=None)

    def run(batches):
        for pdf in batches:
            try:
                yield ask(pdf)
                continue
            except Exception:
                each = [pdf.iloc[i : i + 1] for i in range(len(pdf))]
            for row in each:
                try:
                    yield ask(row)
                except Exception as e:
                    yield row.assign(response=None, transport_error=f"transport_{type(e).__name__}")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, response string, transport_error string")


def parsed(df: DataFrame, response: str = "response", transport_error: str = "transport_error") -> DataFrame:
    """df with probability and status: scored, transport, or the format's failure."""
    rows = df.withColumn("_p", parse_forecast(F.col(response)))
    status = F.when(F.col(transport_error).isNotNull(), "transport").otherwise(F.coalesce("_p.failure", F.lit("scored")))
    return rows.withColumn("probability", F.when(F.col(transport_error).isNull(), F.col("_p.probability"))).withColumn("status", status).drop("_p")


def run_report(df: DataFrame) -> DataFrame:
    """attempted, scored, coverage = scored / attempted, compliance = scored / responses that came."""
    scored, came = F.count_if(F.col("status") == "scored"), F.count_if(F.col("status") != "transport")
    return df.agg(F.count("*").alias("attempted"), scored.alias("scored"), F.try_divide(scored, F.count("*")).alias("coverage"), F.try_divide(scored, came).alias("compliance"))


def require_coverage(df: DataFrame, *, minimum_coverage: float) -> DataFrame:
    """The scored rows, if enough of the attempted are."""
    r = run_report(df).first()
    if r.coverage is None or r.coverage < minimum_coverage:
        raise ValueError(f"coverage {r.coverage} under {minimum_coverage}")
    return df.where("status = 'scored'")


def compliance_rate(df: DataFrame) -> DataFrame:
    """Share of responses that parse; an error over none."""
    n = F.count("*")
    return df.agg(F.when(n > 0, F.avg((F.col("status") == "scored").cast("int"))).otherwise(F.raise_error(F.lit("no responses")).cast("double")).alias("compliance"))


def tally(df: DataFrame, kind: str = "kind", label: str = "label") -> DataFrame:
    """(kind, label, n): mergeable by summing."""
    return df.groupBy(kind, label).agg(F.count("*").alias("n"))


def tally_conflicts(tallies: DataFrame) -> DataFrame:
    """Labels counted under two kinds, which must not mix."""
    return tallies.groupBy("label").agg(F.count_distinct("kind").alias("kinds"), F.sum("n").alias("n")).where("kinds > 1")
