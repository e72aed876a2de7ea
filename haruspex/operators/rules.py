"""Rule tables: reasons are columns, not exceptions, so that every rejected row is counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Column]]


def first_reason(rules: Rules) -> Column:
    """The name of the first rule that holds, or null. A rule that is null doesn't hold."""
    out = None
    for name, broken in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out if out is not None else F.lit(None).cast("string")


def all_reasons(rules: Rules) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).count()


def accounted(df: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: raw, kept and rejected rows; an error if they don't add up."""
    out = df.agg(F.count("*").alias("raw"), F.count_if(F.col(reason).isNull()).alias("kept"), F.count(reason).alias("rejected"))
    return out.withColumn("raw", F.when(F.col("raw") == F.col("kept") + F.col("rejected"), F.col("raw")).otherwise(F.raise_error(F.lit("rows are unaccounted for")).cast("long")))


def examples(df: DataFrame, order: str, reason: str = "reason", limit: int = 3) -> DataFrame:
    """The first rows of each reason."""
    from pyspark.sql import Window

    w = Window.partitionBy(reason).orderBy(order)
    return df.where(F.col(reason).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has the columns that what follows reads; anything richer is carried through."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


class Invariants:
    """Declared checks of load-bearing fields; every check names the outside fact it rests on."""

    def __init__(self):
        self.checks: dict[str, tuple[Column, str]] = {}

    def declare(self, field: str, check: Column, anchor: str) -> Invariants:
        if not anchor.strip():
            raise ValueError(f"{field}: a check needs an anchor outside the data")
        self.checks[field] = (check, anchor)
        return self

    def require(self, fields: Sequence[str]) -> None:
        if missing := sorted(set(fields) - set(self.checks)):
            raise ValueError(f"undeclared fields: {', '.join(missing)}")

    def violations(self, df: DataFrame) -> Column:
        """Names of declared fields, present in df and not null, whose check fails."""
        return all_reasons([(k, F.col(k).isNotNull() & ~F.coalesce(c, F.lit(False))) for k, (c, _) in self.checks.items() if k in df.columns])
