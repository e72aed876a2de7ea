"""Scans and sinks of forecast files, evaluation sets, series and sweeps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "question_id string, quarter int, outcome int, response string, expectation_probability double, expectation_greedy double, expectation_tenths_mass double, seconds double, error string"
EVAL_SCHEMA = "questions array<struct<question_id string, text string, open_date string, scheduled_resolve_date string, resolved_at string, outcome int, quarter int, event_ticker string, category string>>, split string, n bigint, base_rate double, content_hash string"
MARKET_SCHEMA = "ticker string, event_ticker string, status string, mve_collection_ticker string, title string, result string, open_time string, settlement_ts string, close_time string"
BAD = "_bad"


def jsonl(spark, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines (plain or gzip); lines that don't parse, a cut-off last one too, are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", f"{schema}, {BAD} string", options).alias("x")).where(f"x.{BAD} is null").select("x.*").drop(BAD)


def forecasts(spark, path: str) -> DataFrame:
    """(question_id, probability): the last line of each question that has a probability."""
    rows = jsonl(spark, path, RUN_SCHEMA).where("expectation_probability is not null and question_id is not null")
    seq = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    return rows.withColumn("_s", seq).groupBy("question_id").agg(F.max_by("expectation_probability", "_s").alias("probability"))


def eval_set(spark, path: str) -> DataFrame:
    rows = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)
    return rows.select(F.inline("questions"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def done_ids(spark, path: str) -> DataFrame:
    """Questions that a run file has; none where there is no file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "question_id string")
    return jsonl(spark, path, RUN_SCHEMA).where("question_id is not null").select("question_id").distinct()


def remaining(questions: DataFrame, done: DataFrame) -> DataFrame:
    return questions.join(done, "question_id", "left_anti")


def csv_series(spark, path: str, *, date_column: str, value_column: str) -> DataFrame:
    """(ts, value) in order; a blank or unreadable cell or an empty file is an error, dates without zone are UTC."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path).select(F.col(date_column).alias("d"), F.col(value_column).alias("v"))
    ts, value = F.try_to_timestamp("d"), F.expr("try_cast(v as double)")
    need = lambda c, raw, kind: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.concat(F.lit("bad cell: "), F.coalesce(raw, F.lit("blank")))).cast(kind))
    if rows.isEmpty():
        raise ValueError(f"no observations in {path}")
    return rows.select(need(ts, F.col("d"), "timestamp").alias("ts"), need(value, F.col("v"), "double").alias("value")).orderBy("ts")


class CsvSource:
    """A series source: its spec and its observations."""

    def __init__(self, path: str, series_id: str, source: str, policy: str, *, date_column: str, value_column: str, units: str = "", description: str = ""):
        self.path, self.columns = path, {"date_column": date_column, "value_column": value_column}
        self.spec = {"series_id": series_id, "source": source, "policy": policy, "units": units, "description": description}

    def load(self, spark) -> DataFrame:
        return csv_series(spark, self.path, **self.columns).select(F.lit(self.spec["series_id"]).alias("series_id"), "ts", "value")


def market_sweep(spark, path: str, partitions: int | None = None) -> DataFrame:
    """Swept markets with opened and settled instants; gzip can't be split, so its rows are dealt out after the scan."""
    rows = jsonl(spark, path, MARKET_SCHEMA)
    rows = rows.repartition(partitions) if partitions else rows
    return rows.withColumn("opened", F.try_to_timestamp("open_time")).withColumn("settled", F.try_to_timestamp("settlement_ts"))


def json_ids_hash(ids: Column) -> Column:
    """sha256 of a sorted array of ids as Python's json module writes it."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(ids, '", "'), F.lit('"]')), 256)


def eval_payload(questions: DataFrame, dropped: dict[str, int], split: str) -> DataFrame:
    """One row: all questions in order of id, their number, base rate, drops and content hash. An empty set is refused."""
    if questions.isEmpty():
        raise ValueError("an empty evaluation set is not written")
    cols = F.struct(*questions.columns)
    out = questions.agg(F.array_sort(F.collect_list(cols)).alias("questions"), F.count("*").alias("n"), F.avg("outcome").alias("base_rate"), F.array_sort(F.collect_list("question_id")).alias("ids"))
    return out.select("questions", F.lit(split).alias("split"), "n", "base_rate", F.lit(json.dumps(dropped, sort_keys=True)).alias("dropped"), json_ids_hash(F.col("ids")).alias("content_hash"))


def write_run(rows: DataFrame, path: str, append: bool = True) -> None:
    """JSON lines with a fixed set of keys, nulls included; appended part files make a run resumable."""
    keys = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
    have = rows.select(*[F.col(k) if k in rows.columns else F.lit(None).cast("string").alias(k) for k in keys])
    have.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("value")).write.mode("append" if append else "errorifexists").text(path)


def file_hashes(spark, path: str) -> DataFrame:
    """(path, sha256) of files under 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def hash_file(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def last_by(df: DataFrame, key: Iterable[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
