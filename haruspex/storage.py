"""Places that the driver and every executor share, and row numbers that outlive a reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local.

    On a cluster a folder of one machine would be lost on all others, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="haruspex-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this driver has made, until release().
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def held() -> list[str]:
    """Folders written so far and not yet released, in order."""
    return list(_MADE)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete what has been written to the shared folder (or some of it); call it when results that read it are done."""
    n = 0
    for name in _MADE[:] if paths is None else paths:
        _MADE.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _scan_only(df: DataFrame) -> bool:
    """Whether df is one scan of Parquet files with nothing but deterministic projections and filters on top."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    node = plan
    while (kind := node.nodeName()) in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return kind == "LogicalRelation" and node.toString().strip().endswith(" parquet")


def _file_salt(files: list[str], bits: int) -> str | None:
    """A salt under which no two files share the low bits of their hash."""
    import xxhash

    for salt in range(64):
        if len({xxhash.xxh64_intdigest(f"{salt}:{f}".encode(), 42) & (1 << bits) - 1 for f in files}) == len(files):
            return f"{salt}:"
    return None


def numbered(df: DataFrame, name: str, column: str = "rid") -> DataFrame:
    """df with a long column that names each row, the same in every reading.

    A scan of Parquet files is numbered by file and by place in the file, which don't depend on how files are split:
    splits follow the number of live cores, so a generated number would name other rows once an executor is lost or
    added. Anything else is written once, with its number as a column. The high bits are a hash of the file's name
    under a salt that tells all files of the scan apart; the low bits are the place.
    """
    files = sorted(set(df.inputFiles())) if _scan_only(df) else []
    bits = 2 * max(len(files), 2).bit_length() + 1
    salt = _file_salt(files, bits) if files and bits < 40 else None
    if salt is None:
        return materialise(df.withColumn(column, F.monotonically_increasing_id()), name)
    place, room = F.col("_metadata.row_index"), 62 - bits
    file = F.xxhash64(F.concat(F.lit(salt), F.col("_metadata.file_path"))).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    number = F.shiftleft(file, room).bitwiseOR(place)
    checked = F.when(place < F.lit(1 << room), number).otherwise(F.raise_error(F.lit("a file has too many rows to be numbered")).cast("long"))
    return df.withColumn(column, checked)


def replayable(df: DataFrame, name: str) -> DataFrame:
    """df, if it is a mere scan of files that any number of readings may repeat; else a written copy."""
    return df if _scan_only(df) else materialise(df, name)
