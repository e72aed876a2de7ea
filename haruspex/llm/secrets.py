"""Secret scans over an incremental blob ledger.

A text is addressed by its SHA-256, so every version of every path is one blob however often it occurs. The
ledger names the (blob, rule version) pairs already scanned and what was found; a scan takes only the pairs
that it lacks, one representative of each blob, and findings are joined back to all paths.

Spans are (kind, start, end) in code points, end exclusive, leftmost and non-overlapping within a kind.
Base kinds are assign, access and hex; the rule set adds key blocks, web tokens, tokens of code hosts and chat
services, and credentials in addresses.

Edge cases: null and empty texts are the empty blob and have no spans; repeated rows keep their rows, and a pair that
the ledger holds twice counts once; null path values are kept; of matches of one kind that overlap the leftmost
counts, spans that start together are ordered by kind as listed, and all of them stay; very long texts are scanned
whole, each rule in time that grows with their length; an empty table gives empty results; extra columns are ignored
by scan and kept by redact, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import free_name, fresh_path, materialise, numbered
from ._flat import slices

BASE = ("assign", "access", "hex")
#: Name, pattern, least length and which group has it. Names are ordered: base kinds first, as listed.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
    ("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
    ("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("host_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 0),
    ("address", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{1,128}@", 0, 0),
)
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
SPANS = "spans array<struct<kind: string, start: long, `end`: long>>"


def _compiled():
    return [(k, re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)), n, g) for k, p, n, g in RULES]


#: What a text must hold (in lower case) for a rule to match; hex is sought by its own shortest form.
NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "key_block": ("-----begin",), "web_token": ("eyj",), "host_token": ("gh", "glpat-", "xox", "aiza"), "address": ("://",)}
#: 24 places of a hexadecimal digit hold one at every 24th place, so a probe at each decides in few steps.
LONG_HEX = r"[0-9a-f]{24}"


def find(text: str, rules=None, long_hex=None) -> list[tuple[str, int, int]]:
    """All spans of one text, ordered by start, then by kind as listed."""
    rules, long_hex, out, low = rules or _compiled(), long_hex or re.compile(LONG_HEX), [], text.lower()
    for order, (kind, pattern, least, group) in enumerate(rules):
        if kind == "hex":
            at = 0
            while m := long_hex.search(text, at):
                end = pattern.match(text, m.start()).end()
                out.append((m.start(), order, end))
                at = end
        elif any(x in low for x in NEEDS[kind]):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    out.append((m.start(), order, m.end()))
    return [(rules[o][0], s, e) for s, o, e in sorted(out)]


def _scan(batches):
    rules, long_hex = _compiled(), re.compile(LONG_HEX)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch, parts in slices(batches):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.decode(), rules, long_hex)] for t in parts]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], names=["blob", "spans"])


class Ledger:
    """Findings of (blob, rule version) pairs, kept as Parquet under a path of the shared folder; none where it is new.

    Appends are idempotent in effect: a pair's findings follow from the pair, so one that was written twice (by two
    scans at once, or by a job that ran again) is read once.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def entries(self, version: str = VERSION) -> DataFrame:
        """(blob, spans), one row for each blob that this rule version has scanned."""
        schema = f"blob string, version string, {SPANS}"
        try:
            found = self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], schema)
        return found.where(F.col("version") == version).groupBy("blob").agg(F.first("spans").alias("spans"))

    def add(self, found: DataFrame, version: str = VERSION) -> None:
        found.select("blob", F.lit(version).alias("version"), "spans").write.mode("append").parquet(self.path)


def scan(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """(path, blob, spans) of every row of docs; only blobs that the ledger lacks are read.

    Without a ledger a fresh one is laid down in the shared folder. Results always come from the ledger: what it held
    before and what this scan has added to it.
    """
    ledger = ledger or Ledger(docs.sparkSession, fresh_path(docs.sparkSession, "secret-ledger"))
    rows = numbered(docs.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "secret-docs")
    # Only row numbers and addresses meet by blob; texts go to their representative's row number, which no group shares.
    paths = materialise(rows.select("rid", "path", F.sha2(F.col("text").cast("binary"), 256).alias("blob")), "secret-paths")
    unseen = paths.groupBy("blob").agg(F.min("rid").alias("rid")).join(ledger.entries().select("blob"), "blob", "left_anti")
    ledger.add(rows.select("rid", "text").join(unseen, "rid").select("blob", "text").mapInArrow(_scan, f"blob string, {SPANS}"))
    found = ledger.entries().where(F.size("spans") > 0)
    none = F.array().cast(SPANS.split(" ", 1)[1])
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans):
    """kind:start:end, comma-joined, of an ordered array of spans."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_blob_ledger_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans go as one, under the first kind."""
    rid, spans = free_name(docs, "rid"), free_name(docs, "found")
    keyed = numbered(docs, "secret-redact", rid)
    found = scan(keyed, rid, text, ledger).where(F.size("spans") > 0).select(F.col("path").alias(rid), F.col("spans").alias(spans))
    step = lambda acc, x: F.when(
        x["end"] <= acc["at"], acc
    ).otherwise(
        F.struct(
            F.concat(acc["out"], F.when(x["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")))).alias("out"),
            x["end"].alias("at"),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(F.col(text)))))
    out = keyed.join(found, rid, "left").withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(clean))
    return out.select(*docs.columns)
