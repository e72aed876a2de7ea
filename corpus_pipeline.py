"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and all but the last return documents.

Every stage takes null and empty texts as texts without words, texts of any length, repeated rows, null doc_ids, an
empty table and further columns of any name; all but the last return their rows with all columns as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haruspex.llm import decontaminate, dedup_simhash, packing, secrets
from haruspex.llm.toxicity import Toxicity
from haruspex.storage import held, materialise, release


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels of the documents that are here.

    A score equal to the threshold is toxic; texts without words score as the curve says for no evidence; of repeated
    rows all stay or all go.
    """
    model = Toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.keep_clean(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least doc_id."""
    return dedup_simhash.keep_one(docs, first="doc_id")


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; texts without words hold none, and an empty benchmark has none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by their kind, and n_chars follows.

    Spans that overlap go as one, under the kind of the first; null texts stay null.
    """
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; a text without words is its end id alone."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=True, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: The first stage is a fitted model and the last a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage has written on its way is deleted once its result is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), held()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, [p for p in held()[:-1] if p not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
