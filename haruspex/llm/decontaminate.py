"""Benchmark decontamination by winnowing.

Both sides become words (A-Z lowered; runs of digits, letters and non-ASCII). Hashes of ``GRAM`` = 5 words
slide over them, and of every ``WINDOW - GRAM + 1`` = 6 neighbours the least is kept as a fingerprint, so any
shared span of WINDOW = 10 words leaves at least one fingerprint in common. Document fingerprints are joined
with those of the benchmark; only documents with a fingerprint in common are extended, word by word: every
position is compared with the benchmark's windows themselves, so that chance hits of hashes go.
An item of fewer than 10 words is one window of its own length, looked up by its hash at every position.

The benchmark is a stated query set and is held against all documents in blocks of at most ``BLOCK_WORDS`` words, so
what is broadcast has a bound, and the driver holds one block at a time; the documents are read once for each block,
with row numbers that are the same in each reading, and no text is shuffled.

Edge cases: null or empty texts have no words, n_hit 0; items without words never occur; items of equal text
all count, as do windows that overlap; an item of more than a block is a block of its own; very long texts are compared
at every position; rows with null item_id are ignored as they can't be named; repeated item rows count once;
repeated documents keep their rows; an empty benchmark leaves every document clean; extra columns are ignored by
contamination and kept by keep_clean, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from ._flat import LONG, alnum_ascii, mixed, pieces, slices, stash

WINDOW = 10
GRAM = 5
#: Words of the benchmark that one pass holds (about 100 bytes each in every worker).
BLOCK_WORDS = 1_000_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(alnum_ascii()).split()


def _gram_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width consecutive word ids; 0 where a word is unknown (id 0)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(width):
        part = ids[j : j + n]
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
        known &= part > 0
    h |= np.uint64(1)
    h[~known] = 0
    return h


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Which positions hold the least hash of some ``span`` neighbours (all of them where there are fewer)."""
    out = np.zeros(len(hashes), bool)
    n = len(hashes) - span + 1
    if n <= 0:
        return hashes == hashes.min() if len(hashes) else out
    least = hashes[:n].copy()
    for j in range(1, span):
        np.minimum(least, hashes[j : j + n], out=least)
    for j in range(span):
        out[j : j + n] |= hashes[j : j + n] == least
    return out


class Benchmark:
    """One block of items, ready for lookups."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple, set[int]] = {}
        long_prints, short = [], {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            n = min(WINDOW, len(ids))
            for i in range(len(ids) - n + 1):
                self.windows.setdefault(tuple(ids[i : i + n]), set()).add(item)
            if n == WINDOW:
                h = _gram_hashes(np.array(ids), GRAM)
                long_prints.append(h[winnow(h, WINDOW - GRAM + 1)])
            else:
                short.setdefault(n, []).append(_gram_hashes(np.array(ids), n))
        self.prints = np.unique(np.concatenate(long_prints)) if long_prints else np.zeros(0, np.uint64)
        self.short = {n: np.unique(np.concatenate(x)) for n, x in short.items()}
        self.lengths = sorted({len(w) for w in self.windows})

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """(which words are hit, items) of one document, by exact comparison at every position."""
        hit, items = np.zeros(len(ids), bool), set()
        for n in self.lengths:
            known = ids > 0
            runs = np.flatnonzero(np.convolve(known, np.ones(n, int), "valid") == n) if len(ids) >= n else []
            for i in runs:
                if found := self.windows.get(tuple(ids[i : i + n].tolist())):
                    hit[i : i + n] = True
                    items |= found
        return hit, items


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def _candidates(bench: Benchmark, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Documents (by index) with a fingerprint in common; ids of all documents, a 0 after each."""
    found = []
    if len(bench.prints):
        h = _gram_hashes(ids, GRAM)
        if len(h):
            h[h == 0] = np.iinfo(np.uint64).max
            # a whole known run shorter than the span can't hold a window, so the plain sliding rule is enough
            near = np.flatnonzero(_isin(h, bench.prints))
            if len(near):
                kept = winnow(h, WINDOW - GRAM + 1)
                found.append(doc[near[kept[near]]])
    for n, table in bench.short.items():
        h = _gram_hashes(ids, n)
        if len(h):
            found.append(doc[np.flatnonzero(_isin(h, table))])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _ids(text: bytes, known) -> np.ndarray:
    """Ids of the words of a translated text, 0 for unknown ones, and a 0 behind them."""
    if len(text) <= LONG:
        return np.array([known(w, 0) for w in (*text.split(), b"")], np.int32)
    found = [np.array([known(w, 0) for w in ([p] if alone else p.split())], np.int32) for p, alone in pieces(text, b" ")]
    return np.concatenate([*found, np.zeros(1, np.int32)])


def _sha(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _scan(items, whole: bool):
    """items: a broadcast block. Arrow function: RESULT rows, or (rid, doc_id, hit positions, items) of documents that are hit."""
    key = uuid.uuid4().hex

    def run(batches):
        kept = stash()
        if kept.get("benchmark", (None,))[0] != key:
            kept["benchmark"] = (key, Benchmark(items.value))
        bench, table = kept["benchmark"][1], alnum_ascii()
        known = bench.vocabulary.get
        for batch, parts in slices(batches, owner="benchmark"):
            each = [_ids(t.translate(table), known) for t in parts]
            counts = np.fromiter(map(len, each), np.int64, len(each)) - 1
            ids = np.concatenate(each)
            del each
            ends = np.cumsum(counts + 1)
            doc = np.repeat(np.arange(len(parts)), counts + 1)
            n_hit, n_items, sha = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [_sha(())] * len(parts)
            spans, names = [[] for _ in parts], [[] for _ in parts]
            for k in _candidates(bench, ids, doc).tolist():
                hit, own = bench.hits(ids[ends[k] - counts[k] - 1 : ends[k] - 1])
                n_hit[k], n_items[k], sha[k] = int(hit.sum()), len(own), _sha(own)
                spans[k], names[k] = np.flatnonzero(hit).tolist(), sorted(own)
            first = [batch.column("doc_id"), pa.array(counts)]
            if whole:
                yield pa.RecordBatch.from_arrays([*first, pa.array(n_hit), pa.array(n_items), pa.array(sha), pa.array(n_hit > 0)], names=[x.split()[0] for x in RESULT.split(", ")])
            else:
                out = pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.int64()))], names=["rid", "spans", "names"])
                yield out.filter(pa.array(n_hit > 0))

    return run


def blocks_of(benchmark: DataFrame, text: str, item_id: str, block_words: int):
    """Items in blocks of at most block_words words (an item of more is a block of its own)."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null").distinct()
    block, held = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        t = (r.t or "").encode()
        n = len(words_of(t))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        if n:
            block.append((r.i, t))
            held += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """RESULT rows, one for each document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark, blocks = docs.sparkSession, blocks_of(benchmark, item_text, item_id, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), True), RESULT)
    rows, each = numbered(rows, "contamination-docs"), None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        one = materialise(rows.mapInArrow(_scan(shared, False), "rid long, spans array<long>, names array<long>"), "contamination-block")
        shared.unpersist()
        each = one if each is None else each.union(one)
        block, following = following, next(blocks, None)
    hits = each.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    counted = rows.mapInArrow(_word_counts, "rid long, doc_id long, n_words long").join(hits, "rid", "left")
    joined = F.coalesce(F.array_join(F.array_sort(F.transform("names", lambda x: x.cast("string"))), ","), F.lit(""))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return counted.select("doc_id", "n_words", size("spans").alias("n_hit"), size("names").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"))


def _none(word: bytes, default: int) -> int:
    return default


def _word_counts(batches):
    table = alnum_ascii()
    for batch, parts in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([len(_ids(t.translate(table), _none)) - 1 for t in parts], pa.int64())], names=["rid", "doc_id", "n_words"])


def _clean(items, text: str):
    scan = _scan(items, True)

    def run(batches):
        for batch, _ in slices(batches, text, owner="benchmark"):
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text).cast(pa.string())], names=["doc_id", "text"])
            hit = np.concatenate([x.column("contaminated").to_numpy(zero_copy_only=False) for x in scan([own])])
            yield batch.filter(pa.array(~hit))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs, all columns, in which no window of the benchmark occurs; blocks filter one after another.

    What all blocks but the last have left is written, so that one block is held at a time.
    """
    blocks = blocks_of(benchmark, item_text, item_id, block_words)
    block = next(blocks)
    while block:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_clean(shared, text), docs.schema)
        if following is not None:
            docs = materialise(docs, "clean-docs")
            shared.unpersist()
        block = following
    return docs


def op7_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
with dw as (
  select doc_id, row_number() over () rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where item_id is not null),
win as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) i from iw where len(w) > 0)),
sizes as (select distinct n from win),
dg as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') g
  from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) i from dw, sizes where len(w) >= n)),
hits as (select rid, i, dg.n, item_id from dg join win on dg.g = win.g and dg.n = win.n),
words as (select rid, count(distinct p) n_hit from (select rid, unnest(generate_series(i, i + n - 1)) p from hits) group by rid),
named as (select rid, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct rid, item_id from hits) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words using (rid) left join named using (rid)
"""
