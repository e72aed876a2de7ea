"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits; two fingerprints link at Hamming distance ``limit`` (2) or less. Its bits form a
ring of ``SEGMENTS`` = 5 segments. By the pigeonring principle, of two fingerprints that link there is a
segment from which every chain of L consecutive segments holds at most L * limit / 5 differing bits:

    chain of      1  2  3  4  5
    at most       0  0  1  1  2

So candidates are looked for under five keys, each two consecutive segments that must be equal (25 bits),
chains of three and four segments prune them, and the full Hamming check decides.

Skew: equal fingerprints are one node from the start. A key of up to ``CROWD`` fingerprints is compared in
one task in numpy. A more crowded key is split by the chain of three: the third segment differs in one bit at
most, so each member takes the 14 keys (of 38 bits) of its third segment and of that one's one-bit neighbours, and
two that link share one. Where that is crowded too, no pairs are compared: two fingerprints link exactly if they
share a word at distance one or less from both, so each member names its one-bit neighbours outside the equal
segments and every named word becomes a star of links (40 rows a member at most, exact).

Components come from alternating star contraction over links between nodes, on executors only.

Edge cases: null and empty texts have fingerprint zero and link like others; texts of one or two words hash
the whole sequence; very long texts are gone through piece by piece, with 64 counters of state; a bit that exactly
half the shingles have is 0, and of links that tie none is preferred, as components need no order; a fingerprint
that only rows with null doc_id have is no node, so it links nothing and its component_id is null; null doc_id rows
of other fingerprints get their component; repeated rows are kept; an empty table gives an empty result; extra
columns are ignored by near_duplicates and kept by keep_one, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import free_name, materialise, numbered
from ._flat import LONG, WHITE, lower_ascii, pieces, slices

SEGMENTS = (13, 13, 13, 13, 12)
CROWD = 256
WIDTH = 3
SEED = 42


def fingerprint_of(words: list[bytes], width: int = WIDTH) -> int:
    """Majority fingerprint of one word list (as bytes); zero for none."""
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return int(_majority(_shingle_hashes(words, width)))


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all shingles of at least ``width`` words."""
    flat, n = b" ".join(words), len(words) - width + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter([digest(flat[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[lo : lo + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return ones


def _majority(hashes: np.ndarray) -> np.uint64:
    return np.packbits(2 * _ones(hashes) > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint_of_long(text: bytes, width: int = WIDTH) -> int:
    """fingerprint_of the words of a text of any length, with the bits counted piece by piece."""
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for piece, _ in pieces(text, WHITE):
        words = carried + piece.split()
        if len(words) >= width:
            hashes = _shingle_hashes(words, width)
            ones, n = ones + _ones(hashes), n + len(hashes)
            carried = words[len(words) - width + 1 :]
        else:
            carried = words
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else fingerprint_of(carried, width)


def _fingerprint_batches(batches):
    table = lower_ascii()
    for batch, parts in slices(batches):
        low = (t.translate(table) for t in parts)
        prints = np.array([fingerprint_of_long(t) if len(t) > LONG else fingerprint_of(t.split()) for t in low], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _ring(fp, k: int):
    """fp turned so that segment k comes first (lowest bits), as a signed 64-bit column."""
    shift = sum(SEGMENTS[:k])
    return fp if shift == 0 else F.shiftrightunsigned(fp, shift).bitwiseOR(F.shiftleft(fp, 64 - shift))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs_in_order(batches):
    """Rows sorted by (k, key): links among the members of each key, the chain budgets first.

    Of each member, links to every smaller linked member of its key would be quadratic in dense keys, so each
    key's links are thinned to a spanning forest before they leave the task.
    """
    kept = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now)]
        k, key = now[0], now[1]
        last = len(key) - int(np.argmax((k[::-1] != k[-1]) | (key[::-1] != key[-1]))) if ((k != k[-1]) | (key != key[-1])).any() else 0
        done, kept = [x[:last] for x in now], [x[last:] for x in now]
        if last:
            yield from _links_of(*done)
    if kept is not None:
        yield from _links_of(*kept)


def _links_of(k, key, ring, node):
    ring = ring.astype(np.int64).view(np.uint64)
    chains = [(np.uint64((1 << sum(np.roll(SEGMENTS, -r)[:n])) - 1), n, r) for r in range(5) for n in (3, 4)]
    masks = {(n, r): m for m, n, r in chains}
    three = np.array([masks[3, r] for r in range(5)], np.uint64)[k]
    four = np.array([masks[4, r] for r in range(5)], np.uint64)[k]
    left, right, step = [], [], 1
    at = np.arange(len(key))
    while True:
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (k[at] == k[at + step])]
        if not len(at):
            break
        x = ring[at] ^ ring[at + step]
        ok = (_popcount(x & three[at]) <= 1) & (_popcount(x & four[at]) <= 1)
        ok[ok] = _popcount(x[ok]) <= 2
        left.append(at[ok])
        right.append(at[ok] + step)
        step += 1
    if not left or not sum(map(len, left)):
        return
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(key))
    while True:  # hooking and pointer jumping over the key's own members
        ra, rb = root[a], root[b]
        far = ra != rb
        if not far.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[far], np.minimum(ra, rb)[far])
        while (root != root[root]).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(key)))
    yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], names=["a", "b"])


def _variants(ring, k: int):
    """The words at distance one or less from ring that keep its first two segments."""
    first = sum((SEGMENTS * 2)[k : k + 2])
    flips = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(first, 64)]
    return F.array(*[ring.bitwiseXOR(F.lit(f).cast("long")) for f in flips])


def _third(ring, k: int):
    """Words of the third segment at distance one or less from ring's, where they lie in ring."""
    low, width = sum((SEGMENTS * 2)[k : k + 2]), (SEGMENTS * 2)[k + 2]
    own = ring.bitwiseAND(F.lit(((1 << width) - 1) << low).cast("long"))
    return F.array(own, *[own.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(low, low + width)])


def _by_segment(f) -> DataFrame:
    """The union of f(k) over all five segments."""
    out = f(0)
    for k in range(1, 5):
        out = out.unionByName(f(k))
    return out


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("k", "key", "ring", "node").repartition("k", "key").sortWithinPartitions("k", "key").mapInArrow(_pairs_in_order, "a long, b long")


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """Rows whose key others share, with their number."""
    counts = keyed.groupBy("k", "key").count().where("count > 1")
    return materialise(keyed.join(counts, ["k", "key"]), name)


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """nodes (node long, fp long, distinct fps): links (a, b) that keep all components of distance <= 2."""

    def first(k):
        ring = _ring(F.col("fp"), k)
        mask = (1 << sum((SEGMENTS * 2)[k : k + 2])) - 1
        return nodes.select(F.lit(k).alias("k"), ring.bitwiseAND(F.lit(mask).cast("long")).alias("key"), ring.alias("ring"), "node")

    two = _shared(_by_segment(first), "simhash-keys")
    crowded = two.where(F.col("count") > crowd).drop("count")
    three = _by_segment(lambda k: crowded.where(F.col("k") == k).select("k", F.col("key"), "ring", "node", F.explode(_third(F.col("ring"), k)).alias("sub")))
    three = _shared(three.select("k", F.col("key").bitwiseOR(F.col("sub")).alias("key"), "ring", "node"), "simhash-chains")
    dense = three.where(F.col("count") > crowd).select("k", "ring", "node").distinct()
    many = _by_segment(lambda k: dense.where(F.col("k") == k).select("k", F.explode(_variants(F.col("ring"), k)).alias("word"), "node"))
    stars = many.groupBy("k", "word").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)  # 65 members at most
    stars = stars.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")).where("a != b")
    return _pairs(two.where(F.col("count") <= crowd)).unionByName(_pairs(three.where(F.col("count") <= crowd))).unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): (node, root) of every node in them, root the smallest node reachable.

    Alternates large-star and small-star until nothing changes; each round is written to the shared folder.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = materialise(both, "components")
    before = None
    while True:
        tall = now.union(now.select("b", "a"))
        least = tall.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tall.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = materialise(small, "components")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links."""
    prints = materialise(fingerprints(docs, text, doc_id), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where(F.col("node").isNotNull())
    nodes = materialise(nodes, "simhash-nodes")
    roots = components(links(nodes, crowd))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", crowd: int = CROWD, first: str | None = None) -> DataFrame:
    """One row of each group, all columns; groups are of rows, so repeated rows and null doc_ids count too.

    first: a column by which the row that stays is the least (nulls last, row numbers decide ties); else row numbers
    alone decide, which follow the names of files.
    """
    rid = free_name(docs, "rid")
    rows = numbered(docs, "simhash-docs", rid)
    found = near_duplicates(rows, text, rid, crowd).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    if first is None:
        return rows.join(found.where("_row != _group").select(F.col("_row").alias(rid)), rid, "left_anti").select(*docs.columns)
    order = rows.select(F.col(rid).alias("_row"), F.struct(F.col(first).isNull().alias("none"), F.col(first).alias("first"), F.col(rid).alias("row")).alias("_order"))
    stay = order.join(found, "_row").groupBy("_group").agg(F.min("_order").alias("least")).select(F.col("least.row").alias(rid))
    return rows.join(stay, rid, "left_semi").select(*docs.columns)
