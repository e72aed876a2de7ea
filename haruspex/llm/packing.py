"""Packing token ids into sequences by cutting-stock column generation.

Every document's ids end with an end id. Blocks of a whole sequence are cut off first; what remains (fewer ids
than a sequence) is counted in a histogram of length classes, the only thing the driver sees (about 180
numbers). A linear program over patterns (how many of each class share a sequence) is solved by column
generation: a knapsack dynamic program over totals prices new patterns from the duals. Rounded-down pattern
counts and a greedy rest cover every length; documents are ranked within their class (by counts of each class
and input partition, never in one task), and a rank tells pattern, sequence and place.

Two levels: at the first, classes round lengths down and a pattern may overfill a sequence a little; what runs
over is cut off. The second level packs those tails by classes that round up. So only the last few
sequences of the second level, and what its patterns leave free, are padded.

Edge cases: null and empty texts hold the end id alone; null and repeated doc_ids keep their own pieces;
an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from ._encode import encoder, id_width
from ._flat import slices

LENGTH = 2048
#: A class is at most this share wider than its least length.
FINENESS = 32
#: The linear program stops this close to its lower bound.
GAP = 2e-4

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def class_sizes(length: int = LENGTH) -> np.ndarray:
    """1, 2, 3 ... in steps of one 32nd, up to length."""
    out, s = [], 1
    while s <= length:
        out.append(s)
        s += max(1, s // FINENESS)
    return np.array(out, np.int64)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Knapsack by totals: the pattern of greatest price less cost, that difference, and the greatest price / cost.

    costs: of a sequence filled to total 0, 1, 2 ...
    """
    top = len(costs) - 1
    value, chosen = np.full(top + 1, -np.inf), np.zeros(top + 1, np.int64)
    value[0] = 0
    fits = np.searchsorted(sizes, np.arange(top + 1), side="right")
    for t in range(1, top + 1):
        if k := fits[t]:
            gain = value[t - sizes[:k]] + prices[:k]
            chosen[t] = j = gain.argmax()
            value[t] = gain[j]
    net = value - costs
    net[0] = -np.inf
    t = int(net.argmax())
    best, ratio = float(net[t]), float((value[1:] / costs[1:]).max())
    pattern = np.zeros(len(sizes), np.int64)
    while t > 0:
        pattern[chosen[t]] += 1
        t -= int(sizes[chosen[t]])
    return pattern, best, ratio


def column_generation(sizes: np.ndarray, demand: np.ndarray, length: int, slack: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each is used, fractional) of least cost that cover the demand exactly."""
    m = len(sizes)
    costs = 1 + np.maximum(0, np.arange(length + slack + 1) - length) / length
    each = np.maximum(1, length // sizes)
    basis, used, cost = np.diag(each), demand / each, np.ones(m)
    inverse = np.diag(1 / each)
    for _ in range(rounds):
        prices = cost @ inverse
        pattern, gain, ratio = best_pattern(sizes, prices, costs)
        if gain <= 1e-9 or 1 - 1 / ratio <= GAP:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = np.where(step > 1e-9, used / step, np.inf)
        out = int(limit.argmin())
        by = limit[out]
        used = np.maximum(0, used - by * step)
        used[out] = by
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[out] = pattern
        cost[out] = costs[int(pattern @ sizes)]
    return basis, used


def plan(sizes: np.ndarray, demand: np.ndarray, length: int, slack: int) -> list[tuple[np.ndarray, int, bool]]:
    """Whole patterns that cover the demand exactly, as (pattern, times, final).

    slack: how far a pattern may overfill a sequence; 0: never. With slack, a rest that fills no sequence isn't
    final: the second level packs it with the tails.
    """
    live = np.flatnonzero(demand)
    if not len(live):
        return []
    basis, used = column_generation(sizes[live], demand[live].astype(float), length, slack)
    out, left = [], demand[live].copy()
    for pattern, x in zip(basis, np.floor(used + 1e-6).astype(np.int64)):
        x = min(int(x), int((left[pattern > 0] // pattern[pattern > 0]).min())) if pattern.any() else 0
        if x > 0:
            out.append((pattern, x, True))
            left -= x * pattern
    while left.any():  # at most a few items for each pattern are left
        pattern, room = np.zeros(len(live), np.int64), length
        for i in range(len(live) - 1, -1, -1):
            fit = min(int(left[i]), room // int(sizes[live[i]]))
            pattern[i], room = fit, room - fit * int(sizes[live[i]])
        if slack and room and (rest := np.flatnonzero(left - pattern)).size:
            pattern[rest[0]] += 1  # what runs over is cut off
        x = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, x, not slack or int(pattern @ sizes[live]) >= length))
        left -= x * pattern
    wide = []
    for pattern, x, final in out:
        whole = np.zeros(len(sizes), np.int64)
        whole[live] = pattern
        wide.append((whole, x, final))
    return wide


def _placer(patterns: list[tuple[np.ndarray, int, bool]], first: int):
    """Arrow function: rows with cls and rank get their sequence_id, -1 where the pattern isn't final."""
    start, times, seq = [], [], []
    filled: dict[int, int] = {}
    base = first
    for pattern, x, final in patterns:
        for c in np.flatnonzero(pattern).tolist():
            a = int(pattern[c])
            start.append((c << 44) + filled.get(c, 0))
            times.append(a)
            seq.append(base if final else -1)
            filled[c] = filled.get(c, 0) + a * x
        base += x * final
    order = np.argsort(np.array(start, np.int64), kind="stable")
    start, times, seq = (np.array(x, np.int64)[order] for x in (start, times, seq))

    def run(batches):
        for b in batches:
            key = (b.column("cls").to_numpy() << 44) + b.column("rank").to_numpy()
            at = np.searchsorted(start, key, side="right") - 1
            found = np.where(seq[at] < 0, -1, seq[at] + (key - start[at]) // times[at])
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("start"), b.column("length"), pa.array(found)], names=["rid", "start", "length", "sequence_id"])

    return run, base


def _placed(items: DataFrame, sizes: np.ndarray, length: int, slack: int, first: int, name: str) -> tuple[DataFrame, int]:
    """items (rid, start, length, cls) with sequence_id and offset; the next free sequence_id."""
    part = F.shiftright("rid", 33)  # input partition, from monotonically_increasing_id
    items = items.withColumn("part", part)
    counts = items.groupBy("cls", "part").count()
    counts = materialise(counts, f"{name}-counts")
    histogram = np.zeros(len(sizes), np.int64)
    for r in counts.groupBy("cls").agg(F.sum("count").alias("n")).collect():
        histogram[r.cls] = r.n
    run, last = _placer(plan(sizes, histogram, length, slack), first)
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = items.withColumn("own", F.row_number().over(Window.partitionBy("cls", "part").orderBy("rid", "start")))
    ranked = ranked.join(before.drop("count"), ["cls", "part"]).withColumn("rank", (F.col("own") - 1 + F.coalesce("before", F.lit(0))).cast("long"))
    laid = ranked.select("rid", "start", "length", F.col("cls").cast("long").alias("cls"), "rank").mapInArrow(run, "rid long, start long, length long, sequence_id long")
    w = Window.partitionBy("sequence_id").orderBy("length", "rid", "start").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("offset", F.when(F.col("sequence_id") < 0, length).otherwise(F.coalesce(F.sum("length").over(w), F.lit(0))))
    return materialise(laid, name), last


def _class_of(sizes: np.ndarray, column, up: bool):
    """The class of a length: its place in a table of all lengths up to the last, one lookup a row."""
    table = np.searchsorted(sizes, np.arange(int(sizes[-1]) + 1), side="left" if up else "right") - (0 if up else 1)
    listed = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<int>")
    return F.get(listed, F.least(column, F.lit(int(sizes[-1]))).cast("int"))


def _tokens(tokenizer: str, words: bool, end_id: int, width: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer, words)
        for batch, parts in slices(batches, owner="encoder"):
            ids = [encode.ids(t) + end for t in parts]
            narrow = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(narrow, pa.binary())], names=["rid", "doc_id", "n", "ids"])

    return run


def _cutter(length: int, first: int, width: int):
    def run(batches):
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            rows = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc_id, n, ids, blocks, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "blocks", "own"))):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                places = [(length * i, length, first + blocks + i, 0) for i in range(n // length)]
                places += [(x["start"], x["length"], x["sequence_id"], x["offset"]) for x in own or ()]
                for s, k, q, o in sorted(places):
                    for name, value in zip(rows, (doc_id, s, k, wide[s : s + k].tobytes(), n, q, o)):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=list(rows))

    return run


def pack(docs: DataFrame, tokenizer: str, *, words: bool, end_id: int, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """PIECES of all documents: ids as little-endian unsigned 32-bit integers."""
    width = id_width(tokenizer, end_id)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokens = materialise(rows.mapInArrow(_tokens(tokenizer, words, end_id, width), "rid long, doc_id long, n long, ids binary"), "packing-ids")
    sizes = class_sizes(length)
    rest = tokens.select("rid", (F.col("n") - F.col("n") % length).alias("start"), (F.col("n") % length).alias("length")).where("length > 0")
    one, last = _placed(rest.withColumn("cls", _class_of(sizes, F.col("length"), False)), sizes, length, length // FINENESS, 0, "packing-first")
    kept = F.greatest(F.least(F.col("length"), F.lit(length) - F.col("offset")), F.lit(0))
    tails = one.select("rid", (F.col("start") + kept).alias("start"), (F.col("length") - kept).alias("length")).where("length > 0")
    # A class rounds up here; the widest lengths keep their own class, the length of a sequence.
    upper = np.unique(np.append(sizes, length))
    two, last = _placed(tails.withColumn("cls", _class_of(upper, F.col("length"), True)), upper, length, 0, last, "packing-second")
    pieces = one.select("rid", "start", kept.alias("length"), "sequence_id", "offset").where("length > 0").unionByName(two)
    own = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("own"))
    part = F.shiftright("rid", 33)
    blocks = tokens.select("rid", "n", part.alias("part"), F.floor(F.col("n") / length).alias("k")).where("k > 0")
    parts = blocks.groupBy("part").agg(F.sum("k").alias("k"))  # one row for each input partition
    parts = parts.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    mine = F.coalesce(F.sum("k").over(Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("mine", mine).join(parts, "part").select("rid", (F.col("mine") + F.col("before")).cast("long").alias("blocks"))
    side = own.join(blocks, "rid", "full_outer")
    whole = tokens.join(side, "rid", "left").select("doc_id", "n", "ids", F.coalesce("blocks", F.lit(0)).alias("blocks"), "own")
    return whole.mapInArrow(_cutter(length, last, width), PIECES)


def op5_cutting_stock_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), words=True, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
