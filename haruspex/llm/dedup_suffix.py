"""Removal of repeated byte strings, in the corpus order that prefix-free parsing gives.

A byte goes if some string of ``LENGTH`` = 200 bytes over it also starts anywhere else, in the same document or
another. Strings are compared as bytes and never cross documents.

Rolling-hash triggers cut texts into phrases: of every ``REACH`` = 96 neighbouring 16-byte strings the one of
least hash is a trigger, so any 200 bytes hold one, at the same place in every copy, and equal strings are cut
alike. A string of 200 bytes that starts at s then is a suffix of the phrase that ends in its trigger, followed
by a prefix of the parse from that trigger on. Corpus order needs two keys, as in the suffix arrays of
dictionary and parse:

* the parse key, of the 105 bytes from the trigger on, which all strings of the phrase's starts share;
* the phrase key, of the phrase's whole context (from its first start to the end of its last string).

Triggers are sorted by (parse key, phrase key), rows of equal parse key being the only candidates. The parse key is a
Karp-Rabin fingerprint of 64 bits that only brings candidates together; equality is never decided by it. The phrase
key is a BLAKE2b digest of the context's bytes (128 bits), as blobs are addressed by what they hold. Digests group as
lexicographic ranks do: only equality at a depth of 200 bytes is asked for. Equal neighbours in both keys: every string
of the phrase is repeated. A parse key with several contexts: they are that key's dictionary, one row of each, and the
suffix array of the dictionary (all starts of its phrases, sorted by their bytes) puts repeated strings next to each
other, with a common prefix of 200 bytes or more.

Sorted streams are read in batches with one row of state, so a key of any size needs no memory, and no pairs are
made. A dictionary of more than ``CROWD`` contexts (a line that very many documents share) isn't gathered in one task:
its strings are dealt by parse key and their own digests, and equal neighbours are the repeated ones. Both ways give
the same result. Before rows move, each step of a batch keeps two rows of equal keys: more are known to be repeated
there and then, and travel by their document, so that no key is hot. Texts move twice, compressed, to be opened and
to be cut.

Edge cases: null and empty texts have no bytes (the hash of nothing); texts under 200 bytes stay whole; texts of any
length are parsed in chunks of ``CHUNK`` bytes; all copies of a repeated string go, so ties need no order; repeated rows
are copies of each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from ._flat import STEP_BYTES, RollingHash, mixed, slices, stretches

LENGTH = 200
REACH = 96
GRAM = 16
#: Bytes of one text that are hashed at a time.
CHUNK = 4 << 20
#: Contexts that a dictionary may have to be suffix-sorted in one task (300 bytes each).
CROWD = 512
#: Parts that the rows of a crowded dictionary are dealt to.
SALTS = 32
#: Strings that are sorted at a time, of one dictionary or of many.
SORT = 1 << 15


class Shape:
    """Lengths that fit together: of the repeated strings, of a trigger's neighbourhood, of a trigger; bits of the parse key."""

    def __init__(self, length: int = LENGTH, reach: int = REACH, gram: int = GRAM, bits: int = 64):
        if reach + gram - 1 > length:
            raise ValueError("a string must hold a whole neighbourhood of triggers")
        self.length, self.reach, self.gram, self.key = length, reach, gram, length - reach + 1
        self.mask = np.uint64((1 << bits) - 1)


def digests(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each substring, 128 bits as two integers."""
    view = memoryview(buffer)
    found = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """Of every ``reach`` neighbours the least, by start."""
    width, out = 1, values
    while 2 * width <= reach:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = reach - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(buffer: np.ndarray, first: np.ndarray, last: np.ndarray, shape: Shape):
    """(parse key, both halves of the phrase key, first start, number of starts) of the triggers of strings starting in [first, last)."""
    hashes = RollingHash(buffer)
    grams = hashes.every(shape.gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    least = _least((grams & ~low) | (low - place), shape.reach)
    starts = stretches(first, last)
    trigger = (low - (least[starts] & low)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    lo, t = starts[at], trigger[at]
    parse = hashes.of(t, t + shape.key) & shape.mask
    return parse.view(np.int64), *digests(buffer, lo, lo + n - 1 + shape.length), lo, n


def _pieces(parts: list[bytes], shape: Shape):
    """(buffer, document, place of the buffer in it, first and last starts) that together hold every string."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    for i in np.flatnonzero(sizes > CHUNK).tolist():
        whole = np.frombuffer(parts[i], np.uint8)
        for at in range(0, len(whole) - shape.length + 1, CHUNK):
            piece = whole[at : at + CHUNK + shape.length - 1]
            yield piece, np.array([i]), np.array([-at]), np.zeros(1, np.int64), np.array([len(piece) - shape.length + 1])
    fit = np.flatnonzero((sizes >= shape.length) & (sizes <= CHUNK))
    if len(fit):
        begin = np.concatenate(([0], np.cumsum(sizes[fit])[:-1]))
        yield np.frombuffer(b"".join([parts[i] for i in fit.tolist()]), np.uint8), fit, begin, begin, begin + sizes[fit] - shape.length + 1


#: Places travel as one integer: first start, then this many bits for the number of starts.
BITS = 24


def _packed(lo: np.ndarray, n) -> np.ndarray:
    return lo << BITS | n


def _third(*keys: np.ndarray) -> np.ndarray:
    """Which rows have two rows of equal keys before them."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[2:]] = same[1:] & same[:-1]
    return out


SMALL, CROWDED, KNOWN = 0, 1, 2


def _dealt(keys: list[np.ndarray], rid: np.ndarray, lo: np.ndarray, n: np.ndarray, names: list[str], kind: int):
    """Rows to sort by keys, and those already known to be repeated, joined to runs and dealt by document."""
    known = _third(*keys)
    open_ = ~known
    k, c, d = (x[open_] for x in keys)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(k), kind, np.int32), k, c, d, rid[open_], _packed(lo, n)[open_])], names=names)
    if known.any():
        r, a, k = rid[known], lo[known], n[known]
        order = np.lexsort((a, r))
        r, a, k = r[order], a[order], k[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (a[1:] != a[:-1] + k[:-1])))
        at = np.flatnonzero(new)
        total = np.add.reduceat(k, at)
        r, a = r[at], a[at]
        far, none = mixed(r.astype(np.uint64)).view(np.int64), np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), KNOWN, np.int32), far, none, none, r, _packed(a, total))], names=names)


ROWS = ["kind", "k", "c", "d", "rid", "at"]


def _parse(shape: Shape):
    def run(batches):
        for batch, parts in slices(batches):
            rid = batch.column("rid").to_numpy()
            for buffer, doc, begin, first, last in _pieces(parts, shape):
                parse, c, d, lo, n = phrases(buffer, first, last, shape)
                which = np.searchsorted(first, lo, side="right") - 1
                yield from _dealt([parse, c, d], rid[doc[which]], lo - begin[which], n, ROWS, SMALL)

    return run


SINGLE, WHOLE, OPEN, BOTH = 0, 1, 2, 3


def _sorted_rows(batches):
    """(known, columns) of sorted batches, rows to compare apart from rows already known."""
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        known = rows[0] == KNOWN
        for flag in (False, True):
            on = known == flag
            if on.any():
                yield flag, [x[on] for x in rows[1:]]


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in some column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _order(batches):
    """Rows in order of (k, c, d): WHOLE where the context has a copy, OPEN where other contexts share the key, or BOTH.

    The first row of a run of equal (k, c, d) waits for the run's end; all others are known at once.
    """
    held, more, before = None, 0, False  # the open run's first row, how many followed, whether its key had other runs
    for known, rows in _sorted_rows(batches):
        if known:
            yield from _kinds(rows, np.full(len(rows[0]), WHOLE))
            continue
        if held is not None:
            rows = [np.concatenate((a, b)) for a, b in zip(held, rows)]
        k = rows[0]
        new_key, first = _differs(k), _differs(*rows[:3])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(k)))
        size[0] += more
        key = np.cumsum(new_key[at]) - 1
        runs = np.bincount(key)
        runs[0] += before
        kind = np.full(len(k), WHOLE, np.int64)
        kind[at] = np.where(size > 1, WHOLE, SINGLE) + np.where(runs[key] > 1, OPEN, 0)
        more, before, wait = int(size[-1]) - 1, bool(runs[key[-1]] > 1), at[-1]
        held = [x[wait : wait + 1] for x in rows]
        kind[wait] = SINGLE  # not yet known
        yield from _kinds(rows, kind)
    if held is not None:
        yield from _kinds(held, np.array([(WHOLE if more else SINGLE) + (OPEN if before else 0)]))


def _kinds(rows, kind):
    on = np.flatnonzero(kind)
    if len(on):
        k = np.where(kind[on] >= OPEN, rows[0][on], 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[3][on]), pa.array(rows[4][on]), pa.array(kind[on].astype(np.int32)), pa.array(k)], names=["rid", "at", "kind", "k"])


OPENED = [*ROWS, "context"]


def _contexts(shape: Shape):
    """Opened phrases: contexts of small dictionaries to sort by parse key, strings of crowded ones by parse key and digest."""

    def run(batches):
        for batch, parts in _unpacked(batches):
            rows, rid, lo, size, keys, buffers = ([], [], [], []), [], [], [], [], []
            for r, text, places in zip(batch.column("rid").to_pylist(), parts, batch.column("places")):
                at = places.values.field("at").to_numpy()
                k, crowded = places.values.field("k").to_numpy(), places.values.field("crowded").to_numpy(zero_copy_only=False)
                a, n = at >> BITS, at & (1 << BITS) - 1
                for i in np.flatnonzero(~crowded).tolist():
                    for x, v in zip(rows, (k[i], r, at[i], text[a[i] : a[i] + n[i] - 1 + shape.length])):
                        x.append(v)
                if crowded.any():
                    a, n = a[crowded], n[crowded]
                    rid.append(np.full(len(a), r))
                    lo.append(a)
                    size.append(n)
                    keys.append(k[crowded])
                    # contexts side by side: only their own bytes are hashed
                    buffers.append(np.frombuffer(text, np.uint8)[stretches(a, a + n - 1 + shape.length)])
            m = len(rows[0])
            if m:
                k, r, at = (pa.array(x, pa.int64()) for x in rows[:3])
                none = pa.array(np.zeros(m, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, SMALL, np.int32)), k, none, none, r, at, pa.array(rows[3], pa.binary())], names=OPENED)
            if rid:
                rid, lo, n, k, buffer = map(np.concatenate, (rid, lo, size, keys, buffers))
                begin = np.concatenate(([0], np.cumsum(n - 1 + shape.length)[:-1]))
                starts = stretches(begin, begin + n)
                own = [np.repeat(k, n), *digests(buffer, starts, starts + shape.length)]
                for out in _dealt(own, np.repeat(rid, n), stretches(lo, lo + n), np.ones(len(starts), np.int64), ROWS, CROWDED):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], names=OPENED)

    return run


def suffix_order(contexts: list[bytes], n: np.ndarray, dictionary: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each with the one before it, up to length) of the first n starts of contexts.

    dictionary: the number of each context's dictionary; suffixes are sorted within it, and prefixes end at its border.
    """
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    starts = stretches(begin, begin + n)
    own = np.repeat(dictionary.astype(">u4"), n)
    rows = np.empty((len(starts), 4 + length), np.uint8)
    rows[:, :4] = own.view(np.uint8).reshape(-1, 4)
    rows[:, 4:] = np.lib.stride_tricks.sliding_window_view(buffer, length)[starts]
    order = np.argsort(rows.view(f"S{4 + length}").ravel(), kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), 4 + length) - 4
    return order, np.concatenate(([0], np.maximum(common, 0)))


def _repeated(k: np.ndarray, rid: np.ndarray, at: np.ndarray, contexts: list[bytes], length: int):
    """Repeated strings of whole dictionaries, as runs of starts."""
    n = at & (1 << BITS) - 1
    new = np.concatenate(([True], k[1:] != k[:-1]))
    order, common = suffix_order(contexts, n, np.cumsum(new), length)
    twice = common >= length
    hit = np.zeros(len(order), bool)
    hit[order] = twice | np.concatenate((twice[1:], [False]))
    start, row = stretches(at >> BITS, (at >> BITS) + n)[hit], np.repeat(np.arange(len(k)), n)[hit]
    if not len(start):
        return
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))))
    total = np.diff(np.append(first, len(start)))
    yield pa.RecordBatch.from_arrays([pa.array(rid[row[first]]), pa.array(_packed(start[first], total))], names=["rid", "at"])


def _settle(length: int):
    """Repeated strings of opened phrases. Rows come sorted: dictionaries by parse key, then strings by parse key and digest, then known rows."""

    def run(batches):
        held: list | None = None  # contexts not yet sorted; the last dictionary may go on
        waiting, seen = None, False  # first string of a run, and whether it has left
        for batch in batches:
            kind, *rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            small, crowded, known = np.flatnonzero(kind == SMALL), kind == CROWDED, kind == KNOWN
            if len(small):
                now = [rows[0][small], rows[3][small], rows[4][small], batch.column("context").take(pa.array(small)).to_pylist()]
                held = now if held is None else [*[np.concatenate(x) for x in zip(held[:3], now[:3])], held[3] + now[3]]
                while (cut := _whole_dictionaries(held)) > 0:
                    yield from _repeated(*[x[:cut] for x in held], length)
                    held = [x[cut:] for x in held]
            if crowded.any():
                own = [x[crowded] for x in rows]
                if waiting is not None:
                    own = [np.concatenate((a, b)) for a, b in zip(waiting, own)]
                same = ~_differs(*own[:3])[1:]
                hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
                last = bool(hit[-1] or (len(hit) == 1 and seen))
                if seen:
                    hit[0] = False  # the waiting row has left already
                seen, waiting, on = last, [x[-1:] for x in own], np.flatnonzero(hit)
                if len(on):
                    yield pa.RecordBatch.from_arrays([pa.array(own[3][on]), pa.array(own[4][on])], names=["rid", "at"])
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[3][known]), pa.array(rows[4][known])], names=["rid", "at"])
        if held is not None and len(held[0]):
            yield from _repeated(*held, length)

    return run


def _whole_dictionaries(held: list) -> int:
    """How many of the held contexts to sort now: dictionaries that have ended, about SORT strings; 0 to wait for more."""
    k, n = held[0], np.cumsum(held[2] & (1 << BITS) - 1)
    ends = np.flatnonzero(k[1:] != k[:-1]) + 1
    if not len(ends) or n[ends[-1] - 1] < SORT:
        return 0
    return int(ends[np.searchsorted(n[ends - 1], SORT)])


def _pack(batches):
    """Texts as zstd frames: they move twice, and are about a third smaller so."""
    import zstandard

    frame = zstandard.ZstdCompressor(level=1).compress
    for batch, parts in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([frame(t) for t in parts], pa.binary())], names=["rid", "doc_id", "z"])


def _unpacked(batches):
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress
    for batch, parts in slices(batches, "z", STEP_BYTES // 3):
        yield batch, [plain(z) for z in parts]


def _cut(length: int):
    def run(batches):
        for batch, parts in _unpacked(batches):
            kept, spans = [], []
            for text, places in zip(parts, batch.column("places")):
                if not places.is_valid:
                    kept.append(text)
                    spans.append([])
                    continue
                at = np.sort(places.values.to_numpy())
                lo = at >> BITS
                hi = np.maximum.accumulate(lo + (at & (1 << BITS) - 1) - 1 + length)
                first = np.concatenate(([True], lo[1:] > hi[:-1]))
                begin, end = lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)]
                cuts = list(zip(begin.tolist(), end.tolist()))
                out, last = [], 0
                for a, b in cuts:
                    out.append(text[last:a])
                    last = b
                kept.append(b"".join([*out, text[last:]]))
                spans.append([{"start": a, "end": b} for a, b in cuts])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, parts)), pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shape: Shape | None = None) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans of removed bytes) of every document."""
    shape = shape or Shape()
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "suffix-docs")
    sort = "kind int, k long, c long, d long, rid long, at long"
    parsed = rows.select("rid", "text").mapInArrow(_parse(shape), sort)
    ordered = parsed.repartition("k").sortWithinPartitions(F.col("kind") == KNOWN, "k", "c", "d").mapInArrow(_order, "rid long, at long, kind int, k long")
    ordered = materialise(ordered, "suffix-order")
    packed = rows.mapInArrow(_pack, "rid long, doc_id long, z binary")
    opened = ordered.where(F.col("kind") >= OPEN).select("k", "rid", "at")
    crowd = opened.groupBy("k").count().where(F.col("count") > CROWD)
    # a crowded key's rows are dealt over SALTS partitions; there are few such keys, at most one in CROWD rows
    crowd = crowd.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("crowded"))
    opened = opened.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    opened = opened.join(crowd, ["k", "salt"], "left").select("rid", F.struct("k", "at", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("place"))
    opened = opened.groupBy("rid").agg(F.collect_list("place").alias("places"))
    contexts = packed.select("rid", "z").join(opened, "rid").mapInArrow(_contexts(shape), f"{sort}, context binary")
    # c is zero but for strings of crowded dictionaries, which their digest deals
    again = contexts.repartition("k", "c").sortWithinPartitions("kind", "k", "c", "d").mapInArrow(_settle(shape.length), "rid long, at long")
    again = materialise(again, "suffix-again")
    whole = ordered.where(F.col("kind").isin(WHOLE, BOTH)).select("rid", "at").unionByName(again)
    places = whole.groupBy("rid").agg(F.collect_list("at").alias("places"))
    return packed.join(places, "rid", "left").mapInArrow(_cut(shape.length), "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, `end`: long>>")


def op2_prefix_free_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
