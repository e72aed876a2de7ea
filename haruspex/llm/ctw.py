"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case (A-Z), one space between words and an end mark; its bytes are predicted bit by
bit. A node of the tree is a context of the last 0 to ``DEPTH`` bytes with the bits of the byte so far; it holds
counts of both bits and their Krichevsky-Trofimov estimate. From the leaves up, a node's weighted probability is
half its own estimate and half the product of its children's, which says how far each node is trusted; from the
root down, estimates of all depths are mixed by these weights, and the deepest context seen takes what is left.
The sum over bits is the code length of a byte, and the score is the log10 probability of the text.

Counts of contexts and words are gathered from the whole training corpus and summed by Spark; none is cut off. The
distinct byte strings of all rows, learnt from or not, are dealt by their last two bytes of context: all nodes of
depths 2 and more are then in one task, which mixes them for its own strings. Depths 0 and 1 (65,536 nodes at
most) are summed from these and mixed in afterwards. Scores of the ``GRAMS`` most frequent byte strings and counts
of the ``WORDS`` most frequent words are broadcast; all others are joined, with the same result.

Edge cases: null and empty texts hold the end mark alone; null doc_ids are never held out; repeated rows keep
their rows; very long texts are counted and scored piece by piece, with the context of the piece before; scores are
sums, so ties need no order; without training rows all estimates are one half; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, replayable
from ._flat import LONG, WHITE, RollingHash, long_hash, lower_ascii, mixed, pieces, slices, stash, stretches, words_flat
from ._labelled import remainder

DEPTH = 5
GRAMS = 1 << 20
WORDS = 1 << 20
#: Nodes of this depth and deeper are dealt over tasks, by as many bytes of context.
DEALT = 2
#: Byte strings whose nodes a task holds at a time, beyond those of one context.
STRINGS = 1 << 18


def normal_form(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, first byte, end) of the texts in normal form; DEPTH end marks stand before each."""
    table, pad = lower_ascii(), b"\n" * DEPTH
    texts = [b" ".join(t.translate(table).split()) + b"\n" for t in parts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + DEPTH)
    return np.frombuffer(b"".join([x for t in texts for x in (pad, t)]) + b"\0\0", np.uint8), ends - size, ends


def grams_of(buffer: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of every byte of the texts its last DEPTH bytes and itself, as one integer."""
    rolled = np.ndarray((len(buffer) - 7,), ">u8", buffer.tobytes(), 0, (1,))
    return (rolled[stretches(first - DEPTH, ends - DEPTH)] >> np.uint64(8 * (7 - DEPTH))).astype(np.uint64)


def words_of(buffer: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every token: the words, then the end mark."""
    at = stretches(first, ends)
    stops = at[(buffer[at] == 32) | (buffer[at] == 10)]
    doc = np.searchsorted(ends, stops, side="right")
    begin = np.concatenate(([0], stops[:-1] + 1))
    begin[np.concatenate(([True], doc[1:] != doc[:-1]))] = first
    hashes = RollingHash(buffer)
    last = np.flatnonzero(buffer[stops] == 10)
    words = np.delete(np.arange(len(stops)), last[stops[last] == begin[last]])
    h = np.concatenate((hashes.of(begin[words], stops[words]), np.full(len(ends), 1, np.uint64)))
    return h, np.concatenate((doc[words], np.arange(len(ends))))


def steps(parts: list[bytes]):
    """(texts, grams of them in order, texts, word hashes of them) in steps: all short texts in one, long ones in pieces."""
    short = np.array([i for i, t in enumerate(parts) if len(t) <= LONG], np.int64)
    none, no_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        buffer, first, ends = normal_form([parts[i] for i in short.tolist()])
        h, doc = words_of(buffer, first, ends)
        yield np.repeat(short, ends - first), grams_of(buffer, first, ends), short[doc], h
    for i, t in enumerate(parts):
        if len(t) <= LONG:
            continue
        form, same = bytearray(b"\n" * DEPTH), bytes(range(256))
        for piece, alone in pieces(t.translate(lower_ascii()), WHITE):
            buffer, starts, stops, _ = words_flat([piece], same) if not alone else (None, [], [], None)
            h = np.array([long_hash(piece)]) if alone else RollingHash(buffer).of(starts, stops)
            if len(h):
                form += piece if alone else buffer.tobytes()
                form += b" "
                yield no_doc, none, np.full(len(h), i), h
        form[max(len(form) - 1, DEPTH) :] = b"\n"
        for lo in range(0, len(form) - DEPTH, LONG):
            own = bytes(form[lo : lo + LONG + DEPTH])
            grams = grams_of(np.frombuffer(own + b"\0\0", np.uint8), np.array([DEPTH]), np.array([len(own)]))
            yield np.full(len(grams), i), grams, no_doc, none
        yield no_doc, none, np.array([i]), np.array([1], np.uint64)  # the end mark


def _counts(batches):
    """(kind 1 word or 2 gram, key, n) of a task, summed before they leave it; grams of rows not learnt from count 0."""
    kept = {1: [], 2: []}

    def merged(kind):
        k = np.concatenate([x[0] for x in kept[kind]])
        n = np.concatenate([x[1] for x in kept[kind]])
        u, at = np.unique(k, return_inverse=True)
        kept[kind] = [(u, np.bincount(at, n, len(u)).astype(np.int64))]

    for batch, parts in slices(batches):
        learnt = np.array([bool(x) for x in batch.column("train").to_pylist()])
        for in_gram, grams, in_word, words in steps(parts):
            kept[1].append(np.unique(words[learnt[in_word]], return_counts=True))
            train = learnt[in_gram]
            kept[2].append(np.unique(grams[train], return_counts=True))
            other = np.unique(grams[~train])
            kept[2].append((other, np.zeros(len(other), np.int64)))
            for kind in (1, 2):
                if sum(len(y[0]) for y in kept[kind][1:]) > 1 << 20:
                    merged(kind)
    for kind in (1, 2):
        if kept[kind]:
            merged(kind)
            k, n = kept[kind][0]
            for lo in range(0, len(k), 65536):
                x = slice(lo, lo + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[x]), kind, np.int32)), pa.array(k[x].view(np.int64)), pa.array(n[x])], names=["kind", "key", "n"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)


def node_keys(context_and_byte: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """Nodes met at a depth before the given bit of a byte: context, then the byte's bits so far behind a one."""
    byte = context_and_byte & np.uint64(255)
    context = (context_and_byte >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return context << np.uint64(8) | (byte | np.uint64(256)) >> np.uint64(8 - bit)


class ContextTree:
    """All nodes of the depths from ``least`` to ``most``, of each bit and depth: sorted keys, estimate of a one, trust."""

    def __init__(self, tiers: list[tuple[int, np.ndarray, np.ndarray]], least: int = 0):
        """tiers: (depth, grams, counts); grams are whole, so all are of depth DEPTH; those with count 0 add no node."""
        if any(len(g) and d != DEPTH for d, g, _ in tiers):
            raise ValueError(f"grams must have a context of {DEPTH} bytes")
        grams, n = np.concatenate([g for _, g, _ in tiers]), np.concatenate([c for *_, c in tiers]).astype(float)
        grams, n = grams[n > 0], n[n > 0]
        rows = []
        for bit in range(8):
            one = n * ((grams >> np.uint64(7 - bit)) & np.uint64(1))
            rows.append((node_keys(grams, DEPTH, bit), n - one, one, None))
        self._grow(rows, least, DEPTH)

    @classmethod
    def above(cls, keys: np.ndarray, zero: np.ndarray, one: np.ndarray, weighted: np.ndarray, depth: int) -> ContextTree:
        """Nodes from the root to a depth; keys are theirs at that depth, with sums over the nodes one deeper."""
        tree, prefix = cls.__new__(cls), keys & np.uint64(255)
        at = [(prefix >> np.uint64(bit)) == 1 for bit in range(8)]
        tree._grow([(keys[x], zero[x], one[x], weighted[x]) for x in at], 0, depth)
        return tree

    def _grow(self, rows: list, least: int, most: int) -> None:
        self.least, self.most, self.nodes, self.sums = least, most, [], []
        for keys, zeros, ones, split in rows:
            found = {}
            for depth in range(most, least - 1, -1):
                u, at = np.unique(keys, return_inverse=True)
                zero, one = np.bincount(at, zeros, len(u)), np.bincount(at, ones, len(u))
                own = kt_block(zero, one)
                if split is None:
                    weighted, trust = own, np.ones(len(u))
                else:
                    weighted = np.logaddexp(own, np.bincount(at, split, len(u))) - np.log(2)
                    trust = np.exp(own - np.log(2) - weighted)
                found[depth] = (u, (one + 0.5) / (zero + one + 1), trust)
                keys, zeros, ones, split = u & np.uint64((1 << 8 * max(depth - 1, 0) + 8) - 1), zero, one, weighted
            self.nodes.append(found)
            self.sums.append((keys, zeros, ones, split))

    def mixture(self, grams: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
        """Of each bit of each gram's last byte its probability, mixed over the depths held here and then ``deeper``.

        deeper: the same from the next depth on. NaN: no node of that depth is there, so the depth above takes all.
        """
        out = np.empty((8, len(grams)))
        for bit in range(8):
            ones = ((grams >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            p, left = np.zeros(len(grams)), np.ones(len(grams))
            last = np.full(len(grams), np.nan if self.least else 0.5)
            for depth in range(self.least, self.most + 1):
                u, one, trust = self.nodes[bit][depth]
                keys = node_keys(grams, depth, bit)
                at = np.minimum(np.searchsorted(u, keys), max(len(u) - 1, 0))
                seen = u[at] == keys if len(u) else np.zeros(len(keys), bool)
                at = at[seen]
                now = np.where(ones[seen], one[at], 1 - one[at])
                part = left[seen] * trust[at]
                p[seen] += part * now
                left[seen] -= part
                last[seen] = now
            out[bit] = p + left * (last if deeper is None else np.where(np.isnan(deeper[bit]), last, deeper[bit]))
        return out

    def mixed_score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others, mixed over all depths."""
        return np.log10(self.mixture(grams)).sum(axis=0)

    score = mixed_score


DEALT_ROWS = "kind int, key long, n long, " + ", ".join(f"x{i} double" for i in range(8))


def _dealt(batches):
    """Rows (key, n) in order of their last DEALT bytes of context, none of which is in two tasks.

    Gives (2, gram, n, mixture of each bit from depth DEALT on), and (1, node one above, null, counts of zeros and of
    ones and the weighted probability, summed over nodes of depth DEALT that are here).
    """
    names = [x.split()[0] for x in DEALT_ROWS.split(", ")]

    def done(key, n):
        tree = ContextTree([(DEPTH, key, n)], DEALT)
        for lo in range(0, len(key), 1 << 15):
            x = slice(lo, lo + (1 << 15))
            mixture = tree.mixture(key[x])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[x]), 2, np.int32)), pa.array(key[x].view(np.int64)), pa.array(n[x])] + [pa.array(m) for m in mixture], names=names)
        for keys, *sums in tree.sums:
            u, at = np.unique(keys, return_inverse=True)
            none = pa.nulls(len(u), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), 1, np.int32)), pa.array(u.view(np.int64)), pa.nulls(len(u), pa.int64())] + [pa.array(np.bincount(at, y, len(u))) for y in sums] + [none] * 5, names=names)

    kept, size = [], 0
    for batch in batches:
        kept.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size < STRINGS:
            continue
        key, n = (np.concatenate(x) for x in zip(*kept))
        context = (key >> np.uint64(8)) & np.uint64((1 << 8 * DEALT) - 1)
        last = np.flatnonzero(context != context[-1])
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield from done(key[:whole], n[:whole])
        kept, size = [(key[whole:], n[whole:])], len(key) - whole
    if size:
        yield from done(*(np.concatenate(x) for x in zip(*kept)))


def _finished(top: ContextTree):
    """Scores of grams from mixtures of the deeper depths."""

    def run(batches):
        for batch in batches:
            deeper = np.stack([batch.column(f"x{i}").to_numpy() for i in range(8)])
            score = np.log10(top.mixture(batch.column("key").to_numpy().view(np.uint64), deeper)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(score)], names=["key", "n", "score"])

    return run


def gram_scores(grams: DataFrame) -> DataFrame:
    """grams (key long, distinct; n long: how often it is learnt, or 0): (key, n, score), exact whatever their number."""
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * DEALT) - 1).cast("long"))
    dealt = grams.select("key", "n", context.alias("context")).repartition("context").sortWithinPartitions("context")
    dealt = materialise(dealt.select("key", "n").mapInArrow(_dealt, DEALT_ROWS), "ctw-dealt")
    sums = dealt.where("kind = 1").groupBy("key").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(3)]).toArrow()
    top = ContextTree.above(sums["key"].to_numpy().view(np.uint64), *(sums[f"x{i}"].to_numpy() for i in range(3)), DEALT - 1)
    return dealt.where("kind = 2").mapInArrow(_finished(top), "key long, n long, score double")


class Frequent:
    """Scores of grams in an open-addressed table that holds every one of them."""

    EMPTY = np.uint64((1 << 64) - 1)  # no gram: they have 48 bits

    def __init__(self, grams: np.ndarray, scores: np.ndarray):
        self.mask = (1 << max(2 * len(grams), 1).bit_length()) - 1
        self.keys, self.scores = np.full(self.mask + 1, self.EMPTY), np.zeros(self.mask + 1)
        left, at = np.arange(len(grams)), self._start(grams)
        while len(left):
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.scores[at[won]] = grams[left[won]], scores[left[won]]
            left, at = np.delete(left, won), (np.delete(at, won) + 1) & self.mask

    def _start(self, grams: np.ndarray) -> np.ndarray:
        return (mixed(grams) & np.uint64(self.mask)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, 0 where there is none; places in grams of those that are not here)."""
        at = self._start(grams)
        out, got = self.scores[at], self.keys[at]
        left, none = np.flatnonzero(got != grams), []
        at, got = at[left], got[left]
        while len(left):
            out[left] = 0
            none.append(left[got == self.EMPTY])
            on = got != self.EMPTY
            left, at = left[on], (at[on] + 1) & self.mask
            got = self.keys[at]
            hit = got == grams[left]
            out[left[hit]] = self.scores[at[hit]]
            left, at, got = left[~hit], at[~hit], got[~hit]
        return out, np.sort(np.concatenate(none)) if none else left


SCORED = "kind int, h long, rid long, times long, doc_id long, n_tokens long, known long, base double, score double"


def _score(shared, key: str):
    """shared: frequent grams and their scores, frequent words and their logarithms; key names them among what is stashed.

    One row (kind 0) for each document, one for each of its words (1) and grams (2) that the frequent ones lack."""

    def run(batches):
        names = [x.split()[0] for x in SCORED.split(", ")]
        grams_known, scores, frequent, logs = shared.value
        kept = stash()
        if kept.get("frequent", (None,))[0] != key:
            kept["frequent"] = (key, Frequent(grams_known, scores))
        table = kept["frequent"][1]

        def others(kind, h, rid):
            order = np.lexsort((h, rid))
            h, rid = h[order], rid[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (rid[1:] != rid[:-1])))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            none, blank = pa.nulls(len(times), pa.int64()), pa.nulls(len(times), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(times), kind, np.int32)), pa.array(h[first].view(np.int64)), pa.array(rid[first]), pa.array(times), none, none, none, blank, blank], names=names)

        for batch, parts in slices(batches, owner="frequent"):
            k, rid = len(parts), batch.column("rid").to_numpy()
            n, known, base, score = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
            for in_gram, grams, in_word, h in steps(parts):
                found, lacking = table.find(grams)
                score += np.bincount(in_gram, found, k)
                at = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
                hit = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
                n += np.bincount(in_word, minlength=k)
                known += np.bincount(in_word[hit], minlength=k)
                base += np.bincount(in_word[hit], logs[at[hit]], k)
                yield others(1, h[~hit], rid[in_word[~hit]])
                yield others(2, grams[lacking], rid[in_gram[lacking]])
            row_key = mixed(rid.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(row_key), pa.array(rid), pa.array(np.ones(k, np.int64)), batch.column("doc_id"), *map(pa.array, (n, known, base, score))], names=names)

    return run


def _least_grade(rows: DataFrame, grade, most: int) -> int:
    """The least grade from which on there are at most ``most`` rows; none of grade -1, those that are not learnt."""
    total, least = 0, 1 << 30
    for r in sorted(rows.groupBy(grade.alias("grade")).agg(F.count("*").alias("size")).collect(), reverse=True):
        total += r["size"]
        if total > most or r.grade < 0:
            break
        least = r.grade
    return least


def score(docs: DataFrame, train, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); train: a condition on docs, the rows to learn from."""
    spark = docs.sparkSession
    rows = replayable(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), train.alias("train")), "ctw-docs")
    counts = rows.select("text", "train").mapInArrow(_counts, "kind int, key long, n long")
    counts = materialise(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    words = counts.where("kind = 1").select(F.col("key").alias("h"), "n")
    total = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = total.tokens or 0, total.distinct
    grade = F.when(F.col("n") > 0, F.floor(F.log2("n") * 8)).otherwise(-1).cast("int")
    top = words.where(grade >= _least_grade(words, grade, WORDS)).toArrow()
    frequent = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    logs = np.log10(top["n"].to_numpy()[order] + 0.1)
    grams = gram_scores(counts.where("kind = 2").select("key", "n"))
    least = _least_grade(counts.where("kind = 2"), grade, GRAMS)
    most = grams.where(grade >= least).toArrow()
    shared = spark.sparkContext.broadcast((most["key"].to_numpy().view(np.uint64), most["score"].to_numpy(), frequent[order], logs))
    scored = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text").mapInArrow(_score(shared, uuid.uuid4().hex), SCORED)
    known = words.select(F.lit(1).alias("kind"), "h", F.log10(F.col("n") + F.lit(0.1)).alias("value"))
    found = known.unionByName(grams.where(grade < least).select(F.lit(2).alias("kind"), F.col("key").alias("h"), F.col("score").alias("value")))
    joined = scored.join(found, ["kind", "h"], "left")
    is_word, is_gram = F.col("kind") == 1, F.col("kind") == 2
    base = F.when(is_word, F.col("times") * F.coalesce(F.col("value"), F.lit(-1.0))).otherwise(F.col("base"))
    known = F.when(is_word, F.when(F.col("value").isNotNull(), F.col("times")).otherwise(0)).otherwise(F.col("known"))
    part = F.when(is_gram, F.col("times") * F.col("value")).otherwise(F.col("score"))
    out = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base"), F.sum(part).alias("score"))
    norm = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")


def op6_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda c: F.coalesce(remainder(c, 10) == 0, F.lit(False))
    found = score(docs, ~held(F.col("doc_id")))
    return found.select("doc_id", held(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
