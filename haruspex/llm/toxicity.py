"""Toxicity by maximum-scoring segments.

Words score their log-odds between toxic and other texts, with a Dirichlet prior in proportion to the words'
overall frequency; scores without enough evidence (|z| < ``Z``) are zero, and every word pays ``DRIFT``, so the
expected score is negative. A linear-time scan finds all maximal-scoring segments (disjoint passages none of
which gains by growing or shrinking). Extreme-value theory calibrates them: among n background words, the
number of segments scoring S or more is Poisson with mean K n exp(-lambda S); what a segment has over
ln(K n) / lambda is its evidence. A logistic curve over a text's evidence gives its score.

A word is known by itself and by its first 7, 6, 5 and 4 characters; it scores by the longest of these that has a
significant score, so that inflected and compound forms share what is learned. All are hashed to ``BUCKETS`` counters, which bounds what is gathered and broadcast whatever the corpus holds.
Counts come from seven tenths of a bounded sample of labelled documents, calibration from the rest.

Edge cases: null and empty texts have no word and score by the curve's value for no evidence; without labels, or
with labels of one kind, the score is that kind's smoothed share; very long texts are scored piece by piece and scanned
whole; of segments that tie the one that began first takes the other in, and a score equal to the threshold is toxic;
repeated rows keep their rows; an empty table gives an empty result; extra columns are ignored by score and kept by
keep_clean, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import free_name, materialise
from ._flat import LONG, RollingHash, alnum_ascii, long_hash, mixed, pieces, slices, words_flat
from ._labelled import SAMPLE, held_out, logistic, sample

BUCKETS = 1 << 20
PREFIXES = (7, 6, 5, 4)
#: Weight of the prior, as a share of all counts.
PRIOR = 0.1
Z = 3.0
DRIFT = 0.05
THRESHOLD = 0.3


def word_buckets(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word and its prefixes, BUCKETS where it is no longer than one; document) of every word."""
    buffer, starts, ends, doc = words_flat(parts, alnum_ascii())
    hashes = RollingHash(buffer)
    begins = (buffer & 0xC0) != 0x80
    point = np.append(np.flatnonzero(begins), len(buffer))
    which = np.cumsum(begins)[starts] - 1 if len(starts) else starts
    out = np.full((len(starts), 1 + len(PREFIXES)), BUCKETS, np.int64)
    out[:, 0] = hashes.of(starts, ends) % np.uint64(BUCKETS)
    for j, n in enumerate(PREFIXES, 1):
        cut = point[np.minimum(which + n, len(point) - 1)]
        longer = np.flatnonzero(cut < ends)
        out[longer, j] = mixed(hashes.of(starts[longer], cut[longer]) + np.uint64(n)) % np.uint64(BUCKETS)
    return out, doc


def _long_word(word: bytes) -> np.ndarray:
    """word_buckets of one word of more than LONG bytes."""
    out = word_buckets([word[:64]])[0]  # its prefixes
    out[0, 0] = long_hash(word) % np.uint64(BUCKETS)
    return out


def word_steps(parts: list[bytes]):
    """Words in order as (their texts, buckets); all short texts in one step, a long one in a step for each piece."""
    short = np.array([i for i, t in enumerate(parts) if len(t) <= LONG], np.int64)
    buckets, doc = word_buckets([parts[i] for i in short.tolist()])
    yield short[doc], buckets
    for i, t in enumerate(parts):
        if len(t) > LONG:
            for piece, alone in pieces(t.translate(alnum_ascii()), b" "):
                buckets = _long_word(piece) if alone else word_buckets([piece])[0]
                yield np.full(len(buckets), i), buckets


def word_scores(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Of each word the score of its longest known form, less the drift."""
    wide = np.append(table, np.float32(0))
    out = wide[buckets[:, -1]]
    for j in range(buckets.shape[1] - 2, -1, -1):
        own = wide[buckets[:, j]]
        out = np.where(own != 0, own, out)
    return out.astype(np.float64) - DRIFT


def _counts(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch, parts in slices(batches):
        toxic, seen, last = batch.column("label").to_numpy() > 0, np.zeros(BUCKETS, bool), -1
        for doc, buckets in word_steps(parts):
            pairs = (doc[:, None] * (BUCKETS + 1) + buckets).ravel()
            once = np.unique(pairs)  # a text counts a word once
            own, texts = once % (BUCKETS + 1), once // (BUCKETS + 1)
            texts, own = texts[own < BUCKETS], own[own < BUCKETS]
            if len(doc) and len(parts[doc[0]]) > LONG:  # over all its pieces
                if doc[0] != last:
                    seen[:], last = False, doc[0]
                texts, own = texts[~seen[own]], own[~seen[own]]
                seen[own] = True
            for k in (0, 1):
                total[k] += np.bincount(own[toxic[texts] == bool(k)], minlength=BUCKETS)
    on = np.flatnonzero(total.sum(axis=0))
    for lo in range(0, len(on), 65536):
        i = on[lo : lo + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[0][i]), pa.array(total[1][i])], names=["bucket", "other", "toxic"])


def log_odds(other: np.ndarray, toxic: np.ndarray, prior: float = PRIOR, z: float = Z) -> np.ndarray:
    """Significant log-odds of each word, else zero."""
    a = np.maximum(prior * (other + toxic), 1e-9)
    odds = lambda y: np.log((y + a) / (y.sum() + a.sum() - y - a))
    delta = odds(toxic) - odds(other)
    spread = np.sqrt(1 / (toxic + a) + 1 / (other + a))
    return np.where((np.abs(delta) >= z * spread) & (other + toxic > 0), delta, 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), in linear time (Ruzzo and Tompa's rule).

    Runs of positive words come in order; each joins the nearest earlier segment that began lower, unless that
    one's end is at least as high. Links to those segments are kept, so that no segment is looked at twice.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    up = np.concatenate(([False], scores > 0, [False]))
    begin, end = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1])
    out: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total at the end, lower neighbour
    for s, e, low, high in _rows(begin, end, total[begin], total[end]):
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                out.append((s, e, low, high, j))
                break
            s, low = out[j][0], out[j][2]
            del out[j:]
    return [(s, e, high - low) for s, e, low, high, _ in out]


def _rows(*columns: np.ndarray, step: int = 1 << 16):
    """Rows of the columns as Python numbers, some at a time."""
    for lo in range(0, len(columns[0]), step):
        yield from zip(*(c[lo : lo + step].tolist() for c in columns))


class Tail:
    """Karlin-Altschul constants of a score distribution: lambda, and K from the rate of background segments."""

    def __init__(self, values: np.ndarray, shares: np.ndarray, rate: float):
        lo, hi = 1e-3, 50.0
        if values.max() <= 0:
            hi = lo = 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (shares * np.exp(np.minimum(mid * values, 500))).sum() < 1 else (lo, mid)
        self.rate, self.k = (lo + hi) / 2, max(rate, 1e-9)

    def evidence(self, score: float, n: int) -> float:
        return self.rate * score - np.log(max(1.0, self.k * n))


def _features(table: np.ndarray, tail: Tail | None):
    """Arrow function: n_words, n_segments, evidence, best, passages (start and end word, score), and a score histogram's sums."""

    def run(batches):
        passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch, parts in slices(batches):
            k = len(parts)
            n, scored = np.zeros(k, np.int64), [[] for _ in parts]
            for doc, buckets in word_steps(parts):
                scores, own = word_scores(table, buckets), np.bincount(doc, minlength=k)
                n += own
                ends = np.cumsum(own)
                for i in np.unique(doc).tolist():
                    scored[i].append(scores[ends[i] - own[i] : ends[i]])
            count, evidence, best, found = np.zeros(k, np.int64), np.zeros(k), np.zeros(k), [[] for _ in range(k)]
            for i, own in enumerate(scored):
                own = own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0)
                if not (own > 0).any():
                    continue
                own = segments(own)
                count[i] = len(own)
                for s, e, x in own:
                    over = tail.evidence(x, int(n[i])) if tail else x
                    if over > 0:
                        evidence[i] += over
                        best[i] = max(best[i], over)
                        found[i].append({"start": s, "end": e, "score": x})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(count), pa.array(evidence), pa.array(best), pa.array(found, passage)], names=["doc_id", "n_words", "n_segments", "evidence", "best", "passages"])

    return run


def _with_evidence(table: np.ndarray, tail: Tail | None, text: str, added: list[str]):
    """Arrow function: all columns of the rows but the one named text, with evidence and best behind them."""
    run = _features(table, tail)

    def with_evidence(batches):
        for batch, _ in slices(batches, text):
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], names=["doc_id", "text"])
            found = pa.Table.from_batches(list(run([own]))).combine_chunks()
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(found[n].chunk(0) for n in ("evidence", "best"))], names=[*(n for n, _ in kept), *added])

    return with_evidence


FEATURES = "doc_id long, n_words long, n_segments long, evidence double, best double, passages array<struct<start: long, `end`: long, score: double>>"


class Toxicity:
    """A fitted model: a table of BUCKETS word scores, tail constants and a logistic curve."""

    def __init__(self, table: np.ndarray, tail: Tail | None, weights, intercept: float):
        self.table, self.tail, self.weights, self.intercept = table, tail, weights, intercept

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Toxicity:
        picked = materialise(sample(docs, labels, "toxic", rows), "toxicity-sample")
        found = picked.where("fold < 7").select("text", "label").mapInArrow(_counts, "bucket long, other long, toxic long")
        found = found.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()  # BUCKETS rows at most
        counts = np.zeros((2, BUCKETS))
        for i, c in enumerate(("other", "toxic")):
            counts[i][found["bucket"].to_numpy()] = found[c].to_numpy()
        table = log_odds(*counts).astype(np.float32)
        values, shares = np.unique(np.round(table, 2), return_inverse=True)
        shares = np.bincount(shares, counts[0], len(values)) / max(1.0, counts[0].sum())
        rest = picked.where("fold >= 7").select("doc_id", "text", "label")
        label = {r.doc_id: r.label for r in rest.select("doc_id", "label").collect()}
        raw = rest.mapInArrow(_features(table, None), FEATURES).select("doc_id", "n_words", "n_segments").collect()  # of the sample
        calm = [r for r in raw if not label[r.doc_id]]
        rate = sum(r.n_segments for r in calm) / max(1, sum(r.n_words for r in calm))
        tail = Tail(values.astype(float) - DRIFT, shares, rate)
        rows_ = rest.mapInArrow(_features(table, tail), FEATURES).select("doc_id", "evidence", "best").collect()  # of the sample
        y = np.array([label[r.doc_id] for r in rows_], float)
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1)
            return cls(table, tail, np.zeros(2), float(np.log(share / (1 - share))))
        x = np.array([[np.log1p(r.evidence), np.log1p(r.best)] for r in rows_])
        return cls(table, tail, *logistic(x, y))

    def score(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """FEATURES and score of every document."""
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        return rows.mapInArrow(_features(self.table, self.tail), FEATURES).withColumn("score", self._curve("evidence", "best"))

    def _curve(self, evidence: str, best: str):
        a, b = map(float, self.weights)
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + F.lit(a) * F.log1p(evidence) + F.lit(b) * F.log1p(best))))

    def keep_clean(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """Rows of docs, all columns, that score below the threshold; nothing is joined or shuffled."""
        from pyspark.sql.types import DoubleType, StructType

        own, evidence, best = (free_name(docs, n) for n in ("own_text", "evidence", "best"))
        schema = StructType([*docs.schema.fields]).add(evidence, DoubleType()).add(best, DoubleType())
        rows = docs.withColumn(own, F.col(text).cast("string"))
        found = rows.mapInArrow(_with_evidence(self.table, self.tail, own, [evidence, best]), schema)
        return found.where(self._curve(evidence, best) < threshold).drop(evidence, best)


def op1_toxic_segments(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = model.score(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_segments", F.size("passages").alias("n_passages"))
