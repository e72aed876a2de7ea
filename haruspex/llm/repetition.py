"""Quality rules by repetition coverage.

Rolling hashes of 3, 5, 7 and 10 words slide over each whole text in numpy; an n-gram that occurs twice or more
in its text covers its words, all occurrences, and coverage is measured in characters (code points of covered
words over code points of all words). Lines equal to an earlier line of the text count likewise. A text fails if
some coverage exceeds its limit in ``LIMITS`` or ``LINE_LIMIT``.

Edge cases: null and empty texts have no words and fail the base rules; texts shorter than n words have no
n-gram; a coverage equal to its limit passes; very long texts are hashed piece by piece and judged whole; repeated rows
are judged one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._flat import LONG, WHITE, RollingHash, long_hash, mixed, pieces, slices, words_flat

#: Of the characters in words, the most that duplicated n-grams may cover, by n. Every occurrence counts, the first
#: included, so these are about three times the usual limits for repeats alone: one line that a short text says
#: twice (a notice, a refrain) is no fault.
LIMITS = {5: 0.45, 7: 0.40, 10: 0.35}
#: The most that lines equal to an earlier line may hold.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_chars long, " + ", ".join(f"gram{n}_chars long" for n in LIMITS)


#: n-grams of one text that are sorted at a time.
SORT = 1 << 21


def covered(hashes: np.ndarray, doc: np.ndarray, width: int, sort: int = SORT) -> np.ndarray:
    """Which words lie in a run of ``width`` words found twice or more in their document."""
    n = len(hashes) - width + 1
    out = np.zeros(len(hashes), bool)
    if n <= 0:
        return out
    key = hashes[:n].copy()
    for j in range(1, width):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += hashes[j : n + j]
    key = mixed(key)
    key += doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    change, whole = np.zeros(len(hashes) + 1, np.int32), doc[:n] == doc[width - 1 :]
    parts = n // sort + 1
    share = (key >> np.uint64(32)) % np.uint64(parts) if parts > 1 else None
    for part in range(parts):  # equal keys are in one part
        own = np.flatnonzero(whole if share is None else whole & (share == part))
        own = own[np.argsort(key[own])]
        same = np.concatenate(([False], key[own[1:]] == key[own[:-1]], [False])) if len(own) else np.zeros(1, bool)
        twice = own[same[1:] | same[:-1]]
        change[twice] += 1
        change[twice + width] -= 1
    np.cumsum(change, out=change)
    return change[:-1] > 0


def _points(text: bytes) -> int:
    """Code points of the words of a text."""
    words = b"".join(text.split())
    return len(words) if words.isascii() else len(words.decode())


def _lines(text: bytes) -> tuple[int, int]:
    """(lines equal to an earlier one, code points of their words)."""
    if len(text) > LONG:
        return _long_lines(text)
    seen, count, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            if line in seen:
                count, chars = count + 1, chars + _points(line)
            seen.add(line)
    return count, chars


def _long_lines(text: bytes) -> tuple[int, int]:
    """_lines by hashes of lines, piece by piece."""
    found, points = [], []
    for piece, alone in pieces(text, b"\n"):
        lines = [x for x in ([piece] if alone else piece.split(b"\n")) if x.strip(WHITE)]
        found.append(np.array([long_hash(x) for x in lines], np.uint64))
        points.append(np.array([_points(x) for x in lines], np.int32))
    hashes, chars = np.concatenate(found), np.concatenate(points)
    again = np.ones(len(hashes), bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    return int(again.sum()), int(chars[again].sum(dtype=np.int64))


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, code points, text) of every word."""
    buffer, starts, ends, doc = words_flat(parts, bytes(range(256)))
    points = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
    return RollingHash(buffer).of(starts, ends), points[ends] - points[starts], doc


def _long_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_words of one long text, piece by piece."""
    hashes, chars = [], []
    for piece, alone in pieces(text, WHITE):
        h, c = (np.array([long_hash(piece)]), np.array([_points(piece)])) if alone else _words([piece])[:2]
        hashes.append(h)
        chars.append(c.astype(np.int32))
    hashes = np.concatenate(hashes)
    return hashes, np.concatenate(chars), np.zeros(len(hashes), np.int8)


def _counted(hashes: np.ndarray, chars: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Of each of k texts: words, their code points, words in repeated windows of three, code points under each of LIMITS."""
    total = lambda x: np.bincount(doc, x, k).astype(np.int64)
    return np.stack([np.bincount(doc, minlength=k), total(chars), total(covered(hashes, doc, 3)), *(total(np.where(covered(hashes, doc, n), chars, 0)) for n in LIMITS)])


def _measure(batches):
    other = bytes(set(range(256)) - set(SYMBOLS))
    for batch, parts in slices(batches):
        found = np.zeros((3 + len(LIMITS), len(parts)), np.int64)
        short = [i for i, t in enumerate(parts) if len(t) <= LONG]
        found[:, short] = _counted(*_words([parts[i] for i in short]), len(short))
        for i, t in enumerate(parts):
            if len(t) > LONG:
                found[:, [i]] = _counted(*_long_words(t), 1)
        lines = [_lines(t) if t.count(b"\n") else (0, 0) for t in parts]
        symbols = np.array([len(t.translate(None, other)) for t in parts], np.int64)
        columns = [found[0], found[1], symbols, np.array([x[0] for x in lines], np.int64), found[2], np.array([x[1] for x in lines], np.int64), *found[3:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=[x.split()[0] for x in COLUMNS.split(", ")])


def repetition(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts and coverages of every text, with the base rules' and the method's verdicts."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_measure, COLUMNS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.col("line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in LIMITS.items():
        verdict &= F.col(f"gram{n}_chars") <= limit * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)


def op3_repetition_coverage(spark, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    grams = "\nunion all ".join(
        f"select rid, {n} n, i, w[i:i + {n - 1}] g from (select rid, w, unnest(generate_series(1, len(w) - {n - 1})) i from d where len(w) >= {n})" for n in (3, *LIMITS)
    )
    limits = " and ".join(f"gram{n}_chars <= {limit}::double * word_chars" for n, limit in LIMITS.items())
    return rf"""
with d as (select doc_id, row_number() over () rid, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
lines as (select rid, len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) chars, row_number() over (partition by rid, line) k
  from (select rid, unnest(string_split(text, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select rid, count(*) n_dup_lines, sum(chars)::bigint line_chars from lines where k > 1 group by rid),
grams as ({grams}),
twice as (select rid, n, i from (select rid, n, i, count(*) over (partition by rid, n, g) c from grams) where c > 1),
hit as (select distinct rid, n, p from (select rid, n, unnest(generate_series(i, i + n - 1)) p from twice)),
cover as (select rid, n, count(*) words, sum(len(w[p]))::bigint chars from hit join d using (rid) group by rid, n),
wide as (select rid, sum(words) filter (n = 3) n_repeat_words, {", ".join(f"sum(chars) filter (n = {n}) gram{n}_chars" for n in LIMITS)} from cover group by rid),
out as (select doc_id, len(w)::bigint n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
  (len(text) - len(translate(text, '#*$%&|<>', '')))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(line_chars, 0)::bigint line_chars, {", ".join(f"coalesce(gram{n}_chars, 0)::bigint gram{n}_chars" for n in LIMITS)}
  from d left join dup using (rid) left join wide using (rid)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from out)
select *, not base_failed and line_chars <= {LINE_LIMIT}::double * word_chars and {limits} kept from judged
"""


OP3_SQL = _sql()
