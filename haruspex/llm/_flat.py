"""Kernels on flat byte buffers, shared by the operators that run in Arrow batches.

Every function here works on whole texts. ``slices`` only bounds how many texts are held at a time.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a batch handles.
STEP_BYTES = 1 << 20
#: A text of more bytes is gone through piece by piece, and so is no word or line of more: it stands alone.
LONG = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"


def stash() -> dict:
    """A dictionary that lives as long as the worker process, over tasks."""
    return sys.__dict__.setdefault("_haruspex_stash", {})


def tidy(owner: str | None) -> None:
    """Drop what other operators have stashed in this worker, and give freed memory back to the system."""
    kept = stash()
    for key in [k for k in kept if k != "powers" and (k if isinstance(k, str) else k[0]) != owner]:
        del kept[key]
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lower_ascii() -> bytes:
    """Translation table: A-Z to a-z, other bytes unchanged."""
    return bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_ascii() -> bytes:
    """Translation table: A-Z to a-z, digits, a-z and non-ASCII kept, the rest to spaces."""
    keep = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    return bytes(x if keep(x) else 32 for x in lower_ascii())


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches, name: str = "text", step: int = STEP_BYTES, owner: str | None = None):
    """Pieces of the batches with about ``step`` bytes of text each, as (batch, texts).

    owner: whose stashed data the caller uses; what others have left goes first, so workers hold one operator's.
    """
    tidy(owner)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(name)
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:  # only one piece at a time becomes Python objects
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step)) + 1
            yield batch.slice(lo, hi - lo), texts(column.slice(lo, hi - lo))
            lo = hi
        del batch, column
    tidy(owner)


def pieces(text: bytes, stops: bytes, size: int | None = None):
    """The text in consecutive pieces (bytes, whether it is one unit), each cut behind one of the bytes in ``stops``.

    A unit (what lies between stops) of more than ``size`` bytes is a piece of its own, without the stop behind it;
    all other pieces hold whole units of at most ``size`` bytes. Which units stand alone doesn't depend on their place.
    """
    size = size or LONG
    buffer, stop, at = np.frombuffer(text, np.uint8), np.zeros(256, bool), 0
    stop[list(stops)] = True
    while len(text) - at > size:
        last = np.flatnonzero(stop[buffer[at : at + size + 1]])
        if len(last):
            end = at + int(last[-1]) + 1
            yield text[at:end], False
            at = end
            continue
        end = min((x for x in (text.find(bytes([b]), at + size) for b in stops) if x >= 0), default=len(text))
        yield text[at:end], True
        at = end + 1
    if at < len(text):
        yield text[at:], False


def long_hash(unit: bytes) -> np.uint64:
    """Hash of a unit of more than LONG bytes, which rolling hashes never see."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(unit, 20240229))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept = stash().get("powers")
    if kept is None or len(kept[0]) < n:
        m = max(n, 2 * STEP_BYTES)
        base = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
        powers = np.full(m, base, np.uint64)
        powers[0] = 1
        inverse = np.full(m, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        kept = stash()["powers"] = (np.cumprod(powers), np.cumprod(inverse), table)
    return kept


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Karp-Rabin hashes modulo 2**64 of any substrings of one buffer, each in constant time."""

    def __init__(self, buffer: np.ndarray):
        powers, self.inverse, table = _powers(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(table[buffer] * powers[: len(buffer)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def every(self, width: int) -> np.ndarray:
        """Of all substrings of that width, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def words_flat(parts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, document) of the words of translated texts; white space is as in bytes.split()."""
    split = [t.translate(table).split() for t in parts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = b" ".join([w for ws in split for w in ws])
    buffer = np.frombuffer(flat, np.uint8)
    ends = np.append(np.flatnonzero(buffer == 32), len(flat)) if flat else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if flat else np.zeros(0, np.int64)
    return buffer, starts, ends.astype(np.int64), np.repeat(np.arange(len(parts)), counts)


def stretches(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers in the half-open ranges, one range after another."""
    n = ends - starts
    out = np.ones(int(n.sum()), np.int64)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out[:0]
    s, e, k = starts[full], ends[full], n[full]
    at = np.concatenate(([0], np.cumsum(k)[:-1]))
    out[at] = s
    out[at[1:]] = s[1:] - e[:-1] + 1
    return np.cumsum(out)
