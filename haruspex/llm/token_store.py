"""Token files with Elias-Fano coded boundaries.

A store is a folder of shards in ascending doc_id order. A shard holds the concatenated ids of its documents
(16 bits each where the vocabulary allows, else 32), and two Elias-Fano sequences: the documents' boundaries
in the id array and their doc_ids. A sequence of n values below u takes about n * (2 + log2(u / n)) bits;
select on its upper bits returns any value in constant time, without a table of 64-bit offsets.

Shard layout, little-endian: the magic; five u64 (documents, documents without doc_id, ids, bytes of the
first and of the second sequence); u64 bytes per id; the doc_id sequence; the boundary sequence; the ids.
A sequence: i64 least value, u64 n, u64 low bits, then low words, upper words and select samples as u64.

Files are written by executors under a name of their own and moved into place, so a task may run again; they
are read back with Spark's binaryFile reader, from the select samples on, some thousand boundaries at a time, so no
table of offsets is ever expanded.

Edge cases: documents with null doc_id come first; rows of equal doc_id are ordered by text, and equal rows lie side by
side; null and empty texts hold the end id alone; a text of any length lies whole in one shard; ids that don't fit 16
bits make them 32 bits wide; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path
from ._encode import encoder, id_width
from ._flat import slices, stash

MAGIC = b"HXEFIDS1"
SAMPLE = 256
#: Documents whose boundaries are selected at a time on reading.
BLOCK = 16 * SAMPLE
#: Ids that a shard may gather before the next one begins.
SHARD_IDS = 1 << 24


class EliasFano:
    """A non-decreasing sequence of integers."""

    def __init__(self, least: int, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.least, self.n, self.low_bits, self.low, self.high, self.samples = least, n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        least = int(values[0]) if n else 0
        v = (values - least).astype(np.uint64)
        top = int(v[-1]) if n else 0
        k = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
        at = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 64) // 64 * 64 if n else 0, np.uint8)
        high[at] = 1
        return cls(least, n, k, _words(bits), _words(high), at[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """Value i: the place of one bit i among the upper bits, found from the sample before it."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        w = at >> 6
        word = int(self.high[w]) >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left, w = left - ones, w + 1
            word = int(self.high[w])
        for _ in range(left):
            word &= word - 1
        upper = (w << 6) + (word & -word).bit_length() - 1 - i
        return self.least + (upper << self.low_bits | self._low(i))

    def _low(self, i: int) -> int:
        k = self.low_bits
        if not k:
            return 0
        w, b = divmod(i * k, 64)
        x = int(self.low[w]) | (int(self.low[w + 1]) << 64 if b + k > 64 else 0)
        return x >> b & (1 << k) - 1

    def run(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1, from the sample before the first to the sample after the last; nothing else is decoded."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first, after = lo // SAMPLE, -(-hi // SAMPLE)
        begin = int(self.samples[first])
        end = (int(self.samples[after]) >> 6) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(_bits(self.high[begin >> 6 : end])) + (begin >> 6 << 6)
        ones = ones[np.searchsorted(ones, begin) + lo - first * SAMPLE :][: hi - lo]
        v, k = (ones - np.arange(lo, hi)) << self.low_bits, self.low_bits
        if k:
            at = lo * k // 64
            bits = _bits(self.low[at : -(-hi * k // 64)])[lo * k - at * 64 :][: (hi - lo) * k].reshape(hi - lo, k)
            v = v + (bits.astype(np.int64) << np.arange(k)).sum(axis=1)
        return v + self.least

    def all(self) -> np.ndarray:
        return self.run(0, self.n)

    def bytes(self) -> bytes:
        return struct.pack("<qQQ", self.least, self.n, self.low_bits) + struct.pack("<QQQ", len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def read(cls, data: memoryview) -> EliasFano:
        least, n, k, a, b, c = struct.unpack_from("<qQQQQQ", data)
        words = np.frombuffer(data, "<u8", a + b + c, 48)
        return cls(least, n, k, words[:a], words[a : a + b], words[a + b :])


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)]), bitorder="little").view("<u8")


def shard_bytes(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls first; ids: of each document as little-endian unsigned 32-bit integers."""
    nulls = sum(x is None for x in doc_ids)
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    names = EliasFano.of(np.array(doc_ids[nulls:], np.int64)).bytes()
    bounds = EliasFano.of(np.concatenate(([0], ends))).bytes()
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    return MAGIC + struct.pack("<6Q", len(doc_ids), nulls, len(flat), len(names), len(bounds), width) + names + bounds + flat.tobytes()


def open_shard(data: bytes) -> tuple[int, int, EliasFano, EliasFano, np.ndarray]:
    """(documents, those without doc_id, the others' doc_ids, boundaries, ids array) of one shard's bytes."""
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a shard of token ids")
    n, nulls, total, a, b, width = struct.unpack_from("<6Q", data, 8)
    view = memoryview(data)
    return n, nulls, EliasFano.read(view[56 : 56 + a]), EliasFano.read(view[56 + a : 56 + a + b]), np.frombuffer(view, f"<u{width}", total, 56 + a + b)


def read_shard(data: bytes):
    """(doc_ids with None for nulls, boundaries as EliasFano, ids array) of one shard's bytes."""
    n, nulls, names, bounds, ids = open_shard(data)
    return [None] * nulls + (names.all().tolist() if n > nulls else []), bounds, ids


def _writer(folder: str, tokenizer: str, words: bool, end_id: int, width: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        encode, part = encoder(tokenizer, words), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        doc_ids, ids, held, k = [], [], 0, 0

        def flush():
            nonlocal doc_ids, ids, held, k
            name = f"part-{part:08d}-{k:06d}.hxef"
            own = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(shard_bytes(doc_ids, ids, width))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(doc_ids)], "n_ids": [held]})
            doc_ids, ids, held, k = [], [], 0, k + 1
            return row

        for batch, parts in slices(batches, owner="encoder"):
            for d, t in zip(batch.column("doc_id").to_pylist(), parts):
                if held >= SHARD_IDS:
                    yield flush()
                x = encode.ids(t) + end
                doc_ids.append(d)
                ids.append(x)
                held += len(x) // 4
        if doc_ids:
            yield flush()

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, *, words: bool, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode docs into shards under folder (a URI that executors can write), with a manifest.

    The manifest has one row for each shard (16 million ids or a partition), and is a file beside them.
    """
    from pyarrow import fs, parquet

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # The range exchange moves raw texts, so that its sampling pass encodes nothing. A text's beginning, which orders as
    # the text does, deals out rows of one doc_id or of none.
    rows = rows.withColumn("begin", F.substring("text", 1, 32)).repartitionByRange("doc_id", "begin").drop("begin").sortWithinPartitions("doc_id", "text")
    width = id_width(tokenizer, end_id)
    found = rows.mapInArrow(_writer(folder, tokenizer, words, end_id, width), "shard string, n_docs long, n_ids long").collect()  # shards
    found.sort(key=lambda r: r.shard)
    ends = np.cumsum([r.n_ids for r in found], dtype=np.int64)
    manifest = {"shard": pa.array([r.shard for r in found], pa.string()), "n_docs": pa.array([r.n_docs for r in found], pa.int64()), "base": pa.array(ends - np.array([r.n_ids for r in found], np.int64))}
    with store.open_output_stream(f"{root}/manifest.parquet") as out:
        parquet.write_table(pa.table(manifest, metadata={"width": str(width), "end_id": str(end_id)}), out)


def _bases(folder: str) -> dict[str, int]:
    """Ids before each shard, read from the manifest once a worker."""
    from pyarrow import fs, parquet

    kept = stash()
    if ("manifest", folder) not in kept:
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/manifest.parquet") as f:
            table = parquet.read_table(f, columns=["shard", "base"])
        kept["manifest", folder] = dict(zip(table["shard"].to_pylist(), table["base"].to_pylist()))
    return kept["manifest", folder]


def read_store(spark, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Boundaries and doc_ids are selected block by block."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                n, nulls, names, bounds, ids = open_shard(data.as_buffer())
                base = _bases(folder)[path.rpartition("/")[2]]
                for lo in range(0, n, BLOCK):
                    hi = min(lo + BLOCK, n)
                    at = bounds.run(lo, hi + 1)
                    named = names.run(max(lo - nulls, 0), max(hi - nulls, 0))
                    doc_ids = pa.concat_arrays([pa.nulls(hi - lo - len(named), pa.int64()), pa.array(named)])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hxef").load(folder)
    return files.select("path", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_elias_fano_tokens(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), words=False, end_id=0)
    return read_store(spark, folder)
