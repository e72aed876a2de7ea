import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from haruspex.llm._encode import Encoder
from haruspex.llm.token_store import EliasFano, op8_elias_fano_tokens, read_shard, shard_bytes
from tokenizers import Tokenizer

HARD = ["", " ", "  a", "a  b", " a", "a ", "x  y", "x  y", "a\n b", "a \n b", "don't we'll 'S", "é è́ ́x", "\x1c \x1da", "a <|endoftext|> b<|endoftext|>", "ñandú  öl\t\tx   y", "日本 語 です", "A​ b 1234 5,6", "ΣΑΣ ΟΔΟΣ", "İi ſt K", "é e ́"]


@pytest.mark.parametrize("file,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_encode_as_whole_texts(file, words):
    path = public_tokenizers.path(file)
    plain, own = Tokenizer.from_file(path), Encoder(path, words)
    rnd = random.Random(1)
    pieces = [" ", "  ", "\n", " ", "　", "\x85", "\x1c", "a", "Bc", "é", "'s", "'", "12", "!?", "日", "́", "<|endoftext|>", "\t", " "]
    for text in HARD + ["".join(rnd.choices(pieces, k=12)) for _ in range(3000)]:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("values", [[], [0], [5], [-3, -3, 9], list(range(1000)), sorted(random.Random(2).choices(range(10**12), k=3000)), [0] * 700 + [1 << 40]])
def test_elias_fano_round_trip(values):
    x = EliasFano.read(memoryview(EliasFano.of(np.array(values, np.int64)).bytes()))
    assert x.all().tolist() == values
    assert [x.select(i) for i in range(len(values))] == values


def test_space_is_near_the_bound():
    v = np.sort(np.random.default_rng(3).integers(0, 1 << 30, 100_000))
    assert len(EliasFano.of(v).bytes()) * 8 < 100_000 * (2.6 + np.log2((1 << 30) / 100_000))


def test_shards():
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 2], [], [70_000])]
    doc_ids, bounds, flat = read_shard(shard_bytes([None, -4, 9], ids, 4))
    assert doc_ids == [None, -4, 9] and bounds.all().tolist() == [0, 2, 2, 3] and flat.tolist() == [1, 2, 70_000]


def test_query_round_trip(spark, tmp_path):
    rows = [(9, "b b"), (None, "null id"), (3, None), (4, ""), (9, "a <|endoftext|> a"), (-7, "x" * 5000), (5, "same"), (5, "same")]
    rows += [(100 + i, t) for i, t in enumerate(HARD)]
    spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, start long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op8_elias_fano_tokens(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for (d, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op8_elias_fano_tokens(spark, f"{tmp_path}/e").count() == 0
