"""Long texts, gone through piece by piece, against the same texts as a whole; and texts of some megabytes through every query."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from haruspex.llm import _flat, ctw, decontaminate, dedup_simhash, repetition, toxicity


def corpus():
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdé", k=rnd.randrange(1, 9))) for _ in range(60)]
    texts = ["", "x", " \n ", "q" * 900, "a\n" * 400, "one line\n\n" * 30]
    for _ in range(25):
        texts.append("".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ". \t", "#"]) for _ in range(rnd.randrange(1, 400))))
    return texts + ["y" * 700 + " two " + "z" * 800 + "\n" + "y" * 700]


def batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": texts, "rid": list(range(n)), "label": [i % 2 for i in range(n)], "train": [True] * n})


def short(monkeypatch, size):
    for m in (_flat, ctw, decontaminate, dedup_simhash, repetition, toxicity):
        monkeypatch.setattr(m, "LONG", size)


def rows(f):
    return [r for b in f for r in b.to_pylist()]


def test_pieces():
    for text in corpus():
        data = text.encode()
        for stops in (b" \t\n\x0b\x0c\r", b"\n"):
            split = re.compile(b"[" + re.escape(stops) + b"]").split
            got = list(_flat.pieces(data, stops, 64))
            assert all(len(p) <= 65 for p, alone in got if not alone) and all(len(p) > 64 for p, alone in got if alone)
            units = [u for p, alone in got for u in ([p] if alone else split(p)) if u]
            assert units == [u for u in split(data) if u]
            assert [len(u) > 64 for u in units] == [alone for p, alone in got for u in ([p] if alone else split(p)) if u]


@pytest.mark.parametrize("size", [64, 300])
def test_repetition(monkeypatch, size):
    data = batch(corpus())
    want = rows(repetition._measure([data]))
    short(monkeypatch, size)
    assert rows(repetition._measure([data])) == want
    h, doc = np.random.default_rng(1).integers(0, 40, 5000).astype(np.uint64), np.zeros(5000, np.int64)
    assert (repetition.covered(h, doc, 3, 100) == repetition.covered(h, doc, 3)).all()


@pytest.mark.parametrize("size", [64, 300])
def test_fingerprints(monkeypatch, size):
    data = batch(corpus())
    want = rows(dedup_simhash._fingerprint_batches([data]))
    short(monkeypatch, size)
    assert rows(dedup_simhash._fingerprint_batches([data])) == want


@pytest.mark.parametrize("size", [64, 300])
def test_toxicity(monkeypatch, size):
    texts = [t for t in corpus() if len(max(t.split() or [""], key=len)) < 60]
    data = batch(texts)
    table = np.zeros(toxicity.BUCKETS, np.float32)
    table[np.unique(toxicity.word_buckets([texts[9].encode()])[0][::3, 0])] = 1.5
    run = toxicity._features(table, toxicity.Tail(np.array([-0.05, 1.45]), np.array([0.9, 0.1]), 0.01))
    want, counts = rows(run([data])), rows(toxicity._counts([data]))
    short(monkeypatch, size)
    assert rows(run([data])) == want and any(r["passages"] for r in want)
    assert rows(toxicity._counts([data])) == counts
    assert rows(run([batch(["w" * 900])]))[0]["n_words"] == 1


@pytest.mark.parametrize("size", [64, 300])
def test_language_model(monkeypatch, size):
    parts = [t.encode() for t in corpus()]

    def gathered():
        grams, words = [[] for _ in parts], [[] for _ in parts]
        for in_gram, g, in_word, h in ctw.steps(parts):
            for i, x in zip(in_gram.tolist(), g.tolist()):
                grams[i].append(x)
            for i, x in zip(in_word.tolist(), h.tolist()):
                words[i].append(x)
        return grams, [sorted(w) for w in words]

    grams, words = gathered()
    short(monkeypatch, size)
    cut, own = gathered()
    assert cut == grams
    for t, a, b in zip(parts, words, own):
        lone = sum(len(w) > size for w in t.split())
        assert len(a) == len(b) and len(set(a)) == len(set(b)) and len(set(a) - set(b)) <= lone


@pytest.mark.parametrize("size", [64, 300])
def test_benchmark(monkeypatch, size):
    texts = corpus()

    class Block:
        value = [(1, b"two words"), (2, " ".join(texts[20].split()[3:15]).encode()), (3, b"two " + b"z" * 800)]

    want = rows(decontaminate._scan(Block, True)([batch(texts)]))
    short(monkeypatch, size)
    assert rows(decontaminate._scan(Block, True)([batch(texts)])) == want
    assert sum(r["n_hit"] > 0 for r in want) > 1


def test_long_texts_through_every_query(spark, tmp_path):
    from haruspex.llm.registry import queries

    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(4000)]
    long = " ".join(rnd.choices(words, k=400_000))
    texts = [long, "k" * 3_000_000, "line of text\n" * 200_000, "password=hunter22x " + long, "short text", None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(long.split()[399_000:399_020]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {n.split("_")[0]: {r.doc_id: r for r in f(spark, str(tmp_path)).collect()} for n, f in queries().items() if not n.startswith("op5")}
    assert all(len(x) == len(texts) for x in got.values())
    assert got["op2"][0].n_removed == len(long) and got["op2"][3].n_removed == len(long) and got["op2"][4].n_removed == 0
    assert got["op3"][2].n_words == 600_000 and got["op3"][2].n_dup_lines == 199_999 and got["op3"][1].n_words == 1
    assert got["op4"][3].n_assign == 1 and got["op7"][0].n_hit == 20 == got["op7"][3].n_hit
    assert got["op6"][0].n_tokens == 400_001 and got["op6"][1].n_tokens == 2
    assert got["op10"][0].component_id == got["op10"][3].component_id == 0
    from haruspex.llm.packing import op5_cutting_stock_packing

    total = {}
    for r in op5_cutting_stock_packing(spark, str(tmp_path)).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.length <= 2048
    assert set(total) == set(range(len(texts))) and total[5] == 1 and total[2] == 600_001
