import random
from collections import Counter

import haruspex.llm.dedup_suffix as m
import numpy as np
import pytest
from haruspex.llm.dedup_suffix import Shape, remove_repeats


def brute(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((d, len(b), bytes(x for x, g in zip(b, gone) if not g), spans))
    return sorted(out, key=str)


def corpus(seed, length):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choices("abcdeé \n日", k=k))
    shared = [word(length + x) for x in (-2, -1, 0, 1, 7, 3 * length)]
    texts = [None, "", "short", "a" * (3 * length), "ab" * (2 * length), "x" * length]
    for _ in range(50):
        texts.append("".join(rnd.choice([word(rnd.randrange(2 * length)), rnd.choice(shared)]) for _ in range(rnd.randrange(1, 7))))
    base = word(4 * length)
    for _ in range(20):
        k = rnd.randrange(len(base))
        texts.append(base[:k] + "#" + base[k + 1 :])
    texts += [texts[8]] * 3
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


def test_suffix_array_of_dictionaries():
    rnd = random.Random(6)
    contexts = ["".join(rnd.choices("ab\0", k=rnd.randrange(12, 30))).encode() for _ in range(12)] + [b"ab" * 10]
    n = np.array([len(c) - 9 for c in contexts])
    own = np.array([1] * 5 + [2] * 4 + [7] * 4)
    every = [(o, c[i : i + 10]) for o, c, k in zip(own, contexts, n) for i in range(k)]
    order, common = m.suffix_order(contexts, n, own, 10)
    assert [every[i] for i in order] == sorted(every)

    def shared(x, y):
        return 0 if x[0] != y[0] else next((i for i in range(10) if x[1][i] != y[1][i]), 10)

    assert common.tolist() == [0] + [shared(every[a], every[b]) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("length,reach,gram,crowd,sort", [(24, 11, 4, 512, 1 << 15), (24, 11, 4, 1, 64), (24, 11, 4, 3, 8), (200, 96, 16, 512, 500)])
def test_against_brute_force(spark, monkeypatch, length, reach, gram, crowd, sort):
    monkeypatch.setattr(m, "CROWD", crowd)
    monkeypatch.setattr(m, "SORT", sort)
    rows = corpus(length, length)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, kept int").repartition(3)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), [tuple(x) for x in r.spans]) for r in remove_repeats(df, shape=Shape(length, reach, gram)).collect()]
    want = brute(rows, length)
    assert sorted(got, key=str) == want
    assert any(len(x[3]) > 1 for x in want)
    assert remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 512])
@pytest.mark.parametrize("bits", [0, 2])
def test_parse_keys_that_collide_decide_nothing(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(m, "CROWD", crowd)
    rows = corpus(3, 24)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), [tuple(x) for x in r.spans]) for r in remove_repeats(df, shape=Shape(24, 11, 4, bits)).collect()]
    assert sorted(got, key=str) == brute(rows, 24)


def test_long_texts_in_chunks(monkeypatch):
    text = "".join(random.Random(1).choices("abc", k=5000)).encode()
    shape = Shape(24, 11, 4)
    monkeypatch.setattr(m, "CHUNK", 700)
    starts = []
    for buffer, _, begin, first, last in m._pieces([text], shape):
        *_, lo, n = m.phrases(buffer, first, last, shape)
        starts += [x for a, b in zip(lo - begin[0], n) for x in range(a, a + b)]
    assert starts == list(range(5000 - 24 + 1))
