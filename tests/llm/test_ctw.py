import math
import random
import re
import zlib
from collections import Counter

import haruspex.llm.ctw as m
import numpy as np
import pytest
from haruspex.llm.ctw import ContextTree, grams_of, kt_block, normal_form, op6_context_tree_weighting


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def small_tree(texts):
    g = grams_of(*normal_form(texts))
    u, n = np.unique(g, return_counts=True)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return ContextTree([(m.DEPTH, u, n), (3, *none), (1, *none)]), g, u, n


def test_kt_block():
    def direct(a, b):
        p, x, y = 1.0, 0, 0
        for bit in [0] * a + [1] * b:
            p *= ((y if bit else x) + 0.5) / (x + y + 1)
            x, y = x + (not bit), y + bit
        return math.log(p)

    for a, b in [(0, 0), (1, 0), (0, 3), (5, 7), (40, 2)]:
        assert abs(kt_block(np.array([a]), np.array([b]))[0] - direct(a, b)) < 1e-6


def test_mixture_against_a_plain_tree(monkeypatch):
    texts = [b"the cat sat", b"the hat sat on the cat", b"a b a b a b", b""]
    tree, grams, u, n = small_tree(texts)
    nodes = [{} for _ in range(m.DEPTH + 1)]
    for g, k in zip(u.tolist(), n.tolist()):
        by = g.to_bytes(m.DEPTH + 1, "big")
        for d in range(m.DEPTH + 1):
            p = 1
            for i in range(7, -1, -1):
                x = nodes[d].setdefault((by[m.DEPTH - d : m.DEPTH], p), [0, 0, 0.0, 1.0])
                x[by[-1] >> i & 1] += k
                p = 2 * p + (by[-1] >> i & 1)
    lg = math.lgamma
    for d in range(m.DEPTH, -1, -1):
        for (c, p), x in nodes[d].items():
            own = lg(x[0] + 0.5) + lg(x[1] + 0.5) - lg(x[0] + x[1] + 1) - math.log(math.pi)
            weighted = own if d == m.DEPTH else np.logaddexp(own, x[2]) - math.log(2)
            x[3] = math.exp(own - math.log(2) - weighted) if d < m.DEPTH else 1.0
            if d:
                nodes[d - 1][c[1:], p][2] += weighted

    def plain(g):
        by, p, out = g.to_bytes(m.DEPTH + 1, "big"), 1, 0.0
        for i in range(7, -1, -1):
            bit, q, left, last = by[-1] >> i & 1, 0.0, 1.0, 0.5
            for d in range(m.DEPTH + 1):
                x = nodes[d].get((by[m.DEPTH - d : m.DEPTH], p))
                if x is None:
                    break
                last = (x[bit] + 0.5) / (x[0] + x[1] + 1)
                q, left = q + left * x[3] * last, left * (1 - x[3])
            out += math.log10(q + left * last)
            p = 2 * p + bit
        return out

    other = grams_of(*normal_form([b"the dog sat on a cat", b"zzz"]))
    for g in [*u.tolist(), *other.tolist()]:
        assert abs(tree.score(np.array([g], np.uint64))[0] - plain(g)) < 0.05
    context = other[7] & ~np.uint64(255)
    every = context | np.arange(256, dtype=np.uint64)
    assert abs((10 ** tree.mixed_score(every)).sum() - 1) < 1e-9


@pytest.mark.parametrize("few", [1 << 20, 3])
def test_query(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(m, "WORDS", few)
    rnd = random.Random(1)
    vocab = ["the", "The", "of", "a", "één", "x" * 30] + [f"w{i}" for i in range(50)]
    rows = [(i, "  ".join(rnd.choices(vocab, k=rnd.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "the null"), (7, rows[7][1]), (203, "unseen-" + "q" * 40)]
    spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, n_tokens int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_context_tree_weighting(spark, str(tmp_path)).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and any(r.held_out for r in got)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op6_context_tree_weighting(spark, f"{tmp_path}/e").count() == 0
