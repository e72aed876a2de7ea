"""The query's scores against a plain evaluation of the method: counts, log-odds, constants, segments and curve."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from haruspex.llm._labelled import sample
from haruspex.llm.toxicity import BUCKETS, Toxicity, op1_toxic_segments, word_buckets
from test_toxicity import brute, corpus

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def forms(word):
    """Buckets of a word and of its first 7, 6, 5 and 4 characters where it is longer."""
    return [int(b) for b in word_buckets([word])[0][0] if b < BUCKETS]


def test_forms_are_of_characters():
    assert [len(forms(w.encode())) for w in ("abcd", "abcde", "abcdefgh", "éééé", "ééééé")] == [1, 2, 5, 1, 2]
    assert forms(b"abcdefgh")[1:] == forms(b"abcdefgi")[1:] and forms(b"abcdefgh")[0] != forms(b"abcdefgi")[0]


def test_scores_against_a_plain_evaluation(spark, tmp_path):
    rows, labels = corpus()
    rows = [(i, t + " vile foulness" if i % 4 and i % 10 == 1 else t) for i, t in rows]  # so that lambda has a root
    rows += [(1000, None), (1001, ""), (1002, "Vile"), (1003, "déjà vile, VILE! w1"), (1004, "vile " * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labelled = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model, picked = Toxicity.fit(docs, labelled), sample(docs, labelled, "toxic").collect()

    seen = [Counter(), Counter()]
    for r in picked:
        if r.fold < 7:
            seen[r.label].update({b for w in words(r.text) for b in forms(w)})
    prior = {b: 0.1 * (seen[0][b] + seen[1][b]) for b in seen[0] | seen[1]}
    # buckets that no word has keep the floor of the prior
    mass, score = sum(prior.values()) + 1e-9 * (BUCKETS - len(prior)), {}
    size = [sum(c.values()) for c in seen]
    for b, a in prior.items():
        odds = [math.log((c[b] + a) / (n + mass - c[b] - a)) for c, n in zip(seen, size)]
        delta, spread = odds[1] - odds[0], math.sqrt(1 / (seen[1][b] + a) + 1 / (seen[0][b] + a))
        score[b] = float(np.float32(delta)) if abs(delta) >= 3 * spread else 0.0
    assert {b: float(model.table[b]) for b in score} == pytest.approx(score, rel=1e-6)
    assert np.count_nonzero(model.table) == sum(x != 0 for x in score.values()) > 3

    shares = Counter()
    for b, n in seen[0].items():
        shares[round(score[b], 2)] += n / size[0]
    assert sum(p * math.exp(model.tail.rate * (v - 0.05)) for v, p in shares.items()) == pytest.approx(1, abs=1e-4)

    def found(text):
        own = [next((float(model.table[b]) for b in forms(w) if model.table[b]), 0.0) - 0.05 for w in words(text)]
        return len(own), brute(own)

    calm = [found(r.text) for r in picked if r.fold >= 7 and not r.label]
    assert model.tail.k == pytest.approx(max(sum(len(s) for _, s in calm) / sum(n for n, _ in calm), 1e-9))

    def evidence(text):
        n, own = found(text)
        over = [model.tail.rate * x - math.log(max(1.0, model.tail.k * n)) for *_, x in own]
        return [math.log1p(sum(x for x in over if x > 0)), math.log1p(max([0.0, *over]))]

    def curve(x):
        return 1 / (1 + math.exp(-(model.intercept + sum(a * b for a, b in zip(model.weights, x)))))

    rest = [r for r in picked if r.fold >= 7]
    x = np.array([[*evidence(r.text), 1.0] for r in rest])
    slope = x.T @ np.array([curve(v[:2]) - r.label for v, r in zip(x, rest)]) + 1e-3 * np.append(model.weights, model.intercept)
    assert np.abs(slope).max() < 1e-4  # the curve's weights are the optimum

    got = {r.doc_id: r for r in op1_toxic_segments(spark, str(tmp_path)).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx({i: curve(evidence(t)) for i, t in rows}, abs=1e-6)
    assert {i: r.n_segments for i, r in got.items()} == {i: len(found(t)[1]) for i, t in rows}
    assert got[1004].predicted == 1 and got[1000].predicted == 0
