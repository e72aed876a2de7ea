import random
import zlib

import numpy as np
from haruspex.llm.toxicity import Tail, Toxicity, log_odds, op1_toxic_segments, segments


def brute(s):
    """Recursive definition: the best segment, then both sides."""

    def go(lo, hi):
        best = (0.0, None)
        for i in range(lo, hi):
            t = 0.0
            for j in range(i, hi):
                t += s[j]
                if t > best[0] + 1e-12:
                    best = (t, (i, j + 1))
        if best[1] is None:
            return []
        a, b = best[1]
        return [*go(lo, a), (a, b, best[0]), *go(b, hi)]

    return go(0, len(s))


def test_all_maximal_segments():
    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.choice([-3.1, -1.07, -0.53, 0.71, 1.13, 2.9, -7.3]) * (1 + rnd.random()) for _ in range(rnd.randrange(25))]
        got = segments(np.array(s))
        want = brute(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_constants():
    tail = Tail(np.array([-1.0, 1.0]), np.array([0.75, 0.25]), 0.1)
    assert abs(tail.rate - np.log(3)) < 1e-6  # 0.75 / x + 0.25 x = 1
    table = log_odds(np.array([100.0, 100.0, 0.0]), np.array([100.0, 5.0, 60.0]))
    assert table[0] == 0 and table[1] < 0 < table[2]


def corpus():
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = rnd.choices([f"w{j}" for j in range(300)], k=80)
        for k in range(0, 80, 9) if toxic else ():
            w[k] = rnd.choice(["Vile!", "foulness", "foulmouth"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (None, "vile vile"), (4, rows[4][1]), (1002, "x " * 20000)]
    labels += [(None, 1, 1), (5, 1, None), (4, 1, 1), (9999, 1, 1)]
    spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op1_toxic_segments(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    want = {i: int(i % 4 == 0) for i in range(600)}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 100 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (1000, 1001, 1002)} == {1000: 0, 1001: 0, 1002: 0}


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = Toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in model.score(docs).collect()} == {0.5}
    assert model.score(docs.limit(0)).count() == 0
