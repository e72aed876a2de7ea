import random
import zlib

import numpy as np
from haruspex.llm.quality import RuleEnsemble, grow_rules, lasso_logistic, op9_rule_ensemble_quality, score


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    z = (rng.random((400, 12)) < 0.5).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1])))).astype(float)
    w, b = lasso_logistic(z, y, 0.02, 20000)
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / 400
    assert np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5) and (np.abs(g[w == 0]) <= 0.02 + 1e-5).all()
    assert 0 < (w != 0).sum() < 12


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, (2000, 4))
    y = ((x[:, 1] <= 9) & (x[:, 2] > 9)).astype(float)
    assert any({(1, 9, True), (2, 9, False)} <= set(r) for r in grow_rules(x, y, 5))


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 != 0
        w = [f"word{rnd.randrange(999)}" for _ in range(60)]
        rows.append((i, " ".join(w) if good else "### ".join(w[:5] * 12), "en"))
        labels.append((i, int(good), 0))
    rows += [(900, None, None), (901, "", ""), (None, "a b", "en"), (3, rows[3][1], "en"), (902, "y " * 30000, "en")]
    labels += [(None, 1, 0), (7, None, 0), (4, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = op9_rule_ensemble_quality(spark, str(tmp_path))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = RuleEnsemble.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in score(docs, model).collect()} == {0.5}
    assert score(docs.limit(0), model).count() == 0
