import random

import haruspex.llm.ctw as m
import numpy as np
import pytest
from haruspex.llm.ctw import ContextTree, grams_of, normal_form, op6_context_tree_weighting
from haruspex.llm._labelled import remainder
from pyspark.sql import functions as F


@pytest.mark.parametrize("grams, strings", [(7, 50), (1 << 20, 1 << 18)])
def test_every_gram_counts_at_every_depth(spark, tmp_path, monkeypatch, grams, strings):
    monkeypatch.setattr(m, "GRAMS", grams)
    monkeypatch.setattr(m, "STRINGS", strings)
    monkeypatch.setattr(m, "TIERS", ((m.DEPTH, grams), (3, grams // 4), (1, 1 << 16)), raising=False)  # what bounded them
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdé", k=rnd.randrange(1, 7))) for _ in range(rnd.randrange(40))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "no id"), (150, None), (151, "zz zz \x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    held = {r.doc_id for r in df.where(F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False))).collect()}
    u, n = np.unique(grams_of(*normal_form([(t or "").encode() for d, t in rows if d not in held])), return_counts=True)
    assert len(u) > 500
    tree = ContextTree([(m.DEPTH, u, n)])
    want = {d: tree.mixed_score(grams_of(*normal_form([(t or "").encode()]))).sum() for d, t in rows}
    got = {r.doc_id: r.score for r in op6_context_tree_weighting(spark, str(tmp_path)).collect()}
    assert held and got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in want) < 1e-6
