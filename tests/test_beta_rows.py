import random

import haruspex.plans.queries as q
from haruspex.operators import isotonic
from pyspark.sql import functions as F


def test_fit_over_more_points_than_one_driver_would_hold(spark, monkeypatch):
    rnd = random.Random(2)
    pool = sorted((round(rnd.random(), 9), rnd.randrange(1, 9)) for _ in range(12_000))
    pool = [(p, n, sum(rnd.random() < (p if p < 0.8 else 0.3) for _ in range(n))) for p, n in dict(pool).items()]  # the highest differ
    rows = spark.createDataFrame(pool, "p double, n long, sy long").repartition(3)
    want = isotonic.fit_beta(*zip(*[(p, s, n) for p, n, s in pool]))
    assert all(abs(x - y) < 1e-6 for x, y in zip(isotonic.fit_beta_rows(rows), want))
    monkeypatch.setattr(q.X, "forecast", lambda spark, d: None)
    monkeypatch.setattr(q.scoring, "pooled", lambda fc: rows)
    got = {r.p: r.corrected for r in q.agg15(spark, "").collect()}
    fit = rows.select("p", isotonic.apply_beta(F.col("p"), *want).alias("fit")).collect()
    assert len(got) == len(pool) and max(abs(got[r.p] - r.fit) for r in fit) < 2e-6


def test_a_negative_slope_is_left_out(spark):
    pool = [(0.1, 40, 36), (0.5, 40, 20), (0.9, 40, 4)]
    rows = spark.createDataFrame(pool, "p double, n long, sy long")
    want = isotonic.fit_beta(*zip(*[(p, s, n) for p, n, s in pool]))
    assert want[:2] == (0.0, 0.0) and all(abs(x - y) < 1e-9 for x, y in zip(isotonic.fit_beta_rows(rows), want))
