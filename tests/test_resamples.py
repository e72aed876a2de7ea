import inspect

import haruspex.plans.queries as q
from haruspex.operators import resample


def test_paired_bootstrap_draws_the_operators_default(spark, monkeypatch):
    rows = [(i % 30, (i % 10) / 10, (i % 7) / 7, i % 2) for i in range(90)]
    monkeypatch.setattr(q.X, "forecast", lambda spark, d: spark.createDataFrame(rows, "cluster long, p double, p2 double, y int"))
    default = inspect.signature(resample.hash_bootstrap).parameters["resamples"].default
    assert q.agg24(spark, "").first().n_resamples == default == 200
