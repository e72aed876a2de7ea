from datetime import datetime, timedelta

import haruspex.plans.queries3 as q

FIRST, DAYS = datetime(1000, 1, 1), 3_000_000


def totals(spark, monkeypatch, rows):
    monkeypatch.setattr(q.X, "forecast", lambda spark, d: spark.createDataFrame(rows, "grp string, as_of timestamp, resolved_at timestamp"))
    return {r.grp: (r.positive, r.refused, r.total_days) for r in q.date02(spark, "").collect()}


def test_a_sum_of_lifetimes_outgrows_a_long(spark, monkeypatch):
    long = ("a", FIRST, FIRST + timedelta(days=DAYS))
    assert totals(spark, monkeypatch, [long] * 40) == {"a": (40, 0, 40 * DAYS)}


def test_days_of_a_sum_are_whole_ones(spark, monkeypatch):
    long, short = ("a", FIRST, FIRST + timedelta(days=DAYS)), ("a", FIRST, FIRST + timedelta(days=1, microseconds=-1))
    late = ("b", FIRST, FIRST)
    assert totals(spark, monkeypatch, [long] * 30 + [short, late]) == {"a": (31, 0, 30 * DAYS), "b": (0, 1, None)}
