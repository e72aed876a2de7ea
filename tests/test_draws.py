import hashlib
import math
import struct

import duckdb
import numpy as np
import pytest
import xxhash

import haruspex.plans.queries as q
from haruspex.operators import resample

ROWS = [(None if i % 11 == 0 else i % 11 * 7, (i * i % 17) / 17, (i % 5) / 5, i % 3 % 2) for i in range(80)]


def sha(b, c):
    return int(hashlib.sha256(":".join(["boot", str(b), *([str(c)] if c is not None else [])]).encode()).hexdigest()[:8], 16)


def xx(b, c):
    h = xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(b"boot", 42))
    return (h if c is None else xxhash.xxh64_intdigest(struct.pack("<q", c), h)) & 0xFFFFFFFF


def brute(rows, draw, resamples):
    sums: dict = {}
    for c, v in rows:
        s, n = sums.get(c, (0.0, 0))
        sums[c] = s + v, n + 1
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    means = []
    for b in range(1, resamples + 1):
        k = {c: sum(draw(b, c) / 2**32 >= x for x in cuts) for c in sums}
        if any(k.values()):
            means.append(sum(k[c] * sums[c][0] for c in sums) / sum(k[c] * sums[c][1] for c in sums))
    return np.quantile(means, 0.025), np.quantile(means, 0.975), len(means)


def plan(spark, df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,draw", [("sha256", sha), ("xxhash", xx)])
@pytest.mark.parametrize("n", [1, 80])
def test_draws_against_brute_force(spark, name, draw, n):
    rows = [(c, v) for c, v, *_ in ROWS[:n]]
    r = resample.hash_bootstrap(spark.createDataFrame(rows, "c long, v double"), "v", "c", draws=name).first()
    assert (r.lower, r.upper, r.n_resamples) == pytest.approx(brute(rows, draw, 200), abs=1e-12)
    assert r.n_clusters == len({c for c, _ in rows}) and r.n_observations == n


def test_one_cluster_has_the_resamples_of_the_sql(spark, monkeypatch, tmp_path):
    c = duckdb.connect()
    c.execute("create table orders as select 7::bigint o_orderkey, '1' o_orderpriority, timestamp '2024-01-01' o_orderdate")
    c.execute("create table lineitem as select 7::bigint l_orderkey, 3::bigint l_linenumber, 5::bigint l_partkey, 5::bigint l_suppkey, 20.0::double l_quantity, 0.1::double l_discount, 'R' l_returnflag, timestamp '2024-01-02' l_shipdate")
    for t in ("orders", "lineitem"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    assert tuple(q.QUERIES["agg23_bootstrap_hash"](spark, str(tmp_path)).first()) == c.execute(q.SQL["agg23_bootstrap_hash"]).fetchone()


def test_sha256_draws_are_compiled(spark):
    df = spark.createDataFrame([(1, 0.5)], "c long, v double")
    p = plan(spark, resample.hash_bootstrap(df, "v", "c"))
    assert "lambda" not in p and p.count("sha2(") == 1


def test_xxhash_draws_are_compiled(spark):
    df = spark.createDataFrame([(1, 0.5)], "c long, v double")
    p = plan(spark, resample.hash_bootstrap(df, "v", "c", draws="xxhash"))
    assert "lambda" not in p and p.count("xxhash64(") == 1
