"""Cases that the registered queries' tables don't hold: ties, tabs, empty strings, policies, and brute force for queries without SQL."""

import difflib
import hashlib
import json
import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from haruspex import plans, storage
from haruspex.functions import text as T
from haruspex.operators import ingest, isotonic, leakage, resample, runs, sampling, temporal
from haruspex.operators.rules import require_columns
from haruspex.plans import diagram
from haruspex.streaming import twins
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (list, dict)) else 'array<string>' if isinstance(v, list) else 'map<string,double>'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    assert storage.shared_dir(spark)


def test_numbers_are_of_rows_not_of_splits(spark, tmp_path):
    spark.range(5000).repartition(3).write.option("parquet.block.size", 2048).parquet(f"{tmp_path}/t")
    read = lambda: {r.id: r.rid for r in storage.numbered(spark.read.parquet(f"{tmp_path}/t").where("id % 2 = 0"), "t").collect()}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        before = read()
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "40")
        assert read() == before and len(set(before.values())) == 2500
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    twice = storage.numbered(spark.read.parquet(f"{tmp_path}/t").select(F.explode(F.array("id", "id")).alias("rid")), "t", "number")
    assert twice.select("number").distinct().count() == 10_000
    assert storage.free_name(spark.range(1).toDF("RID"), "rid") == "_rid"


def test_base_rates_take_resolved_rows(spark):
    rows = [("a", 1, "train")] * 30 + [("a", None, "train")] * 30 + [("b", None, "dev")]
    df = spark.createDataFrame(rows, "c string, y int, split string")
    assert temporal.BaseRates(df, "c").forecast(df).where("c = 'a'").first().base_rate == 1.0
    for bad in (df.where("y is null"), df.withColumn("split", F.lit("dev"))):
        with pytest.raises(ValueError):
            temporal.BaseRates(bad, "c")


@pytest.mark.parametrize("title", ["Will it rain?", "Will it rain?\t", "Will it rain ?? \n", "Will it rain? "])
def test_question_marks_go_behind_any_white_space(spark, title):
    bare = title.rstrip().rstrip("?").rstrip()
    assert one(spark, ingest.rebuilt_prompt(F.col("t"), F.col("s")), t=title, s="Snow") == bare + " — resolves YES if: Snow"
    assert one(spark, ingest.rebuilt_prompt(F.col("t"), F.col("s")), t=title, s="RAIN") == title


def test_transfer_reasons(spark):
    base = {"status": "finalized", "mve_collection_ticker": "", "event_ticker": "E", "category": "Politics", "title": "t", "result": "yes", "opened": "2024-01-01", "settled": "2024-03-01"}
    cases = [({}, None), ({"mve_collection_ticker": "M"}, "mve"), ({"category": "Sports"}, "mechanical_category"), ({"opened": None}, "bad_timestamps"), ({"opened": "2024-02-28"}, "short_lifetime"), ({"status": None}, "not_finalized")]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], ", ".join(f"{k} string" for k in base)).withColumns({k: F.to_timestamp(k) for k in ("opened", "settled")})
    at = lambda t: F.lit(t).cast("timestamp")
    assert [r.x for r in df.select(ingest.transfer_reason(lo=at("2024-01-01"), hi=at("2025-01-01"), min_days=7).alias("x")).collect()] == [w for _, w in cases]


def test_prompt_defaults(spark):
    got = one(spark, ingest.prompt(F.col("q"), F.lit(None).cast("string"), F.lit(""), F.col("a")), q="Q {criteria}", a="2024-01-02 10:00")
    assert got == ingest.PROMPT.format(question="Q {criteria}", criteria="Resolves YES if the event occurs.", scheduled="unknown", as_of="2024-01-02 10:00")


def test_digit_reads(spark):
    for order in ("72", "27"):
        tied = F.create_map(*[x for d in order for x in (F.lit(d), F.lit(0.4))], F.lit("x"), F.lit(0.2))
        assert spark.range(1).select(T.read_probability(tied, F.lit(None).cast("map<string,double>")).alias("x")).first().x.greedy == int(order[0]) / 10
    rows = [({" 3": 0.3, "3": 0.3, "5": 0.4}, {"1": 0.2, "x": 0.8}), ({"4": 0.45, "a": 0.55}, None), ({"4": 3.0, "a": 1.0}, {"\t9": 2.0})]
    df = spark.createDataFrame(rows, "t map<string,double>, h map<string,double>").select(T.read_probability(F.col("t"), F.col("h")).alias("x"))
    got = [r.x for r in df.collect()]
    assert [None if x.greedy is None else round(x.greedy, 9) for x in got] == [0.3, None, 0.49]
    assert round(got[0].expectation, 9) == round((0.6 * 3 + 0.4 * 5) / 10, 9) and got[1].failure


def test_binomial_does_not_underflow(spark):
    k = leakage.binomial_upper_count(20_000, 0.05)
    assert abs(k - (1000 + 1.645 * math.sqrt(950))) < 3
    assert spark.range(20_000, 20_001).select(leakage.binomial_upper(F.col("id"), 0.05).alias("k")).first().k == k


def test_null_gate_refuses(spark):
    rows = [("null", 0.01 * i, "m") for i in range(30)] + [("adversarial", 0.5, "m")] * 3
    df = spark.createDataFrame(rows, "label string, delta double, v string")
    r = leakage.null_gate(df, version="v").first()
    assert (r.n, r.exceed, r.passed) == (3, 3, False)
    normal = leakage.null_gate(df, method="normal", z=3.0).first()
    deltas = [x[1] for x in rows[:30]]
    assert abs(normal.threshold - (sum(deltas) / 30 + 3 * pd.Series(deltas).std())) < 1e-9
    for bad in (df.where("label = 'null'"), df.where("label != 'null'"), df.withColumn("v", F.col("label"))):
        with pytest.raises(Exception, match="(?i)one model|no adversarial|one null case"):
            print(leakage.null_gate(bad, version="v").collect())


def test_screen_with_policy_and_outcomes(spark):
    day = datetime(2024, 1, 1)
    doc = lambda source, provenance, snippet, forms: (source, day, provenance, day + timedelta(days=9), day, None, day + timedelta(days=5), snippet, forms)
    rows = [doc("fred", "unknown", "The rate rose 3.4%!", ["rate ROSE 3.4%"]), doc("fred", "crawl", "calm", ["", " "]), doc("blog", "publisher_verified", "x", None)]
    df = spark.createDataFrame(rows, "source string, timestamp timestamp, provenance string, last_modified timestamp, retrieved_at timestamp, url string, as_of timestamp, snippet string, forms array<string>")
    tiers = leakage.registry(spark)
    got = leakage.screen(df, tiers, forms="forms").collect()
    assert got[0].reasons == ["modified_at_or_after_as_of", "outcome_string_match"] and got[0].matched_forms == ["rate ROSE 3.4%"] and got[0].max_similarity == 1.0
    assert [r.reasons for r in leakage.screen(df, tiers).collect()] == [r.reasons[:-1] if i == 0 else r.reasons for i, r in enumerate(got)]
    loose = leakage.screen(df, tiers, leakage.Policy(reject_modified=False, disqualifying=(), unknown_tier=2), forms="forms").collect()
    assert [r.reasons for r in loose] == [["outcome_string_match"], [], ["unknown_source"]]


def test_fuzzy_rung_against_a_plain_scan(spark):
    rnd = random.Random(9)
    words = ["rate", "rose", "fell", "3.4%", "the", "bank", "votes", "for"]
    rows = [(" ".join(rnd.choices(words, k=12)) + rnd.choice([" Rates rose 3.4% again", "", " bank-votes"]), [" ".join(rnd.choices(words, k=3)), "bank votes", " "]) for _ in range(40)]
    got = spark.createDataFrame(rows, "s string, f array<string>").select(leakage.scan_outcomes(F.col("s"), F.col("f"), "fuzzy", 0.8).alias("x")).collect()
    form = lambda s: " ".join("".join(c if c.isalnum() or c in ".%" else " " for c in s.casefold()).split())

    def plain(s, f):
        if f in s or form(f) in form(s):
            return 1.0
        w, n = form(s).split(), len(form(f).split())
        return max(difflib.SequenceMatcher(None, form(f), " ".join(w[i : i + k])).ratio() for i in range(len(w)) for k in (n - 1, n, n + 1) if 0 < k <= len(w) - i)

    for (s, fs), r in zip(rows, got):
        each = [(f, plain(s, f)) for f in fs if f.strip()]
        assert r.x.matched_forms == [f for f, v in each if v >= 0.8] and abs(r.x.max_similarity - max(v for _, v in each)) < 1e-9
    with pytest.raises(ValueError):
        leakage.scan_outcomes(F.col("s"), F.col("f"), "fuzzy")


def test_one_bad_row_fails_alone(spark):
    def picky(pdf):
        if (pdf["id"] == 7).any():
            raise TimeoutError
        return pdf["id"].map(lambda i: f"r{i}")

    got = {r.id: (r.response, r.transport_error) for r in runs.forecast_with(spark.range(20).coalesce(1), picky).collect()}
    assert got == {i: (f"r{i}", None) if i != 7 else (None, "transport_TimeoutError") for i in range(20)}


def test_ridge_steadies_the_matrix_alone():
    p, s, n = [0.1, 0.3, 0.6, 0.9], [5, 30, 65, 92], [100, 100, 100, 100]
    a, b, c = isotonic.fit_beta(p, s, n, ridge=1e-2)
    q = [1 / (1 + math.exp(-(a * math.log(x) - b * math.log(1 - x) + c))) for x in p]
    assert abs(sum(y - k * z for y, k, z in zip(s, n, q))) < 1e-6  # no pull on the solution


def test_required_columns(spark):
    df = spark.createDataFrame([("q", 0.4, 1)], "k string, p double, y int")
    assert require_columns(df, "k", "p").columns == ["k", "p", "y"]
    with pytest.raises(ValueError, match="missing columns: y"):
        sampling.select_traces(df.drop("y"), "k", base_rate=0.5, margin=0.1, wrong_fraction=0.5)


@pytest.mark.parametrize("n", [0, 1, 37, 199, 200, 500])
def test_first_in_hash_order(spark, n):
    keys = [str(i) for i in range(200)]
    got = sampling.hash_first(spark.createDataFrame([(k,) for k in keys], "k string"), "k", n, "s")
    assert sorted(r.k for r in got.collect()) == sorted(sorted(keys, key=lambda k: hashlib.sha256(f"s:{k}".encode()).hexdigest())[:n])


def test_diagram(spark):
    rows = [(i / 10, (i + 1) / 10, n, (i + 0.5) / 10 if n else None, 0.5 if n else None) for i, n in enumerate([4, 1, 0, 9, 0, 2, 2, 0, 0, 1])]
    svg = diagram.reliability_diagram(spark.createDataFrame(rows, "lower double, upper double, n long, mean_forecast double, observed_frequency double"), 'a "b" <c>', "s")
    assert svg.count("<polyline") == 4 and svg.count("<circle") == 6 and "questions per bin (min 1, 6 populated)" in svg and 'viewBox="0 0 460 420"' in svg
    assert "forecast 0.35, observed 0.5, n=9" in svg and "[0.3, 0.4): n=9" in svg and svg.count("0.75</text>") == 2
    import xml.dom.minidom

    xml.dom.minidom.parseString(svg)


def test_late_rows_are_counted(spark, tmp_path):
    rows = lambda d, n: spark.createDataFrame([(datetime.fromisoformat(d), 0.5, 1)] * n, "at timestamp, p double, y int").write.mode("append").parquet(f"{tmp_path}/in")
    rows("2024-01-01", 2)
    stream = lambda: twins.windowed_scores(spark.readStream.schema("at timestamp, p double, y int").parquet(f"{tmp_path}/in"), "at")
    late = 0
    for d, n in ((None, 0), ("2024-01-20", 1), ("2024-01-02", 3)):
        if d:
            rows(d, n)
        q = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        late += twins.late_rows(q)
    assert late >= 1


def test_vector_bootstrap_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i % 40, rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "c long, e double").repartition(3)
    h = {r.c: r.h % (1 << 64) for r in df.select("c", F.xxhash64("c").alias("h")).distinct().collect()}
    wide = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & wide
        return x ^ (x >> 31)

    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(int(total * 2**32))
    means = []
    for b in range(500):
        step = mix((b + 7 * 0x9E3779B9) & wide)
        times = {c: sum((mix(x ^ step) >> 32) >= t for t in cuts) for c, x in h.items()}
        n = sum(times[c] for c, _ in rows)
        means.append(sum(times[c] * e for c, e in rows) / n)
    r = resample.vector_bootstrap(df, "e", "c", resamples=500, seed=7).first()
    want = pd.Series(means)
    assert abs(r.lower - want.quantile(0.025)) < 1e-9 and abs(r.upper - want.quantile(0.975)) < 1e-9 and r.n_resamples == 500 and r.n_clusters == 40
    assert 0.9 < sum(sum(mix(x ^ mix(b)) >> 32 >= t for t in cuts) for x in h.values() for b in range(200)) / 8000 < 1.1


def test_queries_without_sql_by_brute_force(spark):
    duck = lambda q: duckdb.sql(q).fetchall()
    blake = lambda x: hashlib.blake2b(x.encode(), digest_size=8)
    keys = [str(r[0]) for r in duck(f"select o_orderkey from '{D}/orders.parquet'")]
    folds = {}
    for k in keys:
        f = int.from_bytes(blake(k).digest(), "big") % 5
        folds[f] = folds.get(f, 0) + 1
    assert {r.fold: r["count"] for r in plans.QUERIES["agg16_fold_exact"](spark, D).collect()} == folds
    assert plans.QUERIES["src10_file_hashes"](spark, D).first()[0] == hashlib.sha256(open(f"{D}/region.parquet", "rb").read()).hexdigest()
    assert abs(plans.QUERIES["agg22_uniform_baseline"](spark, D).first().brier - 1 / 3) < 0.02
    points = duck(f"select l_quantity / 50.0 p, count(*) n, sum((l_returnflag = 'R')::int)::int s from '{D}/lineitem.parquet' join '{D}/orders.parquet' on l_orderkey = o_orderkey group by 1")
    a, b, c = isotonic.fit_beta(*zip(*[(float(p), s, n) for p, n, s in points]))
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    want = {round(float(p), 6): 1 / (1 + math.exp(-(a * math.log(clip(float(p))) - b * math.log(1 - clip(float(p))) + c))) for p, *_ in points}
    got = {round(r.p, 6): r.corrected for r in plans.QUERIES["agg15_beta_calibration"](spark, D).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)
    r = plans.QUERIES["agg24_vector_bootstrap"](spark, D).first()
    assert r.n_resamples == 10_000 and r.lower < r.point < r.upper
    assert json.dumps(sorted(folds))
