"""Corner cases and identities of the operators, and small reference models of our own."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from haruspex.functions import text as T
from haruspex.functions.probability import clamp_price, equal_width_bin
from haruspex.operators import asof, ingest, isotonic, leakage, resample, runs, sampling, scoring, series, temporal
from haruspex.plans import diagram, manifest
from haruspex.sources import files
from haruspex.streaming import twins
from pyspark.sql import functions as F

PY = "p double, y int"


def test_edges_of_bins_are_exact(spark):
    got = spark.createDataFrame([(0.29,), (0.0,), (1.0,), (0.3,), (0.7,)], "p double").select(equal_width_bin(F.col("p"), 100).alias("a"), equal_width_bin(F.col("p"), 10).alias("b")).collect()
    assert [tuple(r) for r in got] == [(29, 2), (0, 0), (99, 9), (30, 3), (70, 7)]


def test_a_large_tie_does_not_cascade(spark):
    rows = [(0.5, 1)] * 60 + [(i / 100, i % 2) for i in range(51, 91)]
    got = scoring.bins(scoring.pooled(spark.createDataFrame(rows, PY)), 5, "equal_mass").orderBy("bin").collect()
    assert [r.n for r in got] == [60, 10, 10, 10, 10]


def test_murphy_and_corp_identities(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(11) / 10, int(rnd.random() < 0.4)) for _ in range(500)]
    df = spark.createDataFrame(rows, PY)
    b = scoring.brier(df, n_bins=100).first()
    assert abs(b.residual) < 1e-12 and not b.coarse
    c = isotonic.corp(scoring.pooled(df)).first()
    assert abs(c.score - (c.mcb - c.dsc + c.unc)) < 1e-12 and abs(c.score - b.score) < 1e-12
    assert c.mcb >= 0 and c.dsc >= 0


@pytest.mark.parametrize("few", [10**6, 0])
def test_isotonic_forms_agree(spark, few, monkeypatch):
    monkeypatch.setattr(isotonic, "FEW", few)
    rnd = random.Random(3)
    rows = [(g, rnd.randrange(40) / 40, int(rnd.random() < 0.5)) for g in "ab" for _ in range(300)]
    points = scoring.pooled(spark.createDataFrame(rows, "g string, p double, y int"), group=["g"])
    got = {(r.g, r.p): r.fit for r in isotonic.isotonic(points, ["g"]).collect()}
    for g in "ab":
        ps = sorted({p for h, p, _ in rows if h == g})
        s = [sum(y for h, q, y in rows if h == g and q == p) for p in ps]
        n = [sum(1 for h, q, _ in rows if h == g and q == p) for p in ps]
        for p, f in zip(ps, isotonic.pool_adjacent(ps, s, n)):
            assert abs(got[g, p] - f) < 1e-12


def test_ties_pool_before_fitting(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], PY)
    assert [r.fit for r in isotonic.isotonic(scoring.pooled(df)).collect()] == [0.5]


def test_beta_map_never_decreases():
    a, b, c = isotonic.fit_beta([0.2, 0.5, 0.8], [30, 10, 25], [40, 40, 40])
    assert a >= 0 and b >= 0
    z = lambda p: a * np.log(p) - b * np.log(1 - p) + c
    assert z(0.8) >= z(0.2) - 1e-12


def test_bad_forecasts_are_errors(spark):
    for bad in (1.5, float("nan"), None):
        with pytest.raises(Exception, match="not a forecast"):
            scoring.brier(spark.createDataFrame([(bad, 1)], PY)).collect()


def test_prices_clamp_only_float_noise(spark):
    one = lambda v: spark.createDataFrame([(v,)], "v double").select(clamp_price(F.col("v"))).first()[0]
    assert one(1.000000000000014) == 1.0 and one(-1e-12) == 0.0
    with pytest.raises(Exception, match="implausible"):
        one(1.5)


def test_center_mass_holds_both_edges(spark):
    r = scoring.output_histogram(spark.createDataFrame([(0.45,), (0.55,), (0.2,), (0.56,)], "p double")).first()
    assert r.center_mass == 0.5 and r.distinct_values == 4 and r.value_entropy == 2.0


RESPONSES = {
    "<reasoning>r</reasoning><probability>0.37</probability>": (0.37, None),
    "<reasoning>r</reasoning><probability>37%</probability>": (None, "percentage"),
    "<REASONING>r</REASONING><Probability> .5 </Probability>": (0.5, None),
    "<probability>0.2</probability><probability>0.3</probability>": (None, "multiple_probabilities"),
    "I can't do that": (None, "refusal"),
    "nothing": (None, "missing_probability"),
    "<reasoning>I cannot know</reasoning><probability>0.1</probability>": (0.1, None),
    "<reasoning>r</reasoning><probability></probability>": (None, "empty_probability"),
    "<reasoning>r</reasoning><probability>1/3</probability>": (None, "not_a_number"),
    "<reasoning>r</reasoning><probability>-0.1</probability>": (None, "out_of_range"),
    "<probability>0.1</probability>": (None, "missing_reasoning"),
}


def test_parsing(spark):
    df = spark.createDataFrame([(k,) for k in RESPONSES], "t string").select("t", T.parse_forecast(F.col("t")).alias("x"))
    assert {r.t: (r.x.probability, r.x.failure) for r in df.collect()} == RESPONSES


def test_superscripts_are_no_digits(spark):
    df = spark.createDataFrame([("<probability>0.²5",), ("<probability>0.25",), ("<probability>later. 3",)], "t string")
    assert [r[0] for r in df.select(T.digit_positions(F.col("t"))).collect()] == [None, [15, 16], None]


def test_screen_at_the_instant(spark):
    at = datetime(2024, 1, 2)
    rows = [("fred", at, "publisher_verified", None, None, None, at), ("Wikipedia", at - timedelta(1), "unknown", None, None, "x?OLDID=7", at), ("x", None, "crawl", at, None, None, at)]
    df = spark.createDataFrame(rows, "source string, timestamp timestamp, provenance string, last_modified timestamp, retrieved_at timestamp, url string, as_of timestamp")
    got = leakage.screen(df, leakage.registry(spark)).collect()
    by = {r.source: r for r in got}
    assert by["fred"].reasons == ["timestamp_not_before_as_of"]
    assert by["Wikipedia"].admissible and by["Wikipedia"].exemption == "tier1_unknown_provenance"
    assert by["x"].reasons == ["missing_timestamp", "ambiguous_provenance", "unknown_source", "untrusted_source_tier"]


def test_versions_must_agree_to_merge(spark):
    df = spark.createDataFrame([("a", 1, "1"), ("a", 2, "2")], "reason string, count long, version string")
    with pytest.raises(Exception, match="different detector versions"):
        leakage.merge_stats(df).collect()


def test_binomial_forms_agree(spark):
    ns = [1, 7, 40, 300]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", leakage.binomial_upper(F.col("n"), 0.05).alias("k")).collect()
    assert {r.n: r.k for r in got} == {n: leakage.binomial_upper_count(n, 0.05) for n in ns}


def test_supervision_against_a_plain_model(spark):
    rnd = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = [(f"q{rnd.randrange(4)}", t0 + timedelta(hours=rnd.randrange(24 * 30)), rnd.randrange(3) / 2) for _ in range(600)]
    opened, resolved = t0 + timedelta(1), t0 + timedelta(28)
    df = spark.createDataFrame(rows, "question_id string, ts timestamp, price double").withColumns({"open_date": F.lit(opened).cast("timestamp"), "resolved_at": F.lit(resolved).cast("timestamp")})
    got = {(r.question_id, r.ts, r.target, r.target_us) for r in asof.supervision_points(asof.validate_prices(df)).where("reason is null").collect()}
    want = set()
    for q in {r[0] for r in rows}:
        seen = {}
        for k, t, p in rows:
            if k == q:
                seen.setdefault(t, set()).add(p)
        use = sorted((t, min(p)) for t, p in seen.items() if len(p) == 1 and opened <= t < resolved - timedelta(hours=1))
        for t, _ in use:
            limit = t + (resolved - t) * 0.5
            found = [x for x in use if x[0] <= limit]
            if found and found[-1][0] - t >= timedelta(hours=6):
                want.add((q, t, found[-1][1], int(found[-1][0].replace(tzinfo=UTC).timestamp() * 1e6)))
    assert got == want and got


def test_splits_at_the_freeze(spark):
    f = temporal.FREEZE
    rows = [(f,), (f + timedelta(microseconds=1),), (temporal.DEV_START,), (temporal.DEV_START - timedelta(1),), (None,)]
    got = spark.createDataFrame(rows, "t timestamp").select(temporal.split(F.col("t"))).collect()
    assert [r[0] for r in got] == ["dev", "published", "dev", "train", "open"]


def test_publishable_guards_come_in_order(spark):
    schema = "split string, outcome int, as_of timestamp, resolved_at timestamp"
    t = datetime(2024, 1, 1)
    with pytest.raises(temporal.NotPublishable, match="the slice is dev"):
        temporal.require_publishable(spark.createDataFrame([("dev", 1, None, t)], schema))
    with pytest.raises(temporal.NotPublishable, match="without a forecast time"):
        temporal.require_publishable(spark.createDataFrame([("published", 1, None, t)], schema))
    temporal.require_publishable(spark.createDataFrame([("published", 1, t - timedelta(1), t)], schema))


def test_mixture_plans():
    assert sampling.mixture_plan(100, 100, 0.2) == (100, 25)
    assert sampling.mixture_plan(100, 30, 0.6) == (20, 30)
    assert sampling.mixture_plan(10, 10, 0.0) == (10, 0)
    with pytest.raises(sampling.Infeasible):
        sampling.mixture_plan(100, 5, 0.9)


def test_exact_bootstrap_is_reproducible():
    rows = [(1.0, 2), (0.0, 1), (3.0, 4)]
    a = resample.exact_bootstrap(rows, resamples=500)
    assert a == resample.exact_bootstrap(rows, resamples=500) and a[0] == 4 / 7 and a[1] <= a[0] <= a[2]


def test_paired_delta_of_few_rows(spark):
    df = spark.createDataFrame([(0.5, 0.4, 1)], "a double, b double, y int")
    r = resample.paired_delta(df, "a", "b").first()
    assert r.n == 1 and r.lower == float("-inf") and r.upper == float("inf")
    r = resample.paired_delta(df.limit(0), "a", "b").first()
    assert (r.n, r.mean, r.lower, r.upper) == (0, 0.0, 0.0, 0.0)


def test_series_that_ends_early_asks_nothing(spark):
    day = temporal.DAY
    s = spark.createDataFrame([("s", i * day, 100.0 + i) for i in range(40)], "series_id string, us long, value double")
    a = spark.createDataFrame([("s", 38 * day), ("s", 36 * day), ("s", 5 * day)], "series_id string, as_of_us long")
    got = {r.as_of_us // day: r.reason for r in series.contexts(s, a, 3 * day, min_history=10).collect()}
    assert got == {38: "ends_early", 36: None, 5: "short_history"}
    with pytest.raises(ValueError):
        series.evidence_of(s, "fred", "revised_in_place")


def test_published_builder_keeps_a_later_good_copy(spark):
    schema = "id string, title string, resolution string, created_ts long, close_ts long, resolved_ms long, seq long"
    rows = [("a", "t", "MKT", 1, 2, 9, 0), ("a", "t", "YES", 1, 2, 9, 1), ("a", "t", "NO", 1, 2, 9, 2), ("b", "t", "NO", 1, None, 9, 3)]
    got = ingest.published_set(spark.createDataFrame(rows, schema), freeze_ms=5, require_close=True).orderBy("seq").collect()
    assert [(r.seq, r.reason) for r in got] == [(0, "unresolved_or_other"), (1, None), (3, "no_close_ts")]


def test_fuzzy_similarity(spark):
    df = spark.createDataFrame([("rates rose by 34 basis points", "rates rose by 34 basis points"), ("nothing here", "zzz")], "a string, b string")
    got = [r[0] for r in df.select(leakage.best_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] < 0.3


def test_forecaster_failures_are_transport(spark):
    def bad(pdf):
        raise TimeoutError

    df = spark.createDataFrame([(1,)], "id int")
    r = runs.run_report(runs.parsed(runs.forecast_with(df, bad))).first()
    assert (r.attempted, r.scored, r.coverage, r.compliance) == (1, 0, 0.0, None)
    ok = runs.forecast_with(df, lambda pdf: pdf["id"].map(lambda _: "<reasoning>r</reasoning><probability>0.5</probability>"))
    assert runs.require_coverage(runs.parsed(ok), minimum_coverage=0.9).count() == 1
    with pytest.raises(ValueError):
        runs.require_coverage(runs.parsed(runs.forecast_with(df, bad)), minimum_coverage=0.5)


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,v\n2024-01-02,2\n2024-01-01,1\n")
    assert [r.value for r in files.csv_series(spark, str(tmp_path / "s.csv"), date_column="date", value_column="v").collect()] == [1.0, 2.0]
    (tmp_path / "bad.csv").write_text("date,v\n2024-01-02,\n")
    with pytest.raises(Exception, match="bad cell"):
        files.csv_series(spark, str(tmp_path / "bad.csv"), date_column="date", value_column="v").collect()
    (tmp_path / "run.jsonl").write_text('{"question_id": "a", "expectation_probability": 0.1}\n\n{"question_id": "a", "expectation_probability": 0.2}\n{"question_id": "b"}\n{"question_id": "c", "exp')
    assert [tuple(r) for r in files.forecasts(spark, str(tmp_path / "run.jsonl")).collect()] == [("a", 0.2)]
    assert {r[0] for r in files.done_ids(spark, str(tmp_path / "run.jsonl")).collect()} == {"a", "b"}
    assert files.done_ids(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(ValueError, match="empty"):
        files.eval_payload(spark.createDataFrame([], "question_id string, outcome int"), {}, "dev")
    assert files.hash_file(str(tmp_path / "s.csv")) == files.file_hashes(spark, str(tmp_path / "s.csv")).first().sha256


def test_diagram_breaks_at_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 0), (0.15, 0), (0.95, 1)], PY)
    svg = diagram.reliability_diagram(scoring.bins(scoring.pooled(df)), "a < b", "s")
    assert svg.count("<polyline") == 2 and svg.count("<circle") == 3 and "a &lt; b" in svg


def test_manifests():
    t = datetime(2024, 1, 1, tzinfo=UTC)
    dec = manifest.Decoding("greedy", 0.0, 1.0, 10, 1, None)
    fields = dict(code_version="c", model_version="m", corpus_version="x", detector_version="d", split="published", freeze=t, base_release=t, created=t, decoding=dec)
    m = manifest.Manifest(**fields)
    assert manifest.certify({"split": "published", "brier": 0.2}, m, t)["manifest"]["decoding.method"] == "greedy"
    with pytest.raises(manifest.Incomplete):
        manifest.Manifest(**fields | {"code_version": " "})
    with pytest.raises(ValueError):
        manifest.certify({"split": "dev"}, m, t)
    with pytest.raises(ValueError):
        manifest.certify({"split": "published"}, manifest.Manifest(**fields | {"base_release": t + timedelta(1)}), t)
    assert not dec.comparable(manifest.Decoding("greedy", 0.5, 1.0, 10, 1, None))


def test_streams_match_their_batch_forms(spark, tmp_path):
    rows = [(f"q{i % 5}", i / 10, i % 2, datetime(2024, 1, 1 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "question_id string, p double, y int, at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, scoring.pooled(df).collect()))
    assert sorted(map(tuple, twins.run_once(twins.pooled_stream(stream), "pooled").collect())) == want
    assert twins.run_once(twins.histogram_stream(stream), "hist").count() == 10
    assert twins.run_once(twins.windowed_scores(stream, "at"), "win").count() == 10
    assert twins.run_once(twins.unscored_stream(stream, "at", "30 days"), "once", "append").count() == 5
    for k in "ab":
        twins.accrue(stream, f"{tmp_path}/out", f"{tmp_path}/cp-{k}", F.col("p") > 0.2).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_outcome_strings_against_a_plain_scan(spark):
    rnd = random.Random(4)
    w = ["yes", "No", "3.4%", "rates,", "rose", "(by)", "ß", "x"]
    docs = [(i, " ".join(rnd.choices(w, k=12)) + rnd.choice(["", "!", " tail"])) for i in range(60)] + [(99, None)]
    forms = [(i, " ".join(rnd.choices(w, k=k))) for i, k in enumerate([1, 2, 3, 3, 4, 4, 5])] + [(20, " "), (21, "!"), (22, "ES rates rose B"), (23, None)]
    d, f = spark.createDataFrame(docs, "d int, snippet string"), spark.createDataFrame(forms, "f int, form string")

    def plain(t):
        return " ".join("".join(c if c.isalnum() or c in ".%" else " " for c in t.casefold()).split())

    for strictness in ("exact", "normalized"):
        want = set()
        for i, t in docs:
            for j, x in forms:
                if t is None or x is None or not x.strip():
                    continue
                if x in t:
                    want.add((i, j, "exact"))
                elif strictness == "normalized" and plain(x) and plain(x) in plain(t):
                    want.add((i, j, "normalized"))
        got = {(r.d, r.f, r.matched_as) for r in leakage.match_outcomes(d, f, strictness=strictness).collect()}
        assert got == want and want


def test_written_tables_can_be_released(spark):
    from haruspex import storage

    df = storage.materialise(spark.range(3).toDF("x"), "released")
    assert df.count() == 3 and storage.release(spark) >= 1 and storage.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])
