"""Registered queries on single steps: bins, entropies, thresholds, maps of digits, rolling sums, pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.probability import equal_width_bin, valid_probability
from ..operators import ingest, isotonic, leakage, rules, scoring, series, temporal
from ..sources import files
from ..sources import fixtures as X
from ..storage import fresh_path
from .queries import BIN, R, query, rounded


@query("agg01_validation", "select count(*) n, count(*) filter (value / 500.0::double between 0 and 1) valid from events")
def agg01(spark, d):
    p = F.col("value") / 500.0
    return X.table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(valid_probability(p)).alias("valid"))


@query("agg02_bin_index", f"with {X.FORECAST}, p as (select l_partkey % 101 i, (l_partkey % 101) / 100.0::double p from fc), k as (select *, least(floor(p * 100)::int, 99) k from p) select i, {BIN.format(n=100)}::bigint bin, count(*) n from k group by all")
def agg02(spark, d):
    i = F.col("l_partkey") % 101
    return rounded(X.forecast(spark, d).select(i.alias("i"), equal_width_bin(i / 100.0, 100).alias("bin")).groupBy("i", "bin").agg(F.count("*").alias("n")))


@query("agg10_entropy", f"select {R('-sum(c / t * log2(c / t))')} bits from (select count(*)::double c, (select count(*) from lineitem)::double t from lineitem group by l_quantity)")
def agg10(spark, d):
    li = X.table(spark, d, "lineitem")
    c = li.groupBy("l_quantity").count().crossJoin(F.broadcast(li.agg(F.count("*").alias("t"))))
    return rounded(c.agg((-F.sum(F.col("count") / F.col("t") * F.log2(F.col("count") / F.col("t")))).alias("bits")))


@query("agg17_cross_fit_beta")
def agg17_beta(spark, d):
    points = isotonic.fold_points(X.forecast(spark, d), "cluster", "p", "y", stratum="grp")
    return rounded(isotonic.cross_fit(points, minimum_stratum=9000, fitter=isotonic.beta_maps), 6)


@query("leak15_null_threshold", f"with {X.PROBE} select label, {R('quantile_cont(delta, 0.95)')} by_quantile, {R('avg(delta) + 1.96 * stddev_samp(delta)')} by_deviation, count(*) n from cs group by 1")
def leak15(spark, d):
    c = leakage.probe_cases(X.probe(spark, d))
    a = leakage.null_threshold(c, group=("label",)).select("label", F.col("threshold").alias("by_quantile"), "n")
    b = leakage.null_threshold(c, "normal", group=("label",)).select("label", F.col("threshold").alias("by_deviation"))
    return rounded(a.join(b, "label"))


@query("leak11_stats_by_tier", f"with {X.EVIDENCE} select coalesce(tier::varchar, 'all') tier, count(*) n, count(*) filter (len(reasons) = 0) kept from (select * replace (coalesce(tier, 0) as tier) from ev) group by rollup (tier)")
def leak11_tier(spark, d):
    s = leakage.screen(X.evidence(spark, d), leakage.registry(spark, X.TIERS)).withColumn("tier", F.coalesce("tier", F.lit(0)))
    return s.rollup("tier").agg(F.count("*").alias("n"), F.count_if("admissible").alias("kept")).select(F.coalesce(F.col("tier").cast("string"), F.lit("all")).alias("tier"), "n", "kept")


@query("map01_digit_distribution", f"with a as (select event_id id, event_id % 10 d, 0.2::double + (event_id % 7) / 10.0::double m from events) select id, {R('m / (0.0::double + m + (1 - m))')} share, {R('(0.0::double + m * d) / m')} e, d::bigint mode from a")
def map01(spark, d):
    i = F.col("event_id")
    m = F.lit(0.2) + (i % 7) / 10.0
    tokens = F.create_map(F.concat(F.lit(" "), (i % 10).cast("string")), m, F.lit("no"), 1 - m)
    x = X.table(spark, d, "events").select(i.alias("id"), T.digit_distribution(tokens).alias("x"))
    return rounded(x.select("id", "x.share", "x.e", "x.mode"))


@query("math01_beta_map", f"with {X.FORECAST} select {R('p')} p, {R('1 / (1 + exp(-(0.8 * ln(c) - 1.1 * ln(1 - c) + 0.1)))')} corrected, count(*) n from (select p, least(greatest(p, 1e-4::double), 1 - 1e-4::double) c from fc) group by all")
def math01(spark, d):
    return rounded(X.forecast(spark, d).groupBy("p").agg(F.count("*").alias("n")).select("p", isotonic.apply_beta(F.col("p"), 0.8, 1.1, 0.1).alias("corrected"), "n"))


@query("date02_lifetimes", f"with {X.FORECAST} select grp, count(*) filter (us > 0) positive, count(*) filter (us <= 0) refused, sum(us) filter (us > 0)::bigint // 86400000000 total_days from (select grp, epoch_us(resolved_at) - epoch_us(as_of) us from fc) group by 1")
def date02(spark, d):
    us = temporal.lifetime(F.col("resolved_at"), F.col("as_of"))
    return rounded(X.forecast(spark, d).withColumn("us", us).groupBy("grp").agg(F.count_if(F.col("us") > 0).alias("positive"), F.count_if(F.col("us") <= 0).alias("refused"), temporal.total_days(F.when(F.col("us") > 0, F.col("us"))).alias("total_days")))


@query("win03_rolling_returns", f"with {X.SERIES}, r as (select series_id, us, ln(v / b) ret from (select series_id, us, value v, lag(value) over (partition by series_id order by us) b from se) where b > 0 and v > 0) select series_id, us, {R('s')} ret3 from (select *, sum(ret) over w s, count(*) over w k from r window w as (partition by series_id order by us rows between current row and 2 following)) where k = 3")
def win03(spark, d):
    w = Window.partitionBy("series_id").orderBy("us").rowsBetween(0, 2)
    r = series.log_returns(X.series(spark, d))
    return rounded(r.withColumn("ret3", F.sum("ret").over(w)).withColumn("k", F.count("*").over(w)).where("k = 3").select("series_id", "us", "ret3"))


@query("win04_latest_value", f"select user_id, event_id, {R('last_value(case when event_type = ' + chr(39) + 'click' + chr(39) + ' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding)')} latest from events")
def win04(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(X.table(spark, d, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "click", F.col("value")), ignorenulls=True).over(w).alias("latest")))


@query("join09_null_safe_fields", "select count(*) shared, count(*) filter (a.c_acctbal is not distinct from b.v) equal from customer a join (select c_custkey k, case when c_custkey % 5 = 0 then null else c_acctbal end v from customer) b on a.c_custkey = b.k")
def join09(spark, d):
    a = X.table(spark, d, "customer")
    b = a.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("v"))
    return a.join(b, a.c_custkey == b.k).agg(F.count("*").alias("shared"), F.count_if(F.col("c_acctbal").eqNullSafe(F.col("v"))).alias("equal"))


@query("join12_paired_arms", f"with a as (select l_orderkey k, avg(l_quantity / 50.0::double) p, max((l_returnflag = 'R')::int) y from lineitem group by 1), b as (select l_orderkey k, avg(1 - l_discount * 5.0::double) p from lineitem where l_suppkey % 7 <> 0 group by 1) select count(*) n, {R('avg((a.p - y) * (a.p - y) - (b.p - y) * (b.p - y))')} mean from a join b using (k)")
def join12(spark, d):
    li = X.table(spark, d, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.avg(F.col("l_quantity") / 50.0).alias("pa"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    b = li.where("l_suppkey % 7 != 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.avg(1 - F.col("l_discount") * 5.0).alias("pb"))
    sq = lambda c: (F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))
    return rounded(a.join(b, "k").agg(F.count("*").alias("n"), F.avg(sq("pa") - sq("pb")).alias("mean")))


@query("set03_undeclared_fields", "select name from (select unnest(['l_quantity', 'l_tax', 'l_discount']) name) where name not in ('l_quantity', 'l_discount')")
def set03(spark, d):
    need, have = (F.array(*[F.lit(x) for x in xs]) for xs in (("l_quantity", "l_tax", "l_discount"), ("l_quantity", "l_discount")))
    return spark.range(1).select(F.explode(F.array_except(need, have)).alias("name"))


@query("src07_published_candidates", "select count(*) n, count(created) with_created from (select case when c_custkey % 4 <> 0 then c_custkey * 1000.0 end created from customer)")
def src07(spark, d):
    path, i = fresh_path(spark, "candidates"), F.col("c_custkey")
    rows = X.table(spark, d, "customer").select(F.to_json(F.struct(i.cast("string").alias("id"), F.when(i % 4 != 0, i * 1000.0).alias("created_ts"))).alias("value"))
    rows.write.text(path)
    return files.jsonl(spark, path, "id string, title string, resolution string, created_ts double, close_ts double, resolved_at string").agg(F.count("*").alias("n"), F.count("created_ts").alias("with_created"))


@query("src08_corpus_load", "select case when t is null then 'no_target' when t < 0 or t > 1 then 'out_of_range' end reason, count(*) n from (select case when event_id % 19 <> 0 then round(value) / 200.0::double end t from events) group by 1")
def src08(spark, d):
    path, i = fresh_path(spark, "corpus"), F.col("event_id")
    rows = X.table(spark, d, "events").select(F.to_json(F.struct(F.lit("q").alias("question"), F.when(i % 19 != 0, F.round("value") / 200.0).alias("target"))).alias("value"))
    rows.write.text(path)
    corpus = files.jsonl(spark, path, "question string, criteria string, scheduled string, as_of string, reasoning string, target double, kind string")
    return corpus.groupBy(ingest.corpus_reason(allow_extreme=True, require_reasoning=False).alias("reason")).agg(F.count("*").alias("n"))


@query("snk02_run_file_keys", "select count(*) n, count(*) filter (c_custkey % 3 <> 0) scored from customer")
def snk02(spark, d):
    path, i = fresh_path(spark, "run-keys"), F.col("c_custkey")
    files.write_run(X.table(spark, d, "customer").select(i.cast("string").alias("question_id"), F.when(i % 3 != 0, F.lit(0.5)).alias("expectation_probability")), path)
    lines = spark.read.text(path)
    keys = [x.split()[0] for x in files.RUN_SCHEMA.split(", ")]
    whole = lines.where(F.array_sort(F.json_object_keys("value")) == F.array_sort(F.array(*[F.lit(k) for k in keys])))
    return whole.agg(F.count("*").alias("n"), F.count_if(F.get_json_object("value", "$.expectation_probability").isNotNull()).alias("scored"))


@query("snk05_diagram_points", f"with {X.FORECAST}, k as (select p, y, least(floor(p * 10)::int, 9) k from fc), b as (select {BIN.format(n=10)} bin, p, y from k), g as (select bin, count(*) n, avg(p) x, avg(y) y from b group by 1) select bin::bigint bin, {R('x')} x, {R('y')} y, {R('3 + 6 * sqrt(n / (select max(n) from g))')} radius from g")
def snk05(spark, d):
    b = scoring.bins(scoring.pooled(X.forecast(spark, d))).where("n > 0")
    most = b.agg(F.max("n").alias("most"))
    return rounded(b.crossJoin(F.broadcast(most)).select("bin", F.col("mean_forecast").alias("x"), F.col("observed_frequency").alias("y"), (3 + 6 * F.sqrt(F.col("n") / F.col("most"))).alias("radius")))


@query("snk03_append_resume", "select count(*) n from customer")
def snk03(spark, d):
    """Half is written, then what the done-set lacks: every question once."""
    path = fresh_path(spark, "resume")
    q = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("question_id"))
    files.write_run(q.where("cast(question_id as long) % 2 = 0"), path)
    files.write_run(files.remaining(q, files.done_ids(spark, path)), path)
    return files.jsonl(spark, path, files.RUN_SCHEMA).agg(F.count("*").alias("n"))


@query("udf03_group_key", f"with {X.FORECAST} select year(as_of)::varchar || '-' || quarter(as_of) label, count(*) n, {R('avg((p - y) * (p - y))')} brier from fc group by 1")
def udf03(spark, d):
    key = F.concat_ws("-", F.year("as_of").cast("string"), F.quarter("as_of").cast("string"))
    return rounded(scoring.breakdown(X.forecast(spark, d), key, minimum_group=1).select("label", "n", "brier"))


@query("rules_all_and_first", "select case when l_quantity > 40 then 'large' when l_discount > 0.05 then 'cheap' end first, array_to_string(list_filter([case when l_quantity > 40 then 'large' end, case when l_discount > 0.05 then 'cheap' end, case when l_tax = 0 then 'untaxed' end], lambda x: x is not null), ',') every, count(*) n from lineitem group by all")
def rules_both(spark, d) -> DataFrame:
    table = [("large", F.col("l_quantity") > 40), ("cheap", F.col("l_discount") > 0.05), ("untaxed", F.col("l_tax") == 0)]
    return X.table(spark, d, "lineitem").select(rules.first_reason(table[:2]).alias("first"), F.array_join(rules.all_reasons(table), ",").alias("every")).groupBy("first", "every").agg(F.count("*").alias("n"))
