"""Registered queries: each an operator on the test tables, with an independent SQL form where SQL has one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.probability import banker_round, micros, toward_truth
from ..operators import asof, categories, ingest, isotonic, leakage, resample, rules, runs, sampling, scoring, series, temporal
from ..sources import fixtures as X
from ..storage import materialise

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to some places, so that the order of sums doesn't show."""
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def R(x: str) -> str:
    return f"round({x}, 9)"


BIN = """case when k < {n} - 1 and p >= (k + 1) / {n}.0::double then k + 1 when k > 0 and p < k / {n}.0::double then k - 1 else k end"""


def binned(src: str, group: str, n: int = 10) -> str:
    return f"pool as (select {group}, p, count(*) n, sum(y)::bigint sy from {src} group by all), binned as (select *, {BIN.format(n=n)} bin from (select *, least(floor(p * {n})::int, {n} - 1) k from pool))"


MURPHY = """per as (select grp, bin, sum(n)::double n, sum(sy)::double sy, sum(p * n) sp, sum(n * p * p - 2 * p * sy + sy) se from binned group by all),
mu as (select grp, sum(n) n, sum(sy) / sum(n) base_rate, sum(se) / sum(n) score, sum(n * pow(sp / n - sy / n, 2)) / sum(n) calibration, sum(n * pow(sy / n, 2)) / sum(n) - pow(sum(sy) / sum(n), 2) resolution from per group by grp)"""
MURPHY_OUT = f"n::bigint n, {R('base_rate')} base_rate, {R('score')} score, {R('calibration')} calibration, {R('resolution')} resolution, {R('base_rate * (1 - base_rate)')} uncertainty, {R('score - (calibration - resolution + base_rate * (1 - base_rate))')} residual, abs(score - (calibration - resolution + base_rate * (1 - base_rate))) > 0.05 * score coarse"


@query("agg05_brier_by_priority", f"with {X.FORECAST}, {binned('fc', 'grp')}, {MURPHY} select grp, {MURPHY_OUT} from mu")
def agg05(spark, d):
    return rounded(scoring.brier(X.forecast(spark, d), group=["grp"]))


@query("agg04_bins", f"with {X.FORECAST}, g as (select 'all' grp, p2 p, y from fc), {binned('g', 'grp', 20)}, own as (select bin, sum(n) n, sum(p * n) sp, sum(sy) sy from binned group by bin) select b.bin, {R('b.bin / 20.0')} lower, {R('(b.bin + 1) / 20.0')} upper, coalesce(n, 0)::bigint n, {R('sp / n')} mean_forecast, {R('sy / n')} observed_frequency from (select unnest(range(20)) bin) b left join own using (bin)")
def agg04(spark, d):
    return rounded(scoring.bins(scoring.pooled(X.forecast(spark, d), "p2"), 20))


MASS = """o as (select grp, p, n, sy, row_number() over (partition by grp order by p) i, sum(n) over (partition by grp) total from pool),
walk as (select grp, i, 0 bin, n held, 0::hugeint placed from o where i = 1 union all
  select o.grp, o.i, w.bin + c.shut, case when c.shut = 1 then o.n else w.held + o.n end, w.placed + case when c.shut = 1 then w.held else 0 end
  from walk w join o on o.grp = w.grp and o.i = w.i + 1, lateral (select case when w.bin < 9 and w.held >= ceil((o.total - w.placed) / (10 - w.bin)::double) then 1 else 0 end shut) c),
binned as (select o.*, w.bin from o join walk w using (grp, i))"""


@query("agg03_equal_mass_bins", f"with recursive {X.FORECAST}, pool as (select grp, p, count(*) n, sum(y)::bigint sy from fc group by all), {MASS} select grp, bin::bigint bin, {R('min(p)')} lower, {R('max(p)')} upper, sum(n)::bigint n, {R('sum(p * n) / sum(n)')} mean_forecast, {R('sum(sy) / sum(n)')} observed_frequency from binned group by grp, bin")
def agg03(spark, d):
    return rounded(scoring.bins(scoring.pooled(X.forecast(spark, d), group=["grp"]), 10, "equal_mass", ["grp"]))


ECE = "select grp, sum(n * abs(sp / n - sy / n)) / sum(n) e, max(abs(sp / n - sy / n)) m, count(*) k from (select grp, bin, sum(n)::double n, sum(p * n) sp, sum(sy)::double sy from {b} group by all) group by grp"


@query("agg07_ece_both", f"with recursive {X.FORECAST}, {binned('fc', 'grp').replace('binned as', 'wide as')}, {MASS}, w as ({ECE.format(b='wide')}), m as ({ECE.format(b='binned')}) select w.grp, {R('w.e')} ece_width, {R('w.m')} mce_width, w.k bins_width, {R('m.e')} ece_mass, {R('m.m')} mce_mass, m.k bins_mass, {R('abs(w.e - m.e)')} spread from w join m using (grp)")
def agg07(spark, d):
    return rounded(scoring.ece_both(X.forecast(spark, d), group=["grp"]))


@query("agg06_ece_one", f"with {X.FORECAST}, g as (select grp, p2 p, y from fc), {binned('g', 'grp')} select grp, {R('sum(n * abs(sp / n - sy / n)) / sum(n)')} ece, {R('max(abs(sp / n - sy / n))')} mce, count(*) populated, min(n)::bigint smallest_bin from (select grp, bin, sum(n)::double n, sum(p * n) sp, sum(sy)::double sy from binned group by all) group by grp")
def agg06(spark, d):
    return rounded(scoring.ece(X.forecast(spark, d), "p2", group=["grp"]))


@query("agg08_log_score", f"with {X.FORECAST} select grp, count(*) n, {R('avg(case when y = 1 then -ln(c) else -ln(1 - c) end)')} log_score, count(*) filter (c <> p) n_clipped from (select *, least(greatest(p, 1e-6::double), 1 - 1e-6::double) c from fc) group by grp")
def agg08(spark, d):
    return rounded(scoring.log_score(X.forecast(spark, d), group=["grp"]))


@query("agg09_output_histogram", f"""with {X.FORECAST}, v as (select grp, round(p, 2) v, count(*) c from fc group by all), t as (select *, sum(c) over (partition by grp)::double total, row_number() over (partition by grp order by c desc, v) r, least(floor(v * 10)::int, 9) k, v p from v),
b as (select grp, -sum(c / total * log2(c / total)) e from (select grp, bin, sum(c)::double c, max(total) total from (select *, {BIN.format(n=10)} bin from t) group by all) group by grp)
select grp, max(total)::bigint n, count(*) distinct_values, {R('-sum(c / total * log2(c / total))')} value_entropy, {R('coalesce(sum(c) filter (abs(v - 0.5) <= 0.05 + 5e-9), 0) / max(total)')} center_mass, min(v) least, max(v) most, {R('sum(v * c) / max(total)')} mean,
string_agg(format('{{:.2f}}:{{}}', v, c), ' ' order by r) filter (r <= 5) top, {R('max(b.e)')} bin_entropy from t join b using (grp) group by grp""")
def agg09(spark, d):
    return rounded(scoring.output_histogram(X.forecast(spark, d), group=["grp"]))


@query("agg11_soft_target_score", f"with {X.FORECAST} select grp, count(*) n, {R('avg((p - p2) * (p - p2))')} mse, {R('avg(abs(p - p2))')} mae, {R('avg(p - p2)')} mean_signed from fc group by grp")
def agg11(spark, d):
    return rounded(scoring.soft_target_score(X.forecast(spark, d), "p", "p2", ["grp"]))


PAV = """g as (select grp, p, sum(y)::double sy, count(*)::double n from fc group by all), c as (select *, sum(sy) over (partition by grp order by p) cs, sum(n) over (partition by grp order by p) cn from g),
r as (select b.grp, b.p, min((b.cs - a.cs + a.sy) / (b.cn - a.cn + a.n)) over (partition by b.grp, a.p order by b.p desc rows unbounded preceding) mn from c a join c b on a.grp = b.grp and b.p >= a.p),
iso as (select g.grp, g.p, any_value(g.sy) sy, any_value(g.n) n, max(mn) fit from r join g using (grp, p) group by all)"""


@query("agg12_corp", f"with {X.FORECAST}, {PAV}, s as (select grp, sum(n) n, sum(n * p * p - 2 * p * sy + sy) / sum(n) score, sum(n * fit * fit - 2 * fit * sy + sy) / sum(n) rec, sum(sy) / sum(n) * (1 - sum(sy) / sum(n)) unc from iso group by grp) select grp, n::bigint n, {R('score')} score, {R('score - rec')} mcb, {R('unc - rec')} dsc, {R('unc')} unc from s")
def agg12(spark, d):
    return rounded(isotonic.corp(scoring.pooled(X.forecast(spark, d), group=["grp"]), ["grp"]))


@query("agg13_isotonic_apply", f"with {X.FORECAST}, {PAV}, bl as (select grp, max(p) edge, fit from iso group by grp, fit), q as (select grp, p2, count(*) n from fc group by all) select q.grp, {R('q.p2')} price, q.n, {R('coalesce((select arg_min(fit, edge) from bl where bl.grp = q.grp and bl.edge >= q.p2), (select arg_max(fit, edge) from bl where bl.grp = q.grp))')} corrected from q")
def agg13(spark, d):
    fc = X.forecast(spark, d)
    maps = isotonic.as_map(isotonic.blocks(scoring.pooled(fc, group=["grp"]), ["grp"]), ["grp"])
    rows = fc.groupBy("grp", "p2").agg(F.count("*").alias("n")).join(F.broadcast(maps), "grp")
    return rounded(rows.select("grp", F.col("p2").alias("price"), "n", isotonic.apply_map(F.col("p2"), F.col("edges"), F.col("values")).alias("corrected")))


FOLD = "(('0x' || substr(sha256(cluster::varchar), 1, 8))::ubigint % 5)::int"


@query("agg16_fold_assignment", f"with {X.FORECAST} select {FOLD}::bigint fold, count(*) n, count(distinct cluster) questions from fc group by 1")
def agg16(spark, d):
    return rounded(X.forecast(spark, d).groupBy(isotonic.fold_sha(F.col("cluster"), 5).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("questions")))


@query("agg16_fold_exact")
def agg16_exact(spark, d):
    ids = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rounded(ids.groupBy(isotonic.fold_exact(F.col("id"), 5).alias("fold")).count())


@query("agg17_cross_fit", f"""with {X.FORECAST}, pts as (select {FOLD} fold, grp stratum, p, count(*) n, sum(y) sy from fc group by all), held as (select unnest(range(5))::int held),
src as (select held::varchar || '/' || coalesce(s, '*') grp, p, n, sy from pts, held, lateral (select null s union all select stratum) where fold <> held),
g as (select grp, p, sum(sy)::double sy, sum(n)::double n from src group by all), c as (select *, sum(sy) over (partition by grp order by p) cs, sum(n) over (partition by grp order by p) cn, sum(n) over (partition by grp) tot from g),
r as (select b.grp, b.p, min((b.cs - a.cs + a.sy) / (b.cn - a.cn + a.n)) over (partition by b.grp, a.p order by b.p desc rows unbounded preceding) mn from c a join c b on a.grp = b.grp and b.p >= a.p),
bl as (select grp, max(p) edge, fit from (select grp, p, max(mn) fit from r group by all) group by grp, fit), big as (select distinct grp from c where tot >= 9000),
w as (select *, case when fold::varchar || '/' || stratum in (select grp from big) then fold::varchar || '/' || stratum else fold::varchar || '/*' end m from pts)
select fold::bigint fold, stratum, {R('p')} p, n::bigint n, sy::bigint sy, {R('coalesce((select arg_min(fit, edge) from bl where bl.grp = w.m and bl.edge >= w.p), (select arg_max(fit, edge) from bl where bl.grp = w.m))')} fit from w""")
def agg17(spark, d):
    points = isotonic.fold_points(X.forecast(spark, d), "cluster", "p", "y", stratum="grp")
    return rounded(isotonic.cross_fit(points, minimum_stratum=9000))


@query("agg15_beta_calibration")
def agg15(spark, d):
    points = materialise(scoring.pooled(X.forecast(spark, d)), "beta-points")
    a, b, c = isotonic.fit_beta_rows(points)
    return points.orderBy("p").select("p", "n", F.round(isotonic.apply_beta(F.col("p"), a, b, c), 6).alias("corrected"))


@query("agg18_breakdown_min_group", f"with {X.FORECAST}, l as (select grp || '/' || l_linenumber::varchar label, p, case when l_suppkey % 10 <> 0 then y end y from fc), s as (select label, count(*) n, avg((p - y) * (p - y)) b, avg(y) r from l where y is not null group by 1) select label, n, {R('n / sum(n) over ()')} share, n >= 300 reported, case when n >= 300 then {R('b')} end brier, case when n >= 300 then {R('r')} end base_rate from s")
def agg18(spark, d):
    fc = X.forecast(spark, d).withColumn("y", F.when(F.col("l_suppkey") % 10 != 0, F.col("y")))
    return rounded(scoring.breakdown(fc, F.concat_ws("/", "grp", F.col("l_linenumber").cast("string")), minimum_group=300))


F0, D0 = datetime(2000, 1, 1), datetime(1999, 1, 1)
SPLIT = "case when {t} is null then 'open' when {t} > timestamp '2000-01-01' then 'published' when {t} >= timestamp '1999-01-01' then 'dev' else 'train' end"
LIFE = "(epoch_us(resolved_at) - epoch_us(as_of))"
BUCKET = "case when us < 30 * 86400000000 then '<30d' when us < 180 * 86400000000 then '30-180d' when us is not null then '180d+' end"


def with_split(fc: DataFrame) -> DataFrame:
    at = F.when(F.col("l_suppkey") % 10 != 0, F.col("resolved_at"))
    return fc.withColumn("at", at).withColumn("split", temporal.split(F.col("at"), F0, D0)).withColumn("lifetime_us", F.when(F.col("at") > F.col("as_of"), temporal.lifetime(F.col("at"), F.col("as_of"))))


CENSUS = f"ce as (select {SPLIT.format(t='end_at')} split, case when end_at > as_of then epoch_us(end_at) - epoch_us(as_of) end us, * from (select *, case when l_suppkey % 10 <> 0 then resolved_at end end_at from fc))"


@query("agg19_split_census", f"with {X.FORECAST}, {CENSUS} select s.split, count(c.p) n, count(c.p) filter (us is null) no_lifetime, count(c.p) filter ({BUCKET} = '<30d') bucket_0, count(c.p) filter ({BUCKET} = '30-180d') bucket_1, count(c.p) filter ({BUCKET} = '180d+') bucket_2 from (select unnest(['train', 'dev', 'published', 'open']) split) s left join ce c on c.split = s.split group by s.split")
def agg19(spark, d):
    return rounded(temporal.census(with_split(X.forecast(spark, d))))


CENSUS_LINE = "'| ' || concat_ws(' | ', split, n, bucket_0, bucket_1, bucket_2, no_lifetime) || ' |'"


@query("snk06_census_table", f"with {X.FORECAST}, {CENSUS}, c as (select line, split, count(p) n, count(p) filter (us is null) no_lifetime, count(p) filter ({BUCKET} = '<30d') bucket_0, count(p) filter ({BUCKET} = '30-180d') bucket_1, count(p) filter ({BUCKET} = '180d+') bucket_2 from (select unnest(['train', 'dev', 'published', 'open']) split, unnest([1, 2, 3, 4]) line) left join ce using (split) group by all) select line::bigint line, {CENSUS_LINE} \"text\" from c")
def snk06(spark, d):
    return temporal.census_table(with_split(X.forecast(spark, d)))


@query("date05_slice_state", f"with {X.FORECAST}, {CENSUS} select count(*) n, count(distinct split) splits, min(split) split, 0::bigint unresolved, count(*) filter (as_of >= resolved_at) late, count(*) filter (as_of is null) without_as_of from ce where split = 'published'")
def date05(spark, d):
    return rounded(temporal.slice_state(with_split(X.forecast(spark, d)).where("split = 'published'").withColumn("outcome", F.col("y"))))


@query("agg20_horizon_scores", f"with {X.FORECAST}, h as (select {BUCKET} bucket, p, y from (select *, {LIFE} us from fc) where us > 0) select coalesce(bucket, 'all') bucket, count(*) n, {R('avg((p - y) * (p - y))')} brier, {R('avg(y)')} base_rate from h group by grouping sets ((), (bucket))")
def agg20(spark, d):
    return rounded(temporal.horizon_scores(X.forecast(spark, d)))


@query("agg21_base_rate", f"with {X.FORECAST}, {CENSUS}, c2 as (select * replace (case when l_suppkey % 9 <> 0 then y end as y), grp || '/' || (l_partkey % 50)::varchar cls from ce), t as (select cls, count(*) n, sum(y) s from c2 where split = 'train' and y is not null group by 1), o as (select sum(s) / sum(n) overall from t) select c2.cls, c2.split, count(*) n, {R('max(case when t.n >= 30 then t.s / t.n else overall end)')} base_rate, bool_or(coalesce(t.n >= 30, false)) covered from c2 left join t using (cls), o where c2.split <> 'train' group by all")
def agg21(spark, d):
    rows = with_split(X.forecast(spark, d)).withColumn("cls", F.concat_ws("/", "grp", (F.col("l_partkey") % 50).cast("string"))).withColumn("y", F.when(F.col("l_suppkey") % 9 != 0, F.col("y")))
    model = temporal.BaseRates(rows.where("split = 'train'"), "cls", split_col=None)
    out = model.forecast(rows.where("split != 'train'"))
    return rounded(out.groupBy("cls", "split").agg(F.count("*").alias("n"), F.max("base_rate").alias("base_rate"), F.bool_or("covered").alias("covered")))


@query("agg22_constant_baseline", f"with {X.FORECAST} select grp, count(*) n, {R('avg((0.5 - y) * (0.5 - y))')} brier from fc group by grp")
def agg22(spark, d):
    return rounded(X.forecast(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.lit(0.5) - F.col("y")) * (F.lit(0.5) - F.col("y"))).alias("brier")))


@query("agg22_uniform_baseline")
def agg22_uniform(spark, d):
    u = X.forecast(spark, d).withColumn("u", F.rand(20260822))
    return u.agg(F.round(F.avg((F.col("u") - F.col("y")) * (F.col("u") - F.col("y"))), 3).alias("brier"))


POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


@query("agg23_bootstrap_hash", f"""with {X.FORECAST}, cl as (select cluster, sum((p - y) * (p - y)) s, count(*) n from fc group by 1), b as (select unnest(range(1, 101)) b),
dr as (select b, s, n, {' + '.join(f'(u >= {c!r}::double)::int' for c in POISSON)} k from (select b, s, n, ('0x' || substr(sha256('boot:' || b::varchar || ':' || cluster::varchar), 1, 8))::ubigint / 4294967296.0::double u from cl, b)),
me as (select b, sum(k * s) / sum(k * n) mean from dr where k > 0 group by b)
select {R('quantile_cont(mean, 0.025)')} lower, {R('quantile_cont(mean, 0.975)')} upper, count(*) n_resamples, {R('(select sum(s) / sum(n) from cl)')} point, (select count(*) from cl) n_clusters, (select sum(n)::bigint from cl) n_observations from me""")
def agg23(spark, d):
    fc = X.forecast(spark, d)
    return rounded(resample.hash_bootstrap(fc.withColumn("e", (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), "e", "cluster", resamples=100))


@query("agg24_paired_bootstrap")
def agg24(spark, d):
    fc = X.forecast(spark, d)
    diff = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")) - (F.col("p2") - F.col("y")) * (F.col("p2") - F.col("y"))
    return rounded(resample.hash_bootstrap(fc.withColumn("e", diff), "e", "cluster", draws="xxhash"))


@query("agg24_vector_bootstrap")
def agg24_vector(spark, d):
    fc = X.forecast(spark, d)
    diff = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")) - (F.col("p2") - F.col("y")) * (F.col("p2") - F.col("y"))
    return rounded(resample.vector_bootstrap(fc.withColumn("e", diff), "e", "cluster"))


DELTA = "((p - y) * (p - y) - (p2 - y) * (p2 - y))"


@query("agg25_paired_delta", f"with {X.FORECAST} select grp, count(*) n, {R(f'avg({DELTA})')} mean, {R(f'avg({DELTA}) - 1.96 * sqrt(var_samp({DELTA}) / count(*))')} lower, {R(f'avg({DELTA}) + 1.96 * sqrt(var_samp({DELTA}) / count(*))')} upper from fc group by grp")
def agg25(spark, d):
    return rounded(resample.paired_delta(X.forecast(spark, d), "p", "p2", group=("grp",)))


def _gate(k: str, c: str) -> str:
    return f"count(*) filter ({c}) n_{k}, avg(d) filter ({c}) m_{k}, 1.96 * sqrt(var_samp(d) filter ({c}) / count(*) filter ({c})) h_{k}"


@query("agg26_event_gate", f"with {X.FORECAST}, g as (select {_gate('all', 'true')}, {_gate('event', 'm = 0')}, {_gate('threshold', 'm = 1')} from (select {DELTA} d, l_linenumber % 3 m from fc)) select " + ", ".join(f"n_{k}, {R(f'm_{k}')} mean_{k}, {R(f'm_{k} - h_{k}')} lower_{k}, {R(f'm_{k} + h_{k}')} upper_{k}" for k in ("all", "event", "threshold")) + ", case when n_event < 100 then 'underpowered' when m_event - h_event > 0 then 'event_slice_degraded' when m_all + h_all < 0 and not m_event + h_event < 0 then 'trained_distribution_only' else 'pass' end verdict from g")
def agg26(spark, d):
    m = F.element_at(F.array(F.lit("event"), F.lit("threshold"), F.lit("ambiguous")), F.col("l_linenumber") % 3 + 1)
    return rounded(resample.event_gate(X.forecast(spark, d).withColumn("m", m), "p", "p2", "m", minimum_event_questions=100))


@query("agg29_run_report", f"with {X.RESPONSES}, st as (select *, case when transport_error is not null then 'transport' else coalesce(failure, 'scored') end status from pf) select count(*) attempted, count(*) filter (status = 'scored') scored, {R('count(*) filter (status = ' + chr(39) + 'scored' + chr(39) + ') / count(*)')} coverage, {R('count(*) filter (status = ' + chr(39) + 'scored' + chr(39) + ') / count(*) filter (status <> ' + chr(39) + 'transport' + chr(39) + ')')} compliance from st")
def agg29(spark, d):
    return rounded(runs.run_report(runs.parsed(X.responses(spark, d))))


@query("agg30_outcome_tally", f"with {X.RESPONSES} select case when transport_error is not null then 'transport' else 'content' end kind, coalesce(transport_error, failure, 'scored') label, count(*) n from pf group by all")
def agg30(spark, d):
    rows = runs.parsed(X.responses(spark, d))
    t = F.col("transport_error").isNotNull()
    return rounded(runs.tally(rows.withColumn("kind", F.when(t, "transport").otherwise("content")).withColumn("label", F.when(t, F.col("transport_error")).otherwise(F.col("status")))))


@query("agg28_compliance", f"with {X.RESPONSES} select {R('avg((failure is null)::int)')} compliance from pf where transport_error is null")
def agg28(spark, d):
    return rounded(runs.compliance_rate(runs.parsed(X.responses(spark, d).where("transport_error is null"))))


STRATA = {"urgent": "grp = '1-URGENT'", "low": "grp = '5-LOW'", "first_line": "l_linenumber = 1", "late": "resolved_at >= timestamp '1998-01-01'"}


@query("agg31_strata_report", f"with {X.FORECAST}, s as ({' union all '.join(f'select {chr(39)}{k}{chr(39)} grp, p, y from fc where {c}' for k, c in STRATA.items())}), {binned('s', 'grp')}, {MURPHY} select grp stratum, {MURPHY_OUT}, {R('1 - score / (base_rate * (1 - base_rate))')} skill from mu where n >= 2 and base_rate > 0 and base_rate < 1")
def agg31(spark, d):
    strata = {k: F.expr(c.replace("resolved_at >= timestamp '1998-01-01'", "resolved_at >= timestamp '1998-01-01 00:00:00'")) for k, c in STRATA.items()}
    return rounded(scoring.strata_report(X.forecast(spark, d), strata))


@query("agg32_model_card", f"with {X.FORECAST}, a as (select 'x' grp, p, y from fc), {binned('a', 'grp')}, {MURPHY} select n::bigint n, {R('score')} brier, {R('1 - score / (base_rate * (1 - base_rate))')} skill, (select count(distinct round(p, 2)) from fc) distinct_values, {R('(select stddev_pop(p) from fc)')} sd from mu")
def agg32(spark, d):
    fc = X.forecast(spark, d)
    b = scoring.brier(fc)
    spread = scoring.pooled(fc).agg(F.count_distinct(F.round("p", 2)).alias("distinct_values"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("p")).alias("s1"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("s2"))
    out = b.crossJoin(spread)
    sd = F.sqrt(F.col("s2") / F.col("t") - F.col("s1") / F.col("t") * F.col("s1") / F.col("t"))
    return rounded(out.select("n", F.col("score").alias("brier"), (1 - F.col("score") / F.col("uncertainty")).alias("skill"), "distinct_values", sd.alias("sd")))


@query("agg35_distinct", "select count(distinct l_orderkey) orders, count(distinct l_quantity) quantities, count(distinct l_returnflag) flags from lineitem")
def agg35(spark, d):
    li = X.table(spark, d, "lineitem")
    return li.agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_quantity").alias("quantities"), F.count_distinct("l_returnflag").alias("flags"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TOKENS = f"tk as (select doc_id, lang, list_filter(regexp_extract_all(lower(text), '([a-z0-9'']+)', 1), lambda x: not list_contains({STOP}, x)) w from documents)"


@query("str03_tokens", f"with {TOKENS} select doc_id, len(w)::bigint n, len(list_distinct(w))::bigint distinct_tokens, sha256(array_to_string(w, ' ')) h from tk")
def str03(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_tokens"), F.sha2(F.array_join("w", " "), 256).alias("h"))


@query("agg34_nb_predict", f"""with {TOKENS}, tr as (select * from tk where doc_id % 5 <> 0), ct as (select lang label, t, count(*) c from (select lang, unnest(w) t from tr) group by all), vo as (select distinct t from ct), v as (select count(*) v from vo),
lab as (select label, ln(docs / sum(docs) over ()) prior, ln(1 / (coalesce(tot, 0) + v)) fl from (select lang label, count(*) docs from tr group by 1) left join (select label, sum(c)::double tot from ct group by 1) using (label), v),
te as (select doc_id, unnest(w) t from tk where doc_id % 5 = 0), kn as (select doc_id, count(*) n from te join vo using (t) group by 1), ga as (select doc_id, label, sum(ln(c + 1.0::double)) gain from te join ct using (t) group by all),
sc as (select d.doc_id, label, prior + coalesce(n, 0) * fl + coalesce(gain, 0) score from (select doc_id from tk where doc_id % 5 = 0) d cross join lab left join kn using (doc_id) left join ga using (doc_id, label)),
rk as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, label) r from sc)
select a.doc_id, a.label, round(a.score, 6) score, b.label runner_up from rk a left join rk b on a.doc_id = b.doc_id and b.r = 2 where a.r = 1""")
def agg34(spark, d):
    docs = X.table(spark, d, "documents")
    model = categories.NaiveBayes(docs.where("doc_id % 5 != 0"), "text", "lang")
    return rounded(model.predict(docs.where("doc_id % 5 = 0"), "doc_id"), 6)


@query("agg33_nb_fit", f"with {TOKENS}, ct as (select lang label, t, count(*) c from (select lang, unnest(w) t from tk) group by all) select label, count(*) tokens, sum(c)::bigint total, (select count(distinct t) from ct) vocabulary from ct group by label")
def agg33(spark, d):
    words = X.table(spark, d, "documents").select(F.col("lang").alias("label"), F.explode(T.tokenize(F.col("text"))).alias("token"))
    ct = words.groupBy("label", "token").agg(F.count("*").alias("c"))
    v = ct.agg(F.count_distinct("token").alias("vocabulary"))
    return ct.groupBy("label").agg(F.count("*").alias("tokens"), F.sum("c").alias("total")).crossJoin(v)


ENDS = "p2 <= 0 or p2 >= 1"


@query("agg27_extreme_share", f"with {X.FORECAST}, t as (select p2 target, l_linenumber % 2 = 0 soft from fc) select count(*) n, {R('avg((target <= 0 or target >= 1)::int)')} at_ends, {R('avg((target <= 0.05 or target >= 0.95)::int)')} near_ends, {R('avg((target <= 0 or target >= 1)::int) filter (soft)')} soft_at_ends, {R('avg((target <= 0.05 or target >= 0.95)::int) filter (soft)')} soft_near_ends from t")
def agg27(spark, d):
    return rounded(ingest.extreme_share(X.forecast(spark, d).select(F.col("p2").alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "soft").otherwise("terminal").alias("kind"))))
