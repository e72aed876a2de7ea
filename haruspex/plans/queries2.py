"""More registered queries: sources, ingest, leakage, joins, windows, samples, text, series and sets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.probability import banker_round, clamp_price, micros, toward_truth
from ..operators import asof, ingest, leakage, rules, sampling, series, temporal
from ..sources import files
from ..sources import fixtures as X
from ..storage import fresh_path
from .queries import R, query, rounded

# Ingest


@query("ing01_market_reasons", f"with {X.RAW} select reason, count(*) n from ing group by 1")
def ing01(spark, d):
    return rules.reason_counts(ingest.normalise_markets(X.raw_markets(spark, d), "venue")).select("reason", F.col("count").alias("n"))


@query("ing04_accounting", f"with {X.RAW} select count(*) raw, count(*) filter (reason is null) kept, count(reason) rejected from ing")
def ing04(spark, d):
    return rules.accounted(ingest.normalise_markets(X.raw_markets(spark, d), "venue"))


@query("top09_examples_per_reason", f"with {X.RAW} select reason, question_id, ingest_seq from ing where reason is not null qualify row_number() over (partition by reason order by ingest_seq) <= 3")
def top09(spark, d):
    return rules.examples(ingest.normalise_markets(X.raw_markets(spark, d), "venue"), "ingest_seq").select("reason", "question_id", "ingest_seq")


@query("ing03_questions", f"with {X.RAW} select question_id, created_ts * 1000 open_us, case when resolution <> 'MKT' then resolve_ts * 1000 end resolved_us, case when resolution <> 'MKT' then (resolution = 'YES')::bigint end outcome, case when resolution = 'MKT' then {R('resolution_prob')} end soft_target, category from ing where reason is null")
def ing03(spark, d):
    kept = ingest.normalise_markets(X.raw_markets(spark, d), "venue").where("reason is null")
    q = ingest.as_questions(kept)
    return rounded(q.select("question_id", micros(F.col("open_date")).alias("open_us"), micros(F.col("resolved_at")).alias("resolved_us"), "outcome", "soft_target", "category"))


@query("ing13_question_faults", f"with {X.RAW} select 0::bigint faulty, count(*) n from ing where reason is null")
def ing13(spark, d):
    q = ingest.as_questions(ingest.normalise_markets(X.raw_markets(spark, d), "venue").where("reason is null"))
    return q.select(ingest.question_faults().alias("f")).agg(F.count_if(F.size("f") > 0).alias("faulty"), F.count("*").alias("n"))


@query("ing02_epoch_ms", "select l_orderkey % 5 k, count(*) n, sum(epoch_us(l_shipdate) // 1000000)::bigint secs from lineitem where epoch_ms(l_shipdate) > 0 group by 1")
def ing02(spark, d):
    li = X.table(spark, d, "lineitem").withColumn("ms", F.unix_millis("l_shipdate"))
    ok = li.where(ingest.epoch_ms_ok(F.col("ms"))).withColumn("t", F.timestamp_millis("ms"))
    return ok.groupBy((F.col("l_orderkey") % 5).alias("k")).agg(F.count("*").alias("n"), F.sum(F.floor(F.unix_micros("t") / 1000000)).alias("secs"))


FREEZE_MS = 883_612_800_000  # 1998-01-01
CAND = f"""cand as (select (o_orderkey % 4000)::varchar id, case when o_orderkey % 9 = 0 then 'MKT' when o_orderkey % 2 = 0 then 'YES' else 'NO' end resolution, case when o_orderkey % 31 <> 0 then epoch_ms(o_orderdate) end created_ts,
  case when o_orderkey % 5 <> 0 then epoch_ms(o_orderdate) + (o_orderkey % 40 - 3) * 86400000 end close_ts, case when o_orderkey % 37 <> 0 then epoch_ms(o_orderdate) + 40 * 86400000::bigint end resolved_ms, o_orderkey seq from orders),
pub0 as (select *, case when resolution not in ('YES', 'NO') then 'unresolved_or_other' when created_ts is null then 'no_created_ts' when resolved_ms is null then 'unresolved_or_other' when resolved_ms <= {FREEZE_MS} then 'not_after_freeze' when close_ts is null then 'no_close_ts' when close_ts <= created_ts then 'close_before_open' end reason from cand),
pub as (select * from (select *, min(seq) filter (reason is null) over (partition by id) kept from pub0) where kept is null or seq <= kept)"""


def candidates(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.lit(86_400_000).cast("long")
    ms = F.unix_millis("o_orderdate")
    return X.table(spark, d, "orders").select(
        (k % 4000).cast("string").alias("id"), F.concat(F.lit("t "), k.cast("string")).alias("title"), F.when(k % 9 == 0, "MKT").when(k % 2 == 0, "YES").otherwise("NO").alias("resolution"), F.when(k % 31 != 0, ms).alias("created_ts"),
        F.when(k % 5 != 0, ms + (k % 40 - 3) * day).alias("close_ts"), F.when(k % 37 != 0, ms + 40 * day).alias("resolved_ms"), k.alias("seq"),
    )


@query("ing05_published_set", f"with {CAND} select reason, count(*) n, min(seq) first_seq from pub group by 1")
def ing05(spark, d):
    return ingest.published_set(candidates(spark, d), freeze_ms=FREEZE_MS, require_close=True).groupBy("reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


SWEEP_CATS = ("Politics", "Sports", "Economics", "Crypto", "World")
SWEEP = """sw as (select l_orderkey::varchar || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey ticker, 'S' || (l_partkey % 8) || '-' || l_orderkey event_ticker, case when l_suppkey % 11 <> 0 then 'finalized' else 'active' end status,
  case when l_partkey % 13 = 0 then 'M' when l_partkey % 13 = 1 then '' end mve, case when l_linenumber = 5 then 'Will it be above $' || l_partkey || '?' when l_linenumber = 6 then 'How many in ' || l_partkey || ' days?' else 'Will it rain?' end title,
  case when l_returnflag = 'R' then 'yes' when l_returnflag = 'A' then 'no' else '' end result, o_orderdate opened, l_shipdate settled,
  case l_partkey % 8 when 0 then 'Politics' when 1 then 'Sports' when 2 then 'Economics' when 3 then 'Crypto' when 4 then 'World' end category from lineitem join orders on l_orderkey = o_orderkey),
swr as (select *, case when status <> 'finalized' then 'not_finalized' when mve <> '' then 'mve' when category is null then 'unknown_series' when category in ('Sports', 'Crypto') then 'mechanical_category'
  when title <> 'Will it rain?' and (title like '%above $%' or title like 'How many%') then 'numeric_title' when result not in ('yes', 'no') then 'no_result' when settled < timestamp '1996-01-01' or settled >= timestamp '1998-01-01' then 'outside_window'
  when floor((epoch_us(settled) - epoch_us(opened)) / 86400000000) < 7 then 'short_lifetime' end reason from sw)"""


def sweep(spark, d: str) -> DataFrame:
    fc = X.forecast(spark, d)
    cats = spark.createDataFrame([(f"S{i}", c) for i, c in enumerate(SWEEP_CATS)], "series string, category string")
    li = X.table(spark, d, "lineitem").join(X.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = lambda c: F.col(c).cast("string")
    rows = li.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("ticker"), F.concat(F.lit("S"), (F.col("l_partkey") % 8).cast("string"), F.lit("-"), s("l_orderkey")).alias("event_ticker"), F.when(F.col("l_suppkey") % 11 != 0, "finalized").otherwise("active").alias("status"),
        F.when(F.col("l_partkey") % 13 == 0, "M").when(F.col("l_partkey") % 13 == 1, "").alias("mve_collection_ticker"), F.when(F.col("l_linenumber") == 5, F.concat(F.lit("Will it be above $"), s("l_partkey"), F.lit("?"))).when(F.col("l_linenumber") == 6, F.concat(F.lit("How many in "), s("l_partkey"), F.lit(" days?"))).otherwise("Will it rain?").alias("title"),
        F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "no").otherwise("").alias("result"), F.col("o_orderdate").alias("opened"), F.col("l_shipdate").alias("settled"),
    )
    rows = rows.withColumn("series", ingest.series_of(F.col("event_ticker"))).join(F.broadcast(cats), "series", "left")
    at = lambda t: F.lit(t).cast("timestamp")
    return rows.withColumn("reason", ingest.transfer_reason(lo=at("1996-01-01"), hi=at("1998-01-01"), min_days=7))


@query("ing06_transfer_reasons", f"with {SWEEP} select reason, count(*) n from swr group by 1")
def ing06(spark, d):
    return sweep(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("top01_one_per_event", f"with {SWEEP} select event_ticker, min(ticker) ticker, min(life) life from (select *, epoch_us(settled) - epoch_us(opened) life from swr where reason is null qualify row_number() over (partition by event_ticker order by epoch_us(settled) - epoch_us(opened) desc, ticker) = 1) group by 1")
def top01(spark, d):
    rows = sweep(spark, d).where("reason is null").withColumn("life", temporal.lifetime(F.col("settled"), F.col("opened")))
    return ingest.one_per_event(rows, "event_ticker", [F.desc("life"), "ticker"]).select("event_ticker", "ticker", "life")


@query("ing08_rebuilt_prompts", """with t as (select doc_id, text || case doc_id % 4 when 0 then '? ' when 1 then '?' || chr(9) when 2 then ' ??' || chr(10) else '' end title, case when doc_id % 3 = 0 then upper(lang) else 'Sub ' || doc_id end sub from documents)
select doc_id, case when contains(lower(title), lower(sub)) then title else regexp_replace(regexp_replace(regexp_replace(title, '\\s+$', ''), '\\?+$', ''), '\\s+$', '') || ' — resolves YES if: ' || sub end prompt from t""")
def ing08(spark, d):
    i = F.col("doc_id")
    t = X.table(spark, d, "documents").select("doc_id", F.concat("text", F.when(i % 4 == 0, "? ").when(i % 4 == 1, "?\t").when(i % 4 == 2, " ??\n").otherwise("")).alias("t"), F.when(i % 3 == 0, F.upper("lang")).otherwise(F.concat(F.lit("Sub "), i.cast("string"))).alias("s"))
    return t.select("doc_id", ingest.rebuilt_prompt(F.col("t"), F.col("s")).alias("prompt"))


@query("ing09_rebuild_join", "select case when c_custkey is null then 'not_found' when c_acctbal < 0 then 'no_title' when c_mktsegment = 'BUILDING' then 'no_subtitle' end reason, count(*) n from orders left join (select * from customer where c_custkey % 17 <> 0) on o_custkey = c_custkey group by 1")
def ing09(spark, d):
    o, c = X.table(spark, d, "orders"), X.table(spark, d, "customer").where("c_custkey % 17 != 0")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left")
    return rows.select(rules.first_reason([("not_found", F.col("c_custkey").isNull()), ("no_title", F.col("c_acctbal") < 0), ("no_subtitle", F.col("c_mktsegment") == "BUILDING")]).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("ing10_set_comparison", "with a as (select o_orderkey k, o_orderstatus s, o_totalprice v from orders where o_orderkey % 10 <> 3), b as (select o_orderkey k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end s, case when o_orderkey % 100 = 1 then null else o_totalprice end v from orders where o_orderkey % 10 <> 5) select count(*) filter (a.k is null) missing, count(*) filter (b.k is null) extra, count(*) filter (a.k is not null and b.k is not null) shared, count(*) filter (a.k is not null and b.k is not null and a.s is distinct from b.s) differs_s, count(*) filter (a.k is not null and b.k is not null and a.v is distinct from b.v) differs_v from a full join b on a.k = b.k")
def ing10(spark, d):
    o = X.table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.where(k % 10 != 3).select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    b = o.where(k % 10 != 5).select(k.alias("k"), F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 100 != 1, F.col("o_totalprice")).alias("v"))
    return ingest.compare_sets(a, b, "k", ["s", "v"])


@query("ing14_clamped_prices", f"select event_type, count(*) n, {R('sum(least(greatest(value / 1000.0::double + case when event_id % 2 = 0 then 1e-12::double else 0 end, 0), 1))')} total from events group by 1")
def ing14(spark, d):
    v = F.col("value") / 1000.0 + F.when(F.col("event_id") % 2 == 0, F.lit(1e-12)).otherwise(F.lit(0.0))
    return rounded(X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(clamp_price(v)).alias("total")))


@query("ing15_invariants", "select v, count(*) n from (select unnest(list_filter([case when l_quantity is not null and not l_quantity <= 45 then 'l_quantity' end, case when not l_discount <= 0.09 then 'l_discount' end], lambda x: x is not null)) v from lineitem) group by 1")
def ing15(spark, d):
    reg = rules.Invariants().declare("l_quantity", F.col("l_quantity") <= 45, "order limit").declare("l_discount", F.col("l_discount") <= 0.09, "price list")
    reg.require(["l_quantity"])
    li = X.table(spark, d, "lineitem")
    return li.select(F.explode(reg.violations(li)).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


SLUGS = "case doc_id % 11 when 0 then ['fun', source] when 1 then ['personal', 'fun'] when 2 then ['manifold-0123456789ab'] when 3 then ['manifoldlove-x1'] when 4 then null when 5 then ['nonpredictive-profit'] else [lang, source] end"


def slugs(spark, d: str) -> DataFrame:
    i = F.col("doc_id") % 11
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    s = F.when(i == 0, a("fun", F.col("source"))).when(i == 1, a("personal", "fun")).when(i == 2, a("manifold-0123456789ab")).when(i == 3, a("manifoldlove-x1")).when(i == 4, None).when(i == 5, a("nonpredictive-profit")).otherwise(a(F.col("lang"), F.col("source")))
    return X.table(spark, d, "documents").select("doc_id", s.alias("slugs"))


@query("ing16_slug_confidence", f"with s as (select doc_id, {SLUGS} s from documents) select case when len(list_filter(s, lambda x: regexp_matches(x, '{ingest.CERTAIN}'))) > 0 then 'certain' when len(list_filter(s, lambda x: regexp_matches(x, '{ingest.COMMUNITY}'))) > 0 then 'possible' else 'none' end confidence, count(*) n from s group by 1")
def ing16(spark, d):
    return slugs(spark, d).groupBy(ingest.slug_confidence(F.col("slugs")).alias("confidence")).agg(F.count("*").alias("n"))


@query("ing17_drop_policy", "with f as (select case doc_id % 4 when 0 then 'certain' when 1 then 'possible' when 2 then 'none' end flag from documents) select 'nothing' policy, count(*) kept from f union all select 'certain', count(*) from f where flag is null or flag <> 'certain' union all select 'certain_and_possible', count(*) from f where flag is null or flag = 'none'")
def ing17(spark, d):
    i = F.col("doc_id") % 4
    f = X.table(spark, d, "documents").select(F.when(i == 0, "certain").when(i == 1, "possible").when(i == 2, "none").alias("nonpredictive"))
    out = None
    for policy in ("nothing", "certain", "certain_and_possible"):
        one = ingest.drop_nonpredictive(f, policy=policy).agg(F.count("*").alias("kept")).select(F.lit(policy).alias("policy"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query("ing18_corpus_reasons", "select case when target is null then 'no_target' when target < 0 or target > 1 then 'out_of_range' when target <= 0 or target >= 1 then 'extreme' when trim(coalesce(reasoning, '')) = '' then 'no_reasoning' end reason, count(*) n from (select case when event_id % 19 <> 0 then round(value) / 200.0::double end target, case when event_id % 7 = 0 then ' ' when event_id % 7 <> 1 then 'r' end reasoning from events) group by 1")
def ing18(spark, d):
    i = F.col("event_id")
    rows = X.table(spark, d, "events").select(F.when(i % 19 != 0, F.round("value") / 200.0).alias("target"), F.when(i % 7 == 0, " ").when(i % 7 != 1, "r").alias("reasoning"))
    return rows.groupBy(ingest.corpus_reason(allow_extreme=False, require_reasoning=True).alias("reason")).agg(F.count("*").alias("n"))


PROMPT_SQL = "'" + ingest.PROMPT.replace("{question}", "' || 'order ' || o_orderkey || '").replace("{criteria}", f"' || coalesce(nullif(case when o_orderkey % 3 = 0 then '' else o_orderpriority end, ''), '{ingest.ABSENT['criteria']}') || '").replace("{scheduled}", "' || case when o_orderkey % 5 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end || '").replace("{as_of}", "unknown") + "'"


@query("ing19_prompts", f"select o_orderkey, sha256({PROMPT_SQL}) h from orders")
def ing19(spark, d):
    k = F.col("o_orderkey")
    p = ingest.prompt(F.concat(F.lit("order "), k.cast("string")), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), F.lit(None).cast("string"))
    return X.table(spark, d, "orders").select("o_orderkey", F.sha2(p, 256).alias("h"))


@query("ing07_numeric_titles", f"select doc_id, regexp_matches(t, '{ingest.NUMERIC_TITLE}') numeric from (select doc_id, case doc_id % 6 when 0 then 'Will X be above $' || doc_id when 1 then 'Rates up 5 percent?' when 2 then 'How many of them?' when 3 then 'Will it be between us?' when 4 then 'under 1,000.5' else text end t from documents)")
def ing07(spark, d):
    i = F.col("doc_id")
    t = F.when(i % 6 == 0, F.concat(F.lit("Will X be above $"), i.cast("string"))).when(i % 6 == 1, "Rates up 5 percent?").when(i % 6 == 2, "How many of them?").when(i % 6 == 3, "Will it be between us?").when(i % 6 == 4, "under 1,000.5").otherwise(F.col("text"))
    return X.table(spark, d, "documents").select("doc_id", t.rlike(ingest.NUMERIC_TITLE).alias("numeric"))


@query("ing11_iso_instants", "select k, count(*) n, count(t) good from (select o_orderkey % 3 k, case when o_orderkey % 3 = 0 then o_orderdate when o_orderkey % 3 = 1 then o_orderdate end t from orders) group by 1")
def ing11(spark, d):
    k = F.col("o_orderkey") % 3
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    s = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+00:00"))).otherwise("junk")
    return X.table(spark, d, "orders").select(k.alias("k"), F.try_to_timestamp(s).alias("t")).groupBy("k").agg(F.count("*").alias("n"), F.count("t").alias("good"))


@query("ing12_question_ids", f"select count(*) n, count(*) filter (regexp_matches(q, '{ingest.QUESTION_ID}')) valid from (select case when o_orderkey % 4 = 0 then 'Venue:' else 'venue:' end || o_orderkey || case when o_orderkey % 6 = 0 then ' x' else '' end q from orders)")
def ing12(spark, d):
    k = F.col("o_orderkey")
    q = F.concat(F.when(k % 4 == 0, "Venue:").otherwise("venue:"), k.cast("string"), F.when(k % 6 == 0, " x").otherwise(""))
    return X.table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(q.rlike(ingest.QUESTION_ID)).alias("valid"))


# Leakage


def screened(spark, d: str) -> DataFrame:
    return leakage.screen(X.evidence(spark, d), leakage.registry(spark, X.TIERS))


SCAN = "trim(regexp_replace(replace(replace(lower({x}), 'ß', 'ss'), 'ſ', 's'), '[^\\p{{L}}\\p{{N}}.%]+', ' ', 'g'))"
STATED = f"contains(d.text, f) or ({SCAN.format(x='f')} <> '' and contains({SCAN.format(x='d.text')}, {SCAN.format(x='f')}))"


@query("leak09_screen", f"""with {X.EVIDENCE}, st as (select doc_id, f, regexp_matches(f, '\\S') and ({STATED}) stated from (select *, case doc_id % 7 when 0 then substr(text, 1, 12) when 1 then upper(substr(text, 1, 12)) else 'no such outcome' end f from documents) d),
e2 as (select ev.*, f, stated, case when stated then list_append(reasons, 'outcome_string_match') else reasons end r from ev join st using (doc_id))
select doc_id, tier::bigint tier, array_to_string(r, ',') reasons, len(r) = 0 admissible, case when len(r) = 0 and provenance = 'unknown' and tier = 1 then 'tier1_unknown_provenance' end exemption, case when stated then f else '' end matched, stated::int::double max_similarity from e2""")
def leak09(spark, d):
    i, start = F.col("doc_id"), F.substring("text", 1, 12)
    stated = X.table(spark, d, "documents").select("doc_id", F.col("text").alias("snippet"), F.array(F.when(i % 7 == 0, start).when(i % 7 == 1, T.capitals(start)).otherwise("no such outcome")).alias("forms"))
    s = leakage.screen(X.evidence(spark, d).join(stated, "doc_id"), leakage.registry(spark, X.TIERS), forms="forms")
    return s.select("doc_id", F.col("tier").cast("bigint").alias("tier"), F.array_join("reasons", ",").alias("reasons"), "admissible", "exemption", F.array_join("matched_forms", ",").alias("matched"), F.when(F.col("snippet").isNotNull(), F.col("max_similarity")).alias("max_similarity"))


@query("leak10_reason_counts", f"with {X.EVIDENCE} select reason, count(*) n from (select unnest(case when len(reasons) = 0 then [null] else reasons end) reason from ev) group by 1")
def leak10(spark, d):
    return leakage.reason_stats(screened(spark, d)).select("reason", F.col("count").alias("n"))


@query("leak10_tier_counts", f"with {X.EVIDENCE} select tier::bigint tier, count(*) n, count(*) filter (len(reasons) = 0) kept, count(*) filter (len(reasons) = 0 and provenance = 'unknown' and tier = 1) exempted from ev group by 1")
def leak10_tiers(spark, d):
    return rounded(leakage.tier_stats(screened(spark, d)))


@query("leak11_merged_stats", f"with {X.EVIDENCE}, s as (select reason, count(*) c from (select unnest(case when len(reasons) = 0 then ['none'] else reasons end) reason from ev) group by reason) select reason, sum(c)::bigint \"count\", (select sum(c)::bigint from s) total from s group by 1")
def leak11(spark, d):
    s = screened(spark, d).select((F.col("doc_id") % 7).alias("b"), F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("none"))).otherwise(F.col("reasons"))).alias("reason"))
    parts = s.groupBy("b", "reason").count().withColumn("version", F.lit(leakage.VERSION))
    return leakage.merge_stats(parts)


@query("leak11_exemption_share", f"with {X.EVIDENCE} select {R('count(*) filter (provenance = ' + chr(39) + 'unknown' + chr(39) + ') / count(*)')} share, count(*) filter (provenance = 'unknown') / count(*) > 0.2 attention from ev where len(reasons) = 0 and tier = 1")
def leak11_share(spark, d):
    return rounded(leakage.exemption_share(screened(spark, d)))


@query("leak06_outcome_scan", f"select doc_id, item_id, case when contains(d.text, b.text) then 'exact' else 'normalized' end matched_as from documents d, benchmark b where trim(b.text) <> '' and (contains(d.text, b.text) or contains({SCAN.format(x='d.text')}, {SCAN.format(x='b.text')}))")
def leak06(spark, d):
    b = X.table(spark, d, "benchmark").select("item_id", F.col("text").alias("form"))
    docs = X.table(spark, d, "documents").select("doc_id", "text")
    return leakage.match_outcomes(docs, b, "text").select("doc_id", "item_id", "matched_as")


@query("leak07_scan_form", f"select doc_id, sha256({SCAN.format(x='text')}) h from documents")
def leak07(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2(leakage.scan_form(F.col("text")), 256).alias("h"))


@query("leak08_fuzzy_similarity")
def leak08(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", F.round(leakage.best_similarity(F.col("text"), F.lit("the outcome was yes")), 6).alias("similarity"))


@query("leak12_forecast_time", f"with {X.FORECAST} select case when as_of >= least(resolved_at, soft) then case when resolved_at <= soft then 'resolved_at' else 'soft_target_at' end end fault, count(*) n from (select *, as_of + to_days((l_linenumber * 10)::int) soft from fc) group by 1")
def leak12(spark, d):
    fc = X.forecast(spark, d).withColumn("soft_target_at", F.timestamp_micros(micros(F.col("as_of")) + F.col("l_linenumber") * F.lit(10 * temporal.DAY)))
    return fc.groupBy(leakage.forecast_time_fault(F.col("as_of")).alias("fault")).agg(F.count("*").alias("n"))


@query("leak13_probe_cases", f"with {X.PROBE} select label, case_id, {R('p_clean')} p_clean, {R('p_injected')} p_injected, outcome::bigint outcome, {R('delta')} delta from cs")
def leak13(spark, d):
    return rounded(leakage.probe_cases(X.probe(spark, d)))


@query("leak14_probe_report", f"with {X.PROBE} select label, count(*) n, {R('avg(delta)')} mean, {R('coalesce(stddev_samp(delta), 0)')} sd, {R('coalesce(stddev_samp(delta), 0) / sqrt(count(*))')} se, {R('quantile_cont(delta, 0.95)')} quantile from cs group by 1")
def leak14(spark, d):
    return rounded(leakage.probe_report(leakage.probe_cases(X.probe(spark, d))))


@query("leak17_null_gate", f"""with recursive {X.PROBE}, t as (select quantile_cont(delta, 0.95) threshold, count(*) n_null from cs where label = 'null'), a as (select count(*) n, max(threshold) threshold, max(n_null) n_null, count(*) filter (delta > threshold) exceed from cs, t where label = 'adversarial'),
b as (select 0 k, pow(0.95::double, n) term, pow(0.95::double, n) cdf from a union all select k + 1, term * (n - k) / (k + 1) * (0.05::double / 0.95::double), cdf + term * (n - k) / (k + 1) * (0.05::double / 0.95::double) from b, a where k < n)
select n, {R('threshold')} threshold, n_null, exceed, (select min(k) from b where cdf >= 0.95)::bigint allowed, exceed <= (select min(k) from b where cdf >= 0.95) passed, n_null >= 20 well_estimated from a""")
def leak17(spark, d):
    return rounded(leakage.null_gate(leakage.probe_cases(X.probe(spark, d))))


@query("leak18_confidence_curve", f"with {X.FORECAST}, t as (select grp, case when y = 1 then p else 1 - p end c from fc), b as (select unnest([0.7, 0.8, 0.9, 0.95, 0.99]::double[]) bar) select grp, bar, count(*) n, count(*) filter (c >= bar) at_or_above, {R('count(*) filter (c >= bar) / count(*)')} rate from t, b group by all")
def leak18(spark, d):
    return rounded(leakage.confidence_curve(X.forecast(spark, d), p="p", y="y", group=("grp",)))


@query("join02_tier_lookup", f"with {X.EVIDENCE} select lower(trim(source)) k, tier::bigint tier, count(*) n from ev group by all")
def join02(spark, d):
    e = X.evidence(spark, d).withColumn("source_key", leakage.source_key(F.col("source")))
    return e.join(F.broadcast(leakage.registry(spark, X.TIERS)), "source_key", "left").groupBy(F.col("source_key").alias("k"), F.col("tier").cast("bigint").alias("tier")).agg(F.count("*").alias("n"))


# As-of, windows and series

VALID = """dup as (select question_id, ts, price, min(price) over w <> max(price) over w many, row_number() over (partition by question_id, ts order by price) k from pr window w as (partition by question_id, ts)),
va as (select question_id, ts, price, case when many then 'ambiguous_at_timestamp' when price < 0 or price > 1 then 'out_of_range' when ts < timestamp '2024-01-02' then 'before_market_opened' when ts > timestamp '2024-01-29' then 'after_resolution'
  when ts >= timestamp '2024-01-28 23:00:00' then 'in_terminal_window' end reason from dup where many or k = 1),
us as (select question_id, epoch_us(ts) us, price from va where reason is null), wa as (select *, us + (epoch_us(timestamp '2024-01-29') - us) // 2 wanted from us),
su as (select w.question_id, w.us, w.price, t.us target_us, t.price target from wa w asof left join us t on w.question_id = t.question_id and w.wanted >= t.us),
sp as (select *, case when coalesce(target_us <= us, true) then 'no_later_observation' when target_us - us < 21600000000 then 'separation_too_small' end reason from su)"""


@query("ts01_price_reject_counts", f"with {X.PRICES}, {VALID} select reason, count(*) n from va group by 1")
def ts01(spark, d):
    return asof.validate_prices(X.prices(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query("ts02_supervision_points", f"with {X.PRICES}, {VALID} select question_id, us, target_us, {R('target')} target from sp where reason is null")
def ts02(spark, d):
    s = asof.supervision_points(asof.validate_prices(X.prices(spark, d))).where("reason is null")
    return rounded(s.select("question_id", "us", "target_us", "target"))


@query("join07_lag_rejects", f"with {X.PRICES}, {VALID} select reason, count(*) n from sp group by 1")
def join07(spark, d):
    return asof.supervision_points(asof.validate_prices(X.prices(spark, d))).groupBy("reason").agg(F.count("*").alias("n"))


for strict in (False, True):

    @query(f"join0{8 if strict else 6}_asof_{'strict' if strict else 'price'}", f"with p as (select user_id, event_id, date_trunc('hour', ts) ts from events where event_type = 'click'), s as (select user_id, ts, value from events where event_type <> 'click') select p.event_id, {R('s.value')} as \"value\" from p asof left join s on p.user_id = s.user_id and p.ts {'>' if strict else '>='} s.ts")
    def join06(spark, d, strict=strict):
        e = X.table(spark, d, "events")
        p = e.where("event_type = 'click'").select("user_id", "event_id", F.date_trunc("hour", "ts").alias("at"))
        return rounded(asof.as_of(p, e.where("event_type != 'click'").select("user_id", "ts", "value"), ["user_id"], "at", "ts", ["value"], strict).select("event_id", "value"))


@query("win01_out_of_order", "select user_id, count(*) filter (value < before) n from (select user_id, value, lag(value) over (partition by user_id order by event_id) before from events) group by 1")
def win01(spark, d):
    return asof.out_of_order(X.table(spark, d, "events"), "user_id", "event_id", "value")


@query("win02_log_returns", f"with {X.SERIES} select series_id, us, {R('ln(v / b)')} ret from (select series_id, us, value v, lag(value) over (partition by series_id order by us) b from se) where b > 0 and v > 0")
def win02(spark, d):
    return rounded(series.log_returns(X.series(spark, d)))


@query("win05_quantiles", f"select event_type, {R('quantile_cont(value, 0.05)')} q05, {R('quantile_cont(value, 0.5)')} q50, {R('quantile_cont(value, 0.95)')} q95 from events group by 1")
def win05(spark, d):
    return rounded(X.table(spark, d, "events").groupBy("event_type").agg(*[F.percentile("value", q).alias(n) for q, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))]))


@query("win06_duplicate_instants", f"with {X.PRICES} select many, count(*) instants, sum(c)::bigint n from (select question_id, ts, count(*) c, min(price) <> max(price) many from pr group by all) group by 1")
def win06(spark, d):
    p = X.prices(spark, d).groupBy("question_id", "ts").agg(F.count("*").alias("c"), (F.min("price") != F.max("price")).alias("many"))
    return p.groupBy("many").agg(F.count("*").alias("instants"), F.sum("c").alias("n"))


@query("win07_binomial_upper", "with recursive p as (select unnest([5, 20, 60, 200]) n), b as (select n, 0 k, pow(0.9::double, n) term, pow(0.9::double, n) cdf from p union all select n, k + 1, term * (n - k) / (k + 1) * (0.1::double / 0.9::double), cdf + term * (n - k) / (k + 1) * (0.1::double / 0.9::double) from b where k < n) select n::bigint n, min(k)::bigint k from b where cdf >= 0.95 group by 1")
def win07(spark, d):
    p = spark.createDataFrame([(5,), (20,), (60,), (200,)], "n long")
    return p.select("n", leakage.binomial_upper(F.col("n"), 0.1).alias("k"))


@query("top08_trailing", f"with {X.SERIES} select series_id, us, {R('value')} as \"value\" from se qualify row_number() over (partition by series_id order by us desc) <= 7")
def top08(spark, d):
    return rounded(asof.trailing(X.series(spark, d), ["series_id"], "us", 7))


DAY = temporal.DAY
CTX = f"""ao as (select series_id, us as_of_us from se where (us // {DAY}) % 2 = 0), h as (select a.series_id, as_of_us, s.us, s.value, row_number() over w i, count(*) over (partition by a.series_id, as_of_us) n, lag(value) over w b from ao a join se s on s.series_id = a.series_id and s.us < as_of_us window w as (partition by a.series_id, as_of_us order by s.us)),
r0 as (select series_id, as_of_us, row_number() over (partition by series_id, as_of_us order by us) i, ln(value / b) r from h where b > 0 and value > 0), r as (select *, sum(r) over (partition by series_id, as_of_us order by i) cs from r0),
m as (select series_id, as_of_us, max(n) n, min(us) f, max(us) l, arg_max(value, us) last, round((max(us) - min(us)) / greatest(max(n) - 1, 1))::bigint span from h group by all), m2 as (select m.*, greatest(3 * {DAY} // nullif(span, 0), 1) steps, q.k from m left join (select series_id, as_of_us, count(*) k from r group by all) q using (series_id, as_of_us)),
dc as (select a.*, s.us dus, s.value realized from (select *, as_of_us + 3 * {DAY} want from m2) a asof left join se s on a.series_id = s.series_id and a.want >= s.us),
jd as (select *, case when n < 10 then 'short_history' when span <= 0 then 'no_span' when as_of_us - l > span then 'stale' when coalesce(dus < as_of_us, true) then 'no_decision' when want - dus > span then 'ends_early' when k < 5 then 'few_returns' when last <= 0 then 'not_positive' end reason from dc),
w as (select j.series_id, j.as_of_us, e.cs - coalesce(b.cs, 0) ret from jd j join r e on e.series_id = j.series_id and e.as_of_us = j.as_of_us and e.i >= least(j.steps, j.k) left join r b on b.series_id = j.series_id and b.as_of_us = j.as_of_us and b.i = e.i - least(j.steps, j.k) where reason is null),
rs as (select series_id, as_of_us, list_sort(list(ret)) rs from w group by all), ps as (select j.*, rs, t target, (1 - t) * (len(rs) - 1) pos from jd j join rs using (series_id, as_of_us), (select unnest([0.3, 0.5, 0.8]::double[]) t)),
th as (select *, last * exp(rs[floor(pos)::int + 1] + (pos - floor(pos)) * (rs[least(floor(pos)::int + 2, len(rs))] - rs[floor(pos)::int + 1])) threshold from ps)"""


def series_contexts(spark, d: str) -> DataFrame:
    s = X.series(spark, d)
    a = s.where(F.floor(F.col("us") / DAY) % 2 == 0).select("series_id", F.col("us").alias("as_of_us"))
    return series.contexts(s, a, 3 * DAY, min_history=10)


@query("ts03_series_contexts", f"with {X.SERIES}, {CTX.split(', th as')[0].rsplit(',' + chr(10) + 'w as', 1)[0]} select series_id, as_of_us, n, {R('last')} as \"last\", case when reason is null then dus end decision_us, reason from jd")
def ts03(spark, d):
    return rounded(series_contexts(spark, d).where("n > 0").select("series_id", "as_of_us", "n", "last", "decision_us", "reason"))


@query("ts04_series_questions", f"with {X.SERIES}, {CTX} select series_id, as_of_us, target, round(threshold, 6) threshold, dus decision_us, (realized > threshold)::bigint outcome from th")
def ts04(spark, d):
    q = series.questions(series_contexts(spark, d), [0.3, 0.5, 0.8])
    return rounded(q.select("series_id", "as_of_us", "target", "threshold", "decision_us", "outcome"), 6)


@query("ts05_look_ahead", "select 0::bigint n")
def ts05(spark, d):
    return series.looks_ahead(series.questions(series_contexts(spark, d), [0.5])).agg(F.count("*").alias("n"))


@query("ts06_series_evidence", f"with {X.SERIES} select count(*) n, count(*) filter (us < 1705708800000000) kept from (select * from se qualify row_number() over (partition by series_id order by us desc) <= 20)")
def ts06(spark, d):
    e = series.evidence_of(X.series(spark, d), "fred", "never_revised", 20).withColumn("as_of", F.timestamp_micros(F.lit(1705708800000000)))
    s = leakage.screen(e, leakage.registry(spark))
    return s.agg(F.count("*").alias("n"), F.count_if("admissible").alias("kept"))


# Joins, sets and order


@query("join01_eval_join", f"select c_mktsegment, count(*) n, {R('avg(o_totalprice)')} mean from orders join customer on o_custkey = c_custkey group by 1")
def join01(spark, d):
    o, c = X.table(spark, d, "orders"), X.table(spark, d, "customer")
    return rounded(o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")))


@query("join04_resume_anti", "select count(*) n, min(c_custkey) first from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0)")
def join04(spark, d):
    q = X.table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    done = X.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("question_id")).distinct()
    return files.remaining(q, done).agg(F.count("*").alias("n"), F.min("question_id").alias("first"))


@query("join05_semi_anti", "select o_custkey is not null has_orders, count(*) n from customer left join (select distinct o_custkey from orders where o_orderpriority = '1-URGENT') on c_custkey = o_custkey group by 1")
def join05(spark, d):
    c, o = X.table(spark, d, "customer"), X.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    semi, anti = (c.join(o, c.c_custkey == o.o_custkey, how).agg(F.count("*").alias("n")) for how in ("left_semi", "left_anti"))
    return semi.select(F.lit(True).alias("has_orders"), "n").unionByName(anti.select(F.lit(False).alias("has_orders"), "n"))


@query("set01_overlap", "select (select count(*) from (select c_custkey from customer intersect select o_custkey from orders)) shared, (select count(*) from (select c_custkey from customer except select o_custkey from orders)) only_customers")
def set01(spark, d):
    c, o = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), X.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).agg(F.count("*").alias("shared")).crossJoin(c.subtract(o).agg(F.count("*").alias("only_customers")))


@query("set02_concatenation", "select origin, count(*) n from (select 'a' origin from orders where o_orderstatus = 'F' union all select 'b' from orders where o_orderstatus <> 'F') group by 1")
def set02(spark, d):
    o = X.table(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select(F.lit("a").alias("origin")), o.where("o_orderstatus != 'F'").select(F.lit("b").alias("origin"))
    return a.unionByName(b).groupBy("origin").agg(F.count("*").alias("n"))


@query("set04_versions_seen", "select count(distinct p_brand) versions, count(distinct p_brand) = 1 single from part")
def set04(spark, d):
    return X.table(spark, d, "part").agg(F.count_distinct("p_brand").alias("versions"), (F.count_distinct("p_brand") == 1).alias("single"))


@query("top03_most_frequent", "select l_quantity, count(*) n from lineitem group by 1 order by n desc, l_quantity limit 5")
def top03(spark, d):
    return X.table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_quantity").limit(5)


@query("top02_ordered_output", "select o_orderkey, epoch_us(o_orderdate) us from orders order by o_orderdate, o_orderkey")
def top02(spark, d):
    return X.table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", micros(F.col("o_orderdate")).alias("us"))


# Samples


@query("top04_hash_prefix", "select o_orderkey from orders order by sha256('s:' || o_orderkey), o_orderkey limit 100")
def top04(spark, d):
    return sampling.hash_first(X.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, "s")


@query("top04_hash_prefix_exact")
def top04_exact(spark, d):
    return sampling.hash_first(X.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, "s", sampling.blake_order)


@query("top05_mixture", """with r as (select o_orderkey k, case when o_orderkey % 10 = 0 then 'certain' end flag from orders where o_orderstatus <> 'F'), p as (select k from r where flag is null), s as (select o_orderkey k from orders where o_orderstatus = 'F'), w as (select round_even((select count(*) from p) * 0.2::double / (1 - 0.2::double), 0)::bigint w)
select origin, count(*) n, sum(k)::bigint checksum from (select 'real' origin, k from p union all (select 'synthetic', k from (select k, row_number() over (order by sha256('mixture:' || k), k) i from s), w where i <= w)) group by 1""")
def top05(spark, d):
    o = X.table(spark, d, "orders").withColumn("nonpredictive", F.when(F.col("o_orderkey") % 10 == 0, "certain"))
    m = sampling.mixture(o.where("o_orderstatus != 'F'"), o.where("o_orderstatus = 'F'"), "o_orderkey", share=0.2, drop_policy="certain")
    return m.groupBy("origin").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("checksum"))


TRACE = "tr as (select event_id id, (event_id % 101) / 100.0::double p, (value > 50)::int y from events), tc as (select *, case when case when y = 1 then p > 0.45::double else not p > 0.45::double end then 'correct_side' when abs(p - 0.45::double) >= 0.25::double then 'confidently_wrong' else 'hedged_wrong' end c from tr)"


def traces(spark, d: str) -> DataFrame:
    return X.table(spark, d, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 101) / 100.0).alias("p"), (F.col("value") > 50).cast("int").alias("y"))


@query("top06_trace_select", f"with {TRACE}, w as (select *, row_number() over (order by sha256('trace:' || id), id) i, count(*) over () n from tc where c = 'confidently_wrong') select c \"class\", count(*) n, sum((k)::int)::bigint kept from (select id, c, c = 'correct_side' k from tc where c <> 'confidently_wrong' union all select id, c, i <= round_even(n * 0.3::double, 0) from w) group by 1")
def top06(spark, d):
    t = sampling.select_traces(traces(spark, d), "id", base_rate=0.45, margin=0.25, wrong_fraction=0.3)
    return t.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"))


@query("top07_training_targets", f"with {TRACE}, e as (select id, row_number() over (order by sha256('sft:' || id), id) i from tc where id % 3 <> 0), n as (select round_even(count(*) * 0.4::double, 0) w from tc) select kind, count(*) n, {R('sum(target)')} total from (select case when i <= w then 'soft' else 'terminal' end kind, case when i <= w then (id % 7) / 10.0::double else y end target from tc left join e using (id), n) group by 1")
def top07(spark, d):
    t = traces(spark, d)
    soft = t.where("id % 3 != 0").select("id", ((F.col("id") % 7) / 10.0).alias("target"), F.lit("crowd_derived").alias("provenance"))
    return rounded(sampling.training_targets(t, soft, "id", soft_fraction=0.4).groupBy("kind").agg(F.count("*").alias("n"), F.sum("target").alias("total")))


@query("math04_trace_class", f"with {TRACE} select c \"class\", count(*) n from tc group by 1")
def math04(spark, d):
    return traces(spark, d).groupBy(sampling.trace_class(F.col("p"), F.col("y"), 0.45, 0.25).alias("class")).agg(F.count("*").alias("n"))


# Text and digits


@query("str01_parse_forecast", f"with {X.RESPONSES} select id, case when failure is null then {R('body::double')} end probability, failure from pf")
def str01(spark, d):
    r = X.responses(spark, d).select("id", T.parse_forecast(F.col("response")).alias("p"))
    return rounded(r.select("id", "p.probability", "p.failure"))


@query("str02_render_forecast", "select event_id, '<reasoning>r</reasoning>' || chr(10) || '<probability>' || format('{:.2f}', least(greatest((event_id % 130 - 10) / 100.0::double, 0), 1)) || '</probability>' as text from events")
def str02(spark, d):
    p = (F.col("event_id") % 130 - 10) / 100.0
    return X.table(spark, d, "events").select("event_id", T.render_forecast(F.lit("r"), p).alias("text"))


@query("str04_digit_positions", f"with {X.RESPONSES}, m as (select id, response r, position('<probability>' in response) s from rs), a as (select *, position('.' in substr(r, s + 13, 4)) dot from m) select id, case when s > 0 and dot > 0 and regexp_matches(substr(r, s + 13 + dot, 1), '^[0-9]$') then s + 12 + dot end first_digit from a")
def str04(spark, d):
    return X.responses(spark, d).select("id", F.get(T.digit_positions(F.col("response")), F.lit(0)).alias("first_digit"))


@query("str07_question_text", "select event_id, 'Will ' || event_type || ' be above ' || floor(value)::bigint || ' on ' || strftime(ts, '%Y-%m-%d') || '?' as text from events")
def str07(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("Will "), "event_type", F.lit(" be above "), F.floor("value").cast("string"), F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"), F.lit("?")).alias("text"))


@query("str06_json_fields", "select event_type, count(*) n, sum((props->>'$.k')::bigint)::bigint k from events group by 1")
def str06(spark, d):
    return X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


@query("map02_digit_read", f"""with a as (select event_id id, event_id % 10 d1, (event_id * 7) % 10 d2, 0.2::double + (event_id % 7) / 10.0::double m from events),
b as (select *, m * 0.75::double w1, m * 0.25::double w2, (d1 + 3) % 10 d3 from a) select id, case when m >= 0.5 then {R('((0.0::double + w1 * d1 + w2 * d3) / (0.0::double + w1 + w2)) / 10 + d2 / 100.0::double')} end expectation, case when m >= 0.5 then {R('d1 / 10.0::double + d2 / 100.0::double')} end greedy, case when m < 0.5 then 'too_little_digit_mass' end failure from b""")
def map02(spark, d):
    i = F.col("event_id")
    m = F.lit(0.2) + (i % 7) / 10.0
    t = F.create_map((i % 10).cast("string"), m * 0.75, F.concat(F.lit(" "), ((i % 10 + 3) % 10).cast("string")), m * 0.25, F.lit("x"), 1 - m)
    h = F.create_map(((i * 7) % 10).cast("string"), F.lit(1.0))
    r = X.table(spark, d, "events").select(i.alias("id"), T.read_probability(t, h).alias("r"))
    return rounded(r.select("id", "r.expectation", "r.greedy", "r.failure"))


# Instants


@query("date01_split", "select case when l_shipdate > timestamp '1998-01-01' then 'published' when l_shipdate >= timestamp '1997-01-01' then 'dev' else 'train' end split, count(*) n from lineitem group by 1")
def date01(spark, d):
    from datetime import datetime

    return X.table(spark, d, "lineitem").groupBy(temporal.split(F.col("l_shipdate"), datetime(1998, 1, 1), datetime(1997, 1, 1)).alias("split")).agg(F.count("*").alias("n"))


@query("date03_horizon_buckets", f"with {X.FORECAST} select case when us < 30 * 86400000000 then '<30d' when us < 180 * 86400000000 then '30-180d' else '180d+' end bucket, count(*) n from (select epoch_us(resolved_at) - epoch_us(as_of) us from fc) where us > 0 group by 1")
def date03(spark, d):
    us = temporal.lifetime(F.col("resolved_at"), F.col("as_of"))
    return X.forecast(spark, d).where(us > 0).groupBy(temporal.bucket(us).alias("bucket")).agg(F.count("*").alias("n"))


@query("date04_floor_days", f"with {X.FORECAST} select floor((epoch_us(resolved_at) - epoch_us(as_of)) / 86400000000)::bigint \"days\", count(*) n from fc group by 1")
def date04(spark, d):
    return X.forecast(spark, d).groupBy(temporal.floor_days(temporal.lifetime(F.col("resolved_at"), F.col("as_of"))).alias("days")).agg(F.count("*").alias("n"))


@query("math02_squared_error", f"with {X.FORECAST} select l_linenumber::bigint l_linenumber, {R('sum((p - y) * (p - y))')} total, {R('sum(case when y = 1 then p else 1 - p end)')} truth from fc group by 1")
def math02(spark, d):
    return rounded(X.forecast(spark, d).groupBy("l_linenumber").agg(F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("total"), F.sum(toward_truth(F.col("p"), F.col("y"))).alias("truth")))


@query("math05_bankers_counts", "select k, round_even(k * 0.5::double, 0)::bigint half, round_even(k * 0.3::double, 0)::bigint three from (select unnest(range(1, 40)) k)")
def math05(spark, d):
    return spark.range(1, 40).select(F.col("id").alias("k"), banker_round(F.col("id") * 0.5).alias("half"), banker_round(F.col("id") * 0.3).alias("three"))


# Sources and sinks


@query("src01_run_file_round_trip", "select c_custkey::varchar question_id, (c_custkey % 100) / 100.0::double probability from customer where c_custkey % 3 <> 0")
def src01(spark, d):
    i = F.col("c_custkey")
    rows = X.table(spark, d, "customer").select(i.cast("string").alias("question_id"), F.lit(0).alias("quarter"), F.lit(1).alias("outcome"), F.when(i % 3 != 0, (i % 100) / 100.0).alias("expectation_probability"))
    path = fresh_path(spark, "run-file")
    files.write_run(rows, path)
    return files.forecasts(spark, path)


@query("src03_resume_set", "select count(*) n from customer")
def src03(spark, d):
    path = fresh_path(spark, "run-resume")
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("question_id"))
    files.write_run(rows, path)
    spark.createDataFrame([('{"question_id": "cut',)], "value string").write.mode("append").text(path)
    return files.done_ids(spark, path).agg(F.count("*").alias("n"))


@query("snk01_eval_payload", f"select count(*) n, {R('avg(c_custkey % 2)')} base_rate, sha256('[\"' || string_agg(q, '\", \"' order by q) || '\"]') content_hash from (select 'venue:' || c_custkey q, c_custkey from customer)")
def snk01(spark, d):
    o = X.table(spark, d, "customer").select(F.concat(F.lit("venue:"), F.col("c_custkey").cast("string")).alias("question_id"), (F.col("c_custkey") % 2).alias("outcome"))
    return rounded(files.eval_payload(o, {"duplicate_id": 0}, "published").select("n", "base_rate", "content_hash"))


@query("src02_eval_set_round_trip", "select count(*) n, sum(c_custkey % 2)::bigint outcomes from customer")
def src02(spark, d):
    o = X.table(spark, d, "customer").select(F.concat(F.lit("venue:"), F.col("c_custkey").cast("string")).alias("question_id"), (F.col("c_custkey") % 2).cast("int").alias("outcome"))
    path = fresh_path(spark, "eval-set")
    files.eval_payload(o, {}, "published").write.json(path)
    return files.eval_set(spark, path).agg(F.count("*").alias("n"), F.sum("outcome").alias("outcomes"))


@query("src09_series_lookup", "select split_part(p_brand || '-' || p_partkey, '-', 1) series, count(*) n from part group by 1")
def src09(spark, d):
    return X.table(spark, d, "part").groupBy(ingest.series_of(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("series")).agg(F.count("*").alias("n"))


@query("src04_csv_series", "select epoch_us(date_trunc('day', ts)) us, count(*)::double as \"value\" from events group by 1")
def src04(spark, d):
    path = fresh_path(spark, "series")
    e = X.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("v"))
    e.write.option("header", True).csv(path)
    return files.csv_series(spark, path, date_column="date", value_column="v").select(micros(F.col("ts")).alias("us"), "value")


@query("src06_gzip_sweep", "select status, count(*) n from (select case when l_suppkey % 11 <> 0 then 'finalized' else 'active' end status from lineitem) group by 1")
def src06(spark, d):
    li = X.table(spark, d, "lineitem")
    path = fresh_path(spark, "sweep")
    li.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("ticker"), F.when(F.col("l_suppkey") % 11 != 0, "finalized").otherwise("active").alias("status"))).alias("value")).write.option("compression", "gzip").text(path)
    return files.market_sweep(spark, path).groupBy("status").agg(F.count("*").alias("n"))


@query("src10_file_hashes")
def src10(spark, d):
    return files.file_hashes(spark, f"{d}/region.parquet").select("sha256")
