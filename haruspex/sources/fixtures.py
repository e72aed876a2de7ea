"""Logical inputs derived from the test tables, the same arithmetic as in the queries' SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table; instants without zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in df.dtypes])


def forecast(spark, sf_dir: str) -> DataFrame:
    """Forecasts p with outcome y, a second arm p2, group, cluster and both instants."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    return rows.select(
        (F.col("l_quantity") / 50.0).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (1 - F.col("l_discount") * 5.0).alias("p2"), F.col("o_orderpriority").alias("grp"), F.col("l_orderkey").alias("cluster"),
        F.col("o_orderdate").alias("as_of"), F.col("l_shipdate").alias("resolved_at"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
    )


FORECAST = """fc as (select l_quantity / 50.0::double p, (l_returnflag = 'R')::int y, 1 - l_discount * 5.0::double p2, o_orderpriority grp, l_orderkey cluster,
  o_orderdate as_of, l_shipdate resolved_at, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem join orders on l_orderkey = o_orderkey)"""

OPEN, RESOLVED = datetime(2024, 1, 2), datetime(2024, 1, 29)


def prices(spark, sf_dir: str, hourly: bool = True) -> DataFrame:
    """Prices of each user's market; instants cut to the hour collide, every 50th row comes twice."""
    e = table(spark, sf_dir, "events")
    ts = F.date_trunc("hour", "ts") if hourly else F.col("ts")
    one = e.select(F.col("event_id"), F.col("user_id").cast("string").alias("question_id"), ts.alias("ts"), (F.col("value") / 500.0).alias("price"))
    both = one.unionByName(one.where("event_id % 50 = 0")).drop("event_id")
    return both.withColumns({"open_date": F.lit(OPEN).cast("timestamp"), "resolved_at": F.lit(RESOLVED).cast("timestamp")})


PRICES = """pr as (select event_id, user_id::varchar question_id, date_trunc('hour', ts) ts, value / 500.0::double price from events
  union all select event_id, user_id::varchar, date_trunc('hour', ts), value / 500.0::double from events where event_id % 50 = 0)"""


def raw_markets(spark, sf_dir: str) -> DataFrame:
    """Orders as raw market rows; every 50th comes twice."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").alias("ship"))
    k = F.col("o_orderkey")
    ms = lambda c: F.unix_millis(c)
    rows = o.join(first, o.o_orderkey == first.k, "left").select(
        F.when(k % 97 == 0, "other").otherwise("venue").alias("platform"), k.cast("string").alias("platform_market_id"), F.when(k % 89 != 0, F.concat(F.lit("order "), k.cast("string"))).alias("title"), F.lit(None).cast("string").alias("description"),
        F.col("o_orderpriority").alias("category"), ms("o_orderdate").alias("created_ts"), (ms("o_orderdate") + F.lit(30 * 86_400_000)).alias("close_ts"), F.when(k % 83 == 0, F.lit(-5).cast("long")).otherwise(ms("ship")).alias("resolve_ts"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"), F.when(k % 53 == 0, "multiple_choice").otherwise("binary").alias("outcome_type"),
        F.when(F.col("o_orderstatus") == "P", "MKT").when(k % 7 == 0, "CANCEL").when(k % 7 == 1, "N/A").when(k % 7 < 4, "YES").otherwise("NO").alias("resolution"), F.when(k % 3 != 0, F.col("o_totalprice") / 500000.0).alias("resolution_prob"), k.alias("ingest_seq"),
    )
    return rows.unionByName(rows.where("ingest_seq % 50 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000))


RAW = """raw0 as (select case when o_orderkey % 97 = 0 then 'other' else 'venue' end platform, o_orderkey::varchar platform_market_id, case when o_orderkey % 89 <> 0 then 'order ' || o_orderkey end title,
  o_orderpriority category, epoch_ms(o_orderdate) created_ts, epoch_ms(o_orderdate) + 30::bigint * 86400000 close_ts, case when o_orderkey % 83 = 0 then -5 else epoch_ms(ship) end resolve_ts,
  case when o_orderstatus = 'O' then 'open' else 'resolved' end status, case when o_orderkey % 53 = 0 then 'multiple_choice' else 'binary' end outcome_type,
  case when o_orderstatus = 'P' then 'MKT' when o_orderkey % 7 = 0 then 'CANCEL' when o_orderkey % 7 = 1 then 'N/A' when o_orderkey % 7 < 4 then 'YES' else 'NO' end resolution,
  case when o_orderkey % 3 <> 0 then o_totalprice / 500000.0::double end resolution_prob, o_orderkey ingest_seq
  from orders left join (select l_orderkey k, min(l_shipdate) ship from lineitem group by 1) on o_orderkey = k),
raw as (select * from raw0 union all select * replace (ingest_seq + 1000000000 as ingest_seq) from raw0 where ingest_seq % 50 = 0),
judged as (select *, platform || ':' || platform_market_id question_id, case
  when platform <> 'venue' then 'wrong_platform' when outcome_type <> 'binary' then 'not_binary' when status <> 'resolved' then 'not_resolved' when resolution = 'CANCEL' then 'annulled'
  when resolution not in ('YES', 'NO', 'MKT') then 'unknown_resolution' when resolution = 'MKT' and resolution_prob is null then 'missing_soft_target' when coalesce(title, '') = '' then 'missing_field'
  when created_ts is null then 'missing_field' when created_ts <= 0 then 'bad_timestamp' when close_ts is null then 'missing_field' when close_ts <= 0 then 'bad_timestamp' when resolve_ts is null then 'missing_field' when resolve_ts <= 0 then 'bad_timestamp'
  when close_ts <= created_ts or case when resolution = 'MKT' then resolve_ts < created_ts else resolve_ts <= created_ts end or (resolution = 'MKT' and not (resolution_prob between 0 and 1)) then 'schema_rejected' end first_reason from raw),
ing as (select *, case when first_reason is null and row_number() over (partition by question_id, first_reason is null order by ingest_seq) > 1 then 'duplicate_id' else first_reason end reason from judged)"""

TIERS = {f"src{i}": 1 if i < 7 else 2 if i < 13 else 3 for i in range(17)}


def evidence(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    plus = lambda minutes: F.timestamp_micros(F.unix_micros(at) + minutes * F.lit(60_000_000))
    i, ts = F.col("doc_id"), plus(F.col("doc_id") * 60)
    return d.select(
        "doc_id", F.when(i % 29 == 0, "Wikipedia ").otherwise(F.col("source")).alias("source"), F.when(i % 17 != 0, ts).alias("timestamp"), F.element_at(F.array(*[F.lit(x) for x in ("publisher_verified", "publisher_claimed", "crawl", "inferred", "unknown")]), (i % 5 + 1).cast("int")).alias("provenance"),
        plus(i * 60 + F.col("n_chars")).alias("last_modified"), F.when(i % 13 == 0, plus(i * 60 - 5)).alias("retrieved_at"), F.when(i % 3 == 0, F.concat(F.lit("https://x/?oldid="), i.cast("string"))).alias("url"), F.lit(datetime(2024, 1, 20)).cast("timestamp").alias("as_of"),
    )


EVIDENCE = """ev0 as (select doc_id, case when doc_id % 29 = 0 then 'Wikipedia ' else source end source, case when doc_id % 17 <> 0 then timestamp '2024-01-01' + to_minutes(doc_id * 60) end ts,
  ['publisher_verified', 'publisher_claimed', 'crawl', 'inferred', 'unknown'][(doc_id % 5 + 1)::int] provenance, timestamp '2024-01-01' + to_minutes(doc_id * 60 + n_chars) last_modified,
  case when doc_id % 13 = 0 then timestamp '2024-01-01' + to_minutes(doc_id * 60 - 5) end retrieved_at, case when doc_id % 3 = 0 then 'https://x/?oldid=' || doc_id end url, timestamp '2024-01-20' as_of from documents),
ev1 as (select *, case when lower(trim(source)) = 'wikipedia' then 1 when try_cast(substr(source, 4) as int) < 7 then 1 when try_cast(substr(source, 4) as int) < 13 then 2 when try_cast(substr(source, 4) as int) < 17 then 3 end tier from ev0),
ev as (select *, list_filter([case when ts is null then 'missing_timestamp' end, case when ts >= as_of then 'timestamp_not_before_as_of' end, case when ts is not null and last_modified >= as_of then 'modified_at_or_after_as_of' end,
  case when ts > retrieved_at then 'timestamp_after_retrieval' end, case when provenance in ('crawl', 'inferred') or (provenance = 'unknown' and coalesce(tier, 3) <> 1) then 'ambiguous_provenance' end,
  case when tier is null then 'unknown_source' end, case when coalesce(tier, 3) > 2 then 'untrusted_source_tier' end,
  case when lower(trim(source)) in ('wikipedia', 'wikinews') and not coalesce(regexp_matches(url, '(?i)[?&]oldid=\\d+'), false) then 'unpinned_revision' end], lambda x: x is not null) reasons from ev1)"""


def responses(spark, sf_dir: str) -> DataFrame:
    """Model responses: well formed, and every kind of malformed one."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    p = F.format_string("%.2f", (i % 101) / 100.0)
    r, body = F.lit("<reasoning>because</reasoning>"), lambda x: F.concat(F.lit("<probability>"), x, F.lit("</probability>"))
    text = (
        F.when(i % 11 == 0, r).when(i % 11 == 1, F.lit("I cannot say.")).when(i % 11 == 2, F.concat(r, body(p), body(p))).when(i % 11 == 3, body(p)).when(i % 11 == 4, F.concat(r, body(F.lit("  "))))
        .when(i % 11 == 5, F.concat(r, body(F.lit("37%")))).when(i % 11 == 6, F.concat(r, body(F.lit("1/3")))).when(i % 11 == 7, F.concat(r, body(F.lit("1.5")))).otherwise(F.concat(r, F.lit("\n"), body(F.concat(F.lit(" "), p))))
    )
    return e.select(i.alias("id"), text.alias("response"), F.when(i % 23 == 0, "Timeout").alias("transport_error"), F.col("user_id"))


RESPONSES = """rs as (select event_id id, case event_id % 11 when 0 then '<reasoning>because</reasoning>' when 1 then 'I cannot say.' when 2 then '<reasoning>because</reasoning><probability>' || pp || '</probability><probability>' || pp || '</probability>'
  when 3 then '<probability>' || pp || '</probability>' when 4 then '<reasoning>because</reasoning><probability>  </probability>' when 5 then '<reasoning>because</reasoning><probability>37%</probability>'
  when 6 then '<reasoning>because</reasoning><probability>1/3</probability>' when 7 then '<reasoning>because</reasoning><probability>1.5</probability>'
  else '<reasoning>because</reasoning>' || chr(10) || '<probability> ' || pp || '</probability>' end response, case when event_id % 23 = 0 then 'Timeout' end transport_error, user_id
  from (select *, format('{:.2f}', (event_id % 101) / 100.0::double) pp from events)),
px as (select *, regexp_extract_all(response, '(?is)<probability>(.*?)</probability>', 1) ps, regexp_extract_all(response, '(?is)<reasoning>(.*?)</reasoning>', 1) rr from rs),
pb as (select *, trim(ps[1]) body from px),
pf as (select *, case when len(ps) = 0 and regexp_matches(response, '(?i)\\bi\\s*(cannot|will not|unable to)') then 'refusal' when len(ps) = 0 then 'missing_probability' when len(ps) > 1 then 'multiple_probabilities' when len(rr) = 0 then 'missing_reasoning'
  when body = '' then 'empty_probability' when contains(body, '%') then 'percentage' when not regexp_matches(body, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') then 'not_a_number' when not (try_cast(body as double) between 0 and 1) then 'out_of_range' end failure from pb)"""
EVIDENCE, RESPONSES = EVIDENCE.replace("\\\\", "\\"), RESPONSES.replace("\\\\", "\\")


def series(spark, sf_dir: str) -> DataFrame:
    """Daily means of events' values by type, in thousandths so that sums are exact."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("day")).agg((F.sum(F.round(F.col("value") * 1000).cast("long")) / F.count("*") / 1000.0).alias("value")).select("series_id", F.unix_micros("day").alias("us"), "value")


SERIES = """se as (select event_type series_id, epoch_us(date_trunc('day', ts)) us, sum(round(value * 1000)::bigint)::bigint / count(*) / 1000.0::double as value from events group by 1, 2)"""


def probe(spark, sf_dir: str) -> DataFrame:
    """Probe calls: parity of the user names the label, of the event the arm."""
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("user_id") % 2 == 0, "null").otherwise("adversarial").alias("label"), (F.col("user_id") % 40).alias("case_id"), F.when(F.col("event_id") % 2 == 0, "clean").otherwise("injected").alias("arm"), F.least(F.round(F.col("value")) / 1000.0, F.lit(1.0)).alias("probability"), ((F.col("user_id") % 40) % 3 == 0).cast("int").alias("outcome"))


PROBE = """pb0 as (select case when user_id % 2 = 0 then 'null' else 'adversarial' end label, user_id % 40 case_id, case when event_id % 2 = 0 then 'clean' else 'injected' end arm, least(round(value) / 1000.0::double, 1.0::double) probability, ((user_id % 40) % 3 = 0)::int outcome from events),
cs as (select *, (p_clean - outcome) * (p_clean - outcome) - (p_injected - outcome) * (p_injected - outcome) delta from (select label, case_id, avg(probability) filter (arm = 'clean') p_clean, avg(probability) filter (arm = 'injected') p_injected, max(outcome) outcome from pb0 group by 1, 2) where p_clean is not null and p_injected is not null)"""
