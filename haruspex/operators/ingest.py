"""Raw market rows to typed questions, and the builders of evaluation sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import all_reasons, first_reason

QUESTION_ID = r"^[a-z0-9][a-z0-9_-]*:[A-Za-z0-9_.:+-]+$"
#: Slugs that say a market is no forecast, and those of communities that often hold none.
CERTAIN = r"^(nonpredictive|nonpredictive-profits|personal-goals|personal|self-resolving|free-lottery|fairlyrandom|manifold-[0-9a-f]{12})$"
COMMUNITY = r"^(fun|destinygg|new-years-resolutions-\d+|manifoldlove-\w+|change-my-mind|gambling|proofniks)$"
#: Titles that ask about a threshold on a quantity.
NUMERIC_TITLE = (
    r"(?i)(above|below|over|under|at least|at most|more than|less than|greater than|exceed|reach|between)\s+[\$€£]?[\d,]+(\.\d+)?"
    r"|[\$€£][\d,]+(\.\d+)?|\b\d+(\.\d+)?\s*(%|percent|bps|basis points)|\bhow many\b|\bnumber of\b"
)
#: Categories settled by judgment.
JUDGMENT = ("Politics", "Elections", "Economics", "Science and Technology", "World", "Companies", "Health", "Social", "Transportation", "Education", "Entertainment", "Exotics")
#: Latest instant that is taken as milliseconds since 1970 (the year 9999).
LAST_MS = 253_402_300_799_999


def epoch_ms_ok(ms: Column) -> Column:
    return F.coalesce((ms > 0) & (ms <= LAST_MS), F.lit(False))


def market_reason(source: str) -> Column:
    """The first rule that a raw market row breaks."""
    r, soft = F.col("resolution"), F.col("resolution") == "MKT"
    stamps = []
    for c in ("created_ts", "close_ts", "resolve_ts"):
        stamps += [("missing_field", F.col(c).isNull()), ("bad_timestamp", ~epoch_ms_ok(F.col(c)))]
    outside = (F.col("resolution_prob") < 0) | (F.col("resolution_prob") > 1) | F.isnan("resolution_prob")
    late = F.when(soft, F.col("resolve_ts") < F.col("created_ts")).otherwise(F.col("resolve_ts") <= F.col("created_ts"))
    no_id = ~F.coalesce(F.concat_ws(":", "platform", "platform_market_id").rlike(QUESTION_ID), F.lit(False))
    return first_reason([
        ("wrong_platform", ~F.col("platform").eqNullSafe(source)),
        ("not_binary", ~F.col("outcome_type").eqNullSafe("binary")),
        ("not_resolved", ~F.col("status").eqNullSafe("resolved")),
        ("annulled", r == "CANCEL"),
        ("unknown_resolution", ~F.coalesce(r.isin("YES", "NO", "MKT"), F.lit(False))),
        ("missing_soft_target", soft & F.col("resolution_prob").isNull()),
        ("missing_field", F.coalesce("title", F.lit("")) == ""),
        *stamps,
        ("schema_rejected", no_id | (F.col("close_ts") <= F.col("created_ts")) | late | (soft & outside)),
    ])


def normalise_markets(raw: DataFrame, source: str) -> DataFrame:
    """raw with question_id and reason; of valid rows with one id the first by ingest_seq stays, others are duplicate_id."""
    rows = raw.withColumn("question_id", F.concat_ws(":", "platform", "platform_market_id")).withColumn("reason", market_reason(source))
    w = Window.partitionBy("question_id", F.col("reason").isNull()).orderBy("ingest_seq")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "duplicate_id").otherwise(F.col("reason")))


def as_questions(kept: DataFrame) -> DataFrame:
    """Question records of kept market rows; a market probability is a soft target at the time of resolution."""
    up = F.col("resolution")
    soft = up == "MKT"
    at = lambda c: F.timestamp_millis(F.col(c))
    return kept.select(
        "question_id", F.col("title").alias("text"), F.coalesce("description", F.lit("")).alias("resolution_criteria"), at("created_ts").alias("open_date"), at("close_ts").alias("scheduled_resolve_date"),
        F.when(~soft, at("resolve_ts")).alias("resolved_at"), F.when(~soft, (up == "YES").cast("int")).alias("outcome"), F.when(soft, F.col("resolution_prob")).alias("soft_target"),
        F.when(soft, "crowd_derived").alias("soft_target_provenance"), F.when(soft, at("resolve_ts")).alias("soft_target_at"), F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("unclassified")).alias("category"), F.lit("unassigned").alias("base_rate_class"),
    )


def question_faults() -> Column:
    """All cross-field rules that a question record breaks."""
    some = lambda *c: sum((F.col(x).isNotNull().cast("int") for x in c), F.lit(0))
    soft = some("soft_target", "soft_target_provenance", "soft_target_at")
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return all_reasons([
        ("bad_id", ~F.col("question_id").rlike(QUESTION_ID)),
        ("empty_text", empty("text")), ("empty_category", empty("category")), ("empty_base_rate_class", empty("base_rate_class")),
        ("closes_before_open", F.col("scheduled_resolve_date") <= F.col("open_date")),
        ("resolved_before_open", F.col("resolved_at") <= F.col("open_date")),
        ("half_resolved", some("outcome", "resolved_at") == 1),
        ("half_soft", (soft > 0) & (soft < 3)),
        ("soft_before_open", F.col("soft_target_at") < F.col("open_date")),
    ])


def published_set(candidates: DataFrame, *, freeze_ms: int, require_close: bool) -> DataFrame:
    """Candidates with a reason; once an id is kept, its later rows are left out uncounted.

    candidates: id, title, resolution, created_ts, close_ts and resolved_ms in milliseconds, seq.
    """
    close = F.col("close_ts") if require_close else F.coalesce("close_ts", "resolved_ms")
    rows = candidates.where("id is not null").withColumn("close_ms", close)
    rows = rows.withColumn("reason", first_reason([
        ("unresolved_or_other", ~F.coalesce(F.col("resolution").isin("YES", "NO"), F.lit(False))), ("no_created_ts", F.col("created_ts").isNull()), ("unresolved_or_other", F.col("resolved_ms").isNull()),
        ("not_after_freeze", F.col("resolved_ms") <= freeze_ms), ("no_close_ts", F.col("close_ms").isNull()), ("close_before_open", F.col("close_ms") <= F.col("created_ts")),
    ]))
    kept = F.min(F.when(F.col("reason").isNull(), F.col("seq"))).over(Window.partitionBy("id"))
    return rows.withColumn("_kept", kept).where(F.col("_kept").isNull() | (F.col("seq") <= F.col("_kept"))).drop("_kept")


def transfer_reason(*, lo: Column, hi: Column, min_days: int) -> Column:
    """First rule that a swept market breaks. category: of its series, by a left join."""
    days = F.floor((F.unix_micros("settled") - F.unix_micros("opened")) / F.lit(86_400_000_000))
    return first_reason([
        ("not_finalized", ~F.col("status").eqNullSafe("finalized")), ("mve", F.coalesce("mve_collection_ticker", F.lit("")) != ""), ("no_event", F.coalesce("event_ticker", F.lit("")) == ""), ("unknown_series", F.col("category").isNull()),
        ("mechanical_category", ~F.col("category").isin(*JUDGMENT)), ("numeric_title", F.col("title").rlike(NUMERIC_TITLE)), ("no_result", ~F.coalesce(F.col("result").isin("yes", "no"), F.lit(False))),
        ("bad_timestamps", F.col("opened").isNull() | F.col("settled").isNull()), ("outside_window", (F.col("settled") < lo) | (F.col("settled") >= hi)), ("short_lifetime", days < min_days),
    ])


def one_per_event(df: DataFrame, event: str, order: list) -> DataFrame:
    w = Window.partitionBy(event).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def series_of(ticker: Column) -> Column:
    return F.substring_index(ticker, "-", 1)


#: White space of any kind at the very end.
SPACE_TAIL = r"(?U)[\s\x1c-\x1f]+\z"


def rebuilt_prompt(title: Column, subtitle: Column) -> Column:
    """title, with what the subtitle adds if the title doesn't say it."""
    bare = title
    for tail in (SPACE_TAIL, r"\?+\z", SPACE_TAIL):
        bare = F.regexp_replace(bare, tail, "")
    return F.when(F.contains(F.lower(title), F.lower(subtitle)), title).otherwise(F.concat(bare, F.lit(" — resolves YES if: "), subtitle))


def compare_sets(built: DataFrame, reference: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: ids missing from either side, and rows that differ in each field."""
    b = built.select(key, F.struct(*fields).alias("b"))
    r = reference.select(key, F.struct(*fields).alias("r"))
    both = b.join(r, key, "full_outer")
    shared = F.col("b").isNotNull() & F.col("r").isNotNull()
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("extra"), F.count_if(shared).alias("shared"), *[F.count_if(shared & ~F.col(f"b.{f}").eqNullSafe(F.col(f"r.{f}"))).alias(f"differs_{f}") for f in fields])


def slug_confidence(slugs: Column) -> Column:
    """certain, possible or none; null slugs are none."""
    has = lambda pattern: F.coalesce(F.exists(slugs, lambda s: s.rlike(pattern)), F.lit(False))
    return F.when(has(CERTAIN), "certain").when(has(COMMUNITY), "possible").otherwise("none")


def drop_nonpredictive(df: DataFrame, *, policy: str, flag: str = "nonpredictive") -> DataFrame:
    """policy: nothing, certain, or certain_and_possible. Rows not assessed (null) stay."""
    dropped = {"nothing": [], "certain": ["certain"], "certain_and_possible": ["certain", "possible"]}[policy]
    return df.where(F.col(flag).isNull() | ~F.col(flag).isin(*dropped)) if dropped else df


def nonpredictive_counts(df: DataFrame, flag: str = "nonpredictive") -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(flag) == k).alias(k) for k in ("certain", "possible")], F.count_if(F.col(flag).isNull()).alias("unassessed"))


def corpus_reason(*, allow_extreme: bool, require_reasoning: bool) -> Column:
    """First fault of a training row: target not a number, outside [0, 1], extreme, or without reasoning."""
    t = F.col("target")
    rules = [("no_target", t.isNull() | F.isnan(t)), ("out_of_range", (t < 0) | (t > 1))]
    if not allow_extreme:
        rules.append(("extreme", (t <= 0) | (t >= 1)))
    if require_reasoning:
        rules.append(("no_reasoning", F.trim(F.coalesce("reasoning", F.lit(""))) == ""))
    return first_reason(rules)


def extreme_share(df: DataFrame) -> DataFrame:
    """Shares at or beyond 0 and 1, and within a twentieth of them, of all rows and of soft ones."""
    t, soft = F.col("target"), F.upper("kind") == "SOFT"
    share = lambda c: F.avg(c.cast("int"))
    at, near = (t <= 0) | (t >= 1), (t <= 0.05) | (t >= 0.95)
    return df.agg(F.count("*").alias("n"), share(at).alias("at_ends"), share(near).alias("near_ends"), F.avg(F.when(soft, at.cast("int"))).alias("soft_at_ends"), F.avg(F.when(soft, near.cast("int"))).alias("soft_near_ends"))


#: The text of a prompt and what stands for absent parts.
PROMPT = """You are a careful forecaster. Estimate the probability that the question below resolves YES.

Question: {question}
Resolution criteria: {criteria}
Scheduled resolution: {scheduled}
You are forecasting as of: {as_of}

Reply with exactly this and nothing else:
<reasoning>two to four sentences</reasoning>
<probability>0.XX</probability>"""
ABSENT = {"criteria": "Resolves YES if the event occurs.", "scheduled": "unknown", "as_of": "unknown"}


def prompt(question: Column, criteria: Column, scheduled: Column, as_of: Column) -> Column:
    """Prompt of one question; null and empty parts have stated defaults."""
    given = {"question": question, "criteria": criteria, "scheduled": scheduled, "as_of": as_of}
    shown = {k: F.coalesce(F.nullif(c, F.lit("")), F.lit(ABSENT[k])) if k in ABSENT else c for k, c in given.items()}
    return F.concat(*[shown[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", PROMPT))])
