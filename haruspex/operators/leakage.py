"""Evidence screened against an instant: every reason is kept, nothing short-circuits."""

from __future__ import annotations

import difflib
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import all_reasons

VERSION = "0.4.0"
#: Sources of the first tier; wikis must pin a revision.
TIER_ONE = ("sec.gov", "federalreserve.gov", "ecb.europa.eu", "bls.gov", "bea.gov", "fred", "reuters", "apnews", "coinbase", "wikipedia", "wikinews")
PINNED_SOURCES = ("wikipedia", "wikinews")
REVISION_PIN = r"(?i)[?&]oldid=\d+"
MAX_TIER = 2
UNKNOWN_TIER = 3


#: Outcome strings that are broadcast at most.
MANY_FORMS = 200_000


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def registry(spark, overrides: dict[str, int] | None = None) -> DataFrame:
    """(source_key, tier): the first tier as shipped, extended or overridden."""
    tiers = dict.fromkeys(TIER_ONE, 1) | {k.strip().lower(): v for k, v in (overrides or {}).items()}
    return spark.createDataFrame(sorted(tiers.items()), "source_key string, tier int")


@dataclass(frozen=True)
class Policy:
    """What a screen asks of a document."""

    max_tier: int = MAX_TIER
    unknown_tier: int = UNKNOWN_TIER
    #: Provenances that no tier redeems, and tiers at which an unknown one is let through.
    disqualifying: tuple[str, ...] = ("crawl", "inferred")
    unknown_allowed: tuple[int, ...] = (1,)
    pinned_sources: tuple[str, ...] = PINNED_SOURCES
    reject_modified: bool = True
    reject_after_retrieval: bool = True


def scan_outcomes(snippet: Column, forms: Column, strictness: str = "normalized", threshold: float | None = None) -> Column:
    """struct(matched_forms, max_similarity) of one text against its own array of outcome strings.

    exact: as substrings; normalized: after scan_form as well; fuzzy: also where some window is similar by the threshold
    or more. Strings in which a text is found count 1; blank ones match nothing.
    """
    if strictness not in ("exact", "normalized", "fuzzy"):
        raise ValueError(f"no such strictness: {strictness}")
    if (strictness == "fuzzy" and threshold is None) or (threshold is not None and not 0 < threshold <= 1):
        raise ValueError("fuzzy matching needs a threshold in (0, 1]")
    own = scan_form(snippet)
    holds = lambda f: F.contains(snippet, f) | ((scan_form(f) != "") & F.contains(own, scan_form(f)) if strictness != "exact" else F.lit(False))
    asked = F.filter(F.coalesce(forms, F.array().cast("array<string>")), lambda f: f.rlike(r"\S"))
    found = F.filter(asked, lambda f: F.coalesce(holds(f), F.lit(False)))
    if strictness != "fuzzy":
        return F.struct(found.alias("matched_forms"), F.when(F.size(found) > 0, 1.0).otherwise(0.0).alias("max_similarity"))

    @F.pandas_udf("array<double>")
    def ratios(text: pd.Series, sought: pd.Series) -> pd.Series:
        return pd.Series([[_best_ratio(t or "", f) for f in fs] for t, fs in zip(text, sought)])

    each = ratios(own, F.transform(asked, scan_form))
    scored = F.zip_with(asked, each, lambda f, r: F.struct(f.alias("f"), F.when(F.coalesce(holds(f), F.lit(False)), 1.0).otherwise(r).alias("r")))
    hit = F.transform(F.filter(scored, lambda x: x["r"] >= threshold), lambda x: x["f"])
    return F.struct(hit.alias("matched_forms"), F.coalesce(F.array_max(F.transform(scored, lambda x: x["r"])), F.lit(0.0)).alias("max_similarity"))


def screen(evidence: DataFrame, tiers: DataFrame, policy: Policy = Policy(), *, forms: str | None = None, snippet: str = "snippet", strictness: str = "normalized", threshold: float | None = None) -> DataFrame:
    """evidence with tier, reasons (timestamp, provenance, source, revision and outcome checks in order), admissible and exemption.

    evidence: source, timestamp, provenance, last_modified, retrieved_at, url, as_of. forms: a column with the outcome
    strings of the row's question; with it, the snippet is scanned too and matched_forms and max_similarity are given.
    tiers is a registry of sources, a vocabulary that is kept on the driver.
    """
    rows = evidence.withColumn("source_key", source_key(F.col("source"))).join(F.broadcast(tiers), "source_key", "left")
    dated = F.col("timestamp").isNotNull()
    effective = F.coalesce("tier", F.lit(policy.unknown_tier))
    exempt = (F.col("provenance") == "unknown") & effective.isin(*policy.unknown_allowed)
    rules = [
        ("missing_timestamp", ~dated),
        ("timestamp_not_before_as_of", dated & (F.col("timestamp") >= F.col("as_of"))),
        ("modified_at_or_after_as_of", F.lit(policy.reject_modified) & dated & (F.col("last_modified") >= F.col("as_of"))),
        ("timestamp_after_retrieval", F.lit(policy.reject_after_retrieval) & dated & (F.col("timestamp") > F.col("retrieved_at"))),
        ("ambiguous_provenance", F.col("provenance").isin(*policy.disqualifying) | ((F.col("provenance") == "unknown") & ~exempt)),
        ("unknown_source", F.col("tier").isNull()),
        ("untrusted_source_tier", effective > policy.max_tier),
        ("unpinned_revision", F.col("source_key").isin(*policy.pinned_sources) & ~F.coalesce(F.col("url").rlike(REVISION_PIN), F.lit(False))),
    ]
    if forms is not None:
        rows = rows.withColumn("_scan", scan_outcomes(F.col(snippet), F.col(forms), strictness, threshold))
        rows = rows.withColumns({"matched_forms": F.col("_scan.matched_forms"), "max_similarity": F.col("_scan.max_similarity")}).drop("_scan")
        rules.append(("outcome_string_match", F.size("matched_forms") > 0))
    rows = rows.withColumn("reasons", all_reasons(rules)).withColumn("admissible", F.size("reasons") == 0)
    return rows.withColumn("exemption", F.when(F.col("admissible") & exempt, "tier1_unknown_provenance")).drop("source_key")


def reason_stats(screened: DataFrame) -> DataFrame:
    """(reason, count): a document counts under each of its reasons, admissible ones under null."""
    return screened.select(F.explode_outer("reasons").alias("reason")).groupBy("reason").count()


def tier_stats(screened: DataFrame) -> DataFrame:
    return screened.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("admissible").alias("kept"), F.count("exemption").alias("exempted"))


def merge_stats(stats: DataFrame) -> DataFrame:
    """Sums of mergeable statistics (version, reason, count); one detector version alone may be merged."""
    one = F.when(F.min("version") == F.max("version"), F.sum("count")).otherwise(F.raise_error(F.lit("statistics of different detector versions")).cast("long"))
    return stats.groupBy("reason").agg(F.sum("count").alias("count")).crossJoin(F.broadcast(stats.agg(one.alias("total"))))


def exemption_share(screened: DataFrame) -> DataFrame:
    """Share of kept first-tier documents whose provenance is unknown; above a fifth it asks for attention."""
    kept = F.col("admissible") & (F.col("tier") == 1)
    share = F.try_divide(F.count_if(kept & F.col("exemption").isNotNull()), F.count_if(kept))
    return screened.agg(share.alias("share"), F.coalesce(share > 0.20, F.lit(False)).alias("attention"))


def scan_form(text: Column) -> Column:
    """Case folded letter by letter, everything but letters, digits, '.' and '%' to single spaces.

    Σ is σ at a word's end too and İ is i, as what a letter becomes may not depend on where a form is cut.
    """
    lower = F.lower(F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))
    folded = F.replace(F.replace(lower, F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}.%]+", " "))


def match_outcomes(docs: DataFrame, forms: DataFrame, snippet: str = "snippet", form: str = "form", strictness: str = "normalized") -> DataFrame:
    """Documents joined with the outcome strings that they hold: exact, or normalized as well (matched_as says which).

    forms is a stated set of queries, broadcast up to MANY_FORMS of them; blank forms match nothing. The words inside a form, but for its
    first and last, must be whole words of a document that holds it. So a form of three words or more is looked up by
    the longest of them, and compared only with documents that have that word; shorter ones are compared with all.
    """
    if strictness not in ("exact", "normalized"):
        raise ValueError("fuzzy matching of rows with their own strings is scan_outcomes'")
    spread = F.broadcast if forms.limit(MANY_FORMS + 1).count() <= MANY_FORMS else lambda df: df
    words = F.split("_form", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    f = forms.where(F.trim(form) != "").withColumn("_form", scan_form(F.col(form))).withColumn("_anchor", longest)
    d = docs.withColumn("_doc", scan_form(F.col(snippet)))
    exact = F.contains(F.col(snippet), F.col(form))
    loose = (F.col("_form") != "") & F.contains(F.col("_doc"), F.col("_form"))
    holds = exact | loose if strictness == "normalized" else exact
    anchored = f.where("_anchor is not null")
    anchors = anchored.agg(F.collect_set("_anchor").alias("_anchors"))
    some = d.crossJoin(F.broadcast(anchors)).withColumn("_hit", F.array_intersect(F.split("_doc", " "), F.col("_anchors"))).where(F.size("_hit") > 0)
    some = some.withColumn("_anchor", F.explode("_hit")).drop("_hit", "_anchors").join(spread(anchored), "_anchor").where(holds)
    rest = d.join(spread(f.where("_anchor is null")), holds)
    rows = some.unionByName(rest.select(*some.columns))
    return rows.withColumn("matched_as", F.when(exact, "exact").otherwise("normalized")).drop("_doc", "_form", "_anchor")


#: Words of a text whose windows are bounded at a time.
PIECE = 50_000
#: From this length on difflib leaves out what it takes for noise.
AUTOJUNK = 200


def _ratio(form: str, window: str) -> float:
    """difflib's ratio. The longest common piece, first in the form, then in the window, is sought by growing: a piece of
    the form that is longer than the best so far is looked up in the window as it is."""
    if len(window) >= AUTOJUNK:
        return difflib.SequenceMatcher(None, form, window).ratio()
    same, parts = 0, [(0, len(form), 0, len(window))]
    while parts:
        a, a_end, b, b_end = parts.pop()
        size, most, at, there = 0, min(a_end - a, b_end - b), a, b
        i = a
        while size < most and i + size < a_end:
            found = window.find(form[i : i + size + 1], b, b_end)
            if found < 0:
                i += 1
            else:
                size, at, there = size + 1, i, found
        if size:
            same += size
            parts += [(a, at, b, there), (at + size, a_end, there + size, b_end)]
    return 2.0 * same / (len(form) + len(window))


def _common(masks, starts, sizes, m: int):
    """Length of the longest common subsequence of a form of m <= 64 characters and each window, bit by bit over all windows.

    masks has the places in the form of each character of the text; windows come in order of size, the longest first.
    """
    import numpy as np

    v = np.full(len(starts), 2**64 - 1, np.uint64)
    for t, k in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")):
        u = v[:k] & masks[starts[:k] + t]
        v[:k] = (v[:k] + u) | (v[:k] - u)
    left = ~v & np.uint64(2**m - 1)
    return np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)


def _best_ratio(text: str, form: str) -> float:
    """Windows are compared in order of a bound on their ratio until none can be better: the characters that they share
    with the form, and for windows that aren't far longer than it, the longest common subsequence, as matching pieces are one."""
    import numpy as np

    words, w, m = text.split(), len(form.split()), len(form)
    letters = sorted(set(form))
    codes = np.array([ord(c) for c in letters], np.uint32)
    places = np.array([sum(1 << i for i, c in enumerate(form) if c == x) for x in letters] + [0], np.uint64) if m <= 64 else None
    best = 0.0
    for lo in range(0, len(words) if w else 0, PIECE):
        piece = words[lo : lo + PIECE + w]
        joined = " ".join(piece)
        ends = np.cumsum([len(x) + 1 for x in piece]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        sizes = [n for n in (w - 1, w, w + 1) if 0 < n <= len(piece)]
        starts = np.concatenate([begins[: len(piece) - n + 1] for n in sizes] or [begins[:0]])
        stops = np.concatenate([ends[n - 1 :] for n in sizes] or [ends[:0]])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(codes, chars), len(codes) - 1)
        at = np.where(codes[at] == chars, at, len(codes))
        shared = np.zeros(len(starts), np.int64)
        for k, c in enumerate(letters):
            count = np.concatenate([[0], np.cumsum(at == k)])
            shared += np.minimum(count[stops] - count[starts], form.count(c))
        bound = 2.0 * shared / (m + stops - starts)
        if places is not None:
            near = np.flatnonzero((stops - starts <= 4 * m) & (bound > best))
            near = near[np.argsort(starts[near] - stops[near], kind="stable")]
            bound[near] = 2.0 * _common(places[at], starts[near], stops[near] - starts[near], m) / (m + stops[near] - starts[near])
        tried = set()
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] <= best:
                break
            window = joined[starts[k] : stops[k]]
            if window not in tried:
                tried.add(window)
                best = max(best, _ratio(form, window))
    return best


def best_similarity(snippet: Column, form: Column) -> Column:
    """Greatest Ratcliff-Obershelp ratio of the form and any window of its length in words, give or take one; a Python island."""

    @F.pandas_udf("double")
    def best(text: pd.Series, sought: pd.Series) -> pd.Series:
        return pd.Series([_best_ratio(t or "", f or "") for t, f in zip(text, sought)], dtype=float)

    return best(scan_form(snippet), scan_form(form))


def forecast_time_fault(as_of: Column) -> Column:
    """Why a forecast at as_of would know the answer: the earlier of both signals at or before it; null if none is."""
    first = F.least("resolved_at", "soft_target_at")
    return F.when(as_of >= first, F.when(F.col("resolved_at") <= F.coalesce("soft_target_at", "resolved_at"), "resolved_at").otherwise("soft_target_at"))


def probe_cases(probe: DataFrame, key: tuple[str, ...] = ("label", "case_id")) -> DataFrame:
    """(key, p_clean, p_injected, outcome, delta): mean forecasts of both arms; one model version alone."""
    arm = lambda a: F.avg(F.when(F.col("arm") == a, F.col("probability")))
    out = probe.groupBy(*key).agg(arm("clean").alias("p_clean"), arm("injected").alias("p_injected"), F.max("outcome").alias("outcome"))
    d = lambda c: (F.col(c) - F.col("outcome")) * (F.col(c) - F.col("outcome"))
    return out.where("p_clean is not null and p_injected is not null").withColumn("delta", d("p_clean") - d("p_injected"))


def probe_report(cases: DataFrame, group: tuple[str, ...] = ("label",), q: float = 0.95) -> DataFrame:
    sd = F.coalesce(F.stddev_samp("delta"), F.lit(0.0))
    return cases.groupBy(*group).agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("*"))).alias("se"), F.percentile("delta", q).alias("quantile"))


def binomial_upper_count(n: int, p: float, alpha: float = 0.05) -> int:
    """The least k with P(X <= k) >= 1 - alpha. Terms are made in logarithms, as (1 - p)^n underflows for large n."""
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if total >= 1 - alpha:
            return k
    return n


def binomial_upper(n: Column, p: float, alpha: float = 0.05) -> Column:
    """binomial_upper_count as a column, by a fold over 0..n with the logarithms of neighbouring terms' ratios."""
    start = F.struct(F.lit(0.0).alias("cdf"), (n * F.lit(math.log1p(-p))).alias("term"), F.lit(-1).cast("long").alias("k"))
    step = lambda a, i: F.struct(
        (a["cdf"] + F.exp(a["term"])).alias("cdf"), F.when(i < n, a["term"] + F.ln((n - i) / (i + 1)) + F.lit(math.log(p) - math.log1p(-p))).otherwise(a["term"]).alias("term"),
        F.when((a["k"] < 0) & (a["cdf"] + F.exp(a["term"]) >= 1 - alpha), i).otherwise(a["k"]).alias("k"),
    )
    return F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), start, step, lambda a: F.when(a["k"] < 0, n).otherwise(a["k"]))


def normal_cdf(x: float) -> float:
    """Of a literal, on the driver: Spark has no error function."""
    return (1 + math.erf(x / math.sqrt(2))) / 2


def null_threshold(cases: DataFrame, method: str = "quantile", q: float = 0.95, z: float = 1.96, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, threshold, n, expected_rate): the null's quantile, or its mean and z deviations; over one case an error."""
    if method not in ("quantile", "normal"):
        raise ValueError(f"no such method: {method}")
    value = F.percentile("delta", q) if method == "quantile" else F.avg("delta") + z * F.stddev_samp("delta")
    rate = 1 - q if method == "quantile" else 1 - normal_cdf(z)
    n = F.count("*")
    return cases.groupBy(*group).agg(F.when(n > 1, value).otherwise(F.raise_error(F.lit("one null case gives no threshold")).cast("double")).alias("threshold"), n.alias("n"), F.lit(rate).alias("expected_rate"))


def null_gate(cases: DataFrame, q: float = 0.95, alpha: float = 0.05, *, method: str = "quantile", z: float = 1.96, version: str | None = None) -> DataFrame:
    """Adversarial cases beyond the null's threshold against what chance allows; passed if no more.

    No adversarial case, or fewer than two null ones, is an error. version: a column with the model's version, of which
    both arms together must have one, as a null belongs to the model that made it.
    """
    null = null_threshold(cases.where("label = 'null'"), method, q, z).select("threshold", F.col("n").alias("n_null"), "expected_rate")
    one = [F.count_distinct(F.coalesce(F.col(version).cast("string"), F.lit(""))).alias("_versions")] if version else []
    arm = cases.where("label = 'adversarial'").crossJoin(F.broadcast(null))
    out = arm.agg(F.count("*").alias("n"), F.max("threshold").alias("threshold"), F.max("n_null").alias("n_null"), F.count_if(F.col("delta") > F.col("threshold")).alias("exceed"))
    refuse = lambda bad, why, c: F.when(bad, F.raise_error(F.lit(why)).cast("long")).otherwise(c)
    out = out.withColumn("n", refuse(F.col("n") == 0, "no adversarial case to judge", F.col("n")))
    if one:
        out = out.crossJoin(F.broadcast(cases.where("label in ('null', 'adversarial')").agg(*one)))
        out = out.withColumn("n", refuse(F.col("_versions") > 1, "both arms must come from one model", F.col("n"))).drop("_versions")
    rate = 1 - q if method == "quantile" else 1 - normal_cdf(z)
    return out.withColumn("allowed", binomial_upper(F.col("n"), rate, alpha)).withColumn("passed", F.col("exceed") <= F.col("allowed")).withColumn("well_estimated", F.col("n_null") >= 20)


def confidence_curve(df: DataFrame, bars=(0.7, 0.8, 0.9, 0.95, 0.99), p: str = "probability", y: str = "outcome", group: tuple[str, ...] = ()) -> DataFrame:
    """Share of forecasts at or above each bar of confidence in what came true."""
    from ..functions.probability import toward_truth

    truth = toward_truth(F.col(p), F.col(y))
    wide = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count_if(truth >= b).alias(f"k{i}") for i, b in enumerate(bars)])
    return wide.select(*group, "n", F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bar"), F.col(f"k{i}").alias("k")) for i, b in enumerate(bars)])).alias("x")).select(*group, "x.bar", "n", F.col("x.k").alias("at_or_above"), (F.col("x.k") / F.col("n")).alias("rate"))
