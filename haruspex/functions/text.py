"""Column functions on model responses, token distributions and labels' words."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without a category's signal.
STOPWORDS = (
    "a", "an", "the", "will", "be", "is", "are", "was", "were", "do", "does", "did", "to", "of", "in", "on", "at", "by", "for", "with", "and", "or",
    "if", "then", "than", "that", "this", "it", "its", "as", "from", "any", "before", "after",
)
#: Patterns of a response.
REASONING = r"(?is)<reasoning>(.*?)</reasoning>"
PROBABILITY = r"(?is)<probability>(.*?)</probability>"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"
REFUSAL = r"(?i)\bi\s*(?:'m|’m|\s+am)?\s*(?:cannot|can(?:'|’)?t|can not|won(?:'|’)?t|will not|unable to|not able to|must decline|do not speculate|don(?:'|’)?t speculate)|\bas an ai\b"
MARKER = "<probability>"
MAX_DOT = 3


def tokenize(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS))


@cache
def capital_letters() -> tuple[str, str]:
    """Letters that have a capital of one letter, and those capitals in the same order."""
    found = {"ß": "ẞ"}
    for c in map(chr, range(0x20000)):
        # Where upper case takes several letters, title case may be a single one (ᾳ is ᾼ); a ligature has neither.
        one = next((x for x in (c.upper(), c.title()) if len(x) == 1), c)
        if one != c:
            found[c] = one
    return "".join(found), "".join(found.values())


def capitals(text: Column) -> Column:
    """Upper case letter by letter, as SQL engines with simple case mapping have it: ß is ẞ, not SS, and no text grows."""
    return F.translate(text, *capital_letters())


def parse_forecast(text: Column) -> Column:
    """struct(probability, reasoning, failure) of a response; exactly one of probability and failure is null."""
    ps, rs = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (PROBABILITY, REASONING))
    body = F.regexp_replace(F.get(ps, F.lit(0)), r"^\s+|\s+$", "")
    value = F.when(body.rlike(NUMBER), body.cast("double"))
    failure = (
        F.when((F.size(ps) == 0) & text.rlike(REFUSAL), "refusal").when(F.size(ps) == 0, "missing_probability").when(F.size(ps) > 1, "multiple_probabilities")
        .when(F.size(rs) == 0, "missing_reasoning").when(body == "", "empty_probability").when(F.contains(body, F.lit("%")) | F.contains(F.lower(body), F.lit("percent")), "percentage")
        .when(~body.rlike(NUMBER), "not_a_number").when((value < 0) | (value > 1), "out_of_range")
    )
    ok = failure.isNull()
    reasoning = F.regexp_replace(F.get(rs, F.lit(0)), r"^\s+|\s+$", "")
    return F.struct(F.when(ok, value).alias("probability"), F.when(ok, reasoning).alias("reasoning"), failure.alias("failure"))


def render_forecast(reasoning: Column, probability: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(0.0)), F.lit(1.0))
    return F.concat(F.lit("<reasoning>"), reasoning, F.lit("</reasoning>\n<probability>"), F.format_string("%.2f", p), F.lit("</probability>"))


def is_digit(token: Column) -> Column:
    return token.rlike(r"\A[0-9]\z")


def digit_positions(text: Column) -> Column:
    """Offsets (from 0) of both digits of the first probability, or null where the response doesn't reach one."""
    start = F.instr(text, MARKER)
    after = start + len(MARKER)
    dot = F.locate(".", F.substring(text, after, F.lit(MAX_DOT + 1)))
    at = after + dot - 1
    ok = (start > 0) & (dot > 0) & is_digit(F.substring(text, at + 1, F.lit(1)))
    return F.when(ok, F.array(at.cast("long"), (at + 1).cast("long")))


def digit_distribution(tokens: Column) -> Column:
    """struct(share, e: expected digit, mode) of a map of tokens to probabilities; e and mode are null without mass.

    Tokens are stripped; single ASCII digits count; the mode is, of equals, the one that comes first in the map.
    """
    entries = F.transform(F.map_entries(tokens), lambda x: F.struct(F.regexp_replace(x["key"], r"^\s+|\s+$", "").alias("k"), x["value"].alias("v")))
    digits = F.filter(entries, lambda x: is_digit(x["k"]))
    total = lambda f: F.aggregate(digits, F.lit(0.0), lambda a, x: a + f(x))
    mass = total(lambda x: x["v"])
    every = F.aggregate(entries, F.lit(0.0), lambda a, x: a + x["v"])
    e = F.try_divide(total(lambda x: x["v"] * x["k"].cast("int")), F.when(mass > 0, mass))
    order = F.transform(digits, lambda x: x["k"].cast("int"))
    sums = F.transform(order, lambda d: F.struct(F.aggregate(digits, F.lit(0.0), lambda a, x: a + F.when(x["k"].cast("int") == d, x["v"]).otherwise(0.0)).alias("m"), (-F.array_position(order, d)).alias("place"), d.alias("d")))
    return F.struct(F.try_divide(mass, every).alias("share"), mass.alias("mass"), e.alias("e"), F.when(mass > 0, F.array_max(sums)["d"]).alias("mode"))


def read_probability(tenths: Column, hundredths: Column, minimum_mass: float = 0.5) -> Column:
    """struct(expectation, greedy, gap, failure): E[first digit] / 10 + E[second] / 100.

    The second position is optional, and adds nothing where it holds too little digit mass.
    """
    t, h = digit_distribution(tenths), digit_distribution(hundredths)
    low = F.coalesce(t["share"], F.lit(0.0)) < minimum_mass
    second = lambda x: F.coalesce(F.when(h["share"] >= minimum_mass, x), F.lit(0)) / 100
    e = t["e"] / 10 + second(h["e"])
    g = t["mode"] / 10 + second(h["mode"])
    return F.struct(F.when(~low, e).alias("expectation"), F.when(~low, g).alias("greedy"), F.when(~low, F.abs(g - e)).alias("gap"), F.when(low, "too_little_digit_mass").alias("failure"))
