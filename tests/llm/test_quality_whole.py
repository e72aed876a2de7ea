"""The query's scores against rules and statistics evaluated in plain Python."""

import math
import random
import re

import pytest
from haruspex.llm.quality import RuleEnsemble, op9_rule_ensemble_quality, score

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def statistics(text):
    t = text or ""
    n, words = len(t), len(re.findall(r"[^\x20\x09-\x0D]+", t))
    tokens, lines = re.split(r"[\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x]
    count = lambda chars: sum(c in chars for c in t)
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_words": math.log1p(words),
        "word_length": share(n, words),
        "upper": share(count(UPPER), n),
        "lower": share(count(LOWER), n),
        "digits": share(count("0123456789"), n),
        "symbols": share(count("#*$%&<>{}[]\\^~=+@_"), words),
        "bars": share(count("|"), words),
        "shouts": share(count("!?"), words),
        "stops": share(count(".,;:"), words),
        "line_feeds": share(count("\n"), words),
        "distinct_words": share(len(set(tokens)), len(tokens)),
        "distinct_lines": share(len(set(lines)), len(lines)),
    }


def test_scores_against_rules_in_plain_python(spark, tmp_path):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.6
        w = [rnd.choice(["alpha", "Beta,", "g4mma", "délta", "\U0001f600", "x"]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(5, 70))]
        if not good:
            w = [rnd.choice(["#", "|", "!", "", "{}"]) + x for x in w]
        rows.append((i, rnd.choice([" ", "\n", " \t", " "]).join(w)))
        labels.append((i, int(good if rnd.random() < 0.95 else not good), 0))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "\n\n"), (904, "one"), (905, " lead and trail "), (906, "a b c"), (907, "z] ^~ " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = RuleEnsemble.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert len(model.rules) > 3 and any(len(r) > 1 for r, _ in model.rules)
    texts, got = dict(rows), {r.doc_id: r.asDict() for r in score(docs, model).collect()}
    assert got.keys() == texts.keys()
    want = {}
    for i, own in got.items():
        assert {k: own[k] for k in statistics(texts[i])} == pytest.approx(statistics(texts[i]), rel=1e-12)
        total = model.intercept
        for rule, weight in model.rules:
            if all(own[name] <= limit if low else own[name] > limit for name, limit, low in rule):
                total += weight
        want[i] = 1 / (1 + math.exp(-total))
    query = {r.doc_id: (r.score, r.predicted) for r in op9_rule_ensemble_quality(spark, str(tmp_path)).collect()}
    assert {i: s for i, (s, _) in query.items()} == pytest.approx(want, abs=1e-9)
    assert {p for _, p in query.values()} == {0, 1} and all(p == int(s >= 0.7) for s, p in query.values())
