import random
import re
from collections import Counter

import duckdb
import pandas as pd
from haruspex.llm.repetition import LIMITS, LINE_LIMIT, OP3_SQL, repetition


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars = sum(map(len, w))

    def cover(n):
        g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        c = Counter(g)
        return {p for i, x in enumerate(g) if c[x] > 1 for p in range(i, i + n)}

    seen, dup, line_chars = set(), 0, 0
    for line in t.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if line in seen:
                dup, line_chars = dup + 1, line_chars + sum(map(len, own))
            seen.add(line)
    grams = [sum(len(w[p]) for p in cover(n)) for n in LIMITS]
    failed = len(w) < 50 or 100 * len(cover(3)) > 50 * len(w)
    ok = line_chars <= LINE_LIMIT * chars and all(g <= x * chars for g, x in zip(grams, LIMITS.values()))
    return (len(w), chars, sum(c in "#*$%&|<>" for c in t), dup, len(cover(3)), line_chars, *grams, failed, not failed and ok)


def test_against_brute_force_and_sql(spark):
    rnd = random.Random(4)
    vocab = ["a", "b", "é", "日本", "x#", "\x1c", "cc"] + [f"w{i}" for i in range(200)]
    texts = [None, "", " \n\n ", "a", "x|y <b> & $%*#", "line one\nline one\n line one\nline one", "a " * 300, "é\n" * 90]
    for _ in range(80):
        w = rnd.choices(vocab, k=rnd.choice([10, 60, 200]))
        if rnd.random() < 0.6:
            k = rnd.randrange(3, 30)
            w[k:k] = w[:k]
        texts.append("".join(x + rnd.choice([" ", " ", "\n", "\t", "  "]) for x in w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[-1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    got = sorted((tuple(r) for r in repetition(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    assert sorted(con.execute(OP3_SQL).fetchall(), key=str) == got
    assert repetition(df.limit(0)).count() == 0
    assert {r[-1] for r in got} == {True, False}
