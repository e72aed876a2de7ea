import hashlib
import random
import re

import duckdb
from haruspex.llm.decontaminate import OP7_SQL, contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(10, len(x))
            wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    own.add(i)
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    rnd = random.Random(3)
    vocab = ["aa", "bb", "Cc", "é", "12", "x1"]
    items = [(i, " ".join(rnd.choices(vocab, k=k))) for i, k in enumerate([3, 9, 10, 11, 25, 40, 5, 1])]
    items += [(20, None), (21, "!!"), (22, items[4][1]), (22, items[4][1])]
    docs = [(0, None), (1, ""), (2, "--"), (3, items[4][1].upper()), (3, items[4][1].upper())]
    docs += [(i, " ".join(rnd.choices(vocab + ["zz", "yy"], k=rnd.choice([4, 30, 120]))) + rnd.choice(["", ", " + rnd.choice(items[:8])[1].replace(" ", "-")])) for i in range(4, 60)]
    docs += [(None, "pre " + " ".join(words(items[5][1])[7:17]) + " post")]
    return docs, items


def test_against_brute_force_and_sql(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, n_words string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for block in (10**6, 12):
        assert sorted(map(tuple, contamination(d, b, block_words=block).collect()), key=str) == want
    con = duckdb.connect()
    documents, benchmark = d.toPandas(), b.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents), con.register("benchmark", benchmark)
    assert sorted(con.execute(OP7_SQL).fetchall(), key=str) == want


def test_empty_tables(spark):
    docs, items = data()
    none, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contamination(some, no_items).where("contaminated").count() == 0 and contamination(some, no_items).count() == len(docs)
