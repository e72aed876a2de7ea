import itertools
import random

import xxhash
from haruspex.llm.dedup_simhash import fingerprint_of, near_duplicates

DOCS = "doc_id long, text string, lang string, fp string"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Straße", "ÉTÉ", "\x1cx"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "a b c"), (6, "A B C")]
    for i in range(7, 60):
        rows.append((i, " ".join(rnd.choices(vocab, k=rnd.choice([5, 30, 200])))))
    base = " ".join(rnd.choices(vocab, k=400)).split()
    for i in range(60, 140):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    want = {d: brute_print(t) for d, t in rows}
    groups = brute_groups(want)
    df = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], DOCS).repartition(3)
    for crowd in (256, 2):
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in near_duplicates(df, crowd=crowd).collect()}
        assert {d: x[0] for d, x in got.items()} == want
        assert {d: x[1] for d, x in got.items()} == groups
    assert len(set(groups.values())) < len(rows)


def test_edge_rows(spark):
    assert fingerprint_of([]) == 0
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(7, "x y z", None, None), (7, "x y z", None, None), (None, "x y z", None, None), (None, "p q", None, None)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 and sorted(str(r.component_id) for r in got) == ["7", "7", "7", "None"]
