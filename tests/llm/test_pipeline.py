import random
import re
from collections import defaultdict

import corpus_pipeline as p
import public_tokenizers
from haruspex.llm.toxicity import Toxicity
from test_decontaminate import brute as contaminated
from test_secrets import find
from test_simhash import brute_groups, brute_print
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    texts = []
    for i in range(240):
        w = rnd.choices([f"w{j}" for j in range(200)], k=70)
        if i % 4 == 0:
            w[::9] = ["vileness"] * len(w[::9])
        if i % 7 == 0:
            w[5] = "password=hunter22x"
        texts.append(" ".join(w))
    items = [(1, texts[9]), (2, "w1 w2 w3")]
    texts += [texts[5], texts[5], texts[6] + " w1", None, "", "quiet " + " ".join(texts[9].split()[3:20])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1), (None, "null id", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {"documents": docs}
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = p.materialise(stage(spark, now, str(tmp_path)), "t")
        assert now.dtypes == docs.dtypes
        seen[name] = now
    data = {k: [tuple(r) for r in v.collect()] for k, v in seen.items()}

    scores = {r.doc_id: r.score for r in Toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).score(docs).collect()}
    assert sorted(data["toxicity"], key=str) == sorted((r for r in data["documents"] if scores[r[0]] < 0.3), key=str)
    assert 40 < len(data["documents"]) - len(data["toxicity"]) < 70

    prints = {i: brute_print(r[1]) for i, r in enumerate(data["toxicity"])}
    groups = defaultdict(set)
    for i, g in brute_groups(prints).items():
        groups[g].add(data["toxicity"][i])
    left = list(data["near_dedup"])
    assert len(left) == len(groups) and all(sum(r in own for r in left) >= 1 for own in groups.values())

    bad = {(r[0]) for r in contaminated([(x[0], x[1]) for x in data["near_dedup"]], items) if r[-1]}
    assert bad and sorted(data["decontamination"], key=str) == sorted((r for r in data["near_dedup"] if r[0] not in bad), key=str)

    def redacted(t):
        for k, s, e in reversed(find(t or "")):
            t = f"{t[:s]}[{k}]{t[e:]}"
        return t

    want = [(d, redacted(t), a, b, None if t is None else len(redacted(t))) for d, t, a, b, _ in data["decontamination"]]
    assert sorted(data["secret_scan"], key=str) == sorted(want, key=str) and any("[assign]" in (x[1] or "") for x in want)

    pieces = p.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x, *_ in data["secret_scan"]}
    total = defaultdict(int)
    for r in pieces:
        total[r.doc_id] += r.length
    assert dict(total) == tokens
    assert re.match("toxicity", p.STAGES[0][0])
