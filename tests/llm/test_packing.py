import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from haruspex.llm.packing import best_pattern, class_sizes, column_generation, op5_cutting_stock_packing, plan
from tokenizers import Tokenizer


def padding(rows, length=2048):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    pad = total = 0
    for places in seqs.values():
        end = 0
        for o, k in sorted(places):
            assert o == end and k > 0
            end += k
        assert end <= length
        total += end
        pad += 0 if end & (end - 1) == 0 else length - end
    return pad, total


def test_pricing_finds_the_best_pattern():
    sizes, prices = np.array([3, 5, 7]), np.array([0.2, 0.45, 0.5])
    pattern, gain, _ = best_pattern(sizes, prices, np.ones(16))
    best = max((a * 0.2 + b * 0.45 + c * 0.5 - 1 for a in range(6) for b in range(4) for c in range(3) if a * 3 + b * 5 + c * 7 <= 15))
    assert abs(gain - best) < 1e-12 and pattern @ sizes <= 15


def test_linear_program_reaches_a_known_optimum():
    sizes, demand = np.array([3, 4, 5]), np.array([60.0, 60.0, 60.0])
    basis, used = column_generation(sizes, demand, 12, 0)
    assert np.allclose(used @ basis, demand) and abs(used.sum() - 60) < 0.1  # 3 + 4 + 5 fills 12


def test_plans_cover_every_length():
    rnd = np.random.default_rng(1)
    for slack in (0, 64):
        sizes = class_sizes(2048)
        demand = rnd.integers(0, 50, len(sizes))
        got = plan(sizes, demand, 2048, slack)
        assert (sum(p * x for p, x, _ in got) == demand).all()
        assert slack or all(p @ sizes <= 2048 for p, _, _ in got)


def test_query(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(0, None), (1, ""), (1, ""), (None, "a b c"), (2, "word " * 9000)]
    rows += [(i, " ".join(rnd.choices(["alpha", "be", "gamma!", "Straße"], k=int(rnd.paretovariate(0.8) * 20) % 5000))) for i in range(3, 400)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_cutting_stock_packing(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for d, x in rows:
        ids[d].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert r.doc_tokens in {len(x) for x in ids[r.doc_id]}
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        if len(ids[d]) == 1:
            end = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == end
                end += r.length
            assert end == len(ids[d][0])
    pad, total = padding(got)
    assert total == sum(len(x) for xs in ids.values() for x in xs)
    assert pad < max(2048, 0.01 * total)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op5_cutting_stock_packing(spark, f"{tmp_path}/e").count() == 0
