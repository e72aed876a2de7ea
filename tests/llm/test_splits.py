"""Row numbers hold when files are split in another way in the middle of a query, as after a change of executors."""

import random

import pytest
from haruspex import storage
from haruspex.llm.decontaminate import contamination
from haruspex.llm.dedup_simhash import keep_one
from haruspex.llm.dedup_suffix import op2_prefix_free_dedup
from haruspex.llm.secrets import op4_blob_ledger_secret_scan, redact
from test_decontaminate import brute as contaminated
from test_dedup_suffix import brute as removed
from test_secrets import brute as secrets
from test_simhash import brute_groups, brute_print


@pytest.fixture
def shifting(spark, monkeypatch):
    """Every table that is written changes how files are split from then on."""
    plain, n = storage.fresh_path, [0]

    def fresh_path(session, name):
        n[0] += 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str([64, 2, 17, 5][n[0] % 4]))
        return plain(session, name)

    monkeypatch.setattr(storage, "fresh_path", fresh_path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    yield
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdefg", k=6)) for _ in range(300)]
    texts = [" ".join(rnd.choices(vocabulary, k=60)) for _ in range(120)]
    rows = [(i, rnd.choice(["", "password=hunter2%d " % i]) + rnd.choice(texts), "c") for i in range(200)]
    path = f"{tmp_path_factory.mktemp('splits')}"
    spark.createDataFrame(rows, "doc_id long, text string, _rid string").repartition(2).write.option("parquet.block.size", 4096).parquet(f"{path}/documents.parquet")
    return path, rows


def test_splits_do_change(spark, documents, shifting):
    read = lambda: spark.read.parquet(f"{documents[0]}/documents.parquet").rdd.getNumPartitions()
    before = read()
    storage.fresh_path(spark, "x")
    assert read() != before


def test_op2(spark, documents, shifting):
    path, rows = documents
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in op2_prefix_free_dedup(spark, path).collect())
    assert got == sorted((d, n - len(kept), len(spans)) for d, n, kept, spans in removed([r[:2] for r in rows], 200))
    assert sum(x[1] for x in got) > 10_000


def test_op4_and_redact(spark, documents, shifting):
    path, rows = documents
    got = {r.doc_id: r.n_assign for r in op4_blob_ledger_secret_scan(spark, path).collect()}
    assert got == {d: sum(k == "assign" for k, *_ in secrets(t)) for d, t, _ in rows} and sum(got.values()) > 50
    clean = redact(spark.read.parquet(f"{path}/documents.parquet"))
    assert clean.columns == ["doc_id", "text", "_rid"] and clean.where("contains(text, 'hunter')").count() == 0
    assert clean.where("startswith(text, '[assign]')").count() == sum(got.values())


def test_keep_one(spark, documents, shifting):
    path, rows = documents
    left = keep_one(spark.read.parquet(f"{path}/documents.parquet")).collect()
    groups = brute_groups({d: brute_print(t) for d, t, _ in rows})
    assert len(left) == len(set(groups.values())) == len({groups[r.doc_id] for r in left}) and {r._rid for r in left} == {"c"}


def test_op7_in_blocks(spark, documents, shifting):
    path, rows = documents
    items = [(i, " ".join(rows[i][1].split()[3:25])) for i in range(6)]
    found = contamination(spark.read.parquet(f"{path}/documents.parquet"), spark.createDataFrame(items, "item_id long, text string"), block_words=30)
    assert sorted(map(tuple, found.collect()), key=str) == contaminated([r[:2] for r in rows], items)


def test_keep_one_by_doc_id(spark, documents, shifting):
    path, rows = documents
    groups = brute_groups({d: brute_print(t) for d, t, _ in rows})
    left = keep_one(spark.read.parquet(f"{path}/documents.parquet"), first="doc_id").collect()
    assert sorted(r.doc_id for r in left) == sorted(set(groups.values()))
