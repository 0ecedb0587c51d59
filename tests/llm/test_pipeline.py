import random

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from meterql.llm import quality_rules, secrets, sentencepiece_fst
from tests.llm.helpers import docs
from tests.llm.test_decontaminate import BENCH
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_simhash import brute_components, brute_fingerprint


def corpus():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "walk house tree river stone cloud".split() for b in "abcdefghij"]
    clean = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, clean(14)) for i in range(5)]
    texts = [clean(rng.randrange(30, 120)) for _ in range(30)]
    texts += [texts[0], texts[1] + ".", texts[2], None, "", "too short", "same " * 50, "Word### " * 40]
    texts += [clean(30) + " " + items[k][1] + " " + clean(20) for k in range(3)]
    texts += [clean(40) + ' token = "9742a250774262d69ad6a86100194ed53da5a0ef" ' + clean(5)]
    return texts, items


def brute(texts, items, ids):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(zip(ids, texts)))
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.ledger_sql()}) where kept").fetchall()}
    rows = [(i, t) for i, t in zip(ids, texts) if i in kept]
    roots = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    rows = [r for r, root in zip(rows, roots) if r[0] == root]
    rows = [r for r, c in zip(rows, brute_contamination([t for _, t in rows], items)) if not c[-1]]
    found = secrets.scan([t for _, t in rows], ["s"] * len(rows), secrets.default_forest())
    masked = [(i, secrets.redacted(t, [x[:2] for x in own if x[3] >= secrets.THRESHOLD])) for (i, t), own in zip(rows, found)]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.DEFAULT_MODEL)
    return sorted((i, library.encode(t)) for i, t in masked)


@pytest.fixture
def tables(spark, tmp_path):
    texts, items = corpus()
    ids = [3 * i for i in range(len(texts))]
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, items, ids


def test_against_brute_force(spark, tables):
    folder, texts, items, ids = tables
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    want = brute(texts, items, ids)
    assert got == want and 20 < len(want) < len(texts) - 8
    assert all(secrets.MASK in sentencepiece_fst.compiled(open(sentencepiece_fst.DEFAULT_MODEL, "rb").read()).decode(x) for i, x in got if i == ids[-1])


def test_stages_keep_the_columns(spark, tables):
    folder, *_ = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).schema.names == frame.columns
        assert stage(spark, frame.limit(0), folder).collect() == []


def test_a_repeated_row_stays_once(spark, tables):
    folder, texts, _, ids = tables
    frame = docs(spark, [texts[5], texts[5], texts[6]], [9, 9, 4])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, folder).collect()) == [4, 9]


def test_each_stage_begins_with_collected_heaps(spark, tables):
    folder, *_ = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, frame.limit(0), folder)
        assert full() > before
