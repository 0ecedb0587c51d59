import hashlib
import random
import re

import numpy as np

from meterql.llm import decontaminate as dec
from meterql.llm.fm_index import FMIndex
from tests.llm.helpers import docs

BENCH = "item_id long, text string"


def brute(texts, items, window=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = [(i, w[k:k + window]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    named |= {str(i)} if i is not None else set()
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def case(seed=5):
    rng = random.Random(seed)
    vocab = ["ab", "cé", "d1", "e", "f", "ñu"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 14])))) for i in range(25)] + [(100, None), (3, "again Ab"), (None, "no id here")]
    texts = [None, "", "--- !", "again ab", "no ID here", items[10][1] or "x"]
    for _ in range(40):
        parts = [rng.choice(vocab + ["zz", "Q."]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), (rng.choice(items)[1] or "").upper().replace("É", "é").replace("Ñ", "ñ"))
        texts.append(", ".join(parts))
    return texts, items


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 4, 400)
    symbols[-1] = 0
    index = FMIndex(symbols, 3)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    rows, places = index.find(phrases)
    want = sorted((r, i) for r, p in enumerate(phrases) for i in range(398) if (symbols[i:i + 3] == p).all())
    assert sorted(zip(rows.tolist(), places.tolist())) == want


def test_against_brute_force(spark):
    texts, items = case()
    want = brute(texts, items)
    for shard, block in ((dec.SHARD_WORDS, dec.BLOCK_WORDS), (37, 20)):
        found = dec.contamination(docs(spark, texts, extra=["items", "n_words"]), spark.createDataFrame(items, BENCH), shard_words=shard, block_words=block)
        got = sorted(map(tuple, dec.digest(found).collect()))
        assert got == [(i, *w) for i, w in enumerate(want)]


def test_stage_keeps_clean_documents_whole(spark):
    texts, items = case()
    frame = docs(spark, texts, extra=["clean"])
    got = dec.clean_only(frame, spark.createDataFrame(items, BENCH))
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, w in enumerate(brute(texts, items)) if not w[-1]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCH)
    assert dec.contamination(docs(spark, []), none).collect() == []
    assert [r.n_hit for r in dec.contamination(docs(spark, ["a b"]), none).collect()] == [0]


def test_ids_beside_nulls_and_several_blocks(spark):
    big, words = (1 << 53) + 1, "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(i, f"{words} {i}") for i in range(6)], BENCH)
    frame = docs(spark, [f"x {words} 3 y", "clean", None], [big, None, 7])
    got = dec.contamination(frame, bench, block_words=5).collect()
    assert sorted((r.doc_id or 0, r.n_hit, len(r.items)) for r in got) == [(0, 0, 0), (7, 0, 0), (big, 12, 6)]
