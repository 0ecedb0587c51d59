import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from meterql.llm import chunks, ppm
from tests.llm.helpers import docs


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def contexts_of(texts, order, share):
    """The kept contexts, counted symbol by symbol."""
    rows = {}
    for t in texts:
        s = [256] * order + [*lower(t), 256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                rows.setdefault(tuple(s[i - k:i]), Counter())[s[i]] += 1
    whole = sum(rows.get((), Counter()).values())
    return {c: dict(r) for c, r in rows.items() if sum(r.values()) * share >= whole}


def brute_score(text, contexts, order):
    s, total = [256] * order + [*lower(text), 256], 0.0
    for i in range(order, len(s)):
        start = next(k for k in range(order, -1, -1) if tuple(s[i - k:i]) in contexts or k == 0)
        excluded = set()
        for k in range(start, -1, -1):
            row = {x: n for x, n in contexts.get(tuple(s[i - k:i]), {}).items() if x not in excluded}
            whole = sum(row.values()) + len(row)
            if s[i] in row:
                total += math.log10(row[s[i]] / whole)
                break
            if row:
                total += math.log10(len(row) / whole)
            excluded |= row.keys()
        else:
            total -= math.log10(257 - len(excluded))
    return total


def texts(seed=2):
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choice(["the", "The", "of", "été", "x1", "b"]) + rng.choice(["", "ing", "s"]) for _ in range(rng.randrange(1, 200)))
    return [None, "", "a", "Z" * 600, *(make() for _ in range(40))]


@pytest.mark.parametrize("order", [0, 2, 5])
def test_table_gives_the_escapes_and_exclusions(order):
    found = texts()
    contexts = contexts_of(found[::2], order, 200)
    got = ppm.PretrainedModel(contexts, order).log10(found)
    assert got == pytest.approx([brute_score(t, contexts, order) for t in found], rel=1e-5)


def test_a_model_without_counts_is_uniform():
    assert ppm.PretrainedModel({}, 3).log10(["ab"]) == pytest.approx([-3 * math.log10(257)], rel=1e-6)


def test_probabilities_of_the_next_symbol_sum_to_one():
    model = ppm.PretrainedModel(contexts_of(texts(), 3, 300), 3)
    assert (10.0 ** model.costs.reshape(-1, 257)).sum(1) == pytest.approx(1, rel=1e-4)


def test_adaptive_learns():
    once = ppm.adaptive_log10("the cat sat on the mat ")
    assert ppm.adaptive_log10("the cat sat on the mat " * 4) > 3 * once
    assert ppm.adaptive_log10(None) == pytest.approx(-math.log10(257))


def test_rows_against_brute_force(spark):
    found = texts()
    ids = list(range(len(found)))
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in ids]
    tokens = [[*lower(t).split(), None] for t in found]
    seen = Counter(w for own, use in zip(tokens, train) if use for w in own)
    n, v = sum(seen.values()), len(seen)
    contexts = contexts_of([t for t, use in zip(found, train) if use], ppm.ORDER, ppm.SHARE)
    for chunk, block in ((ppm.CHUNK_CHARS, ppm.BLOCK_WORDS), (900, 40)):
        got = sorted(ppm.scores(docs(spark, found, ids, ["key", "train", "score"]), chunk_chars=chunk, block_words=block).collect())
        assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [
            (i, not train[i], len(tokens[i]), sum(seen[w] > 0 for w in tokens[i]), n) for i in ids]
        assert [r.base_score for r in got] == pytest.approx([sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens[i]) for i in ids])
        assert [r.score for r in got] == pytest.approx([brute_score(t, contexts, ppm.ORDER) for t in found], rel=1e-5)


def test_repeated_rows_and_empty_table(spark):
    assert len(ppm.scores(docs(spark, ["a b", "a b", None], [1, 1, None])).collect()) == 3
    assert ppm.scores(docs(spark, [])).collect() == []


@pytest.mark.parametrize("order", [0, 1, 2, 5])
def test_every_context_of_the_corpus_counts(spark, order):
    rng = random.Random(5)
    found = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(600)) for _ in range(60)]
    ids = list(range(len(found)))
    train = [t for i, t in zip(ids, found) if zlib.crc32(str(i).encode()) % 7 != 2]
    contexts = contexts_of(train, order, 1 << 62)
    assert sum(len(t) + 1 for t in train) > 16384  # so that a share of all symbols leaves contexts out
    got = sorted(ppm.scores(docs(spark, found, ids), order=order, chunk_chars=9000, block_words=900).collect())
    assert [r.score for r in got] == pytest.approx([brute_score(t, contexts, order) for t in found], rel=1e-5)


def test_ids_beside_nulls_stay_exact(spark):
    big = (1 << 53) + 1
    got = ppm.scores(docs(spark, ["a b", None, "c"] + [""] * 50, [big, None, 3] + [4] * 50)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[:2] == [(0, 1), (3, 2)] and max(r.doc_id or 0 for r in got) == big


def test_distinct_counts_against_a_plain_count():
    rng = random.Random(3)
    grams = [rng.randrange(1 << 54) if rng.random() < 0.2 else rng.randrange(9) for _ in range(500)]
    train = [rng.randrange(2) for _ in grams]
    want = Counter()
    for g, t in zip(grams, train):
        want[g] += t
    got = ppm.distinct_counts(np.array(grams), np.array(train))
    assert list(zip(got[0].tolist(), got[1].tolist())) == sorted(want.items()) and len(ppm.distinct_counts(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_each_written_stage_begins_with_collected_heaps(spark, monkeypatch):
    said = []
    for name in ("release_heaps", "packed", "cut"):
        monkeypatch.setattr(ppm, name, lambda *a, name=name, f=getattr(ppm, name): (said.append(name), f(*a))[1])
    rows = ppm.scores(docs(spark, ["a b", "b c"]))
    assert said == ["release_heaps", "packed", *["release_heaps", "cut"] * 3, "release_heaps"]
    assert len(rows.collect()) == 2


def test_a_counting_task_holds_no_chunk_when_it_sends(spark):
    class Chunks:
        def mapInPandas(self, run, _):
            self.run = run
            return self

        select = groupBy = agg = lambda self, *_: self

    found = ["ab " * 400_000] * 3
    data = chunks._pack(pa.record_batch({"key": list(range(3)), "text": found, "train": [True, False, True]}))
    run = ppm.gram_counts(Chunks()).run
    list(run(iter([pd.DataFrame({"data": [data]})])))
    tracemalloc.start()
    try:
        sent = next(out := run(iter([pd.DataFrame({"data": [data]})])))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert sent["n"].sum() == 2 * (len(found[0]) + 1) and list(out) == []
    assert held < 1 << 20  # the packed texts have 3.6 million characters


def test_words_stand_as_objects_one_text_at_a_time():
    rng = random.Random(1)
    found = [" ".join(f"W{rng.randrange(500)}" for _ in range(1000)) for _ in range(200)] + [None, ""]
    tracemalloc.start()
    try:
        own = ppm._Vocabulary(found, 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert own.sizes.tolist() == [1001] * 200 + [1, 1] and len(own.ids) == 200_202 and len(own.order) == 501
    assert most < 30 * len(own.ids)


@pytest.mark.parametrize("blocks", [1, 7])
def test_costs_come_with_their_block(spark, blocks):
    data = ppm.packed(docs(spark, texts()).selectExpr("doc_id AS key", "text", "true AS train"))
    got = ppm.cost_table(data, 3, blocks)
    assert got._jdf.queryExecution().executedPlan().toString().count("InPandas") == 1  # one worker a task
    rows = got.toPandas()
    assert len(rows) and rows["block"].tolist() == ppm._gram_block(rows["gram"].to_numpy(), blocks).tolist()
