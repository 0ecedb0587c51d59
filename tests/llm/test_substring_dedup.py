import hashlib
import random
import re
from collections import Counter

import numpy as np

from meterql.llm import substring_dedup as sub
from tests.llm.helpers import docs


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "é", "dd", "e,", "漢"]) + str(rng.randrange(30))
    passages = [[word() for _ in range(rng.randrange(3, 60))] for _ in range(8)]
    out = [None, "", " \t\n", "a", "same " * 50, "u v w " * 3]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
        out.append("  ".join(parts) + "\n")
    return out + out[10:14]


def test_against_brute_force(spark):
    found = texts()
    for width, chunk, block in ((35, sub.CHUNK_CHARS, sub.BLOCK_WORDS), (5, 200, 50), (1, 500, 100)):
        got = sub.repeats(docs(spark, found, extra=["key", "chunk", "n_words"]), width=width, chunk_chars=chunk, block_words=block)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == [(i, *b) for i, b in enumerate(brute(found, width))]
        assert all(r.n_removed == sum(f.end - f.start for f in r.factors) for r in got.collect())


def test_each_factor_occurs_as_a_whole_elsewhere(spark):
    found = texts(9)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in found]
    got = sub.repeats(docs(spark, found), width=7, chunk_chars=400, block_words=200).collect()
    assert sum(len(r.factors) for r in got) > 40
    for r in got:
        for f in r.factors:
            factor = words[r.doc_id][f.start:f.end]
            there = sum(w[i:i + len(factor)] == factor for w in words for i in range(len(w) - len(factor) + 1))
            assert there >= 2


def test_longest_matches_and_greedy_factors_against_plain_loops():
    rng = random.Random(6)
    for _ in range(60):
        pieces = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 8))]
        want = []
        for p, a in enumerate(pieces):
            for i in range(len(a)):
                best = 0
                for q, b in enumerate(pieces):
                    for j in range(len(b)):
                        n = 0
                        while (p, i) != (q, j) and i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        best = max(best, n)
                want.append(best)
        ends = np.cumsum([len(a) for a in pieces])
        assert sub.longest_matches(np.array([x for a in pieces for x in a]), ends).tolist() == want
        for a, b in zip([0, *ends], ends):
            match, width = want[a:b], 3
            covered = {k for i, n in enumerate(match) if n >= width for k in range(i, i + n)}
            factors = sub.greedy_factors(match, width)
            assert {k for i, n in factors for k in range(i, i + n)} == covered and all(match[i] == n for i, n in factors)


def test_ids_beside_nulls_and_many_empty_texts(spark):
    big, text = (1 << 53) + 1, " ".join(str(i) for i in range(40))
    got = sub.repeats(docs(spark, [text, text, None] + [""] * 300, [big, None, 3] + list(range(10, 310)))).collect()
    assert len(got) == 303 and sorted((r.doc_id or 0, r.n_removed) for r in got if r.n_words) == [(0, 40), (big, 40)]


def test_repeated_rows_are_each_others_copies(spark):
    text = " ".join(str(i) for i in range(40))
    got = sub.repeats(docs(spark, [text, text], [4, 4])).collect()
    assert [r.n_removed for r in got] == [40, 40]


def test_empty_table(spark):
    assert sub.repeats(docs(spark, [])).collect() == []
