import random

import xxhash

from meterql.llm import simhash
from tests.llm.helpers import docs


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, max_bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(50)) for _ in range(400)) for _ in range(6)]
    out = [None, "", " \n", "One", "one", "one two", "A b C d", "a b c d", "x " * 5000]
    for b in base:
        out += [b, b.upper().lower(), b]
        for _ in range(8):
            words = b.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "new"
            out.append(" ".join(words))
    return out


def check(spark, bucket_pairs):
    found = texts()
    ids = [7 * (i * 37 % 101) for i in range(len(found))]
    prints = [brute_fingerprint(t) for t in found]
    got = simhash.near_duplicates(docs(spark, found, ids, ["fp", "fingerprint"]), bucket_pairs=bucket_pairs).collect()
    assert sorted(map(tuple, got)) == sorted(zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints)))


def test_against_brute_force(spark):
    check(spark, simhash.BUCKET_PAIRS)


def test_large_buckets_go_another_exact_way(spark):
    check(spark, 2)


def test_links_are_complete_and_single(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        prints |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(12)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (2, 128):
        assert sorted(map(tuple, simhash.links(frame, bucket_pairs=most).collect())) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)}


def test_one_of_each_keeps_columns_and_one_row(spark):
    frame = docs(spark, ["same text here now"] * 3 + ["other words stand alone", None], [5, 2, 2, 9, None], ["component_id"])
    got = simhash.one_of_each(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == [(False, 2), (False, 9), (True, None)]


def test_texts_that_share_an_id_are_not_lost(spark):
    a, b = "one long text about a house by a river", "quite another text about the stones on a hill"
    got = simhash.one_of_each(docs(spark, [a, b, a, a], [5, 5, 9, 5]))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(5, a), (5, b)]


def test_hot_fingerprints_go_by_broadcast(spark, monkeypatch):
    found = texts()
    frame = docs(spark, found + [""] * 60)
    want = sorted(map(tuple, simhash.near_duplicates(frame).collect()))
    monkeypatch.setattr(simhash, "HOT_ROWS", 2)
    assert sorted(map(tuple, simhash.near_duplicates(frame).collect())) == want and len(want) == len(found) + 60


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_few_edges_are_searched_in_one_task(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(16)
    found = simhash.components(edges)
    assert {r.root for r in found.collect()} == {0} and found.rdd.getNumPartitions() <= 2


def test_meetings_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    prints = []
    for flips in [*range(14)] * 12:
        p = rng.getrandbits(64)
        prints += [p, p ^ sum(1 << b for b in rng.sample(range(64), flips))]
    ones = lambda x: bin(x).count("1")
    meet = lambda x: ones(x) <= 12 and any(ones(x >> at & 0xFFFF) <= 1 for at in range(0, 64, 16))
    want = {(i, j) for j in range(len(prints)) for i in range(j) if meet(prints[i] ^ prints[j])}
    frame = spark.createDataFrame([(i, [p - (1 << 64) if p >> 63 else p]) for i, p in enumerate(prints)], "node long, fps array<long>")
    assert set(map(tuple, simhash.meetings(frame, 12).collect())) == want
    assert all((i, i + 1) in want for i in range(0, len(prints), 2) if ones(prints[i] ^ prints[i + 1]) <= 7)
