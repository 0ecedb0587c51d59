import math
import os
import random
import tracemalloc
import struct

import numpy as np
import pytest
import sentencepiece

from meterql.llm import sentencepiece_fst as fst
from tests.llm.helpers import docs

pytestmark = pytest.mark.skipif(not os.path.exists(fst.DEFAULT_MODEL), reason="no model file")
TEXTS = [None, "", " ", "a", " a ", "two  spaces\n\n\tand a tab", "héllo 漢字 😀", "▁ literal", "<s> <0x0A>", "don't!!! ***", "x" * 3000, "word " * 4000, "a", "\x00"]


def message(number, value):
    return bytes([number << 3 | 2]) + bytes([len(value)]) + value


def unigram_model():
    pieces = [("<unk>", 0, 2), ("▁", -2, 1), ("a", -3, 1), ("b", -3, 1), ("ab", -4, 1), ("▁a", -4.5, 1), ("bab", -5, 1), ("c", -6, 1), ("aba", -5.5, 1)]
    out = b"".join(message(1, message(1, t.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for t, s, k in pieces)
    return out + message(2, bytes([3 << 3, 1])) + message(3, message(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


def test_same_as_the_library_on_random_texts():
    machine, library = fst.Transducer(open(fst.DEFAULT_MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=fst.DEFAULT_MODEL)
    rng = random.Random(7)
    pool = [chr(i) for i in range(32, 127)] + list("\n\t  ▁éñß漢") + machine.texts[300:20000:37]
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]:
        ids = machine.encode(text).tolist()
        assert ids == library.encode(text)
        assert machine.decode(ids) == library.decode(ids)
        some = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(259, 32000) for _ in range(rng.randrange(9))]
        assert machine.decode(some) == library.decode(some)


def test_unigram_shortest_path():
    model = unigram_model()
    machine, library = fst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("ab abc") for _ in range(rng.randrange(1, 14)))
        assert machine.encode(text).tolist() == library.encode(text)


def paths(machine, lattice, state, last=fst.FALLBACK):
    """Every path from a state to the end of a part's lattice: (weight, labels)."""
    if state == lattice.last[0]:
        yield 0.0, ()
    for k in np.flatnonzero(lattice.source == state):
        weight = lattice.weight[k] + machine.after(np.array([last]), lattice.label[k : k + 1])[0]
        if weight < math.inf:
            for rest, tail in paths(machine, lattice, lattice.target[k], int(lattice.label[k])):
                yield weight + rest, (int(lattice.label[k]), *tail)


def test_shortest_path_is_the_least_of_all_paths_of_the_lattice():
    bpe, unigram = fst.Transducer(open(fst.DEFAULT_MODEL, "rb").read()), fst.Transducer(unigram_model())
    rng = random.Random(11)
    for _ in range(60):
        for machine, letters in ((bpe, "theringswat\x00"), (unigram, "abcz")):
            lattice = machine.compose([fst.META + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))])
            found = list(paths(machine, lattice, 0))
            distance, label, back = machine.shortest_paths(lattice)
            own, at = [], int(lattice.last[0])
            while at:
                own.insert(0, int(label[at]))
                at = int(back[at])
            assert abs(distance[-1] - min(w for w, _ in found)) < 1e-9 and any(tail == tuple(own) and abs(w - distance[-1]) < 1e-9 for w, tail in found)
            assert machine is unigram or len(found) == 1  # one path stands


def test_many_parts_at_once_are_as_each_alone():
    rng = random.Random(5)
    for model in (open(fst.DEFAULT_MODEL, "rb").read(), unigram_model()):
        texts = ["".join(rng.choice("ab ctheé\n漢") for _ in range(rng.choice([0, 3, 30, 700]))) for _ in range(60)]
        ids, ends = fst.Transducer(model).encode_all(texts)
        machine = fst.Transducer(model)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [machine.encode(t).tolist() for t in texts]


def test_normaliser_machine():
    drops, keeps = fst.Normaliser(True, True), fst.Normaliser(True, False)
    assert drops.write("  a  b ") == "▁a▁b" and drops.write("   ") == drops.write("") == "" and drops.write("a\n b") == "▁a\n▁b"
    assert keeps.write(" a  b") == "▁▁a▁▁b" and keeps.write("") == ""


def test_ids_beside_nulls_stay_exact(spark):
    big = (1 << 53) + 1
    rows = fst.encode(docs(spark, ["ab", None, "cd"], [big, None, 1])).collect()
    assert sorted((r.doc_id or 0, r.n_ids > 0) for r in rows) == [(0, False), (1, True), (big, True)]


def test_rows_and_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=fst.DEFAULT_MODEL)
    frame = docs(spark, TEXTS, [*range(len(TEXTS) - 2), 3, 3], ["ids"])
    found = fst.encode(frame)
    rows = found.collect()
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == sorted((d, library.encode(t or "")) for d, t in zip([*range(len(TEXTS) - 2), 3, 3], TEXTS))
    assert all(r.round_trip == ("▁" not in (TEXTS[r.doc_id] or "")) for r in rows if r.doc_id != 3)
    back = {r.doc_id: r.text for r in fst.decode(found).collect()}
    assert back[6] == TEXTS[6] and back[0] == "" and back[5] == TEXTS[5]


def test_empty_table(spark):
    assert fst.encode(docs(spark, [])).collect() == []


def test_memory_stays_small_over_many_new_parts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(60_000))
    with open(fst.DEFAULT_MODEL, "rb") as f:
        machine = fst.Transducer(f.read())
    machine.encode("warm up")
    tracemalloc.start()
    try:
        machine.encode(text)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
