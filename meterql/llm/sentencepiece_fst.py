r"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three transducers:

* `Normaliser`: states start, word and gap over runs of spaces and of other
  characters; its arcs write U+2581 for white space and the dummy prefix, and
  drop the spaces that the model drops;
* `Pieces`: a trie whose states are beginnings of pieces; from a piece's last
  state an arc without input writes the piece's id at its weight and returns to
  the root;
* `Fallback`: an arc for each character that no piece spells; it writes the
  character's UTF-8 bytes as byte pieces (or the unknown piece).

They are composed with the input (`compose`): all places of many parts of text walk
through the trie at once, character by character, and leave the arcs of a lattice.
In the tropical semiring weights add along a path and the least path counts; the
shortest path to each state is found place by place, again for many parts at once
(`shortest_paths`). For a unigram model an arc
weighs minus its score, and states are positions. For a BPE model a state is a
position with the piece that ends there, and the arc that follows piece a with
piece b weighs 0 if the merges leave a|b standing when they are applied to the
two alone, else infinity. A merge never looks past the two symbols it joins, so a
sequence is what the merges make of a text exactly if every neighbouring pair in
it stands; hence one path of weight 0 exists for each prefix, one state of each
position is at a finite distance, and the shortest path is the library's result.
Pair weights are computed when a path first meets them and kept in a table of fixed size.

Where no piece has U+2581 behind another character, the lattice falls apart at
each start of U+2581 runs and at line ends that no piece spells; those parts are
solved one by one and the solutions of recent ones are kept, also in bounded memory.

Decoding runs the inverse: pieces to their text, byte runs through UTF-8 (a
broken byte gives U+FFFD), U+2581 to a space, without the dummy prefix.

Defined edge cases: a null or empty text has no ids and decodes to an empty
text; U+2581 in a text comes back as a space (so round_trip is false); texts of
any length are whole; of equally light unigram paths the one with the longer last
piece counts; repeated rows and rows without an id each get a row; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.common import by_rows

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PARTS_KEPT, PAIR_BITS, CHARS_SOLVED, CHARS_SPLIT = 400_000, 20, 1 << 17, 1 << 20
#: The label of arcs of characters that no piece spells, and of the start.
FALLBACK = -1
_RUNS = re.compile(" +|[^ ]+")
#: What an unknown character costs beyond the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Normaliser:
    """The identity rule's machine: arcs[state, whether the run is of spaces] = (next state, what is written before the run's text)."""

    START, WORD, GAP = range(3)

    def __init__(self, dummy_prefix: bool, extra_spaces_go: bool) -> None:
        self.arcs = {
            (self.START, False): (self.WORD, META if dummy_prefix else ""), (self.START, True): (self.START, ""),
            (self.WORD, False): (self.WORD, ""), (self.WORD, True): (self.GAP, ""),
            (self.GAP, False): (self.WORD, META), (self.GAP, True): (self.GAP, ""),
        }
        self.keeps_spaces = None if extra_spaces_go else (META if dummy_prefix else "")

    def write(self, text: str) -> str:
        if self.keeps_spaces is not None:  # every state then has the same arcs: a character for a character
            return (self.keeps_spaces + text).replace(" ", META) if text else ""
        state, out, arcs = self.START, [], self.arcs
        for run in _RUNS.findall(text):
            space = run[0] == " "
            state, prefix = arcs[state, space]
            if not space:
                out.append(prefix + run)
        return "".join(out)


class Pieces:
    """The trie of all pieces, as arrays.

    States are numbered from the root, 0; characters are numbered as the pieces use them, 0 for all others.
    Transitions stand in a hash table by (state, character); `piece[state]` is the id that ends in a state, or FALLBACK.
    """

    def __init__(self, ids: dict[str, int]) -> None:
        letters = sorted(set("".join(ids)))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_letters = len(letters) + 1
        edges, piece = {}, [FALLBACK]
        for text, i in ids.items():
            state = 0
            for c in self.letter[[ord(c) for c in text]].tolist():
                key = state * self.n_letters + c
                state = edges.get(key, 0)
                if not state:
                    state = edges[key] = len(piece)
                    piece.append(FALLBACK)
            piece[state] = i
        self.piece = np.array(piece, np.int64)
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for key, state in edges.items():
            slot = int(_slot(np.int64(key), self.bits))
            while self.keys[slot] != -1:
                slot = slot + 1 & (1 << self.bits) - 1
            self.keys[slot], self.next[slot] = key, state

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is none."""
        key = state * self.n_letters + letter
        slot = _slot(key, self.bits)
        out, left = np.zeros(len(key), np.int64), np.arange(len(key))
        while len(left):
            there = self.keys[slot]
            same = there == key
            out[left[same]] = self.next[slot[same]]
            on = ~same & (there != -1)
            left, key, slot = left[on], key[on], slot[on] + 1 & (1 << self.bits) - 1
        return out


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Lattice:
    """The composition of the pieces and the fallback with parts of text: a state for each place in a part, its end included.

    Arcs (source, target, label, weight) are ordered by the target's place in its part, so those of place k follow those before it.
    """

    first: np.ndarray  # state of each part's beginning
    last: np.ndarray
    source: np.ndarray
    target: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    steps: np.ndarray  # where the arcs of each place begin


class PairWeights:
    """Of a BPE model: the tropical weight of one piece after another, 0 or infinity."""

    def __init__(self, score: dict[str, float]) -> None:
        self.score = score
        self._histories: dict[str, tuple[bool, list, list]] = {}

    def _history(self, piece: str) -> tuple[bool, list, list]:
        """What the merges do to a piece alone, best score first, then leftmost: whether they make it whole,
        and after each merge its score with the rightmost and with the leftmost symbol then."""
        known = self._histories.get(piece)
        if known is None:
            symbols, rights, lefts = list(piece), [], []
            while len(symbols) > 1:
                score, where = max((self.score.get(symbols[i] + symbols[i + 1], -math.inf), -i) for i in range(len(symbols) - 1))
                if score == -math.inf:
                    break
                symbols[-where : 2 - where] = [symbols[-where] + symbols[1 - where]]
                rights.append((score, symbols[-1]))
                lefts.append((score, symbols[0]))
            stop = [(-math.inf, "")]
            known = self._histories[piece] = (len(symbols) == 1, rights + stop, lefts + stop)
        return known

    def __call__(self, left: str, right: str) -> float:
        """0 if no merge across the pair comes up while both sides are merged; left is empty at the start."""
        right_whole, _, lefts = self._history(right)
        if not left or not right_whole:
            return 0.0 if right_whole else math.inf
        _, rights, _ = self._history(left)
        a, b, across = left[-1], right[0], self.score.get(left[-1] + right[0], -math.inf)
        i = j = 0
        while True:
            (of_left, new_a), (of_right, new_b) = rights[i], lefts[j]
            if across > of_left and across >= of_right:
                return math.inf
            if of_left >= of_right:
                if of_left == -math.inf:
                    return 0.0
                i += 1
                if len(new_a) == len(a):
                    continue
                a = new_a
            else:
                j += 1
                if len(new_b) == len(b):
                    continue
                b = new_b
            across = self.score.get(a + b, -math.inf)


class Transducer:
    """A compiled model; encode and decode whole texts."""

    def __init__(self, model: bytes) -> None:
        self.kinds: list[int] = []
        self.texts: list[str] = []
        scores: list[float] = []
        self.model_type, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, extra_spaces_go, escape, charsmap = True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.texts.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.model_type, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                charsmap = own.get(2, b"")
                self.dummy_prefix, extra_spaces_go, escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if charsmap or not escape or self.model_type not in (UNIGRAM, BPE) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only unigram and BPE models with the identity rule and without user-defined or unused pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.special = np.array(self.kinds) != NORMAL
        self.normaliser, self.pieces = Normaliser(self.dummy_prefix, extra_spaces_go), Pieces(ids)
        #: Weights of piece arcs (the last one: of a fallback arc); and of an arc after another.
        self.fallback_weight = 0.0 if self.model_type == BPE else UNKNOWN_PENALTY - min((scores[i] for i in ids.values()), default=0.0)
        self.weights = np.array([*([0.0] * len(scores) if self.model_type == BPE else [-x for x in scores]), self.fallback_weight])
        self.pair_weight = PairWeights({t: scores[i] for t, i in ids.items()}) if self.model_type == BPE else None
        self._pair_keys, self._pair_values = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS)
        alphabet = set("".join(ids))
        cuts_at_meta = not any(META in t.lstrip(META) for t in ids)
        # A line end that no piece spells stands alone, so texts share more parts.
        ends = "" if "\n" in alphabet else "\n"
        self.part = re.compile(f"{META}+[^{META}{ends}]*|[^{META}{ends}]+" + (f"|{ends}" if ends else "")) if cuts_at_meta else re.compile("(?s).+")
        self.forget()

    def forget(self) -> None:
        """Drops the kept solutions."""
        self._parts: dict[str, int] = {}
        self._ids, self._ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def compose(self, parts: list[str]) -> Lattice:
        """The lattice of parts, all walked at once, one character deeper each time."""
        sizes = np.array([len(p) for p in parts], np.int64)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.pieces.letter[codes].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        place = np.arange(len(codes)) - starts[owner]  # of each character in its part
        room = sizes[owner] - place
        sources, lengths, labels = [], [], []
        at, state, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        alone = np.zeros(len(codes), bool)
        while len(at):
            state = self.pieces.step(state, letters[at + depth])
            depth += 1
            piece = self.pieces.piece[state]
            ends = (state > 0) & (piece != FALLBACK)
            sources.append(at[ends])
            lengths.append(np.full(len(sources[-1]), depth))
            labels.append(piece[ends])
            if depth == 1:
                alone[at[ends]] = True
            on = (state > 0) & (room[at] > depth)
            at, state = at[on], state[on]
        sources.append(np.flatnonzero(~alone))
        lengths.append(np.ones(len(sources[-1]), np.int64))
        labels.append(np.full(len(sources[-1]), FALLBACK))
        source, length, label = map(np.concatenate, (sources, lengths, labels))
        to = place[source] + length
        # By place, then by part; into one state, long arcs before short ones.
        order = np.lexsort((source, to))
        order = order[np.lexsort((-length[order], owner[source[order]], to[order]))] if self.pair_weight is None else order
        source, length, label, to = source[order], length[order], label[order], to[order]
        node = np.arange(len(codes)) + owner  # each part has one state more than characters
        return Lattice(starts + np.arange(len(parts)), starts + sizes + np.arange(len(parts)), node[source], node[source] + length, label, self.weights[label],
                       np.searchsorted(to, np.arange(1, int(sizes.max(initial=0)) + 2)))

    def after(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weights of pieces after others; FALLBACK stands for the start and for characters outside the pieces. The last ones met are kept."""
        if self.pair_weight is None:
            return np.zeros(len(piece))
        key = (last + 1) * (len(self.texts) + 1) + piece + 1
        slot = _slot(key, PAIR_BITS)
        out = self._pair_values[slot]
        missing = np.flatnonzero(self._pair_keys[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            text = lambda i: "" if i < 0 else self.texts[i]
            n = len(self.texts) + 1
            values = np.array([self.pair_weight(text(k // n - 1), text(k % n - 1)) if k % n else 0.0 for k in new.tolist()])
            out[missing] = values[back]
            slots = _slot(new, PAIR_BITS)
            self._pair_keys[slots], self._pair_values[slots] = new, values
            clash = self._pair_keys[slots] != new  # of keys that share a slot the last one is kept, with its value
            if clash.any():
                self._pair_keys[slots[clash]] = -1
        return out

    def shortest_paths(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, label, source) of each state along the path of least weight that leads to it, place by place."""
        n = int(lattice.last[-1]) + 1 if len(lattice.last) else 0
        distance, label, back = np.full(n, math.inf), np.full(n, FALLBACK), np.zeros(n, np.int64)
        distance[lattice.first] = 0.0
        for a, b in zip(lattice.steps[:-1].tolist(), lattice.steps[1:].tolist()):
            source, target, piece = lattice.source[a:b], lattice.target[a:b], lattice.label[a:b]
            total = distance[source] + lattice.weight[a:b] + self.after(label[source], piece)
            if self.pair_weight is None:  # the first of the least arcs into each state
                least = np.full(0, 0.0)
                fresh = np.flatnonzero(np.diff(target, prepend=-1))
                least = np.repeat(np.minimum.reduceat(total, fresh), np.diff(fresh, append=len(target))) if len(fresh) else least
                best = np.flatnonzero(total == least)
                best = best[np.diff(target[best], prepend=-1) != 0]
            else:  # at most one arc into a state is of finite weight
                best = np.flatnonzero(total < math.inf)
            distance[target[best]], label[target[best]], back[target[best]] = total[best], piece[best], source[best]
        return distance, label, back

    def _solve(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in order, where each part's end)."""
        lattice = self.compose(parts)
        _, label, back = self.shortest_paths(lattice)
        owners, pieces, steps = [], [], []
        owner, at = np.arange(len(parts)), lattice.last
        while len(at):  # from each part's end, an arc back at a time
            owners.append(owner)
            pieces.append(label[at])
            steps.append(np.column_stack([back[at], at]))
            at = back[at]
            on = at > lattice.first[owner]
            owner, at = owner[on], at[on]
        owner, piece, span = np.concatenate(owners), np.concatenate(pieces), np.concatenate(steps)
        order = np.lexsort((span[:, 0],))
        owner, piece, span = owner[order], piece[order], span[order]
        if (piece == FALLBACK).any():
            out, ends = [], []
            bounds = np.searchsorted(owner, np.arange(len(parts) + 1))
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                own: list[int] = []
                for p, end in zip(piece[a:b].tolist(), (span[a:b, 1] - lattice.first[k]).tolist()):
                    if p != FALLBACK:
                        own.append(p)
                    elif self.byte_fallback:
                        own += [self.bytes[x] for x in parts[k][end - 1].encode("utf-8", "surrogatepass")]
                    elif not own or own[-1] != self.unknown:  # the library joins neighbouring unknown characters
                        own.append(self.unknown)
                out += own
                ends.append(len(out))
            return np.array(out, np.int32), np.array(ends, np.int64)
        return piece.astype(np.int32), np.searchsorted(owner, np.arange(len(parts)), "right")

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's end)."""
        split = [self.part.findall(self.normaliser.write(t or "")) for t in texts]
        if len(self._parts) > PARTS_KEPT:
            self.forget()
        known = self._parts
        new = [p for p in dict.fromkeys(p for parts in split for p in parts) if p not in known]
        # Parts of like length together, so that long ones don't hold up the short.
        new.sort(key=len)
        at = 0
        while at < len(new):
            end, chars = at + 1, len(new[at])
            while end < len(new) and chars + len(new[end]) <= CHARS_SOLVED and len(new[end]) <= 2 * len(new[at]) + 8:
                chars += len(new[end])
                end += 1
            ids, ends = self._solve(new[at:end])
            self._ends.append(ends + self._ends[-1][-1])
            self._ids.append(ids)
            for p in new[at:end]:
                known[p] = len(known)
            at = end
        self._ids, self._ends = [np.concatenate(self._ids)], [np.concatenate(self._ends)]
        bounds = self._ends[0]
        which = np.fromiter((k for parts in split for k in map(known.__getitem__, parts)), np.int64, sum(map(len, split)))
        first, size = bounds[which], bounds[which + 1] - bounds[which]
        total = np.cumsum(size)
        take = np.repeat(first - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
        ends = np.cumsum([len(parts) for parts in split], dtype=np.int64)
        return self._ids[0][take], np.concatenate([[0], total])[ends] if len(ends) else ends

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        kinds, texts = self.kinds, self.texts
        first = int(ids[0])
        if not self.special[ids].any():
            text = "".join(map(texts.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if kinds[i] == BYTE:
                    run.append(int(texts[i][3:5], 16))
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                if kinds[i] != CONTROL:
                    out.append(" ⁇ " if i == self.unknown else texts[i])
            if run:
                out.append(_utf8(bytes(run)))
            text = "".join(out)
        text = text.replace(META, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " and kinds[first] == NORMAL else text


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out = []
        while run:  # one U+FFFD for each byte that starts no character
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[:size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            run = run[size:]
        return "".join(out)


_compiled: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, compiled once in each Python worker."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Transducer(model)
    return _compiled[name]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(key, ids, n_ids, n_byte_ids, decoded_sha256, round_trip) per row.

    The driver reads the model (a vocabulary file of fixed size) and broadcasts it.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))

    def run(texts: list[str | None]) -> dict[str, list]:
        machine = compiled(model.value)
        is_byte = np.array(machine.kinds) == BYTE
        flat, ends = machine.encode_all(texts)
        ids = np.split(flat, ends[:-1])
        back = [machine.decode(i) for i in ids]
        return {
            "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32())), "n_ids": [len(i) for i in ids], "n_byte_ids": [int(is_byte[i].sum()) for i in ids],
            "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
            "round_trip": [b == (t or "") for b, t in zip(back, texts)],
        }

    # A worker that goes on to other work keeps the compiled model, not the solutions.
    return by_rows(slim, run, "ids array<int>, n_ids long, n_byte_ids long, decoded_sha256 string, round_trip boolean", CHARS_SPLIT, done=lambda: compiled(model.value).forget())


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(key, text) of encoded rows."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        machine = compiled(model.value)
        return pd.Series([machine.decode([] if x is None else x) for x in column], dtype=object)

    return encoded.select(F.col(key), text_of(F.col(ids)).alias("text"))
