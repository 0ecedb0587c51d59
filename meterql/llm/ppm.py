r"""LM scoring by prediction by partial matching over bytes.

The model is a byte-context trie of order up to `order` with escape method C
and full symbol exclusion. A symbol is predicted from the longest context that
the trie has; where it never followed, an escape is paid and the next shorter
context predicts among the symbols not yet excluded, down to a uniform choice.
Texts begin in a context of start marks and close with an end symbol, so the
probabilities of all texts sum to one at most.

Two uses: `adaptive_log10` learns within one document as it goes;
`PretrainedModel` holds given counts, `scores` those of a corpus. Since every occurrence of a
context is one of its suffix too, the symbols excluded on an escape are just
those of the context left behind. A pretrained model's costs and moves are thus
a finite table of contexts by symbols, and texts are
scored many at a time, step by step; long ones in pieces that each begin with
their true context.

The counts are of every training document, and no context is left out. `gram_costs`
turns the counts of all grams that end their contexts alike into the costs of
these grams; each chunk asks for its distinct grams' costs once, by hash block,
so the model is as large as the corpus makes it and stands nowhere as a whole.
Only the counts after contexts of at most one symbol go to every task, which
are 257 * 258 numbers at most.

`scores` adds the unigram base score over words `[^\x20\x09-\x0D]+` and one end
token a text. Each chunk asks for the counts of its distinct words once, by
hash (128 bits, of which the upper half picks the block), so neither a frequent
word nor a hot source gathers in a task.

Defined edge cases: a null text is empty, has one token (its end) and a score;
A-Z are lower-cased for words and bytes alike; repeated rows count and are
scored row by row; a null doc_id trains like an empty one's remainder says;
without training documents every symbol is equally likely.

An executor's memory holds its JVM's heap beside its Python workers. So each
written stage begins by having the heaps collected, a worker keeps of a chunk
only what it has yet to send, and gives back what it no longer uses.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.chunks import BLOCK_WORDS, CHUNK_CHARS, n_blocks, packed, unpack
from meterql.llm.common import LOWER, crc_mod, cut, release, release_heaps, slices, utf8

ORDER, SHARE = 5, 1 << 62  # a context is kept from one in `SHARE` of all symbols: all are
NEAR = 2  # last symbols of a context by which its grams are gathered
MARK, SYMBOLS, WIDTH = 256, 257, 9  # the mark starts contexts and ends texts; bits of a symbol in a gram
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 7, 2
LANE, GRAMS_HELD, GROUP_GRAMS = 256, 1_000_000, 50_000
#: Characters whose grams stand in memory one by one; of the rest of a chunk only the distinct ones do.
PIECE_CHARS = 1 << 20


def symbols_of(texts: Iterable[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(stream, sizes): for each text its start marks, bytes and end; sizes count the predicted symbols."""
    raw = [utf8(t).translate(LOWER) for t in texts]
    sizes = np.array([len(b) + 1 for b in raw], np.int64)
    stream = np.full(int((sizes + order).sum()), MARK, np.uint16)
    at = 0
    for b in raw:
        stream[at + order : at + order + len(b)] = np.frombuffer(b, np.uint8)
        at += order + len(b) + 1
    return stream, sizes


def gram_stream(texts: Iterable[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, sizes): the (context, symbol) grams of texts in order, packed into integers; sizes count each text's."""
    stream, sizes = symbols_of(texts, order)
    n = max(0, len(stream) - order)
    block, have, keys, done = stream.astype(np.int64), 1, np.zeros(n, np.int64), 0
    while True:  # blocks of 1, 2, 4 ... symbols make up order + 1 of them
        if order + 1 & have:
            keys <<= WIDTH * have
            keys |= block[done : done + n]
            done += have
        if 2 * have > order + 1:
            break
        longer = block[: len(block) - have] << WIDTH * have
        longer |= block[have:]
        block, have = longer, 2 * have
    starts = np.cumsum(sizes + order) - sizes - order
    use = np.zeros(len(stream) + 1, np.int64)
    np.add.at(use, starts, 1)
    np.add.at(use, starts + sizes, -1)
    return keys[np.cumsum(use)[: len(keys)] > 0], sizes


def distinct_counts(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams in order, sums of their counts); counts of 0 or 1 ride in the lowest bit, so one sort of numbers does."""
    key = np.sort(grams << 1 | counts)
    gram = key >> 1
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    ones = np.concatenate([[0], np.cumsum(key & 1)])
    return gram[first], ones[np.append(first[1:], len(gram))] - ones[first]


def distinct_grams(texts: list[str | None], order: int) -> np.ndarray:
    """The distinct grams of texts in order, a piece of the texts at a time."""
    found = []
    for a, b in slices(texts, PIECE_CHARS):
        keys = np.sort(gram_stream(texts[a:b], order)[0])
        found.append(keys[np.flatnonzero(np.diff(keys, prepend=-1))])
    keys = np.sort(np.concatenate(found))
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def adaptive_log10(text: str | None, order: int = ORDER) -> float:
    """log10 probability of a text by a model that starts empty and learns each symbol after it is paid for."""
    counts: dict[bytes | tuple, dict[int, int]] = {}
    history: tuple[int, ...] = (MARK,) * order
    total = 0.0
    for symbol in [*utf8(text).translate(LOWER), MARK]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            own = {s: n for s, n in counts.get(history[order - k :], {}).items() if s not in excluded}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if symbol in own:
                total += math.log10(own[symbol] / whole)
                break
            total += math.log10(len(own) / whole)
            excluded |= own.keys()
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for k in range(order + 1):
            row = counts.setdefault(history[order - k :], {})
            row[symbol] = row.get(symbol, 0) + 1
        history = (*history[1:], symbol) if order else ()
    return total


class PretrainedModel:
    """contexts: {context (tuple of symbols, oldest first): {symbol: count}}; with a context, its suffixes and prefixes are in."""

    def __init__(self, contexts: dict[tuple[int, ...], dict[int, int]], order: int = ORDER) -> None:
        names = sorted(contexts | {(): contexts.get((), {})}, key=len)
        number = {c: i for i, c in enumerate(names)}
        self.order, n = order, len(names)
        moves, costs = np.zeros((n, SYMBOLS), np.int32), np.zeros((n, SYMBOLS), np.float32)
        below = np.zeros((n, SYMBOLS))  # log10 of what follows the escape from a context
        longer: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for c in names[1:]:
            longer.setdefault(c[:-1], []).append((c[-1], number[c]))
        counts = np.zeros((n, SYMBOLS), np.int64)
        for c, row in contexts.items():
            counts[number[c], list(row)] = list(row.values())
        for i, c in enumerate(names):
            seen = counts[i] > 0
            if i == 0:
                below[i] = -math.log10(max(1, SYMBOLS - int(seen.sum())))
            else:
                up = number[c[1:]]
                moves[i] = moves[up]
                left = np.where(seen, 0, counts[up])
                distinct = int((left > 0).sum())
                if distinct:
                    whole = int(left.sum()) + distinct
                    below[i] = np.where(left > 0, np.log10(np.maximum(left, 1) / whole), math.log10(distinct / whole) + below[up])
                else:
                    below[i] = below[up]
            for symbol, to in longer.get(c, ()):
                moves[i, symbol] = to
            whole = int(counts[i].sum()) + int(seen.sum())
            costs[i] = np.where(seen, np.log10(np.maximum(counts[i], 1) / whole), math.log10(seen.sum() / whole) + below[i]) if whole else below[i]
        self.moves, self.costs = moves.ravel(), costs.ravel()

    def log10(self, texts: Iterable[str | None]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        order = self.order
        stream, sizes = symbols_of(texts, order)
        if not len(sizes):
            return np.zeros(0)
        starts = np.cumsum(sizes + order) - sizes - order
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        base, length = starts[owner] + nth * LANE, np.minimum(LANE, sizes[owner] - nth * LANE)
        by_length = np.argsort(-length, kind="stable")
        base, length, owner = base[by_length], length[by_length], owner[by_length]
        state, total = np.zeros(len(base), np.int64), np.zeros(len(base))
        for k in range(order):
            state = self.moves[state * SYMBOLS + stream[base + k]].astype(np.int64)
        going = len(base) - np.searchsorted(length[::-1], np.arange(int(length[0])), "right")
        for k, n in enumerate(going.tolist()):
            at = state[:n] * SYMBOLS + stream[base[:n] + order + k]
            total[:n] += self.costs[at]
            state[:n] = self.moves[at]
        return np.bincount(owner, total, len(sizes))


def _released[T](result: T) -> T:
    """The result, once what its making has left unused is given back."""
    release()
    return result


def _written(df: DataFrame) -> DataFrame:
    """df cut, its stages beginning with collected heaps."""
    release_heaps(df.sparkSession)
    return cut(df)


def _piece_counts(texts: list[str | None], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    grams, sizes = gram_stream(texts, order)
    return distinct_counts(grams, np.repeat(train, sizes))


def _added(keys: np.ndarray, counts: np.ndarray, data: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and their counts, with those of a packed chunk added."""
    rows = unpack(data)
    texts, train = rows["text"].tolist(), rows["train"].to_numpy(np.int64)
    found = [(keys, counts), *(_piece_counts(texts[a:b], train[a:b], order) for a, b in slices(texts, PIECE_CHARS))]
    every, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    del rows, texts, found
    by = np.argsort(every, kind="stable")
    every, n = every[by], n[by]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first], np.add.reduceat(n, first) if len(first) else counts


def gram_counts(chunks: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of all rows of packed chunks, n counted in training rows only; each task adds up before it sends."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts:
            for data in part["data"]:
                keys, counts = _released(_added(keys, counts, data, order))
                if len(keys) > GRAMS_HELD:
                    yield pd.DataFrame({"gram": keys, "n": counts})
                    keys, counts = keys[:0].copy(), counts[:0].copy()  # a view would keep what was sent
        yield pd.DataFrame({"gram": keys, "n": counts})
        del keys, counts
        release()  # the worker may go on to other work

    return chunks.select("data").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_costs(grams: np.ndarray, n: np.ndarray, order: int, short: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each gram's symbol after its context. With a gram, all of its last len(short) context symbols are given.

    short[k]: counts of (the last k symbols of a context, symbol), for the k that are below.
    """
    levels = []  # of each k: the grams' counts, their contexts' totals and distinct symbols, and what the suffix counts of these symbols sum to
    counts: list[np.ndarray] = []
    for k in range(order + 1):
        if k < len(short):
            counts.append(short[k].ravel()[_short_index(grams, k)])
            continue
        key, at = np.unique(grams & ((1 << WIDTH * (k + 1)) - 1), return_inverse=True)
        counts.append(np.bincount(at, n, len(key)).astype(np.int64)[at])
    for k in range(order + 1):
        if k < len(short):
            table = short[k].reshape(-1, SYMBOLS)
            up = np.zeros_like(table) if k == 0 else np.where(table > 0, short[k - 1].reshape(-1, SYMBOLS)[np.arange(len(table)) % SYMBOLS ** (k - 1)], 0)
            row = _short_index(grams, k) // SYMBOLS
            levels.append((table.sum(1)[row], (table > 0).sum(1)[row], up.sum(1)[row]))
            continue
        key, first = np.unique(grams & ((1 << WIDTH * (k + 1)) - 1), return_index=True)
        _, context = np.unique(key >> WIDTH, return_inverse=True)
        _, mine = np.unique((grams >> WIDTH) & ((1 << WIDTH * k) - 1), return_inverse=True)
        own = counts[k][first]
        up = np.where(own > 0, counts[k - 1][first], 0) if k else np.zeros(len(key), np.int64)
        levels.append(tuple(np.bincount(context, x).astype(np.int64)[mine] for x in (own, own > 0, up)))
    cost, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
    over, over_distinct = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(order, -1, -1):
        whole, distinct, up = levels[k]
        left, rest = whole - over, distinct - over_distinct  # without the symbols that the longer context has
        hit = ~done & (counts[k] > 0)
        cost[hit] += np.log10(counts[k][hit] / (left + rest)[hit])
        done |= hit
        escape = ~done & (rest > 0)
        cost[escape] += np.log10(rest[escape] / (left + rest)[escape])
        over, over_distinct = up, distinct
    cost[~done] -= np.log10(np.maximum(1, SYMBOLS - over_distinct[~done]))
    return cost


def _short_index(grams: np.ndarray, k: int) -> np.ndarray:
    """Where the last k context symbols and the symbol stand in a table of k + 1 dimensions."""
    at = np.zeros(len(grams), np.int64)
    for j in range(k, -1, -1):
        at = at * SYMBOLS + (grams >> WIDTH * j & 511)
    return at


def cost_table(chunks: DataFrame, order: int = ORDER, blocks: int = 1) -> DataFrame:
    """(gram, cost, block) of every gram in the chunks' texts, learnt from all training rows."""
    full, near = _written(gram_counts(chunks, order)), min(order, NEAR)
    short = []
    for k in range(near):
        table = np.zeros(SYMBOLS ** (k + 1), np.int64)
        rows = full.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << WIDTH * (k + 1)) - 1)).alias("g")).agg(F.sum("n").alias("n")).collect()
        table[_short_index(np.array([r.g for r in rows], np.int64), k)] = [r.n for r in rows]
        short.append(table)

    def costs(part: pd.DataFrame) -> pd.DataFrame:
        grams = part["gram"].to_numpy()
        return pd.DataFrame({"gram": grams, "cost": gram_costs(grams, part["n"].to_numpy(), order, short).astype(np.float32), "block": _gram_block(grams, blocks)})

    # Grams that end their contexts alike stay together; groups of them hold some `GROUP_GRAMS`.
    ending = F.xxhash64(F.shiftright("gram", WIDTH).bitwiseAND(F.lit((1 << WIDTH * near) - 1)))
    groups = max(1, -(-full.count() // GROUP_GRAMS))
    return full.groupBy(F.pmod(ending, F.lit(groups)).alias("ending")).applyInPandas(lambda part: _released(costs(part)), "gram long, cost float, block long")


def _gram_block(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)


def _by_block(grams: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by block and then by gram, the blocks in that order) of distinct grams in order."""
    block = _gram_block(grams, blocks)
    by = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
    return by, block[by]


def gram_answers(chunks: DataFrame, table: DataFrame, order: int, blocks: int) -> DataFrame:
    """(chunk, block, costs): the costs of each chunk's distinct grams, in the order in which it asks; table has them by block."""

    def question(chunk: int, data: bytes) -> pd.DataFrame:
        keys = distinct_grams(unpack(data)["text"].tolist(), order)
        by, block = _by_block(keys, blocks)
        keys = keys[by]
        edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        return pd.DataFrame([(chunk, int(block[a]), keys[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(block)])], columns=["chunk", "block", "grams"])

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for chunk, data in zip(part["chunk"], part["data"]):
                yield _released(question(chunk, data))
        release()

    def answer(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("gram")
        keys, costs = given["gram"].to_numpy(), given["cost"].to_numpy(np.float32)
        return pd.DataFrame({"chunk": asked["chunk"], "block": asked["block"], "costs": [costs[np.searchsorted(keys, np.frombuffer(g, np.int64))].tobytes() for g in asked["grams"]]})

    sent = chunks.select("chunk", "data").mapInPandas(send, "chunk long, block long, grams binary")
    both = sent.groupBy("block").cogroup(table.groupBy("block"))
    return _written(both.applyInPandas(lambda asked, given: _released(answer(asked, given)), "chunk long, block long, costs binary"))


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Vocabulary:
    """The distinct tokens of a chunk; the empty word is the end token."""

    def __init__(self, texts: Iterable[str | None], blocks: int) -> None:
        number, sizes = _Numbers(), []

        def tokens(text: str | None) -> list[bytes]:
            found = utf8(text).translate(LOWER).split()
            found.append(b"")
            sizes.append(len(found))
            return found

        # One text's words stand as objects at a time.
        self.ids = np.fromiter(map(number.__getitem__, chain.from_iterable(map(tokens, texts))), np.int64)
        self.sizes = np.array(sizes, np.int64)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), ">u8").reshape(-1, 2).astype(np.uint64)
        block = (digests[:, 0] % np.uint64(blocks)).astype(np.int64)
        self.order = np.lexsort((digests[:, 1], block))
        self.value, self.block = digests[self.order, 1], block[self.order]

    def by_block(self) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.diff(self.block, prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(self.block)]):
            yield int(self.block[a]), a, b


def word_answers(chunks: DataFrame, blocks: int) -> DataFrame:
    """(chunk, block, counts, n_tokens, n_words): training counts of each chunk's words in hash order; each block's totals are on one row."""

    def question(chunk: int, data: bytes) -> pd.DataFrame:
        rows = unpack(data)
        own = _Vocabulary(rows["text"], blocks)
        trains = np.repeat(rows["train"].to_numpy(bool), own.sizes)
        n = np.bincount(own.ids[trains], minlength=len(own.order))[own.order].astype(np.uint32)
        return pd.DataFrame([(chunk, block, own.value[a:b].tobytes(), n[a:b].tobytes()) for block, a, b in own.by_block()], columns=["chunk", "block", "words", "n"])

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for chunk, data in zip(part["chunk"], part["data"]):
                yield _released(question(chunk, data))
        release()

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, np.uint64) for x in part["words"]]
        distinct, back = np.unique(np.concatenate(values), return_inverse=True)
        sums = np.bincount(back, np.concatenate([np.frombuffer(x, np.uint32) for x in part["n"]]), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(v) for v in values])
        kind = np.uint32 if sums.max(initial=0) < 1 << 32 else np.int64
        first = np.arange(len(part)) == 0
        return pd.DataFrame({"chunk": part["chunk"], "block": part["block"], "counts": [sums[back[e - len(v) : e]].astype(kind).tobytes() for v, e in zip(values, ends)],
                             "wide": kind is np.int64, "n_tokens": np.where(first, sums.sum(), 0), "n_words": np.where(first, (sums > 0).sum(), 0)})

    sent = chunks.select("chunk", "data").mapInPandas(send, "chunk long, block long, words binary, n binary")
    return _written(sent.groupBy("block").applyInPandas(lambda part: _released(answer(part)), "chunk long, block long, counts binary, wide boolean, n_tokens long, n_words long"))


def _word_scores(texts: list[str | None], given: dict[int, np.ndarray], blocks: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score) of each text; given: the counts of a chunk's words by block."""
    words = _Vocabulary(texts, blocks)
    counts = np.zeros(len(words.order), np.int64)
    for block, a, b in words.by_block():
        counts[words.order[a:b]] = given[block]
    starts = np.cumsum(words.sizes) - words.sizes
    logs = np.log10((counts + 1) / whole)
    return words.sizes, np.add.reduceat((counts > 0)[words.ids].astype(np.int64), starts), np.add.reduceat(logs[words.ids], starts)


def _gram_scores(texts: list[str | None], given: dict[int, np.ndarray], order: int, blocks: int) -> np.ndarray:
    """The model's log10 probability of each text; given: the costs of a chunk's grams by block."""
    keys = distinct_grams(texts, order)
    by, asked = _by_block(keys, blocks)
    table = np.empty(len(keys))
    table[by] = np.concatenate([given[b] for b in np.unique(asked).tolist()])
    del by, asked

    def piece(some: list[str | None]) -> np.ndarray:
        stream, sizes = gram_stream(some, order)
        at, own = pd.factorize(stream)
        return np.add.reduceat(table[np.searchsorted(keys, own)][at], np.cumsum(sizes) - sizes)

    return np.concatenate([piece(texts[a:b]) for a, b in slices(texts, PIECE_CHARS)])


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = HELD_OUT_MODULUS, remainder: int = HELD_OUT_REMAINDER,
           order: int = ORDER, chunk_chars: int = CHUNK_CHARS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, learnt from the rows that aren't held out."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (crc_mod(key, modulus) != remainder).alias("train"))
    kind = slim.schema["key"].dataType.simpleString()
    release_heaps(docs.sparkSession)
    chunks = packed(slim, chunk_chars)
    blocks = n_blocks(chunks, block_words)
    answers = word_answers(chunks, blocks)
    n_tokens, n_words = (x or 0 for x in answers.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    # One table of both answers: those of words are blocks from 0, those of grams lie below.
    costs = gram_answers(chunks, cost_table(chunks, order, blocks), order, blocks)
    answers = answers.select("chunk", "block", "counts", "wide").unionByName(costs.select("chunk", (-1 - F.col("block")).alias("block"), F.col("costs").alias("counts"), F.lit(False).alias("wide")))

    def judge(own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        out = []
        of_grams = {-1 - b: np.frombuffer(x, np.float32) for b, x in zip(answered["block"], answered["counts"]) if b < 0}
        answered = answered[answered["block"] >= 0]
        given = {b: np.frombuffer(x, np.int64 if wide else np.uint32).astype(np.int64) for b, x, wide in zip(answered["block"], answered["counts"], answered["wide"])}
        for data in own["data"]:
            rows = unpack(data)
            texts = rows.pop("text").tolist()
            sizes, known, base = _word_scores(texts, given, blocks, n_tokens + n_words + 1)
            out.append(pd.DataFrame({
                key: rows["key"], "held_out": ~rows["train"].to_numpy(bool), "n_tokens": sizes, "n_known": known,
                "train_tokens": n_tokens, "base_score": base, "score": _gram_scores(texts, of_grams, order, blocks),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    release_heaps(docs.sparkSession)
    return chunks.select("chunk", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda own, answered: _released(judge(own, answered)), f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
