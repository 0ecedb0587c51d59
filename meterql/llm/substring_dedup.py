r"""Substring dedup by relative Lempel-Ziv parsing.

Words are `[^\x20\x09-\x0D]+`, unchanged. A document is parsed into factors, runs
of at least `width` words that occur as a whole somewhere else in the corpus, and
literal words. Every word of a factor goes, copies on both sides alike, and the
parse reads the input as it is, not what is left of it.

The reference is the corpus itself, dealt into blocks that are indexed by suffix
arrays. A document has to meet each block that may hold one of its factors, and
no other: a factor holds a window of `width` words, and a window goes to the block
of its anchor, the `gram`-word run of least hash in it, which equal windows share.

1. Documents are packed, compressed, into chunks of about `chunk_chars`
   characters, written once to the shared folder.
2. Which windows to parse: each chunk sends the 32-bit hashes of its distinct
   windows, once, to hash blocks of about `block_words`, and gets a bit for each:
   met a second time or not. A hash mistaken for another, one in some four
   thousand, costs a needless parse and no more.
3. Each chunk cuts the runs of such windows where the anchor changes and sends the
   pieces, as words and each distinct one once, to the anchors' reference blocks.
4. A reference block indexes its pieces by a suffix array over words and finds for
   every place the longest match elsewhere: the longer of those with its two
   neighbours in suffix order. Pieces are factored greedily: the longest match at
   a place, then, where it ends, the match across that boundary that reaches
   furthest, as long as one of `width` words does. Words are compared, no hashes.
5. Each chunk, joined with its factors, is written out. Consecutive pieces overlap
   by `width` - 1 words, so every window lies in one piece and none is lost at a cut;
   where factors overlap the later one gives way.

What many documents share is sent once a chunk, and answered once a chunk. Hash
blocks and reference blocks grow in number, not in size, with the corpus; a
message holds what a chunk has for a block, at worst a single hash, so messages
never outnumber windows.

Defined edge cases: a null text has no words; texts shorter than `width` have
no window and stay; a document's own repeats count; repeated rows are documents
of their own, so each one's windows occur elsewhere; a row without an id gets a
row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.chunks import BLOCK_WORDS, CHUNK_CHARS, n_blocks, packed, unpack
from meterql.llm.common import cut, utf8

WIDTH, GRAM = 35, 8
#: Odd multipliers of the rolling hashes of windows and of anchors.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """Hash of a word; words met often are looked up."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the `width` values from each position on, by doubling; the last ones lack followers and mean nothing."""
    out, have, span, power, block = np.zeros_like(x), 0, 1, base, x
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                later = np.zeros_like(x)
                later[: len(x) - have or None] = block[have:] if have < len(x) else 0
                out, have = out * np.uint64(power) + later, have + span
            if span * 2 > width:
                break
            follow = np.zeros_like(x)
            follow[: max(0, len(x) - span)] = block[span:]
            block = block * np.uint64(power) + follow
            span, power = span * 2, power * power & _MASK
    return out


def leftmost_least(x: np.ndarray, span: int) -> np.ndarray:
    """Of each place on, the place of the least of `span` values, the first of equal ones; the last places mean nothing."""
    key = (x >> np.uint64(28) << np.uint64(28)) | np.arange(len(x), dtype=np.uint64)
    have = 1
    while 2 * have <= span:
        key[: len(key) - have] = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    rest = span - have
    if rest:
        key[: len(key) - rest] = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & np.uint64((1 << 28) - 1)).astype(np.int64)


def longest_matches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place of the concatenated pieces the length of its longest match elsewhere. words: symbols from 0; ends: where pieces end.

    Suffixes are ordered by doubling; the ranks of all prefix lengths 1, 2, 4 ... stay, so that the common
    prefix of two suffixes is read off from the longest to the shortest.
    """
    sizes = np.diff(ends, prepend=0)
    places = np.arange(len(words)) + np.repeat(np.arange(len(ends)), sizes)  # each piece is closed by a symbol of its own
    n = len(words) + len(ends)
    text = np.empty(n, np.int64)
    text[places] = words
    text[ends + np.arange(len(ends))] = int(words.max(initial=0)) + 1 + np.arange(len(ends))
    levels, span, longest = [np.unique(text, return_inverse=True)[1].astype(np.int32)], 1, int(sizes.max(initial=0))
    while span <= longest:
        rank = levels[-1].astype(np.int64)
        follow = np.full(n, -1, np.int64)
        follow[: n - span] = rank[span:]
        levels.append(np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int32))
        span *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common[same] += 1 << k
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best[places]


def greedy_factors(match: list[int], width: int) -> list[tuple[int, int]]:
    """(start, length) of a piece's factors, given its places' longest matches: each reaches further than all before it."""
    out, at, n = [], 0, len(match)
    while at < n:
        if match[at] < width:
            at += 1
            continue
        out.append((at, match[at]))
        end = at + match[at]
        while True:  # the boundary: of the matches that begin inside the factor or right behind it, the one that reaches furthest
            reach, start = max(((k + match[k], -k) for k in range(at + 1, min(end + 1, n)) if match[k] >= width), default=(0, 0))
            if reach <= end:
                break
            at, end = -start, reach
            out.append((at, match[at]))
        at = end + 1
    return out


def _payload(pieces: list[bytes], twice: list[bool]) -> tuple[bytes, bytes]:
    return b"\n".join(pieces), np.packbits(np.array(twice, bool)).tobytes()


class Phrases:
    """The windows of a chunk of documents, as hashes and blocks, and the pieces to parse."""

    def __init__(self, texts: Iterable[str | None], width: int, blocks: int, gram: int = GRAM, hashes: _WordHashes | None = None) -> None:
        hashes = _WordHashes() if hashes is None else hashes
        if len(hashes) > 300_000:
            hashes.clear()
        self.words = [utf8(t).split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.x = np.fromiter((h for w in self.words for h in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
        fits = np.zeros(len(self.x) + 1, np.int64)  # a window may start where its document still has enough words
        long = sizes >= width
        np.add.at(fits, self.starts[long], 1)
        np.add.at(fits, self.starts[long] + sizes[long] - width + 1, -1)
        self.at = np.flatnonzero(np.cumsum(fits)[:-1] > 0)
        hashed = _rolling(self.x, width, _BASES[0])[self.at]
        hashed ^= hashed >> np.uint64(29)
        # The upper half picks the block, the lower is compared in it: one sort for both.
        key = np.uint64(blocks) * (hashed >> np.uint64(32)) >> np.uint64(32) << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF)
        order = np.argsort(key)
        key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        group = np.cumsum(fresh) - 1
        key = key[fresh]
        self.value, self.block = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)
        self.twice = np.bincount(group, minlength=len(key)) > 1
        self.group = np.empty(len(order), np.int64)  # of each window in text order
        self.group[order] = group
        self.width, self.gram, self.blocks = width, min(gram, width), blocks

    def by_block(self) -> Iterator[tuple[int, int, int]]:
        """(block, first, end) of each block's share of the distinct phrases."""
        edges = np.flatnonzero(np.diff(self.block, prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(self.block)]):
            yield int(self.block[a]), a, b

    def pieces(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[bytes], list[bool]]]]:
        """(each piece's first word, its number among the distinct pieces, and these by block: (block, pieces, whether met twice here))."""
        hit = self.at[found[self.group]]
        if not len(hit):
            return hit, hit, []
        grams = _rolling(self.x, self.gram, _BASES[1])
        grams ^= grams >> np.uint64(29)
        anchor = leftmost_least(grams, self.width - self.gram + 1)[hit]
        cut = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(anchor, prepend=-2) != 0))
        first, end = hit[cut], hit[np.append(cut[1:], len(hit)) - 1] + self.width
        block = (grams[anchor[cut]] % np.uint64(self.blocks)).astype(np.int64)
        flat = [w for words in self.words for w in words]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(b" ".join(flat[a:b]), len(number)) for a, b in zip(first.tolist(), end.tolist())], np.int64)
        texts, many = list(number), np.bincount(which) > 1
        of = np.zeros(len(texts), np.int64)
        of[which] = block  # equal pieces have equal anchors
        by = np.argsort(of, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        edges = np.flatnonzero(np.diff(of[by], prepend=-1)).tolist()
        dealt = [(int(of[by[a]]), [texts[k] for k in by[a:b].tolist()], many[by[a:b]].tolist()) for a, b in zip(edges, [*edges[1:], len(by)])]
        return first, rank[which], dealt

    def parse(self, first: np.ndarray, which: np.ndarray, factors: list[list[tuple[int, int]]]) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
        """(words, factors) of each document, given the factors of the distinct pieces; of overlapping factors the later gives way."""
        matches = [(a + start, a + start + n) for a, k in zip(first.tolist(), which.tolist()) for start, n in factors[k]]
        k = 0
        for start, words in zip(self.starts.tolist(), self.words):
            own, end = [], start
            while k < len(matches) and matches[k][0] < start + len(words):
                a, b = matches[k]
                if b > end:
                    own.append((max(a, end) - start, b - start))
                    end = b
                k += 1
            yield words, own


def factored(pieces: list[bytes], twice: list[bool], width: int) -> list[list[tuple[int, int]]]:
    """The factors of a reference block's pieces, each parsed against all of them; one met twice in its chunk is its own copy."""
    if not pieces:
        return []
    number = _Symbols()
    split = [p.split(b" ") for p in pieces]
    ends = np.cumsum([len(w) for w in split])
    match = longest_matches(np.fromiter((i for w in split for i in map(number.__getitem__, w)), np.int64, int(ends[-1])), ends).tolist()
    out, at = [], 0
    for end, again in zip(ends.tolist(), twice):
        out.append([(0, end - at)] if again else greedy_factors(match[at:end], width))
        at = end
    return out


class _Symbols(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, chunk_chars: int = CHUNK_CHARS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, n_removed, factors, kept_sha256) per row: factors are spans of words, end exclusive."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    chunks = packed(slim, chunk_chars)
    blocks = n_blocks(chunks, block_words)

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for part in parts:
            for chunk, data in zip(part["chunk"], part["data"]):
                own = Phrases(unpack(data)["text"], width, blocks, gram, hashes)
                rows = [(chunk, block, own.value[a:b].tobytes(), np.packbits(own.twice[a:b]).tobytes()) for block, a, b in own.by_block()]
                yield pd.DataFrame(rows, columns=["chunk", "block", "windows", "twice"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, np.uint32) for x in part["windows"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)) for t, v in zip(part["twice"], values)]).astype(bool)
        every = np.concatenate(values)
        order = np.argsort(every)
        same = np.diff(every[order]) == 0
        found = twice[order]
        found[1:] |= same
        found[:-1] |= same
        out = np.empty(len(every), bool)
        out[order] = found
        # A hash is in a chunk once, so equal ones lie in other chunks; more than two have a neighbour each.
        ends = np.cumsum([len(v) for v in values])
        bits = [np.packbits(out[e - len(v) : e]).tobytes() for v, e in zip(values, ends)]
        return pd.DataFrame({"chunk": part["chunk"], "block": part["block"], "answer": bits})

    sent = chunks.select("chunk", "data").mapInPandas(send, "chunk long, block long, windows binary, twice binary")
    met = cut(sent.groupBy("block").applyInPandas(answer, "chunk long, block long, answer binary"))

    def to_parse(data: bytes, answered: pd.DataFrame) -> tuple[pd.DataFrame, Phrases, tuple]:
        rows = unpack(data)
        phrases, bits = Phrases(rows["text"], width, blocks, gram), dict(zip(answered["block"], answered["answer"]))
        found = np.zeros(len(phrases.value), bool)
        for block, a, b in phrases.by_block():
            found[a:b] = np.unpackbits(np.frombuffer(bits[block], np.uint8), count=b - a)
        return rows, phrases, phrases.pieces(found)

    def deal(own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        rows = [(chunk, block, *_payload(pieces, twice)) for chunk, data in zip(own["chunk"], own["data"]) for block, pieces, twice in to_parse(data, answered)[2][2]]
        return pd.DataFrame(rows, columns=["chunk", "block", "pieces", "twice"])

    def factor(part: pd.DataFrame) -> pd.DataFrame:
        pieces = [x.split(b"\n") for x in part["pieces"]]
        twice = [t for x, own in zip(part["twice"], pieces) for t in np.unpackbits(np.frombuffer(x, np.uint8), count=len(own)).astype(bool).tolist()]
        found, at, out = factored([p for own in pieces for p in own], twice, width), 0, []
        for own in pieces:
            mine = found[at : at + len(own)]
            at += len(own)
            out.append(np.array([*(len(f) for f in mine), *(x for f in mine for pair in f for x in pair)], np.int64).tobytes())
        return pd.DataFrame({"chunk": part["chunk"], "block": part["block"], "answer": out})

    held, by_chunk = chunks.select("chunk", "data").groupBy("chunk"), met.groupBy("chunk")
    dealt = held.cogroup(by_chunk).applyInPandas(deal, "chunk long, block long, pieces binary, twice binary")
    factors = dealt.groupBy("block").applyInPandas(factor, "chunk long, block long, answer binary")
    # One table of both answers: bits are blocks from 0, factors lie below.
    answers = met.unionByName(factors.select("chunk", (-1 - F.col("block")).alias("block"), "answer"))

    def parse(own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        of_block = {-1 - b: np.frombuffer(x, np.int64).tolist() for b, x in zip(answered["block"], answered["answer"]) if b < 0}
        out = []
        for data in own["data"]:
            rows, phrases, (first, which, blocks_of) = to_parse(data, answered[answered["block"] >= 0])
            found: list[list[tuple[int, int]]] = []
            for block, pieces, _ in blocks_of:
                numbers, at = of_block[block], len(pieces)
                for n in numbers[: len(pieces)]:
                    found.append([(numbers[at + 2 * k], numbers[at + 2 * k + 1]) for k in range(n)])
                    at += 2 * n
            for name, (words, spans) in zip(rows["key"].tolist(), phrases.parse(first, which, found)):
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((name, len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=[key, "n_words", "n_removed", "factors", "kept_sha256"], dtype=object)

    return chunks.select("chunk", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        parse, f"`{key}` {kind}, n_words long, n_removed long, factors array<struct<start:long,end:long>>, kept_sha256 string")


def repeats_sql(width: int = WIDTH) -> str:
    """n_words, n_removed and kept_sha256 in DuckDB's SQL: phrases are compared as texts."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, i, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)),
hit AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {width})) AS k FROM hit),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
