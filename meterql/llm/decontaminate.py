r"""Benchmark decontamination with an FM-index per training shard.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A window is
`window` consecutive words of a benchmark item, or the whole of a shorter one.
The words of a shard of documents become symbols of the benchmark's alphabet;
a word the benchmark does not use ends a run, as does a document's end. The
shard's runs are indexed, all windows are searched backwards through the wavelet tree's ranks,
occurrences are located by sampled suffix positions, and overlapping ones merge
into removal spans.

Memory: a shard has at most `shard_words` words, whatever a document's length;
longer texts go on in the next shard, with an overlap of one window. The
benchmark goes to the executors in blocks of at most `block_words` words, each
a bounded broadcast; a worker holds one block at a time, and reads it again from
its executor's disk for the next batch if there are several.

Defined edge cases: null or empty texts have no words and are never
contaminated; items without words have no window; items of equal id count as
one, and an item without an id still marks words but is not listed; repeated
document rows each get a row; other columns are not read; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.common import by_rows, release, slices, utf8
from meterql.llm.fm_index import FMIndex

WINDOW, SHARD_WORDS, BLOCK_WORDS = 10, 1 << 20, 1 << 20
#: Every byte to what it is as part of a word, or to a space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_TABLE).split()


def compile_block(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict:
    """Symbols, windows by length, and the items of each window."""
    symbols: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str | None]] = {}
    for item, text in items:
        own = [symbols.setdefault(w, len(symbols) + 1) for w in words_of(text)]
        for i in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(tuple(own[i : i + window]), set()).add(item)
    names = sorted({x for o in owners.values() for x in o if x is not None})
    number = {x: k for k, x in enumerate(names)}
    tables = []
    for length in sorted({len(p) for p in owners}):
        phrases = [p for p in owners if len(p) == length]
        listed = [[number[x] for x in owners[p] if x is not None] for p in phrases]
        ends = np.cumsum([len(x) for x in listed])
        tables.append((np.array(phrases, np.int32), ends, np.array([k for x in listed for k in x], np.int64)))
    return {"symbols": symbols, "names": names, "tables": tables}


def _search(ids: np.ndarray, block: dict, shard_words: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(starts, length, number of items each, items) of all occurrences in a stream of symbols."""
    longest = block["tables"][-1][0].shape[1]
    for at in range(0, len(ids), shard_words):
        part = ids[at : at + shard_words + longest - 1]
        part = np.concatenate([part, np.zeros(1, part.dtype)])
        source = np.flatnonzero((part != 0) | (np.concatenate([[0], part[:-1]]) != 0))  # runs, each with one end
        if not len(source):
            continue
        index = FMIndex(part[source], len(block["symbols"]))
        for phrases, item_ends, items in block["tables"]:
            rows, places = index.find(phrases)
            if not len(rows):
                continue
            first = item_ends[rows] - np.diff(item_ends, prepend=0)[rows]
            many = item_ends[rows] - first
            flat = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            yield source[places] + at, phrases.shape[1], many, items[flat]


def scan(texts: Iterable[str | None], blocks: list, shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(number of words, merged spans as an (n, 2) array of word positions, items) of each text."""
    tokens = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in tokens], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a 0 stands after each text
    total = int((sizes + 1).sum())
    change = np.zeros(total + 1, np.int64)
    found: list[set[str]] = [set() for _ in tokens]
    for handle in blocks:
        block = handle.value if hasattr(handle, "value") else handle
        if not block["tables"]:
            continue  # items without words
        get = block["symbols"].get
        ids = np.zeros(total, np.int32)
        for start, words in zip(starts, tokens):
            ids[start : start + len(words)] = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        for places, length, many, items in _search(ids, block, shard_words):
            np.add.at(change, places, 1)
            np.add.at(change, places + length, -1)
            owner = np.searchsorted(starts, np.repeat(places, many), "right") - 1
            for pair in np.unique(owner * len(block["names"]) + items).tolist() if len(items) else ():
                found[pair // len(block["names"])].add(block["names"][pair % len(block["names"])])
        if len(blocks) > 1 and hasattr(handle, "value"):
            vars(handle).pop("_value", None)  # what a worker has read of a broadcast; it stays on disk
        del block
    hit = np.cumsum(change[:-1]) > 0
    for start, size, items in zip(starts.tolist(), sizes.tolist(), found):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[start : start + size], [False]]).astype(np.int8)))
        yield size, edges.reshape(-1, 2), sorted(items)


def broadcast_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark as broadcast blocks; the driver holds one block's items at a time."""
    sc, out, rows, size = benchmark.sparkSession.sparkContext, [], [], 0
    for name, body in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        rows.append((name, body))
        size += len(words_of(body))
        if size >= block_words:
            out.append(sc.broadcast(compile_block(rows, window)))
            rows, size = [], 0
    return [*out, sc.broadcast(compile_block(rows, window))] if rows else out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, n_hit, items, spans) per row: spans of words to remove, end exclusive."""
    blocks = broadcast_blocks(benchmark, item, item_text, window, block_words)
    slim = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))

    def run(texts: list[str | None]) -> dict[str, list]:
        found = list(scan(texts, blocks, shard_words))
        return {
            "n_words": [n for n, _, _ in found],
            "n_hit": [int((s[:, 1] - s[:, 0]).sum()) for _, s, _ in found],
            "items": [i for _, _, i in found],
            "spans": [[{"start": a, "end": b} for a, b in s.tolist()] for _, s, _ in found],
        }

    return by_rows(slim, run, "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from contamination()'s."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_only(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no window occurs, in one pass, with the input's columns."""
    blocks = broadcast_blocks(benchmark, **options)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        out = pd.Series([not len(s) for a, b in slices(texts) for _, s, _ in scan(texts[a:b], blocks)])
        release()
        return out

    return docs.where(clean(F.col(text).cast("string")))


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_sql(window: int = WINDOW) -> str:
    r"""The digest in DuckDB's SQL: windows are compared as texts."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
         SELECT item, w, least(len(w), {window}) AS n, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, s)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)"""
