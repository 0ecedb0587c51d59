r"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint bit is 1 if it is set in over half of a text's shingle hashes
(XXH64, seed 42, of the UTF-8 of three lower-cased words joined by a space).
Fingerprints link at `max_bits` or fewer differing bits. They are cut into so
few segments that one of them differs by at most one bit; each segment is
indexed under all its one-wildcard variants; an equality on (slot, variant)
gives candidates, and each pair is verified on the whole fingerprint.

Copies share a fingerprint, so only distinct fingerprints are indexed, and a
group of exact copies costs one row. A bucket is looked at as pairs only while
it has at most `bucket_pairs` fingerprints. Those of larger buckets are linked
exactly, in linear space, by wildcards over the whole fingerprint: a key with
`max_bits` wildcards holds at most 2 ** max_bits fingerprints.

Defined edge cases: a null or empty text has fingerprint zero and links like
any other; fewer words than a shingle make one shingle; repeated rows each get
a row; a null doc_id is never a component's id unless no other is there; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterql.llm.common import LOWER, cut, utf8

SEED, SHINGLE, BITS, MAX_BITS, BUCKET_PAIRS, TASK_PRINTS, HOT_ROWS = 42, 3, 64, 2, 128, 1 << 15, 50_000
#: Edges that a task of the component search takes; fewer are searched in one task, without an exchange.
TASK_EDGES = 1 << 18
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle, repeats included."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(_HASH, shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that the bits of very long texts never stand in memory at once
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    return majority(shingle_hashes(text, width))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint's bits as a signed long. Written once to the shared folder."""
    return cut(docs.select(F.col(key).alias("doc_id"), _fingerprints(F.col(text).cast("string")).alias("fp")))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    if not 2 <= n <= 8:
        raise ValueError("max_bits must be between 2 and 15")
    edges = [BITS * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], np.diff(edges).tolist()))


def _long(mask: int) -> str:
    """An unsigned 64-bit constant as a SQL long."""
    return f"{mask - (1 << 64) if mask >> 63 else mask}L" if mask != 1 << 63 else "(-9223372036854775807L - 1L)"


def _variants(max_bits: int) -> Column:
    """All one-wildcard variants of all segments: (slot, part); the wildcard bit is cleared."""
    out = []
    for first, width in _segments(max_bits):
        mask = ((1 << width) - 1) << first
        out += [f"named_struct('slot', {bit}, 'part', fp & {_long(mask & ~(1 << bit))})" for bit in range(first, first + width)]
    return F.expr(f"explode(array({', '.join(out)}))").alias("v")


def _first_shared(max_bits: int, slot: str, x: str) -> str:
    """SQL: slot is the first under which two fingerprints that differ by x meet, so a pair is made once."""
    cases, before = [], []
    for first, width in _segments(max_bits):
        own = f"({x} & {_long(((1 << width) - 1) << first)})"
        cases.append(f"({' and '.join([*before, f'{slot} >= {first} and {slot} < {first + width}'])} and "
                     f"(({own} = 0 and {slot} = {first}) or {own} = shiftleft(1L, {slot})))")
        before.append(f"bit_count{own} > 1")
    return "(" + " or ".join(cases) + ")"


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints at max_bits or fewer differing bits, once."""
    # So many tasks that none makes more than some two million variants, however few files hold the fingerprints.
    spread = distinct.select("fp").repartition(max(1, -(-distinct.count() // TASK_PRINTS)), "fp")
    variants = spread.select("fp", _variants(max_bits)).select("fp", "v.slot", "v.part")
    sizes = variants.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = cut(sizes)
    near = f"bit_count(a ^ b) <= {max_bits} and {_first_shared(max_bits, 'slot', '(a ^ b)')}"
    twos = sizes.where("n = 2").where(near).select("a", "b")
    # Always a sort-merge join: both sides grow with the corpus, so neither may be broadcast when it happens to be small.
    members = variants.join(sizes.where("n > 2").select("slot", "part", "n").hint("merge"), ["slot", "part"])
    lists = members.where(F.col("n") <= bucket_pairs).groupBy("slot", "part").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    pair = near.replace("(a ^ b)", "(x ^ y)")
    more = lists.selectExpr("slot", f"explode(flatten(transform(all, x -> transform(filter(all, y -> x < y and {pair}), "
                            "y -> named_struct('a', x, 'b', y))))) as l").select("l.a", "l.b")
    return cut(twos.unionByName(more).unionByName(_hot_links(members.where(F.col("n") > bucket_pairs), max_bits)).distinct())


def _hot_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of large buckets, by max_bits wildcards over all bits: no bucket is larger than 2 ** max_bits."""
    masks = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), max_bits)], np.uint64).view(np.int64).tolist()
    keys = F.posexplode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseAND(F.bitwise_not(m)))).alias("slot", "part")
    wild = members.select("fp").distinct().select("fp", keys)
    lists = wild.groupBy("slot", "part").agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    return lists.selectExpr("explode(flatten(transform(all, x -> transform(filter(all, y -> x < y), y -> named_struct('a', x, 'b', y))))) as l").select("l.a", "l.b")


def variant_keys(column: str, segments: int) -> Column:
    """An array of (key, fp) over an array of fingerprints: each one's one-wildcard variants; a key holds the fingerprint's index, the wildcard and the segment."""
    at = [(first, width, bit) for first, width in _segments(2 * segments - 1) for bit in range(first, first + width)]
    part = lambda first, width, bit: f"shiftrightunsigned(x & {_long((((1 << width) - 1) << first) & ~(1 << bit))}, {first})"
    rows = ", ".join(f"named_struct('key', ((i * {BITS} + {bit}) * 4294967296L) + {part(first, width, bit)}, 'fp', x)" for first, width, bit in at)
    return F.expr(f"flatten(transform({column}, (x, i) -> array({rows})))")


def met_in(key: np.ndarray, fp: np.ndarray, node: np.ndarray, segments: int, most: int, window: int, links: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: nodes that share a key, at most `most` bits apart; rows are sorted by key and fingerprint.

    Each row is held against `window` rows before it and gets up to `links` partners a key. A pair counts under the first
    wildcard that it meets under only.
    """
    fp = fp.view(np.uint64)
    bit = (key >> 32) % BITS
    cuts = [(np.uint64(first), np.uint64((1 << width) - 1)) for first, width in _segments(2 * segments - 1)]
    got, out, at = np.zeros(len(key), np.int64), [], np.arange(len(key))
    for d in range(1, window + 1):
        at = at[at >= d]
        at = at[(key[at] == key[at - d]) & (got[at] < links)]
        if not len(at):
            break
        x = fp[at] ^ fp[at - d]
        close = np.bitwise_count(x) <= most
        i, x = at[close], x[close]
        own_bit, found = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        for first, mask in cuts:
            own = (x >> first) & mask
            here = ~found & (np.bitwise_count(own) <= 1)
            low = np.where(own > 0, np.bitwise_count(own - (own > 0)), 0)
            own_bit[here] = int(first) + low[here].astype(np.int64)
            found |= here
        i = i[(own_bit == bit[i]) & (node[i] != node[i - d])]
        got[i] += 1
        out.append(np.column_stack([node[i], node[i - d]]))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pairs.min(1), pairs.max(1)


def meetings(prints: DataFrame, most: int, window: int = 512, links: int = 2) -> DataFrame:
    """(a, b), a < b, of prints (node, fps): nodes of which a fingerprint's segment differs by at most one bit and the whole one by at most `most`.

    There are as many segments (four at most) as leave fewer than `window` fingerprints to a key by chance. Keys are
    sorted and read as a stream, so a task's memory doesn't follow the size of a group, nor do links follow its square:
    beyond `links` partners a key and node, or `window` rows, a pair is left to its other keys and to the caller.
    """
    n = prints.count()
    segments = next((k for k in (4, 3) if n >> (BITS // k - 1) < window), 2)
    rows = prints.select("node", F.explode(variant_keys("fps", segments)).alias("k")).select("k.key", "k.fp", "node")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                held.append([c.to_numpy() for c in batch.columns])
                size += len(batch)
            if held and (last or size >= 1 << 16):
                key, fp, node = (np.concatenate(x) for x in zip(*held))
                end = len(key) if last else int(np.searchsorted(key, key[-1]))
                if not end or len(key) - end > 1 << 17:  # one key's rows: looked at as far as they came, and the last ones again with the next
                    end, keep = len(key), len(key) - window
                else:
                    keep = end
                a, b = met_in(key[:end], fp[:end], node[:end], segments, most, window, links)
                held = [[key[keep:], fp[keep:], node[keep:]]]
                size = len(key) - keep
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "fp", "node")
    return cut(dealt.mapInArrow(pairs, "a long, b long").distinct())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps, each of joins and minima, cut
    by a checkpoint; only a count and a checksum come to the driver. Tasks follow
    the number of edges, so that few edges don't leave files in every partition.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    state, tasks = None, -(-edges.count() // TASK_EDGES) or 1
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        step = edges.join(low.hint("merge"), "u").coalesce(tasks)
        edges = cut(step.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").coalesce(tasks).distinct())


def _rooted(marked: DataFrame, max_bits: int, bucket_pairs: int) -> DataFrame:
    """(fp, n, least_id, root) of all distinct fingerprints: n rows have it, the smallest id among them, and its component's smallest fingerprint."""
    distinct = cut(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id")))
    of = components(links(distinct, max_bits, bucket_pairs))
    return distinct.join(of, F.col("fp") == F.col("node"), "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits, and the smallest doc_id reachable."""
    marked = fingerprints(docs, key, text)
    rooted = cut(_rooted(marked, max_bits, bucket_pairs))
    groups = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = cut(rooted.join(groups, "root").select("fp", "n", "component_id"))
    # Fingerprints of more than HOT_ROWS rows (of all empty texts, say) are few, at most one for each HOT_ROWS rows, so they are
    # broadcast and their rows stay where they are; the others are joined by sorting.
    hot = F.broadcast(named.where(F.col("n") > HOT_ROWS).select("fp", "component_id"))
    rest = marked.join(hot, "fp", "left_anti").join(named.where(F.col("n") <= HOT_ROWS).select("fp", "component_id").hint("merge"), "fp")
    found = marked.join(hot, "fp").unionByName(rest)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """The rows of docs that stay: one of each component, of its smallest id and of that id's smallest fingerprint in the component.

    Of several such rows the least by its columns stays. Rows that share an id but no component all stay. A row without
    an id can neither stand for a group nor be named as a copy; it stays. Columns must be orderable.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.where(F.col(key).isNotNull())
    marked = fingerprints(named, key, text)
    best = _rooted(marked, max_bits, bucket_pairs).groupBy("root").agg(F.min(F.struct("least_id", "fp")).alias("m")).select(F.col("m.least_id").alias("id"), F.col("m.fp").alias("fp"))
    rows = named.select(F.col(key).alias("id"), _fingerprints(F.col(text).cast("string")).alias("fp"), columns)
    stay = rows.join(best, ["id", "fp"], "left_semi").groupBy("id", "fp").agg(F.min("row").alias("row"))
    return stay.select("row.*").unionByName(docs.where(F.col(key).isNull()))
