"""Documents packed into compressed chunks, for operators that pass over whole texts more than once.

A chunk's number is drawn at random when it is written to the shared folder, so every later
pass, a repeated task's too, meets the same documents under the same number. What
chunks ask of the whole corpus they ask once each, by hash block, whatever the
number of documents that ask it.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.common import cut

CHUNK_CHARS, BLOCK_WORDS, ROW_CHARS = 6_000_000, 1_000_000, 16


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pd.DataFrame:
    """The rows of a chunk; integers beside nulls stay integers."""
    return pa.ipc.open_stream(data).read_all().to_pandas(integer_object_nulls=True)


def packed(rows: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, chars, data): the rows, whose second column is text, in chunks of about chunk_chars characters."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            data = _pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["chunk", "chars", "data"])

        for part in parts:
            # A row weighs something even if it is empty, so a chunk of empty texts is bounded too.
            lengths = np.array([ROW_CHARS + (len(x) if x is not None else 0) for x in part.column(1).to_pylist()], np.int64)
            a = 0
            while a < part.num_rows:
                room = np.cumsum(lengths[a:])
                b = min(part.num_rows, a + int(np.searchsorted(room, chunk_chars - size)) + 1)
                held.append(part.slice(a, b - a))
                size += int(room[b - a - 1])
                a = b
                if size >= chunk_chars:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return cut(rows.mapInArrow(run, "chunk long, chars long, data binary"))


def n_blocks(chunks: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    """Blocks for the corpus, by its size: about block_words words each."""
    chars = chunks.agg(F.sum("chars")).first()[0] or 0
    return max(1, -(-chars // (6 * block_words)))  # some six characters a word
