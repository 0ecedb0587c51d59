"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows' characters that a Python worker turns into objects at a time.
CHARS_AT_ONCE = 1 << 22
#: Rows of one number each that may be broadcast.
BROADCAST_ROWS = 1 << 20

#: The characters that end a word in the `[^\x20\x09-\x0D]+` sense, as a regex class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The same as bytes; `bytes.split()` without arguments splits on exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    shared_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable in the session's shared folder; only a session within one process gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meterql-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df written to the shared checkpoint folder, with a plan that starts there."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def joined_by(rows: DataFrame, few: DataFrame, on: str, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined (semi or anti) with a narrow written table: broadcast while it has at most `most` rows, else by sorting both."""
    return rows.join(F.broadcast(few) if few.count() <= most else few.hint("merge"), on, how)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(texts: Sequence[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about so many characters; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        end, held = at + 1, len(texts[at] or "")
        while end < len(texts) and held + len(texts[end] or "") <= chars:
            held += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def release() -> None:
    """Gives back to the system what Arrow and the C library hold but don't use, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, so that heap which one stage filled goes back to the system before the next.

    Else a heap stays as large as it ever was, beside the Python workers of later stages. There is a task a core, as free
    executors share them; rows and results don't depend on where they run.
    """
    cores = spark.sparkContext.defaultParallelism
    collect = F.expr("java_method('java.lang.System', 'gc')")
    spark.range(0, cores, 1, cores).select(collect.alias("none")).write.format("noop").mode("overwrite").save()


def by_rows(df: DataFrame, run: Callable[..., dict[str, list]], fields: str, chars: int = CHARS_AT_ONCE, done: Callable[[], None] | None = None) -> DataFrame:
    """(first column, fields): run gets the other columns as lists, the first of them text, and returns fields as lists or Arrow arrays.

    The first column passes through as Arrow has it, so no id changes, whatever
    its type and whether nulls stand beside it. Rows go to run in slices of
    about `chars` characters; done is called at the end of each task.
    """
    key, spark = df.schema[0], df.sparkSession
    schema = T.StructType([key, *spark.createDataFrame([], fields).schema])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at, end in slices(batch.column(1).to_pylist(), chars):
                    part = batch.slice(at, end - at)
                    out = run(*[c.to_pylist() for c in part.columns[1:]])
                    columns = [part.column(0).cast(arrow.types[0]), *[x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in list(arrow)[1:]]]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            if done:
                done()
            release()  # the worker may go on to other work

    return df.mapInArrow(each, schema)
