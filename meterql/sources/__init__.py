"""A directory of CSV and Parquet files as tables."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterql.errors import QueryError
from meterql.plans.nodes import Field

_NAMES = {T.LongType: "INT64", T.DoubleType: "FLOAT64", T.BooleanType: "BOOL", T.StringType: "STRING", T.NullType: "NULL"}
_WIDEN = {T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.FloatType: "double"}
_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
#: The only spellings of booleans.
BOOLEANS = ("true", "TRUE", "True", "false", "FALSE", "False")
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def type_name(kind: T.DataType) -> str:
    return _NAMES.get(type(kind)) or kind.simpleString().upper()


class Catalog:
    """Tables of one flat directory, on any file system that Spark reads.

    name.csv goes before name.parquet; a Parquet table may be a directory.
    Schemas are read once and kept. strict_types refuses nested columns.
    """

    def __init__(self, spark: SparkSession, directory: str, strict_types: bool = False, multi_line_csv: bool = False) -> None:
        self.spark, self.directory = spark, directory.rstrip("/") or "/"
        self.strict_types, self.multi_line_csv = strict_types, multi_line_csv
        self._lock = threading.Lock()
        self._locks: dict[str, threading.Lock] = {}
        self._frames: dict[str, DataFrame] = {}
        self._fields: dict[str, tuple[Field, ...]] = {}
        self._cells: dict[str, tuple[T.StructType, list[str]]] = {}

    def _files(self) -> dict[str, bool]:
        """Entry names, and whether each is a directory."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.directory)
        system = path.getFileSystem(conf)
        if not system.exists(path):
            raise QueryError(f'list data dir "{self.directory}": not found')
        return {s.getPath().getName(): s.isDirectory() for s in system.listStatus(path)}

    def tables(self) -> list[str]:
        files = self._files()
        return sorted({f.removesuffix(".csv") for f, is_dir in files.items() if f.endswith(".csv") and not is_dir and f != ".csv"}
                      | {f.removesuffix(".parquet") for f in files if f.endswith(".parquet") and f != ".parquet"})

    def _path(self, name: str) -> str:
        if not name:
            raise QueryError("empty table name")
        if "/" in name or "\\" in name or ".." in name:
            raise QueryError(f'invalid table name "{name}"')
        files = self._files()
        for extension in (".csv", ".parquet"):
            if name + extension in files and (extension == ".parquet" or not files[name + extension]):
                return f"{self.directory}/{name}{extension}"
        raise QueryError(f'table "{name}" not found in "{self.directory}"')

    def frame(self, name: str) -> DataFrame:
        """The table, whole numbers as bigint and fractions as double; other types as Spark has them."""
        with self._lock:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._frames:
                path = self._path(name)
                frame = self._csv(name, path) if path.endswith(".csv") else self._parquet(path)
                self._fields[name] = tuple(Field(f.name, type_name(f.dataType), f.nullable) for f in frame.schema)
                self._frames[name] = frame
            return self._frames[name]

    def stream(self, name: str) -> DataFrame:
        """The table as a file stream with frame()'s columns; files that come later are read too.

        A table that is one file is watched in its directory by its name.
        """
        self.frame(name)
        path = self._path(name)
        whole = name + (".csv" if path.endswith(".csv") else ".parquet")
        folder, only = (path, "*") if self._files()[whole] else (self.directory, whole)
        if path.endswith(".csv"):
            schema, kinds = self._cells[name]
            raw = self.spark.readStream.options(**self._csv_options(), pathGlobFilter=only).schema(schema).csv(folder)
            return _typed(raw, kinds, self._frames[name].columns)
        return _widened(self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("pathGlobFilter", only).parquet(folder))

    def schema(self, name: str) -> tuple[Field, ...]:
        if name not in self._fields:
            self.frame(name)
        return self._fields[name]

    def _parquet(self, path: str) -> DataFrame:
        frame = self.spark.read.parquet(path)
        for f in frame.schema if self.strict_types else ():
            if isinstance(f.dataType, _NESTED):
                raise QueryError(f'column "{f.name}": {"repeated fields" if isinstance(f.dataType, T.ArrayType) else "nested schemas"} are not supported')
        return _widened(frame)

    def _csv_options(self) -> dict:
        return {"header": True, "inferSchema": False, "ignoreLeadingWhiteSpace": True, "mode": "FAILFAST", "escape": '"', "multiLine": self.multi_line_csv}

    def _csv(self, name: str, path: str) -> DataFrame:
        raw = self.spark.read.options(**self._csv_options()).csv(path)
        if not raw.columns:
            raise QueryError(f'csv "{name}" is empty')
        columns = raw.columns
        # The types are decided by one pass that counts, for every column, the cells of each shape.
        flat = raw.toDF(*[f"c{i}" for i in range(len(columns))])
        found = flat.agg(*[a.alias(f"{k}{i}") for i in range(len(columns)) for k, a in _shapes(F.col(f"c{i}")).items()], F.count(F.lit(1)).alias("rows")).first()
        kinds = [_kind(*(found[f"{k}{i}"] for k in ("filled", "ints", "floats", "bools"))) for i in range(len(columns))]
        schema = T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(len(columns))])
        self._cells[name] = schema, kinds
        return _typed(self.spark.read.options(**self._csv_options()).schema(schema).csv(path), kinds, columns)


def _typed(cells: DataFrame, kinds: list[str], names: list[str]) -> DataFrame:
    return cells.select(*[F.col(f"c{i}").cast(k).alias(c) for i, (c, k) in enumerate(zip(names, kinds))])


def _widened(frame: DataFrame) -> DataFrame:
    """Casts over plain columns only: the reader still prunes and pushes filters down."""
    wide = {f.name: _WIDEN[type(f.dataType)] for f in frame.schema if type(f.dataType) in _WIDEN}
    return frame.select(*[F.col(f"`{c}`").cast(wide[c]).alias(c) if c in wide else F.col(f"`{c}`") for c in frame.columns]) if wide else frame


def _shapes(c: Column) -> dict[str, Column]:
    whole = c.rlike(_INT) & c.try_cast("bigint").isNotNull()
    count = lambda condition: F.count(F.when(condition, 1))
    return {"filled": F.count(c), "ints": count(whole), "floats": count(c.rlike(_FLOAT)), "bools": count(c.isin(*BOOLEANS))}


def _kind(filled: int, ints: int, floats: int, bools: int) -> str:
    """Whole numbers, then numbers, then booleans, else text; a column without values is text."""
    if not filled:
        return "string"
    if ints == filled:
        return "bigint"
    if floats == filled:
        return "double"
    return "boolean" if bools == filled else "string"
