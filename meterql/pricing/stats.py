"""Table statistics: exact counts for the columns a price needs, in one Spark job, kept for the catalog's life.

A column's values are grouped, added up before they are shuffled, and the groups counted: distinct values, nulls
and bounds come from one grouping of that column alone, so no row is expanded once for each column.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnStats:
    distinct: int
    nulls: int = 0
    numeric: bool = False
    low: float = 0.0
    high: float = 0.0


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)  # by lower-case name


class StatsProvider:
    """approximate counts distinct values by a sketch; prices are then estimates of the exact ones."""

    def __init__(self, frame_of: Callable[[str], DataFrame], approximate: bool = False) -> None:
        self.frame_of, self.approximate = frame_of, approximate
        self._lock, self._locks, self._known = threading.Lock(), {}, {}

    def get(self, table: str, columns: Iterable[str] = ()) -> TableStats:
        """Statistics of a table that hold at least the named columns (those it has)."""
        with self._lock:
            lock = self._locks.setdefault(table, threading.Lock())
        with lock:
            known: TableStats | None = self._known.get(table)
            frame = self.frame_of(table)
            wanted = {c.lower() for c in columns}
            missing = [f for f in frame.schema if f.name.lower() in wanted and (known is None or f.name.lower() not in known.columns)]
            if known is None or missing:
                self._known[table] = known = self._measure(frame, missing, known)
            return known

    def _measure(self, frame: DataFrame, columns: list, known: TableStats | None) -> TableStats:
        numeric = [f.dataType.typeName() in ("long", "double") for f in columns]
        parts = [self._column(frame, f, i, numeric[i]) for i, f in enumerate(columns)]
        if not parts:
            return TableStats(frame.count(), dict(known.columns) if known else {})
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        rows = {r.i: r for r in whole.collect()}  # one row a column
        found = dict(known.columns) if known else {}
        for i, f in enumerate(columns):
            own = rows[i]
            seen = numeric[i] and own.low is not None
            found[f.name.lower()] = ColumnStats(own.distinct, own.rows - own.filled, seen, own.low if seen else 0.0, own.high if seen else 0.0)
        return TableStats(rows[0].rows, found)

    def _column(self, frame: DataFrame, field, i: int, numeric: bool) -> DataFrame:
        """(i, rows, filled, distinct, low, high) of one column."""
        value, count = F.col("v"), F.count(F.lit(1)).cast("bigint")
        own = frame.select(F.col(f"`{field.name}`").alias("v"))
        bounds = [(f(value) if numeric else F.lit(None)).cast("double").alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
        if field.dataType.typeName() in ("array", "map", "struct"):
            return own.agg(F.lit(i).alias("i"), count.alias("rows"), F.count(value).alias("filled"), F.lit(0).cast("bigint").alias("distinct"), *bounds)
        if self.approximate:
            return own.agg(F.lit(i).alias("i"), count.alias("rows"), F.count(value).alias("filled"), F.approx_count_distinct(value).alias("distinct"), *bounds)
        groups = own.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return groups.agg(F.lit(i).alias("i"), total("n").alias("rows"), total(F.when(value.isNotNull(), F.col("n"))).alias("filled"), F.count(value).alias("distinct"), *bounds)
