"""Statements over growing tables: the same plan, lowered onto file streams.

Filters, projections and inner joins give append streams; statements that
group give streams for the complete or update mode, where ORDER BY is allowed
in the complete mode, as Structured Streaming has it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from meterql.engine import Engine
from meterql.errors import QueryError
from meterql.front.parse import parse
from meterql.operators import lower
from meterql.plans.binder import Binder


def dataframe(engine: Engine, sql: str, static: Iterable[str] = ()) -> DataFrame:
    """The streaming answer; tables named in static are read once, as the small side of joins."""
    once = set(static)
    plan = Binder(engine.catalog.schema, engine.strict).bind(parse(sql))
    try:
        return lower(plan, lambda t: engine.catalog.frame(t) if t in once else engine.catalog.stream(t))
    except AnalysisException as e:
        raise QueryError(str(e).splitlines()[0]) from e
