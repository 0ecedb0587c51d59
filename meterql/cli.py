"""python -m meterql.cli query|explain|cost|tables|version|help"""

from __future__ import annotations

import sys
from collections.abc import Callable

from meterql import __version__
from meterql.errors import QueryError

USAGE = f"""meterql {__version__}: SQL over a directory of CSV and Parquet files, priced before it runs

usage:
  meterql query   "SELECT ..." [--data DIR]           run a query
  meterql explain "SELECT ..." [--cost] [--data DIR]  print the plan (--cost: as priced)
  meterql cost    "SELECT ..." [--data DIR]           print the price
  meterql tables               [--data DIR]           list tables
  meterql version
"""
_NEEDS = {"query": '[--data DIR] "<SQL>"', "explain": '[--cost] [--data DIR] "<SQL>"', "cost": '[--data DIR] "<SQL>"'}


def _arguments(args: list[str]) -> tuple[str, bool, list[str]]:
    """(directory, whether --cost, the rest); flags may stand anywhere."""
    data, cost, rest = "./testdata", False, []
    left = iter(args)
    for a in left:
        name, given, value = a.partition("=")
        if name in ("--data", "-data"):
            data = value if given else next(left, "")
            if not data:
                raise QueryError("--data requires a directory")
        elif a == "--cost":
            cost = True
        elif a.startswith("-"):
            raise QueryError(f'unknown flag "{a}"')
        else:
            rest.append(a)
    return data, cost, rest


def _engine(data: str):
    from pyspark.sql import SparkSession

    from meterql.engine import Engine

    return Engine(SparkSession.builder.appName("meterql").config("spark.ui.enabled", "false").getOrCreate(), data)


def run(args: list[str], write: Callable[[str], object] = sys.stdout.write, engine_of: Callable[[str], object] = _engine) -> None:
    command, rest = (args[0], args[1:]) if args else ("help", [])
    if command in ("help", "--help", "-h"):
        write(USAGE)
    elif command in ("version", "--version", "-v"):
        write(f"meterql {__version__}\n")
    elif command in ("query", "explain", "cost", "tables"):
        data, cost, words = _arguments(rest)
        if command in _NEEDS and not words:
            raise QueryError(f"usage: meterql {command} {_NEEDS[command]}")
        engine = engine_of(data)
        if command == "query":
            write(str(engine.query(words[0])))
        elif command == "explain":
            write(engine.explain_cost(words[0]) if cost else engine.explain(words[0]))
        elif command == "cost":
            write(f"{engine.cost(words[0]):.1f}\n")
        else:
            write("".join(f"{t}\n" for t in engine.tables()) or "(no tables found)\n")
    else:
        raise QueryError(f'unknown command "{command}"')


def main() -> int:
    try:
        run(sys.argv[1:])
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
