"""Plan nodes as DataFrame operations: one lazy DataFrame a plan, all execution Spark's.

Columns have internal names from the scan on (r<relation>_c<column>, then g/a/o
and a number), so duplicate names, self joins and names like COUNT(*) cannot
clash; the output's names are given last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterql import functions as fn
from meterql.front import nodes as n
from meterql.plans.binder import Relation, Scope, canonical, check_join_keys
from meterql.plans.nodes import Aggregate, Filter, Join, Limit, Node, Project, Scan, Sort

Known = dict[n.Expr, fn.Typed]
_HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def scans(node: Node) -> list[Scan]:
    return [node] if isinstance(node, Scan) else [s for c in node.inputs() for s in scans(c)]


class Lowering:
    """Lowers one plan; frame_of gives a table's DataFrame, its columns in the schema's order."""

    def __init__(self, frame_of: Callable[[str], DataFrame]) -> None:
        self.frame_of = frame_of

    def run(self, plan: Node) -> DataFrame:
        self.scope = Scope([Relation(s.label, s.columns) for s in scans(plan)])
        self.known: Known = {
            n.Column(f"c{c}", f"r{r}"): (F.col(f"r{r}_c{c}"), f.type) for r, rel in enumerate(self.scope.relations) for c, f in enumerate(rel.fields)}
        self.relation = 0
        names = [f.name for f in plan.fields]
        return self._node(plan).toDF(*names)

    def _value(self, expr: n.Expr) -> fn.Typed:
        """A canonical expression as a column; what is known is never computed again."""
        if expr in self.known:
            return self.known[expr]
        match expr:
            case n.Literal():
                return fn.literal(expr)
            case n.Unary(op, operand):
                return fn.unary(op, self._value(operand))
            case n.Binary(op, left, right):
                return fn.binary(op, self._value(left), self._value(right))
        raise AssertionError(f"unbound expression {expr}")

    def _bound(self, expr: n.Expr) -> fn.Typed:
        return self._value(canonical(expr, self.scope))

    @staticmethod
    def _shown(typed: fn.Typed) -> Column:
        return typed[0].cast("string") if typed[1] == "NULL" else typed[0]

    def _node(self, node: Node) -> DataFrame:
        match node:
            case Scan():
                frame, r = self.frame_of(node.table), self.relation
                self.relation += 1
                return frame.toDF(*[f"r{r}_c{c}" for c in range(len(node.columns))])
            case Filter():
                return self._node(node.input).where(fn.boolean(self._bound(node.predicate)))
            case Join():
                return self._join(node)
            case Aggregate():
                return self._aggregate(node)
            case Project():
                out = self._node(node.input)
                out = out.select(*[self._shown(self._bound(i.expr)).alias(f"o{k}") for k, i in enumerate(node.items)])
                return out.distinct() if node.distinct else out
            case Sort():
                return self._sort(node)
            case Limit():
                return self._node(node.input).limit(node.count)
        raise AssertionError(f"unknown node {node}")

    def _join(self, node: Join) -> DataFrame:
        left = self._node(node.left)
        right = self._node(node.right)
        check_join_keys(node.on, Scope(self.scope.relations[: len(scans(node.left))]), Scope(self.scope.relations[: self.relation]))
        # Spark chooses broadcast, sort-merge or shuffled hash by measured sizes.
        return left.join(right, fn.boolean(self._value(canonical(node.on, Scope(self.scope.relations[: self.relation])))), _HOW[node.kind])

    def _aggregate(self, node: Aggregate) -> DataFrame:
        frame = self._node(node.input)
        keys = [canonical(g, self.scope) for g in node.group_by]
        calls = [canonical(a, self.scope) for a in node.aggregates]
        columns, arguments = [self._shown(self._value(k)).alias(f"g{i}") for i, k in enumerate(keys)], []
        for i, call in enumerate(calls):
            if isinstance(call.args[0], n.Star):
                arguments.append((None, "INT64"))
            else:
                column, kind = self._value(call.args[0])
                columns.append(column.alias(f"x{i}"))
                arguments.append((f"x{i}", kind))
        out = [fn.aggregate(c, *a).alias(f"a{i}") for i, (c, a) in enumerate(zip(calls, arguments))]
        narrow = frame.select(*columns)
        if not keys:
            result = narrow.agg(*out)
        elif not out:
            result = narrow.distinct()
        else:
            result = narrow.groupBy(*[f"g{i}" for i in range(len(keys))]).agg(*out)
        self.known = {k: (F.col(f"g{i}"), "STRING" if t == "NULL" else t) for i, (k, t) in enumerate(zip(keys, node.types))}
        self.known |= {c: (F.col(f"a{i}"), t) for i, (c, t) in enumerate(zip(calls, node.types[len(keys) :]))}
        return result

    def _sort(self, node: Sort) -> DataFrame:
        out = self._node(node.input)
        self.known = {n.Column(str(i)): (F.col(f"o{i}"), f.type) for i, f in enumerate(node.fields)}
        keys = []
        for key, resolved in zip(node.keys, node.resolved):
            if resolved is not None:  # a constant orders nothing
                column = self._value(resolved)[0]
                keys.append(column.desc_nulls_first() if key.descending else column.asc_nulls_last())
        return out.orderBy(*keys) if keys else out


def lower(plan: Node, frame_of: Callable[[str], DataFrame]) -> DataFrame:
    return Lowering(frame_of).run(plan)
