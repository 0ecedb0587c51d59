"""The registered queries: each statement in this dialect beside the same in plain SQL.

The reader casts whole numbers to bigint; the SQL does so where a table has
narrower ones. Sums of floats are rounded alike on both sides, as engines add
in different orders.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterql.admission import Quota, bucket_step, tokens_for
from meterql.engine import Engine
from meterql.errors import QueryError
from meterql.front.parse import parse


@dataclass(frozen=True)
class Entry:
    """rounded: columns that are rounded to so many places on the Spark side."""

    sql: str
    oracle: str | None = None  # the dialect's own text where None
    rounded: tuple[tuple[str, int], ...] = ()
    renamed: tuple[str, ...] = ()


_LINE = "l_orderkey, l_linenumber"
_LINE_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
_Q1 = """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc,
SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, AVG(l_quantity) AS avg_qty, AVG(l_discount) AS avg_disc, COUNT(*) AS n
FROM lineitem WHERE l_quantity < 45 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""

ENTRIES: dict[str, Entry] = {
    # scans
    "scan_star_region": Entry("SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "scan_projection": Entry("SELECT o_orderkey, o_totalprice FROM orders"),
    "scan_qualified_star": Entry("SELECT n.* FROM nation n", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "scan_native_types": Entry("SELECT event_id, ts, props FROM events"),
    "scan_alias": Entry("SELECT c.c_name AS customer_name, c.c_acctbal balance FROM customer AS c", "SELECT c_name AS customer_name, c_acctbal AS balance FROM customer"),
    # filters and predicates
    "filter_cmp_eq": Entry("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "filter_cmp_ne": Entry("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_cmp_lt": Entry("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000.5"),
    "filter_cmp_le": Entry("SELECT o_orderkey FROM orders WHERE o_totalprice <= 20000"),
    "filter_cmp_gt": Entry(f"SELECT {_LINE} FROM lineitem WHERE l_quantity > 48", f"SELECT {_LINE_SQL} FROM lineitem WHERE l_quantity > 48"),
    "filter_cmp_ge": Entry(f"SELECT {_LINE} FROM lineitem WHERE l_discount >= 0.09", f"SELECT {_LINE_SQL} FROM lineitem WHERE l_discount >= CAST(0.09 AS DOUBLE)"),
    "filter_bool_3vl": Entry(f"SELECT {_LINE} FROM lineitem WHERE NOT (l_discount > 0.05) AND l_quantity < 10 OR l_tax = 0.0 AND NULL",
                             f"SELECT {_LINE_SQL} FROM lineitem WHERE NOT (l_discount > CAST(0.05 AS DOUBLE)) AND l_quantity < 10 OR l_tax = 0.0 AND CAST(NULL AS BOOLEAN)"),
    "filter_null_cmp": Entry("SELECT o_orderkey FROM orders WHERE o_custkey = NULL"),
    "filter_null": Entry("SELECT o_orderkey FROM orders WHERE NULL", "SELECT o_orderkey FROM orders WHERE CAST(NULL AS BOOLEAN)"),
    "filter_column_cmp": Entry("SELECT o_orderkey FROM orders WHERE o_orderkey > o_custkey * 10 AND o_orderstatus >= 'O'"),
    # scalar expressions
    "arith_int_div": Entry("SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey / 7 AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS m FROM orders"),
    "arith_div_zero": Entry("SELECT o_orderkey, o_orderkey / (o_custkey - o_custkey) AS q, o_totalprice / 0 AS f FROM orders", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS q, CAST(NULL AS DOUBLE) AS f FROM orders"),
    "arith_float": Entry(f"SELECT {_LINE}, l_extendedprice * (1 - l_discount) AS net FROM lineitem", f"SELECT {_LINE_SQL}, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem", (("net", 4),)),
    "arith_null": Entry("SELECT r_regionkey + NULL AS a, NULL AS b FROM region", "SELECT CAST(NULL AS BIGINT) AS a, CAST(NULL AS VARCHAR) AS b FROM region"),
    "arith_precedence": Entry("SELECT o_orderkey + o_custkey * 2 - (o_orderkey - 1) AS x FROM orders", "SELECT o_orderkey + o_custkey * 2 - (o_orderkey - 1) AS x FROM orders"),
    "unary_minus": Entry("SELECT o_orderkey, -o_totalprice AS neg, -(-o_custkey) AS pos FROM orders"),
    "literals": Entry("SELECT r_name, 1 AS i, 2.5 AS f, 'it''s' AS s, TRUE AS t FROM region", "SELECT r_name, CAST(1 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS f, 'it''s' AS s, TRUE AS t FROM region"),
    "boolean_output": Entry("SELECT o_orderkey, o_totalprice > 100000 AS large, NOT o_custkey = 7 AS other FROM orders"),
    "default_names": Entry("SELECT r_regionkey + 1, COUNT(*) FROM region GROUP BY r_regionkey + 1", "SELECT CAST(r_regionkey + 1 AS BIGINT) AS x, COUNT(*) AS n FROM region GROUP BY 1", renamed=("x", "n")),
    # distinct
    "distinct_multi": Entry("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_nulls": Entry("SELECT DISTINCT n.n_name FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey"),
    # joins
    "join_inner": Entry("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_inner_filtered": Entry("SELECT o.o_orderkey, c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 150000 AND c.c_mktsegment = 'BUILDING'"),
    "join_inner_multikey": Entry("SELECT a.l_orderkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45"),
    "join_three_way": Entry("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "join_self": Entry("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "join_expr_key": Entry("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey + 1 = r.r_regionkey * 1"),
    "join_int_float_key": Entry("SELECT p.p_partkey, l.l_orderkey FROM part p JOIN lineitem l ON l.l_quantity = p.p_partkey"),
    "join_star": Entry("SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left_miss": Entry("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey"),
    "join_left_aggregate": Entry("SELECT n.n_name, COUNT(c.c_custkey) AS n FROM nation n LEFT OUTER JOIN customer c ON c.c_custkey = n.n_nationkey GROUP BY n.n_name"),
    "join_right": Entry("SELECT n.n_name, c.c_custkey FROM nation n RIGHT JOIN customer c ON c.c_custkey = n.n_nationkey"),
    "join_full": Entry("SELECT n.n_name, s.s_name FROM nation n FULL JOIN supplier s ON s.s_suppkey = n.n_nationkey"),
    "join_null_keys": Entry("SELECT a.c_custkey, b.n_name FROM customer a LEFT JOIN nation n ON a.c_custkey = n.n_nationkey JOIN nation b ON b.n_name = n.n_name"),
    # aggregation
    "group_count": Entry("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "group_count_expr": Entry("SELECT c.c_mktsegment, COUNT(n.n_name) AS n FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey GROUP BY c.c_mktsegment"),
    "group_sum": Entry("SELECT o_custkey, SUM(o_orderkey) AS total FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(SUM(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey"),
    "group_sum_float": Entry("SELECT o_orderpriority, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority", (("total", 2),)),
    "group_avg": Entry("SELECT event_type, AVG(value) AS mean FROM events GROUP BY event_type", "SELECT event_type, round(AVG(value), 6) AS mean FROM events GROUP BY event_type", (("mean", 6),)),
    "group_min": Entry("SELECT o_orderstatus, MIN(o_totalprice) AS low, MIN(o_orderpriority) AS first FROM orders GROUP BY o_orderstatus"),
    "group_max": Entry("SELECT o_custkey, MAX(o_orderdate) AS latest FROM orders GROUP BY o_custkey"),
    "group_multi_key": Entry("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_expr_key": Entry("SELECT o_custkey / 100 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey / 100", "SELECT o_custkey // 100 AS bucket, COUNT(*) AS n FROM orders GROUP BY 1"),
    "group_constant": Entry("SELECT COUNT(*) AS n FROM orders GROUP BY 1", "SELECT COUNT(*) AS n FROM orders"),
    "group_null_key": Entry("SELECT n.n_name, COUNT(*) AS n FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey GROUP BY n.n_name"),
    "group_without_aggregate": Entry("SELECT p_brand FROM part GROUP BY p_brand"),
    "group_qualified_mix": Entry("SELECT o.o_orderstatus, COUNT(*) AS n FROM orders o GROUP BY o_orderstatus"),
    "agg_global": Entry("SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders", "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders"),
    "agg_global_empty": Entry("SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
                              "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_arith": Entry("SELECT o_orderstatus, SUM(o_totalprice) / COUNT(*) AS mean FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(SUM(o_totalprice) / COUNT(*), 4) AS mean FROM orders GROUP BY o_orderstatus", (("mean", 4),)),
    "agg_sum_null": Entry("SELECT SUM(NULL) AS s, COUNT(NULL) AS n FROM region", "SELECT CAST(NULL AS BIGINT) AS s, CAST(0 AS BIGINT) AS n"),
    "count_distinct": Entry("SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "sum_avg_distinct": Entry("SELECT SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a FROM part", "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, AVG(DISTINCT CAST(p_size AS DOUBLE)) AS a FROM part"),
    # order and limit
    "order_nulls_asc": Entry("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey ORDER BY n_name, c_custkey LIMIT 40",
                             "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_custkey = n_nationkey ORDER BY n_name ASC NULLS LAST, c_custkey LIMIT 40"),
    "order_nulls_desc_limit": Entry("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey ORDER BY n_name DESC, c_custkey DESC LIMIT 20",
                                    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_custkey = n_nationkey ORDER BY n_name DESC NULLS FIRST, c_custkey DESC LIMIT 20"),
    "order_alias_aggregate": Entry("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 15"),
    "order_expression": Entry("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey - o_orderkey, o_orderkey LIMIT 25"),
    "limit_zero": Entry("SELECT * FROM region LIMIT 0", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region LIMIT 0"),
    "order_all": Entry("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber",
                       "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem"),
    "topk": Entry("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    # whole queries
    "q1_like": Entry(_Q1, """SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS sum_qty, round(SUM(l_extendedprice), 2) AS sum_base, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(AVG(l_quantity), 6) AS avg_qty, round(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
FROM lineitem WHERE l_quantity < 45 GROUP BY l_returnflag, l_linestatus""", (("sum_qty", 2), ("sum_base", 2), ("sum_disc", 2), ("sum_charge", 2), ("avg_qty", 6), ("avg_disc", 6))),
    "revenue_by_region": Entry("""SELECT r.r_name, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue, COUNT(DISTINCT o.o_orderkey) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'O' GROUP BY r.r_name""",
                               """SELECT r.r_name, round(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, COUNT(DISTINCT o.o_orderkey) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'O' GROUP BY r.r_name""", (("revenue", 2),)),
}

FLAGSHIP = "SELECT o_orderpriority, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority ORDER BY total DESC"

#: Columns of all tables: (numeric, other comparable, nested).
_STATS_COLUMNS = {
    "region": ("r_regionkey", "r_name", ""), "nation": ("n_nationkey n_regionkey", "n_name", ""), "customer": ("c_custkey c_nationkey c_acctbal", "c_name c_mktsegment", ""),
    "supplier": ("s_suppkey s_nationkey s_acctbal", "s_name", ""), "part": ("p_partkey p_size p_retailprice", "p_name p_brand p_type", ""), "orders": ("o_orderkey o_custkey o_totalprice", "o_orderstatus o_orderdate o_orderpriority", ""),
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "l_returnflag l_linestatus l_shipdate", ""), "events": ("event_id user_id value", "ts event_type props", ""),
    "documents": ("doc_id n_chars", "text lang source", ""), "embeddings": ("vec_id label", "", "embedding"), "pages": ("page_id", "url html", ""), "benchmark": ("item_id", "text", ""),
    "labels": ("doc_id quality toxic", "", ""), "conversations": ("conv_id turn", "role text", ""),
}

#: Statements whose price the SQL works out from the tables' own counts: (name, statement, its price in SQL).
_PRICED = (
    ("scan all columns", "SELECT * FROM region", "(SELECT 2 * count(*) + count(*) FROM region)"),
    ("scan two columns", "SELECT o_orderkey, o_totalprice FROM orders", "(SELECT 2 * count(*) + count(*) FROM orders)"),
    ("equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "(SELECT 2 * n + n + greatest(1, floor(n * (1 / d))) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS d FROM orders))"),
    ("inequality", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "(SELECT 2 * n + n + greatest(1, floor(n * (1 - 1 / d))) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS d FROM orders))"),
    ("range", "SELECT o_totalprice FROM orders WHERE o_totalprice > 100000", "(SELECT n + n + greatest(1, floor(n * least(1, greatest(0, (hi - 100000) / (hi - lo))))) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders))"),
    ("both of two", "SELECT l_orderkey FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'",
     "(SELECT 3 * n + n + greatest(1, floor(n * (((10 - lo) / (hi - lo)) * (1 / d)))) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(count(DISTINCT l_returnflag) AS DOUBLE) AS d FROM lineitem))"),
    ("grouping", "SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority", "(SELECT count(*) + count(*) + count(DISTINCT o_orderpriority) FROM orders)"),
    ("whole aggregate", "SELECT COUNT(*), MAX(o_totalprice) FROM orders", "(SELECT count(*) + count(*) + 1 FROM orders)"),
    ("sort", "SELECT o_custkey FROM orders ORDER BY o_custkey", "(SELECT n + n + n * log2(n) FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders))"),
    ("limit", "SELECT c_name FROM customer LIMIT 7", "(SELECT count(*) + count(*) + least(7, count(*)) FROM customer)"),
    ("distinct", "SELECT DISTINCT l_returnflag FROM lineitem ORDER BY l_returnflag", "(SELECT n + n + CASE WHEN d > 1 THEN d * log2(d) ELSE 0 END FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT l_returnflag) AS DOUBLE) AS d FROM lineitem))"),
    ("join, the smaller side built", "SELECT n.n_name, c.c_name FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey",
     "(SELECT 2 * small + 2 * large + (2 * small + large) + greatest(1, floor(small * large / keys)) FROM (SELECT CAST((SELECT count(*) FROM nation) AS DOUBLE) AS small, CAST((SELECT count(*) FROM customer) AS DOUBLE) AS large, CAST(greatest((SELECT count(DISTINCT n_nationkey) FROM nation), (SELECT count(DISTINCT c_nationkey) FROM customer)) AS DOUBLE) AS keys))"),
)
#: Plans as EXPLAIN shows them.
_EXPLAINED = (
    ("SELECT r_name FROM region", ("Project: r_name", "  Scan: region")),
    ("SELECT DISTINCT n.n_name AS name FROM nation AS n WHERE n.n_regionkey = 1 LIMIT 3", ("Limit: 3", "  Project (DISTINCT): n.n_name AS name", "    Filter: n.n_regionkey = 1", "      Scan: nation AS n")),
    ("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC", ("Sort: n DESC", "  Project: c_mktsegment, COUNT(*) AS n", "    Aggregate: group by c_mktsegment; aggs COUNT(*)", "      Scan: customer")),
    ("SELECT n.n_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey", ("Project: n.n_name", "  Join LEFT on n.n_regionkey = r.r_regionkey", "    Scan: nation AS n", "    Scan: region AS r")),
)
#: Statements that are refused, and why.
_REFUSED = (
    ("SELECT nope FROM region", 'SELECT: unknown column "nope"'),
    ("SELECT r_name FROM nope", None),
    ("SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", 'SELECT: ambiguous column "n_name" (qualify it with a table name)'),
    ("SELECT o_custkey, COUNT(*) FROM orders", 'SELECT: column "o_custkey" must appear in GROUP BY or be used in an aggregate'),
    ("SELECT * FROM orders GROUP BY o_custkey", "'*' cannot be used with GROUP BY or aggregates"),
    ("SELECT o_orderkey FROM orders WHERE o_orderstatus > 1", "WHERE: cannot compare STRING with INT64"),
    ("SELECT o_orderkey FROM orders WHERE o_orderkey", "WHERE clause must be boolean, got INT64"),
    ("SELECT o_orderkey FROM orders WHERE COUNT(*) > 1", "WHERE: aggregate COUNT is not allowed here"),
    ("SELECT SUM(o_orderstatus) FROM orders", "SELECT: SUM requires a number, got STRING"),
    ("SELECT SUM(o_orderkey, o_custkey) FROM orders", "SELECT: SUM expects exactly one argument"),
    ("SELECT MEDIAN(o_orderkey) FROM orders", 'SELECT: unknown function "MEDIAN"'),
    ("SELECT -o_orderstatus FROM orders", "SELECT: unary minus requires a number, got STRING"),
    ("SELECT o_orderstatus + 1 FROM orders", "SELECT: + requires numbers, got STRING and INT64"),
    ("SELECT x.* FROM orders", 'unknown table "x" in x.*'),
    ("SELECT o_orderkey FROM orders ORDER BY o_custkey", 'ORDER BY o_custkey: unknown column "o_custkey" (only selected columns and aliases can be ordered by)'),
    ("SELECT n_name FROM nation JOIN region ON n_regionkey > r_regionkey", "hash join supports only '=' conditions (optionally ANDed), got >"),
)
#: Two small files, and the published prices of four statements over them: 8 orders of 3 names at 40 to 500, 3 customers.
_SAMPLE = {
    "orders": ("id,name,amount,status", "1,Alice,120.5,paid", "2,Bob,75,pending", "3,Alice,310,paid", "4,Carol,40,pending", "5,Bob,220,paid", "6,Alice,95.25,pending", "7,Carol,500,paid", "8,Bob,180,paid"),
    "customers": ("name,city,tier", "Alice,Seattle,gold", "Bob,Portland,silver", "Carol,Denver,gold"),
}
_PUBLISHED = (
    ("SELECT name, COUNT(*) FROM orders GROUP BY name", 19), ("SELECT name FROM orders WHERE amount > 100", 30), ("SELECT * FROM orders", 40),
    ("SELECT o.name, c.city FROM orders o JOIN customers c ON o.name = c.name WHERE o.amount > 100", 48),
)
#: Statements and their canonical text.
_WRITTEN = (
    ("select * from t", "SELECT * FROM t"), ("SELECT a.x AS y, b.* FROM t a INNER JOIN u AS b ON a.i = b.i;", "SELECT a.x AS y, b.* FROM t AS a JOIN u AS b ON a.i = b.i"),
    ("SELECT x FROM t LEFT OUTER JOIN u ON t.i = u.i", "SELECT x FROM t LEFT JOIN u ON t.i = u.i"), ("SELECT DISTINCT a FROM t WHERE (a <> 1 OR b) AND NOT (c = 2 OR d)", "SELECT DISTINCT a FROM t WHERE (a != 1 OR b) AND NOT (c = 2 OR d)"),
    ("SELECT a - (b - c) - d, (a + b) * c / -e FROM t", "SELECT a - (b - c) - d, (a + b) * c / -e FROM t"), ("SELECT COUNT(DISTINCT x), sum(a*b) FROM t GROUP BY c, d+1 ORDER BY c ASC, 2 DESC LIMIT 7", "SELECT COUNT(DISTINCT x), sum(a * b) FROM t GROUP BY c, d + 1 ORDER BY c, 2 DESC LIMIT 7"),
    ("SELECT 'it''s', .5, 1e3, TRUE, null FROM t -- note\n/* more */ WHERE x = - -5", "SELECT 'it''s', 0.5, 1000.0, TRUE, NULL FROM t WHERE x = -(-5)"),
)
#: Token bucket at rate 10 and burst 10: (tokens, seconds since, cost, allowed, whole tokens left).
_STEPS = ((10.0, 0.0, 4, True, 6), (3.0, 0.0, 3, True, 0), (2.0, 0.0, 5, False, 2), (0.0, 0.5, 5, True, 0), (0.0, 10.0, 1, True, 9), (10.0, 0.0, 20, False, 10), (5.0, -3.0, 5, True, 0))
#: A file with every shape of cell: its lines, and what a reader makes of them.
_CELLS = ("i,f,e,b,s,d,m,blank,mixed", "0,3.14,1e3,true,hello,2026-06-19,1,,1", "-42,2,-1E-2,FALSE,\"a, \"\"b\"\"\",2026-06-20,2.5,,true", "+7,.5,,False, x y ,not a date,,,x")
_CELLS_SQL = """SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(3.14 AS DOUBLE), CAST(1000 AS DOUBLE), TRUE, 'hello', '2026-06-19', CAST(1 AS DOUBLE), CAST(NULL AS VARCHAR), '1'),
(-42, 2, -0.01, FALSE, 'a, "b"', '2026-06-20', 2.5, NULL, 'true'), (7, 0.5, NULL, FALSE, 'x y ', 'not a date', NULL, NULL, 'x')) AS t(i, f, e, b, s, d, m, blank, mixed)"""


def run(spark: SparkSession, sf_dir: str, entry: Entry) -> DataFrame:
    df = Engine(spark, sf_dir).dataframe(entry.sql)
    df = df.toDF(*entry.renamed) if entry.renamed else df
    return df.withColumns({c: F.round(c, n) for c, n in entry.rounded}) if entry.rounded else df


def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every column of every table."""
    engine, rows = Engine(spark, sf_dir), []
    for table in _STATS_COLUMNS:
        fields = engine.table_schema(table)
        stats = engine.stats.get(table, [f.name for f in fields])
        for f in fields:
            own = stats.columns[f.name.lower()]
            rows.append((table, f.name, stats.rows, own.distinct, own.nulls, own.low if own.numeric else None, own.high if own.numeric else None))
    return spark.createDataFrame(rows, "table_name string, column_name string, row_count long, distinct_count long, null_count long, low double, high double")


def price_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that the SQL works out by itself."""
    engine = Engine(spark, sf_dir)
    return spark.createDataFrame([(name, round(float(engine.cost(sql)), 4)) for name, sql, _ in _PRICED], "statement string, price double")


def explain_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as text, a row for each line."""
    engine = Engine(spark, sf_dir)
    rows = [(k, i, line) for k, (sql, _) in enumerate(_EXPLAINED) for i, line in enumerate(engine.explain(sql).splitlines())]
    return spark.createDataFrame(rows, "statement long, line_number long, line string")


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why statements are refused; none of them runs."""
    engine, rows = Engine(spark, sf_dir), []
    for k, (sql, message) in enumerate(_REFUSED):
        try:
            engine.prepare(sql)
            rows.append((k, "accepted"))
        except QueryError as e:
            rows.append((k, str(e) if message else "refused"))  # a missing table's message names the directory
    return spark.createDataFrame(rows, "statement long, message string")


def _scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; in a session within one process a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise QueryError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/csv-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="meterql-csv-")


def _write_csv(spark: SparkSession, path: str, lines: tuple[str, ...]) -> None:
    """A small file on any file system that Spark writes."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray("\n".join([*lines, ""]).encode()))
    finally:
        out.close()


def published_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over two small CSV files, as they are published, and the tokens they take."""
    folder = _scratch(spark)
    for table, lines in _SAMPLE.items():
        _write_csv(spark, f"{folder}/{table}.csv", lines)
    engine = Engine(spark, folder)
    return spark.createDataFrame([(k, int(cost), tokens_for(cost)) for k, (sql, _) in enumerate(_PUBLISHED) for cost in [engine.cost(sql)]], "statement long, price long, tokens long")


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as the parser writes them back."""
    return spark.createDataFrame([(k, str(parse(sql))) for k, (sql, _) in enumerate(_WRITTEN)], "statement long, text string")


def admission_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a token bucket."""
    found = [(k, bucket_step(tokens, elapsed, cost, Quota(10, 10))[0]) for k, (tokens, elapsed, cost, _, _) in enumerate(_STEPS)]
    return spark.createDataFrame([(k, d.allowed, d.remaining) for k, d in found], "step long, allowed boolean, remaining long")


def schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns of the catalog with the dialect's types."""
    engine = Engine(spark, sf_dir)
    rows = [(t, i, f.name, f.type) for t in engine.tables() if t in _STATS_COLUMNS for i, f in enumerate(engine.table_schema(t))]
    return spark.createDataFrame(rows, "table_name string, place long, column_name string, type string")


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred types and parsed cells of a file with every shape of cell."""
    folder = _scratch(spark)
    _write_csv(spark, f"{folder}/cells.csv", _CELLS)
    return Engine(spark, folder).dataframe("SELECT * FROM cells")


def csv_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and a grouping over tables that were written as CSV files."""
    folder = _scratch(spark)
    for table in ("nation", "region"):
        frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        _write_csv(spark, f"{folder}/{table}.csv", (",".join(frame.columns), *(",".join('"' + str(v).replace('"', '""') + '"' for v in row) for row in frame.collect())))  # tables of a fixed size
    return Engine(spark, folder).dataframe("SELECT r.r_name, COUNT(*) AS n, MIN(n.n_name) AS first, SUM(n.n_nationkey) AS keys FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")


def price_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and tokens of every registered statement."""
    engine = Engine(spark, sf_dir)
    rows = [(name, cost, tokens_for(cost)) for name, e in ENTRIES.items() for cost in [engine.cost(e.sql)]]
    return spark.createDataFrame(rows, "query string, price double, tokens long")


def explain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced plan of every registered statement, as text."""
    engine = Engine(spark, sf_dir)
    return spark.createDataFrame([(name, engine.explain(e.sql), engine.explain_cost(e.sql)) for name, e in ENTRIES.items()], "query string, plan string, priced_plan string")


def _stats_sql() -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, {d} AS distinct_count, COUNT(*) - COUNT({c}) AS null_count, {lo} AS low, {hi} AS high FROM {t}"
    none, parts = "CAST(NULL AS DOUBLE)", []
    for t, (numeric, other, nested) in _STATS_COLUMNS.items():
        parts += [one.format(t=t, c=c, d=f"COUNT(DISTINCT {c})", lo=f"CAST(MIN({c}) AS DOUBLE)", hi=f"CAST(MAX({c}) AS DOUBLE)") for c in numeric.split()]
        parts += [one.format(t=t, c=c, d=f"COUNT(DISTINCT {c})", lo=none, hi=none) for c in other.split()]
        parts += [one.format(t=t, c=c, d="CAST(0 AS BIGINT)", lo=none, hi=none) for c in nested.split()]
    return " UNION ALL ".join(parts)


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    kinds = ", ".join(f"CAST({c} AS {'BIGINT' if isinstance(v, int) else 'VARCHAR'}) AS {c}" for c, v in zip(columns.split(", "), rows[0]))
    return f"SELECT {kinds} FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


_REPORTS = {"stats_table": stats_table, "price_report": price_report, "explain_report": explain_report, "price_core": price_core, "explain_core": explain_core,
            "error_messages": error_messages, "csv_cells": csv_cells, "csv_nation": csv_nation,
            "published_prices": published_prices, "canonical_text": canonical_text, "admission_steps": admission_steps, "schema_table": schema_table}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda s, d, e=e: run(s, d, e)) for name, e in ENTRIES.items()}
    return out | _REPORTS


def oracle_sql() -> dict[str, str]:
    return {name: e.oracle or e.sql for name, e in ENTRIES.items()} | {
        "stats_table": _stats_sql(),
        "price_core": " UNION ALL ".join(f"SELECT '{name}' AS statement, round(CAST({price} AS DOUBLE), 4) AS price" for name, _, price in _PRICED),
        "explain_core": _values([(k, i, line) for k, (_, lines) in enumerate(_EXPLAINED) for i, line in enumerate(lines)], "statement, line_number, line"),
        "error_messages": _values([(k, message or "refused") for k, (_, message) in enumerate(_REFUSED)], "statement, message"),
        "csv_cells": _CELLS_SQL,
        "published_prices": _values([(k, price, -(-price // 10)) for k, (_, price) in enumerate(_PUBLISHED)], "statement, price, tokens"),
        "canonical_text": _values([(k, text) for k, (_, text) in enumerate(_WRITTEN)], "statement, text"),
        "admission_steps": "SELECT CAST(step AS BIGINT) AS step, allowed, CAST(remaining AS BIGINT) AS remaining FROM (VALUES " + ", ".join(f"({k}, {ok}, {left})" for k, (*_, ok, left) in enumerate(_STEPS)) + ") AS t(step, allowed, remaining)",
        "schema_table": f"""SELECT table_name, CAST(ordinal_position - 1 AS BIGINT) AS place, column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INT64' WHEN data_type = 'DOUBLE' THEN 'FLOAT64' WHEN data_type = 'VARCHAR' THEN 'STRING'
WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP_NTZ' WHEN data_type = 'FLOAT[]' THEN 'ARRAY<FLOAT>' ELSE data_type END AS type FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in _STATS_COLUMNS)})""",
        "csv_nation": "SELECT r_name, COUNT(*) AS n, MIN(n_name) AS first, CAST(SUM(n_nationkey) AS BIGINT) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    }
