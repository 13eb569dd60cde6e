"""The query catalogue: every operator as a query on the test tables.

`QUERIES` maps a name to a callable of (spark, sf_dir); `ORACLE` maps it to the
equivalent SQL of the test oracle.  Queries written once in SQL that both
engines read alike are listed in `SHARED`, those in the dialect in `DIALECT`;
both run through `Engine.execute`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.dml import ConstraintError
from skarn.functions import fts, json, spatial, vector
from skarn.operators import relational, statistics
from skarn.session import Engine
from skarn.sources import tables as sources
from skarn.sources.tables import views
from skarn.store import ConflictError

FLAGSHIP = "flagship"

#: name -> (tables, SQL read alike by Spark and the oracle)
SHARED: dict[str, tuple[str, str]] = {
    FLAGSHIP: (
        "customer orders nation",
        """SELECT n.n_name, c.c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
        FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
        WHERE o.o_totalprice > 1000 GROUP BY n.n_name, c.c_mktsegment HAVING COUNT(*) > 1
        ORDER BY n_orders DESC, n_name, c_mktsegment LIMIT 50""",
    ),
    # scans, projections, filters
    "scan_project": ("orders", "SELECT o_orderkey, o_custkey AS cust, o_totalprice * 2 AS doubled FROM orders"),
    "scan_all": ("supplier", "SELECT * FROM supplier"),
    "filter_point": ("orders", "SELECT * FROM orders WHERE o_orderkey = 1234"),
    "filter_range_and": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount > 0.05"),
    "filter_or": ("part", "SELECT p_partkey, p_size FROM part WHERE p_size = 3 OR p_size > 48"),
    "filter_in_list": ("customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_not_in_list": ("orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    "filter_between": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "filter_like": ("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%7'"),
    "filter_is_null": ("orders", "SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders) q WHERE st IS NULL"),
    "filter_is_not_null": ("orders", "SELECT o_orderkey, st FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders) q WHERE st IS NOT NULL"),
    "filter_not": ("orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)"),
    "filter_column_to_column": ("lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey % 100 = l_suppkey"),
    "filter_null_three_valued": ("orders", "SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders) q WHERE st <> 'O'"),
    "filter_boolean": ("part", "SELECT p_partkey, p_size > 25 AS is_large FROM part WHERE (p_size > 25) = TRUE"),
    # expressions
    "arith_mixed": ("lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, -l_quantity AS neg, l_orderkey % 7 AS m FROM lineitem"),
    "case_cast": ("part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CAST(p_size AS DOUBLE) AS size_d, CAST(p_size AS VARCHAR(10)) AS size_s FROM part"),
    "coalesce_nullif": ("orders", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS st, NULLIF(o_custkey, 5) AS cust FROM orders"),
    "string_funcs": ("part", "SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low, LENGTH(p_name) AS len, SUBSTRING(p_name, 2, 3) AS mid, CONCAT(p_brand, '-', p_type) AS joined, TRIM(p_name) AS trimmed, REPLACE(p_brand, 'Brand', 'B') AS replaced FROM part"),
    "string_concat_operator": ("nation", "SELECT n_nationkey, n_name || ':' || CAST(n_regionkey AS VARCHAR(5)) AS label FROM nation"),
    "math_funcs": ("part", "SELECT p_partkey, ABS(p_size - 25) AS a, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, CAST(CEIL(p_retailprice) AS BIGINT) AS c, ROUND(p_retailprice, 1) AS r, ROUND(SQRT(p_retailprice), 6) AS s, ROUND(POWER(p_size, 2), 4) AS p FROM part"),
    "bit_operators": ("part", "SELECT p_partkey, CAST(p_size & 7 AS BIGINT) AS band, CAST(p_size | 8 AS BIGINT) AS bor FROM part"),
    "select_without_from": ("", "SELECT 1 + 2 AS three, 'a' || 'b' AS ab"),
    "select_distinct": ("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "derived_table": ("orders", "SELECT q.o_custkey, q.n FROM (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) q WHERE q.n > 12"),
    # joins
    "join_inner": ("customer orders", "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey"),
    "join_left": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000"),
    "join_right": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000"),
    "join_full": ("supplier customer", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 5000"),
    "join_multiway": ("customer orders nation region", "SELECT r.r_name, n.n_name, c.c_custkey, o.o_orderkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000"),
    "join_theta": ("nation region", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey > r.r_regionkey * 5"),
    "join_cross": ("nation region", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON 1 = 1"),
    "join_self": ("nation", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_comma": ("nation region", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey"),
    "join_using": ("lineitem", "SELECT a.l_orderkey, a.c1, b.c2 FROM (SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS c1 FROM lineitem GROUP BY l_orderkey) a JOIN (SELECT l_orderkey, CAST(SUM(l_linenumber) AS BIGINT) AS c2 FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)"),
    "join_with_cte": ("orders customer", "WITH big AS (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) SELECT c.c_custkey, big.n FROM customer c JOIN big ON big.o_custkey = c.c_custkey"),
    "join_post_where_order_limit": ("customer orders", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20 OFFSET 5"),
    "join_semi": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "join_anti": ("customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    # subqueries
    "sub_scalar_where": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)"),
    "sub_scalar_select": ("orders region", "SELECT r_regionkey, (SELECT MAX(o_totalprice) FROM orders) AS top_price FROM region"),
    "sub_in": ("part lineitem", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"),
    "sub_not_in": ("part lineitem", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
    "sub_exists": ("region orders", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)"),
    "sub_not_exists": ("region orders", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)"),
    "sub_correlated_exists": ("orders lineitem", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)"),
    "sub_correlated_scalar": ("orders", "SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_totalprice > (SELECT 1.5 * AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    # aggregates
    "agg_global": ("lineitem", "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem"),
    "agg_empty": ("orders", "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0"),
    "agg_group": ("lineitem", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_having": ("orders", "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MAX(o_totalprice) > 1000"),
    "agg_having_group_column": ("orders", "SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus HAVING o_orderstatus <> 'F'"),
    "agg_join": ("customer orders", "SELECT c.c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"),
    "agg_distinct": ("lineitem", "SELECT l_returnflag, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS supps FROM lineitem GROUP BY l_returnflag"),
    "agg_filter": ("orders", "SELECT o_orderpriority, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority"),
    "agg_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "agg_cube": ("lineitem", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": ("lineitem", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "agg_order_by_aggregate": ("orders", "SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 3"),
    "agg_null_skipping": ("orders", "SELECT CAST(COUNT(st) AS BIGINT) AS non_null, CAST(COUNT(*) AS BIGINT) AS n, MIN(st) AS lo FROM (SELECT NULLIF(o_orderstatus, 'F') AS st FROM orders) q"),
    "agg_variance": ("lineitem", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 4) AS sd, ROUND(VAR_POP(l_quantity), 4) AS vp FROM lineitem GROUP BY l_returnflag"),
    # windows
    "win_row_number": ("orders", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS rn FROM orders"),
    "win_rank": ("orders", "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders"),
    "win_dense_rank": ("orders", "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS BIGINT) AS r FROM orders"),
    "win_lead": ("events", "SELECT event_id, LEAD(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events"),
    "win_lag": ("events", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prv FROM events"),
    "win_first": ("orders", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM orders"),
    "win_last": ("orders", "SELECT o_orderkey, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders"),
    "win_nth": ("orders", "SELECT o_orderkey, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM orders"),
    "win_rows_frame": ("events", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s FROM events"),
    "win_range_frame": ("part", "SELECT p_partkey, CAST(COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM part"),
    "win_ntile_percent": ("orders", "SELECT o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS q, ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS p, ROUND(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS c FROM orders"),
    "win_aggregate": ("orders", "SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS a FROM orders"),
    # order and limits
    "sort_multi": ("customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey"),
    "sort_nulls": ("orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders ORDER BY st ASC NULLS FIRST, o_orderkey LIMIT 100"),
    "sort_nulls_last": ("orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders ORDER BY st DESC NULLS LAST, o_orderkey LIMIT 100"),
    "sort_expression": ("part", "SELECT p_partkey, p_size FROM part ORDER BY ABS(p_size - 25), p_partkey LIMIT 40"),
    "topk": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10"),
    # set operations
    "union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("part lineitem", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40"),
    "except_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "intersect_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    # common table expressions
    "cte_chain": ("orders", "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE t > 100000) SELECT CAST(COUNT(*) AS BIGINT) AS n FROM b"),
    "cte_columns": ("orders", "WITH a(k, n) AS (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) FROM orders GROUP BY o_custkey) SELECT k, n FROM a WHERE n > 11"),
    "cte_recursive": ("", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(SUM(n) AS BIGINT) AS s, CAST(COUNT(*) AS BIGINT) AS c FROM t"),
    # reference benchmark shapes
    "bench_point_select": ("customer", "SELECT * FROM customer WHERE c_custkey = 777"),
    "bench_range_scan": ("orders", "SELECT * FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000"),
    "bench_group_by": ("customer", "SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(c_acctbal), 4) AS a, MAX(c_acctbal) AS hi, MIN(c_acctbal) AS lo FROM customer GROUP BY c_mktsegment"),
    "bench_join": ("orders lineitem", "SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_totalprice FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_totalprice > 100000"),
    "bench_index_scan": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'"),
    "full_scan_count": ("lineitem", "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem"),
}


_readers: dict[tuple[str, str], tuple[Engine, dict[str, int]]] = {}


def _reader(spark: SparkSession, sf_dir: str, tables: Iterable[str]) -> Engine:
    """One engine for all queries of an application that change nothing; a test
    table is attached again when its file or folder has changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _readers:
        _readers[key] = Engine(spark), {}
    engine, seen = _readers[key]
    engine.inherit(("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"))
    for t in tables:
        changed = sources.modified(spark, f"{sf_dir}/{t}.parquet")
        if seen.get(t) != changed:
            engine.attach(t, _t(spark, sf_dir, t))
            seen[t] = changed
    return engine


def _shared(tables: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _reader(spark, sf_dir, tables.split()).execute(sql)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function as a query with its oracle."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


for _name, (_tables, _sql) in SHARED.items():
    QUERIES[_name] = _shared(_tables, _sql)
    ORACLE[_name] = _sql


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# expressions and operators whose spelling differs ---------------------------


@query("arith_int_div_null", "SELECT p_partkey, CASE WHEN p_size - 25 = 0 THEN NULL ELSE CAST(p_partkey // (p_size - 25) AS BIGINT) END AS q, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey % (p_size % 5) AS BIGINT) END AS m FROM part")
def arith_int_div_null(spark, sf_dir):
    div, mod = relational.int_div, relational.int_mod
    size, key = F.col("p_size"), F.col("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", div(key, size - 25).alias("q"), mod(key, size % 5).alias("m"))


@query("total_of_empty", "SELECT CAST(COALESCE(SUM(o_custkey), 0) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0")
def total_of_empty(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where("o_orderkey < 0").agg(relational.total(F.col("o_custkey")).alias("total"))


@query("rowid_range", "SELECT rid, o_orderkey FROM (SELECT CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) AS BIGINT) AS rid, o_orderkey FROM orders) q WHERE rid BETWEEN 100 AND 110")
def rowid_range(spark, sf_dir):
    return relational.with_rowid(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "rid").where("rid BETWEEN 100 AND 110").select("rid", "o_orderkey")


#: name -> (tables, SQL of the engine's dialect, SQL of the oracle)
DIALECT: dict[str, tuple[str, str, str]] = {
    "join_natural": (
        "nation",
        "SELECT n_regionkey, COUNT(*) AS n FROM (SELECT n_nationkey, n_regionkey FROM nation) a NATURAL JOIN (SELECT n_nationkey, n_name FROM nation) b GROUP BY n_regionkey",
        "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
    ),
    "sub_any": ("part nation", *["SELECT p_partkey FROM part WHERE p_size > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"] * 2),
    "sub_all": ("part nation", *["SELECT p_partkey FROM part WHERE p_size > ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"] * 2),
    "int_division": (
        "part",
        "SELECT p_partkey, p_partkey / p_size AS q, -p_partkey / 7 / 2 AS r, ROUND(p_retailprice / p_size, 6) AS x, p_size / (p_size - p_size) AS z FROM part",
        "SELECT p_partkey, CAST(p_partkey // p_size AS BIGINT) AS q, CAST(trunc(trunc(-p_partkey / 7) / 2) AS BIGINT) AS r, ROUND(p_retailprice / p_size, 6) AS x, CAST(NULL AS BIGINT) AS z FROM part",
    ),
    "sql_comments": ("region", "SELECT r_regionkey, /* a ; b */ r_name -- the name\nFROM region -- 'all'", "SELECT r_regionkey, r_name FROM region"),
    "sort_ordinal": ("supplier", *["SELECT s_name, s_acctbal FROM supplier ORDER BY 2 DESC, 1 LIMIT 7"] * 2),
    "limit_all": ("region", "SELECT r_name FROM region ORDER BY r_name LIMIT ALL", "SELECT r_name FROM region"),
    "join_lateral": ("customer orders", *["SELECT c.c_custkey, q.top FROM customer c, LATERAL (SELECT MAX(o.o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) q WHERE c.c_custkey < 500"] * 2),
    "agg_collect": (
        "orders",
        "SELECT o_custkey, ARRAY_JOIN(SORT_ARRAY(COLLECT_LIST(o_orderkey)), ',') AS keys FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey",
    ),
    "agg_approximate": (
        "orders",
        "SELECT ABS(APPROX_COUNT_DISTINCT(o_custkey, 0.02) - COUNT(DISTINCT o_custkey)) <= 0.08 * COUNT(DISTINCT o_custkey) AS near, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS n FROM orders",
        "SELECT TRUE AS near, COUNT(DISTINCT o_custkey) AS n FROM orders",
    ),
    "total_sql": ("orders", "SELECT TOTAL(o_custkey) AS t FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS BIGINT) AS t"),
    "json_sql": (
        "events",
        "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS DOUBLE) AS k, JSON_VALID(event_type) AS ok, JSON(event_type) AS j, JSON_TYPE(props) AS kind, JSON_ARRAY(event_id, event_type) AS a, JSON_OBJECT('id', event_id) AS o FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, FALSE AS ok, CAST(NULL AS VARCHAR) AS j, 'object' AS kind, '[' || event_id || ',\"' || event_type || '\"]' AS a, '{\"id\":' || event_id || '}' AS o FROM events",
    ),
    "json_paths": (
        "region",
        """SELECT r_regionkey, JSON_EXTRACT(j, '$.a[0][1]') AS x, JSON_EXTRACT(j, '$.a[1][0].b.c') AS y, JSON_TYPE(j, '$.a[0]') AS t, JSON_TYPE(j, '$.a[0][0]') AS u, JSON_EXTRACT(j, '$.a[9]') AS z
        FROM (SELECT r_regionkey, '{"a":[[' || r_regionkey || ',"n"],[{"b":{"c":"' || r_name || '"}}]]}' AS j FROM region) q""",
        """SELECT r_regionkey, json_extract_string(j, '$.a[0][1]') AS x, json_extract_string(j, '$.a[1][0].b.c') AS y, lower(json_type(j, '$.a[0]')) AS t, CASE WHEN json_type(j, '$.a[0][0]') = 'UBIGINT' THEN 'real' END AS u, json_extract_string(j, '$.a[9]') AS z
        FROM (SELECT r_regionkey, '{"a":[[' || r_regionkey || ',"n"],[{"b":{"c":"' || r_name || '"}}]]}' AS j FROM region) q""",
    ),
    "highlight_sql": ("region", "SELECT r_regionkey, HIGHLIGHT('the big apple', 'BIG') AS h FROM region", "SELECT r_regionkey, 'the **big** apple' AS h FROM region"),
    "bbox_sql": (
        "customer",
        "SELECT c_custkey, BBOX_AREA(0, c_nationkey, 0, 2) AS area, BBOX_INTERSECTS(0, c_nationkey, 0, 2, 5, 9, 1, 3) AS meets, BBOX_CONTAINS_POINT(0, c_nationkey, 0, 2, 7, 1) AS holds, ROUND(BBOX_DISTANCE(0, c_nationkey, 0, 2, 20, 2), 6) AS d FROM customer",
        "SELECT c_custkey, c_nationkey * 2.0::DOUBLE AS area, c_nationkey >= 5 AS meets, c_nationkey >= 7 AS holds, ROUND(greatest(0, 20 - c_nationkey)::DOUBLE, 6) AS d FROM customer",
    ),
    "vec_sql_literal": (
        "region",
        "SELECT r_regionkey, ROUND(L2_DISTANCE([r_regionkey, 0, 1], [0, 2.5, 1]), 6) AS d, ROUND(VECTOR_COSINE_SIMILARITY([r_regionkey, 1], [1, 0]), 6) AS c FROM region ORDER BY L2_DISTANCE([r_regionkey, 0, 1], [0, 2.5, 1])",
        "SELECT r_regionkey, ROUND(sqrt(r_regionkey * r_regionkey + 6.25), 6) AS d, ROUND(r_regionkey / sqrt(r_regionkey * r_regionkey + 1), 6) AS c FROM region",
    ),
}
for _name, (_tables, _sql, _oracle) in DIALECT.items():
    QUERIES[_name] = _shared(_tables, _sql)
    ORACLE[_name] = _oracle


@query("rowid_point", "SELECT o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS row_id FROM orders) q WHERE row_id = 42")
def rowid_point(spark, sf_dir):
    rows = relational.with_rowid(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "rid")
    return rows.where("rid = 42").select("o_orderkey", "o_totalprice")


@query("rowid_sql", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS rid, n_name FROM nation WHERE n_nationkey BETWEEN 4 AND 8")
def rowid_sql(spark, sf_dir):
    with _engine(spark, sf_dir, "nation") as e:
        e.execute("CREATE TABLE n (k INTEGER, name TEXT)")
        for sql in ("n_nationkey < 10", "n_nationkey >= 10"):
            e.execute(f"INSERT INTO n SELECT n_nationkey, n_name FROM nation WHERE {sql} ORDER BY n_nationkey")
        return e.execute("SELECT rowid AS rid, name AS n_name FROM n WHERE rowid BETWEEN 5 AND 9")


@query("view_expand", "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
def view_expand(spark, sf_dir):
    with _engine(spark, sf_dir, "orders") as e:
        e.execute("CREATE VIEW big_orders AS SELECT * FROM orders WHERE o_totalprice > 100000")
        return e.execute("SELECT o_custkey, COUNT(*) AS n FROM big_orders GROUP BY o_custkey")


@query("view_columns", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'")
def view_columns(spark, sf_dir):
    with _engine(spark, sf_dir, "orders") as e:
        e.execute("CREATE VIEW done(k, price) AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
        e.execute("CREATE VIEW gone AS SELECT 1 AS one")
        e.execute("DROP VIEW gone")
        e.execute("DROP VIEW IF EXISTS gone")
        return e.execute("SELECT k, price FROM done")


@query("view_check_option", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 900001, 6000.0")
def view_check_option(spark, sf_dir):
    with _engine(spark, sf_dir, "customer") as e:
        e.execute("CREATE TABLE c AS SELECT c_custkey, c_acctbal FROM customer")
        e.execute("CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM c WHERE c_acctbal > 5000 WITH CHECK OPTION")
        e.execute("INSERT INTO rich VALUES (900001, 6000.0)")
        _refused(e, "INSERT INTO rich VALUES (900002, 10.0)")
        _refused(e, "UPDATE rich SET c_acctbal = 0 WHERE c_custkey = 900001")
        return e.execute("SELECT * FROM rich")


@query("prepared_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")
def prepared_parameters(spark, sf_dir):
    e = _reader(spark, sf_dir, ["orders"])
    statement = e.prepare("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ? AND o_totalprice > ?")
    e.execute_prepared(statement, [1, 5.0])
    return e.execute_prepared(statement, [7, 1000.0])


@query("function_registration", "SELECT p_partkey, p_size * 2 + 1 AS y FROM part WHERE p_size > 40")
def function_registration(spark, sf_dir):
    e = _reader(spark, sf_dir, ["part"])

    def odd(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    e.register_function("twice_and_one", F.pandas_udf(odd, "long"))
    return e.execute("SELECT p_partkey, TWICE_AND_ONE(p_size) AS y FROM part WHERE p_size > 40")


@query("join_interval", "SELECT o_orderkey, b.lo FROM orders JOIN (SELECT s_acctbal * 30 AS lo, s_acctbal * 30 + 900 AS hi FROM supplier) b ON o_totalprice BETWEEN b.lo AND b.hi")
def join_interval(spark, sf_dir):
    bands = _t(spark, sf_dir, "supplier").selectExpr("s_acctbal * 30 AS lo", "s_acctbal * 30 + 900 AS hi")
    out = relational.interval_join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "lo", "hi", 900.0)
    return out.select("o_orderkey", "lo")


@query("join_salted", "SELECT c.c_custkey, o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
def join_salted(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").where("o_totalprice > 200000").selectExpr("o_custkey AS k", "o_orderkey")
    return relational.salted_join(orders, _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), "k").selectExpr("k AS c_custkey", "o_orderkey")


@query("asof_join_buckets", "SELECT c.event_id, (SELECT max_by(p.event_id, struct_pack(t := p.ts, i := p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts < c.ts) AS prev_id FROM events c WHERE c.event_type = 'click'")
def asof_join_buckets(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    out = relational.asof_join(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'").withColumnRenamed("event_id", "prev_id"), "user_id", "ts", ["prev_id"], ["prev_id"], "date_trunc('day', ts)")
    return out.select("event_id", "prev_id")


@query("source_formats", "SELECT n_nationkey, n_name, 4 AS copies FROM nation")
def source_formats(spark, sf_dir):
    """A table written and read back in four formats."""
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = []
    with _engine(spark, sf_dir) as e:
        for kind in ("parquet", "orc", "json", "csv"):
            sources.write(nation, f"{e.path}/{kind}", kind)
            parts.append(sources.read(spark, f"{e.path}/{kind}", kind, nation.schema))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return every.groupBy("n_nationkey", "n_name").agg(F.count("*").cast("int").alias("copies"))


@query("asof_join", "SELECT c.event_id, (SELECT max_by(p.event_id, struct_pack(t := p.ts, i := p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts < c.ts) AS prev_id FROM events c WHERE c.event_type = 'click'")
def asof_join(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    out = relational.asof_join(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'").withColumnRenamed("event_id", "prev_id"), "user_id", "ts", ["prev_id"], ["prev_id"])
    return out.select("event_id", "prev_id")


# vectors --------------------------------------------------------------------


def _query_vector(spark, sf_dir) -> list[float]:
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_DIST = "list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("vec_l2_topk", f"SELECT e.vec_id, ROUND({_DIST}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DIST}, e.vec_id LIMIT 10")
def vec_l2_topk(spark, sf_dir):
    out = vector.top_k(_t(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


@query("vec_cosine_topk", f"SELECT e.vec_id, ROUND({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def vec_cosine_topk(spark, sf_dir):
    out = vector.top_k(_t(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id", "cosine")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vec_l2_all", f"SELECT e.vec_id, ROUND({_DIST}, 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def vec_l2_all(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vector.l2_distance(F.col("embedding"), vector.literal(_query_vector(spark, sf_dir))), 5).alias("distance"))


@query("vec_join_knn", f"SELECT query_key, neighbour_key, CAST(rank AS BIGINT) AS rank FROM (SELECT q.vec_id AS query_key, e.vec_id AS neighbour_key, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) z WHERE rank <= 5")
def vec_join_knn(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return vector.knn_join(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("query_key", "neighbour_key", F.col("rank").cast("long").alias("rank"))


# JSON -----------------------------------------------------------------------


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_extract(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", json.json_number(F.col("props"), "$.k").alias("k"))


@query("json_extract_missing", "SELECT event_id, json_extract_string(props, '$.missing') AS v FROM events")
def json_extract_missing(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", json.json_extract(F.col("props"), "$.missing").alias("v"))


@query("json_type", "SELECT event_id, 'real' AS k_type, 'object' AS root_type, CAST(NULL AS VARCHAR) AS none_type FROM events")
def json_type(spark, sf_dir):
    p = F.col("props")
    return _t(spark, sf_dir, "events").select("event_id", json.json_type(p, "$.k").alias("k_type"), json.json_type(p).alias("root_type"), json.json_type(p, "$.zz").alias("none_type"))


@query("json_valid", "SELECT event_id, json_valid(props) AS ok, json_valid(event_type) AS bad FROM events")
def json_valid(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", json.json_valid(F.col("props")).alias("ok"), json.json_valid(F.col("event_type")).alias("bad"))


@query("json_array", "SELECT event_id, '[' || event_id || ',\"' || event_type || '\",null]' AS a FROM events")
def json_array(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", json.json_array(F.col("event_id"), F.col("event_type"), F.lit(None).cast("string")).alias("a"))


@query("json_object", "SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS o FROM events")
def json_object(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", json.json_object(F.lit("id"), F.col("event_id"), F.lit("type"), F.col("event_type")).alias("o"))


# full-text search -----------------------------------------------------------

_TOKENS = r"list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')"


@query("fts_tokenize", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n FROM documents")
def fts_tokenize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(fts.tokenize(F.col("text"))).cast("long").alias("n"))


@query("fts_match_and", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'of', 'is'])")
def fts_match_and(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(fts.match("the of is", ["text"])).select("doc_id")


@query("fts_or", f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['schau', 'elle'])")
def fts_or(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(fts.match("schau OR elle", ["text"])).select("doc_id")


@query("fts_search_score", f"SELECT doc_id, score FROM (SELECT doc_id, CAST(len(list_filter({_TOKENS}, lambda w: w = 'the' OR w = 'und')) AS BIGINT) AS score FROM documents) q WHERE score > 0")
def fts_search_score(spark, sf_dir):
    return fts.search(_t(spark, sf_dir, "documents"), "doc_id", "text", "the und")


@query("fts_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ')")
def fts_phrase(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(fts.match('"of the"', ["text"])).select("doc_id")


@query("fts_not", f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'the') AND NOT list_contains({_TOKENS}, 'was')")
def fts_not(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(fts.match("the -was", ["text"])).select("doc_id")


@query("fts_index_df", f"SELECT term, CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS df, CAST(COUNT(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) q GROUP BY term HAVING COUNT(DISTINCT doc_id) > 20")
def fts_index_df(spark, sf_dir):
    postings = fts.index(_t(spark, sf_dir, "documents"), "doc_id", ["text"])
    return postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("tf")).where("df > 20")


@query("fts_highlight", "SELECT p_partkey, CASE WHEN strpos(lower(p_type), 'e') > 0 THEN substr(p_type, 1, strpos(lower(p_type), 'e') - 1) || '**' || substr(p_type, strpos(lower(p_type), 'e'), 1) || '**' || substr(p_type, strpos(lower(p_type), 'e') + 1) ELSE p_type END AS h FROM part")
def fts_highlight(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fts.highlight(F.col("p_type"), "E").alias("h"))


@query("match_sql", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'of']) AND NOT list_contains({_TOKENS}, 'was')")
def match_sql(spark, sf_dir):
    return _reader(spark, sf_dir, ["documents"]).execute("SELECT doc_id FROM documents WHERE text MATCH 'the of -was'")


@query("match_columns", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 1 AND regexp_split_to_array(lower(p_name), '[^a-z0-9]+')[1] = split_part(lower((SELECT p_name FROM part WHERE p_partkey = 5)), ' ', 1)")
def match_columns(spark, sf_dir):
    word = _t(spark, sf_dir, "part").where("p_partkey = 5").select(F.split(F.lower("p_name"), " ")[0]).first()[0]
    with _engine(spark, sf_dir, "part") as e:
        e.execute("CREATE VIRTUAL TABLE d USING FTS5(name, other)")
        e.execute("INSERT INTO d SELECT element_at(split(p_name, ' '), 1), CAST(p_partkey AS STRING) FROM part")
        e.execute("DELETE FROM d WHERE CAST(other AS INTEGER) % 2 = 0")
        return e.execute(f"SELECT CAST(other AS BIGINT) AS p_partkey FROM d WHERE d MATCH 'name:{word}'")


# spatial --------------------------------------------------------------------

_BOXES = "(SELECT c_custkey AS id, c_acctbal AS x0, c_acctbal + 50 AS x1, CAST(c_custkey % 1000 AS DOUBLE) AS y0, CAST(c_custkey % 1000 + 5 AS DOUBLE) AS y1 FROM customer)"
_REGIONS = "(SELECT s_suppkey AS sid, s_acctbal AS u0, s_acctbal + 100 AS u1, CAST(s_suppkey * 10 % 1000 AS DOUBLE) AS v0, CAST(s_suppkey * 10 % 1000 + 20 AS DOUBLE) AS v1 FROM supplier)"


def _boxes(spark, sf_dir) -> DataFrame:
    views(spark, sf_dir, ["customer"])
    return spark.sql(f"SELECT * FROM {_BOXES} b")


@query("rtree_range", f"SELECT id FROM {_BOXES} b WHERE x0 <= 3000 AND x1 >= 1000 AND y0 <= 400 AND y1 >= 100")
def rtree_range(spark, sf_dir):
    return spatial.search_range(_boxes(spark, sf_dir), spatial.Box.of("x0", "x1", "y0", "y1"), spatial.Box.of(1000, 3000, 100, 400)).select("id")


@query("rtree_knn", f"SELECT id, ROUND(d, 6) AS distance FROM (SELECT id, sqrt(power(greatest(x0 - 500, 0, 500 - x1), 2) + power(greatest(y0 - 500, 0, 500 - y1), 2)) AS d FROM {_BOXES} b) q ORDER BY d, id LIMIT 10")
def rtree_knn(spark, sf_dir):
    out = spatial.nearest(_boxes(spark, sf_dir), spatial.Box.of("x0", "x1", "y0", "y1"), 500, 500, 10, "id")
    return out.select("id", F.round("distance", 6).alias("distance"))


@query("bbox_intersect_join", f"SELECT id, sid FROM {_BOXES} b JOIN {_REGIONS} r ON x0 <= u1 AND x1 >= u0 AND y0 <= v1 AND y1 >= v0")
def bbox_intersect_join(spark, sf_dir):
    left = _boxes(spark, sf_dir)
    views(spark, sf_dir, ["supplier"])
    right = spark.sql(f"SELECT * FROM {_REGIONS} r")
    return spatial.box_join(left, right, spatial.Box.of("x0", "x1", "y0", "y1"), spatial.Box.of("u0", "u1", "v0", "v1"), 100.0).select("id", "sid")


@query("bbox_measures", f"SELECT id, ROUND((x1 - x0) * (y1 - y0), 4) AS area, ROUND((x0 + x1) / 2, 4) AS cx, ROUND((y0 + y1) / 2, 4) AS cy, x0 <= 100 AND x1 >= 100 AND y0 <= 100 AND y1 >= 100 AS has_point, ROUND((greatest(x1, 10) - least(x0, 0)) * (greatest(y1, 10) - least(y0, 0)) - (x1 - x0) * (y1 - y0), 4) AS grown FROM {_BOXES} b")
def bbox_measures(spark, sf_dir):
    b = spatial.Box.of("x0", "x1", "y0", "y1")
    cx, cy = b.center()
    return _boxes(spark, sf_dir).select("id", F.round(b.area(), 4).alias("area"), F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"), b.contains_point(F.lit(100.0), F.lit(100.0)).alias("has_point"), F.round(b.expanded_area(spatial.Box.of(0, 10, 0, 10)), 4).alias("grown"))


# statistics -----------------------------------------------------------------


@query("stats_columns", "SELECT 'o_custkey' AS column_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS ndv, CAST(COUNT(*) - COUNT(o_custkey) AS BIGINT) AS nulls, CAST(MIN(o_custkey) AS VARCHAR) AS lo, CAST(MAX(o_custkey) AS VARCHAR) AS hi FROM orders UNION ALL SELECT 'o_orderstatus', COUNT(*), COUNT(DISTINCT o_orderstatus), COUNT(*) - COUNT(o_orderstatus), MIN(o_orderstatus), MAX(o_orderstatus) FROM orders")
def stats_columns(spark, sf_dir):
    return statistics.column_stats(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], exact=True)


@query("stats_mcv", "SELECT o_orderpriority AS value, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, value LIMIT 3")
def stats_mcv(spark, sf_dir):
    return statistics.most_common(_t(spark, sf_dir, "orders"), "o_orderpriority", 3)


@query("stats_histogram", "SELECT CAST(least(99, floor((o_totalprice - lo) / ((hi - lo) / 100))) AS BIGINT) AS bucket, CAST(COUNT(*) AS BIGINT) AS n FROM orders, (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders) r GROUP BY 1")
def stats_histogram(spark, sf_dir):
    return statistics.histogram(_t(spark, sf_dir, "orders"), "o_totalprice", 100)


@query("stats_selectivity", "SELECT ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F') / COUNT(*), 6) AS eq FROM orders")
def stats_selectivity(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return orders.agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("eq"))


# data changes: the final state of a table -----------------------------------


@query("dml_insert", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 900001, 'new one', 1.5 UNION ALL SELECT 900002, 'new two', NULL")
def dml_insert(spark, sf_dir):
    with _engine(spark, sf_dir, "customer") as e:
        e.execute("CREATE TABLE c AS SELECT c_custkey, c_name, c_acctbal FROM customer")
        e.execute("INSERT INTO c VALUES (900001, 'new one', 1.5)")
        e.execute("INSERT INTO c (c_name, c_custkey) VALUES ('new two', 900002)")
        return e.execute("SELECT * FROM c")


@query("dml_insert_select", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def dml_insert_select(spark, sf_dir):
    with _engine(spark, sf_dir, "customer", "supplier") as e:
        e.execute("CREATE TABLE c AS SELECT c_custkey, c_acctbal FROM customer")
        e.execute("INSERT INTO c SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
        return e.execute("SELECT * FROM c")


@query("dml_update_expr", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ROUND(c_acctbal * 2 + c_custkey, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update_expr(spark, sf_dir):
    with _engine(spark, sf_dir, "customer") as e:
        e.execute("CREATE TABLE c AS SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
        e.execute("UPDATE c SET c_acctbal = ROUND(c_acctbal * 2 + c_custkey, 2), c_mktsegment = 'X' WHERE c_custkey % 3 = 0")
        return e.execute("SELECT * FROM c")


@query("dml_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_totalprice > 50000 AND o_orderstatus = 'F')")
def dml_delete(spark, sf_dir):
    with _engine(spark, sf_dir, "orders") as e:
        e.execute("CREATE TABLE o AS SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
        e.execute("DELETE FROM o WHERE o_totalprice > 50000 AND o_orderstatus = 'F'")
        return e.execute("SELECT o_orderkey, o_custkey FROM o")


@query("txn_rollback", "SELECT r_regionkey, r_name FROM region")
def txn_rollback(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE r AS SELECT r_regionkey, r_name FROM region")
        e.execute("BEGIN")
        e.execute("DELETE FROM r WHERE r_regionkey > 1")
        e.execute("UPDATE r SET r_name = 'gone'")
        e.execute("ROLLBACK")
        return e.execute("SELECT * FROM r")


@query("txn_commit", "SELECT r_regionkey, 'done' AS r_name FROM region WHERE r_regionkey <= 1")
def txn_commit(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE r AS SELECT r_regionkey, r_name FROM region")
        e.execute("BEGIN TRANSACTION")
        e.execute("DELETE FROM r WHERE r_regionkey > 1")
        e.execute("UPDATE r SET r_name = 'done'")
        e.execute("COMMIT")
        return e.execute("SELECT * FROM r")


def _refused(e: Engine, sql: str) -> None:
    """Run a statement that a constraint must refuse."""
    try:
        e.execute(sql)
    except ConstraintError:
        return
    raise AssertionError(f"not refused: {sql}")


@query("dml_insert_many", "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(id) AS BIGINT) AS s, CAST(10000 AS BIGINT) AS last FROM range(10000) r(id)")
def dml_insert_many(spark, sf_dir):
    with _engine(spark, sf_dir) as e:
        e.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        e.execute("INSERT INTO t VALUES " + ", ".join(f"({k}, 'row {k}')" for k in range(10_000)))
        return e.execute("SELECT COUNT(*) AS n, SUM(id) AS s, MAX(rowid) AS last FROM t")


@query("dml_with_cte", "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3")
def dml_with_cte(spark, sf_dir):
    with _engine(spark, sf_dir, "customer") as e:
        e.execute("CREATE TABLE c (c_custkey INTEGER, c_acctbal REAL, c_nationkey INTEGER)")
        e.execute("WITH q AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer) INSERT INTO c SELECT * FROM q")
        e.execute("WITH q AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000) UPDATE c SET c_acctbal = 1.0 WHERE c_custkey IN (SELECT k FROM q)")
        e.execute("WITH q AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3) DELETE FROM c WHERE c_custkey IN (SELECT k FROM q)")
        return e.execute("SELECT c_custkey, c_acctbal FROM c")


@query("ddl_flags", "SELECT r_regionkey FROM region")
def ddl_flags(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE IF NOT EXISTS r (r_regionkey INTEGER)")
        e.execute("CREATE TABLE IF NOT EXISTS r (other TEXT)")
        e.execute("CREATE TABLE gone (x INTEGER)")
        e.execute("DROP TABLE gone")
        e.execute("DROP TABLE IF EXISTS gone")
        e.execute("CREATE INDEX ix ON r (r_regionkey)")
        e.execute("DROP INDEX ix")
        e.execute("INSERT INTO r SELECT r_regionkey FROM region")
        return e.execute("SELECT * FROM r")


@query("index_unique", "SELECT n_nationkey, n_name FROM nation")
def index_unique(spark, sf_dir):
    with _engine(spark, sf_dir, "nation") as e:
        e.execute("CREATE TABLE n AS SELECT n_nationkey, n_name FROM nation")
        e.execute("CREATE UNIQUE INDEX u ON n (n_name)")
        _refused(e, "INSERT INTO n SELECT 99, n_name FROM nation WHERE n_nationkey = 1")
        _refused(e, "UPDATE n SET n_name = 'one'")
        return e.execute("SELECT * FROM n")


@query("index_hnsw", f"SELECT e.vec_id, ROUND({_DIST}, 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id < 50 ORDER BY {_DIST}, e.vec_id LIMIT 5")
def index_hnsw(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    with _engine(spark, sf_dir, "embeddings") as e:
        e.execute(f"CREATE TABLE v (vec_id INTEGER, emb VECTOR({len(q)}))")
        e.execute("INSERT INTO v SELECT vec_id, embedding FROM embeddings WHERE vec_id < 50")
        e.execute("CREATE INDEX ix ON v USING HNSW (emb)")
        e.execute("DROP INDEX ix")
        d = f"L2_DISTANCE(emb, [{', '.join(map(str, q))}])"
        return e.execute(f"SELECT vec_id, ROUND({d}, 5) AS distance FROM v ORDER BY {d}, vec_id LIMIT 5")


@query("constraints", "SELECT p_partkey, p_size, 'none' AS note, p_size * 2 AS twice FROM part WHERE p_size > 10")
def constraints(spark, sf_dir):
    with _engine(spark, sf_dir, "part") as e:
        e.execute("CREATE TABLE p (p_partkey INTEGER PRIMARY KEY, p_size INTEGER NOT NULL CHECK (p_size > 10), note TEXT DEFAULT 'none', twice INTEGER GENERATED ALWAYS AS (p_size * 2))")
        e.execute("INSERT INTO p (p_partkey, p_size) SELECT p_partkey, p_size FROM part WHERE p_size > 10")
        for row in ("(900001, 5, 'x')", "(900001, NULL, 'x')", "(NULL, 20, 'x')"):
            _refused(e, f"INSERT INTO p (p_partkey, p_size, note) VALUES {row}")
        _refused(e, "INSERT INTO p (p_partkey, p_size) SELECT MIN(p_partkey), 20 FROM p")
        return e.execute("SELECT * FROM p")


@query("txn_savepoint", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'two' ELSE r_name END AS r_name FROM region WHERE r_regionkey > 0")
def txn_savepoint(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE r AS SELECT r_regionkey, r_name FROM region")
        e.execute("BEGIN")
        e.execute("DELETE FROM r WHERE r_regionkey = 0")
        e.execute("SAVEPOINT a")
        e.execute("DELETE FROM r")
        e.execute("ROLLBACK TO SAVEPOINT a")
        e.execute("UPDATE r SET r_name = 'two' WHERE r_regionkey = 2")
        e.execute("RELEASE SAVEPOINT a")
        e.execute("COMMIT")
        return e.execute("SELECT * FROM r")


@query("txn_batch", "SELECT CAST(i AS BIGINT) AS id FROM range(20) r(i)")
def txn_batch(spark, sf_dir):
    with _engine(spark, sf_dir) as e:
        e.execute("CREATE TABLE t (id INTEGER)")
        with e.batch():
            for k in range(0, 20, 5):
                e.execute("INSERT INTO t VALUES " + ", ".join(f"({k + i})" for i in range(5)))
        return e.execute("SELECT * FROM t")


@query("snapshot_read", "SELECT r_regionkey, r_name, TRUE AS still FROM region")
def snapshot_read(spark, sf_dir):
    """What a snapshot sees after the table was changed and old versions went."""
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE r AS SELECT r_regionkey, r_name FROM region")
        old = e.snapshot()
        e.execute("UPDATE r SET r_name = 'new'")
        e.execute("DELETE FROM r WHERE r_regionkey > 2")
        e.execute("VACUUM 0")
        return old.execute("SELECT r_regionkey, r_name, TRUE AS still FROM r")


@query("commit_conflict", "SELECT 'b' AS r_name, TRUE AS refused FROM region")
def commit_conflict(spark, sf_dir):
    """Of two transactions on one table the second is refused."""
    with _engine(spark, sf_dir, "region") as a:
        a.execute("CREATE TABLE r AS SELECT r_name FROM region")
        b = Engine(spark, a.path)
        a.execute("BEGIN")
        b.execute("BEGIN")
        a.execute("UPDATE r SET r_name = 'a'")
        b.execute("UPDATE r SET r_name = 'b'")
        b.execute("COMMIT")
        try:
            a.execute("COMMIT")
            refused = False
        except ConflictError:
            refused = True
        return a.execute(f"SELECT r_name, {refused} AS refused FROM r")


@query("trigger_instead_of", "SELECT r_regionkey + 100 AS id, r_name AS name FROM region WHERE r_regionkey < 2")
def trigger_instead_of(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        e.execute("CREATE VIEW v AS SELECT id, name FROM t")
        e.execute("CREATE TRIGGER i INSTEAD OF INSERT ON v BEGIN INSERT INTO t VALUES (NEW.id + 100, NEW.name); END")
        e.execute("CREATE TRIGGER u AFTER INSERT ON t BEGIN INSERT INTO t VALUES (0, 'never'); END")
        e.execute("DROP TRIGGER u")
        e.execute("INSERT INTO v SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 2")
        return e.execute("SELECT * FROM t")


@query("rtree_sql", f"SELECT CAST(id AS BIGINT) AS id FROM {_BOXES} b WHERE x0 <= 3000 AND x1 >= 1000 AND y0 <= 400 AND y1 >= 100")
def rtree_sql(spark, sf_dir):
    with _engine(spark, sf_dir, "customer") as e:
        e.execute("CREATE VIRTUAL TABLE r USING RTREE(id, min_x, max_x, min_y, max_y)")
        e.execute(f"INSERT INTO r SELECT id, x0, x1, y0, y1 FROM {_BOXES} b")
        return e.execute("SELECT CAST(id AS BIGINT) AS id FROM r WHERE BBOX_INTERSECTS(min_x, max_x, min_y, max_y, 1000, 3000, 100, 400)")


_FK = ("CREATE TABLE n (n_nationkey INTEGER PRIMARY KEY, n_name TEXT)", "CREATE TABLE s (s_suppkey INTEGER PRIMARY KEY, s_nationkey INTEGER REFERENCES n(n_nationkey) ON DELETE {})", "INSERT INTO n SELECT n_nationkey, n_name FROM nation", "INSERT INTO s SELECT s_suppkey, s_nationkey FROM supplier")


@query("fk_cascade", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier WHERE s_nationkey >= 10")
def fk_cascade(spark, sf_dir):
    with _engine(spark, sf_dir, "nation", "supplier") as e:
        for sql in _FK:
            e.execute(sql.format("CASCADE"))
        e.execute("DELETE FROM n WHERE n_nationkey < 10")
        return e.execute("SELECT * FROM s")


@query("fk_set_null", "SELECT s_suppkey, CAST(CASE WHEN s_nationkey >= 10 THEN s_nationkey END AS BIGINT) AS s_nationkey FROM supplier")
def fk_set_null(spark, sf_dir):
    with _engine(spark, sf_dir, "nation", "supplier") as e:
        for sql in _FK:
            e.execute(sql.format("SET NULL"))
        e.execute("DELETE FROM n WHERE n_nationkey < 10")
        return e.execute("SELECT * FROM s")


@query("trigger_after_insert", "SELECT r_regionkey AS id, 'added ' || r_name AS note FROM region WHERE r_regionkey > 0")
def trigger_after_insert(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE r (r_regionkey INTEGER, r_name TEXT)")
        e.execute("CREATE TABLE log (id INTEGER, note TEXT)")
        e.execute("CREATE TRIGGER t AFTER INSERT ON r FOR EACH ROW WHEN NEW.r_regionkey > 0 BEGIN INSERT INTO log (id, note) VALUES (NEW.r_regionkey, 'added ' || NEW.r_name); END")
        e.execute("INSERT INTO r SELECT r_regionkey, r_name FROM region")
        return e.execute("SELECT * FROM log")


@query("upsert_dedup", "SELECT k, MAX(v) AS v FROM (SELECT o_custkey AS k, o_totalprice AS v FROM orders) q GROUP BY k")
def upsert_dedup(spark, sf_dir):
    """Keep one row a key, the last by value: a window group limit."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    last = Window.partitionBy("k").orderBy(F.desc("v"))
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


@query("alter_table", "SELECT r_regionkey AS id, r_name AS label, 'none' AS extra FROM region")
def alter_table(spark, sf_dir):
    with _engine(spark, sf_dir, "region") as e:
        e.execute("CREATE TABLE r AS SELECT r_regionkey, r_name, 1 AS unused FROM region")
        e.execute("ALTER TABLE r ADD COLUMN extra TEXT DEFAULT 'none'")
        e.execute("ALTER TABLE r RENAME COLUMN r_regionkey TO id")
        e.execute("ALTER TABLE r RENAME COLUMN r_name TO label")
        e.execute("ALTER TABLE r DROP COLUMN unused")
        e.execute("ALTER TABLE r RENAME TO r2")
        return e.execute("SELECT * FROM r2")


class _engine:
    """A fresh engine with test tables as external views."""

    def __init__(self, spark: SparkSession, sf_dir: str, *tables: str):
        self.spark, self.sf_dir, self.tables = spark, sf_dir, tables

    def __enter__(self) -> Engine:
        engine = Engine(self.spark)
        for t in self.tables:
            engine.attach(t, _t(self.spark, self.sf_dir, t))
        return engine

    def __exit__(self, *_):
        return False


# event-time windows ---------------------------------------------------------


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    from skarn.streaming import windows

    out = windows.windowed(_t(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select("window_start", "event_type", "n", "total")


@query("window_sessions", "SELECT user_id, MIN(ts) AS window_start, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT *, SUM(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) a) b GROUP BY user_id, s")
def window_sessions(spark, sf_dir):
    from skarn.streaming import windows

    out = windows.sessions(_t(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", "window_start", "n")
