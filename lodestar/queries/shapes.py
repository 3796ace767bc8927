"""Sorting, limits, distinct, set operations, CTEs and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.queries.registry import Registry

registry = Registry()
sql, frame = registry.sql, registry.frame

sql("sort_multi_key", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice ASC NULLS FIRST, o_orderkey")
sql("sort_nulls", "SELECT event_id, NULLIF(event_type, 'click') AS k FROM events ORDER BY k ASC NULLS LAST, event_id")
sql("sort_nulls_lowest", "SELECT event_id, NULLIF(event_type, 'click') AS k FROM events ORDER BY k, event_id", "SELECT event_id, NULLIF(event_type, 'click') AS k FROM events ORDER BY k ASC NULLS FIRST, event_id")
sql("sort_hidden_column", "SELECT c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
sql("sort_ordinal", "SELECT c_custkey, c_name FROM customer ORDER BY 1 DESC NULLS LAST")
sql("sort_all", "SELECT n_regionkey, n_name FROM nation ORDER BY ALL")


@frame("sort_by", "SELECT n_name FROM nation")
def sort_by(t):
    return t("nation").sortWithinPartitions("n_name").select("n_name")


sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")


@frame("limit_fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def limit_fetch_first(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").offset(3).limit(7)


sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("distinct_null", "SELECT DISTINCT NULLIF(event_type, 'click') AS k FROM events")


@frame("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey")
def distinct_on(t):
    return R.distinct_on(t("orders"), ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey % 3 > 0"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("except", "EXCEPT"), ("intersect_all", "INTERSECT ALL"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", f"{_A} {_op} {_B}")

sql("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 1")
sql("parenthesised", "(SELECT r_name AS x FROM region) UNION ALL (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3)")
sql("table_statement", "TABLE region")
sql("values_query", "VALUES (1, 'a'), (2, 'b')", "SELECT col0 AS col1, col1 AS col2 FROM (VALUES (1, 'a'), (2, 'b'))")
sql("subq_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql("subq_scalar_select", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
sql("subq_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("subq_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("subq_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
sql("subq_not_exists", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_nationkey % 4 > 0)")
sql("subq_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@frame("subq_any_all", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier) AND c_acctbal <= ALL (SELECT c_acctbal + 9000 FROM customer)")
def subq_any_all(t):
    some = R.any_subquery(t("customer"), "c_acctbal", ">", t("supplier"), "s_acctbal")
    return R.all_subquery(some, "c_acctbal", "<=", t("customer").select((F.col("c_acctbal") + 9000).alias("y")), "y").select("c_custkey")
