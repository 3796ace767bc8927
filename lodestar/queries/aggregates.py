"""Grouped, ungrouped and multi-dimensional aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.queries.registry import Registry

registry = Registry()
sql, frame = registry.sql, registry.frame

sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
sql("agg_group_by", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, length(o_orderpriority) > 6 AS long_name, count(*) AS n FROM orders GROUP BY year(o_orderdate), length(o_orderpriority) > 6")
sql("agg_group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql("agg_sum_int", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation GROUP BY n_regionkey")
sql("agg_min_max_text", "SELECT min(c_name) AS lo, max(c_mktsegment) AS hi FROM customer")
sql("agg_count_nulls", "SELECT count(*) AS n, count(NULLIF(event_type, 'click')) AS not_click, round(sum(CASE WHEN value > 50 THEN value END), 4) AS s, count(CASE WHEN value > 50 THEN 1 END) AS k FROM events")
sql("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(user_id) AS n FROM events GROUP BY event_type")
sql("agg_stddev_variance", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(variance(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")


@frame("agg_having_no_group", "SELECT n FROM (SELECT count(*) AS n FROM orders) WHERE n > 10")
def agg_having_no_group(t):
    return R.having(t("orders").agg(F.count("*").alias("n")), F.col("n") > 10)


sql("agg_case", "SELECT o_orderstatus, count(CASE WHEN o_totalprice > 150000 THEN 1 END) AS big, round(sum(CASE WHEN o_totalprice > 150000 THEN o_totalprice ELSE 0 END), 2) AS total FROM orders GROUP BY o_orderstatus")
sql("agg_expr_over_agg", "SELECT o_custkey, round(sum(o_totalprice) / (count(*) * 7) + 1, 4) AS x FROM orders GROUP BY o_custkey")
sql("agg_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_totalprice < -1")
sql("agg_empty_groups", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice < -1 GROUP BY o_custkey")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
sql("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE user_id % 2 = 0), 4) AS even FROM events GROUP BY event_type")
