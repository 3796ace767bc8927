"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestar.operators import relational as R
from lodestar.queries.registry import Registry

registry = Registry()
sql, frame = registry.sql, registry.frame

sql("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS BIGINT) AS rn FROM orders")
sql("win_rank_dense_rank", "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey % 3 ORDER BY floor(s_acctbal / 1000) DESC NULLS LAST) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY s_nationkey % 3 ORDER BY floor(s_acctbal / 1000) DESC NULLS LAST) AS BIGINT) AS d FROM supplier")
sql("win_lag_lead", "SELECT event_id, round(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS prev, round(lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS next2, lag(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type FROM events")
sql("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
sql("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
sql("win_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma FROM events")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
sql("win_min_max_count", "SELECT c_custkey, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
sql("win_named", "SELECT s_suppkey, CAST(rank() OVER w AS BIGINT) AS r, count(*) OVER w AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
sql("win_ntile_dist", "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey % 2 ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY s_nationkey % 2 ORDER BY s_acctbal, s_suppkey), 6) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey % 2 ORDER BY s_acctbal, s_suppkey), 6) AS c, nth_value(s_suppkey, 2) OVER (PARTITION BY s_nationkey % 2 ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM supplier")


@frame("win_qualify", "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) <= 2")
def win_qualify(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return R.qualify(t("customer"), "_rn", F.row_number().over(w), F.col("_rn") <= 2).select("c_custkey", "c_nationkey")


@frame("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def topn(t):
    return R.top_n(t("orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@frame("topn_per_group", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part) WHERE rn <= 3")
def topn_per_group(t):
    return R.top_n_per_group(t("part"), ["p_brand"], 3, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "p_brand")
