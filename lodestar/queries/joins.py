"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.queries.registry import Registry

registry = Registry()
sql, frame = registry.sql, registry.frame

sql(
    "flagship_revenue",
    """
    SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS BIGINT) AS year, count(DISTINCT o_orderkey) AS n_orders,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND c_acctbal > 0
    GROUP BY c_mktsegment, year(o_orderdate)
    HAVING count(*) > 5
    ORDER BY revenue DESC, segment, year LIMIT 20
    """,
    """
    SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS BIGINT) AS year, count(DISTINCT o_orderkey) AS n_orders,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND c_acctbal > 0
    GROUP BY c_mktsegment, year(o_orderdate)
    HAVING count(*) > 5
    ORDER BY revenue DESC, segment, year LIMIT 20
    """,
)
sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
sql("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
sql("join_full", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_multi_key", "SELECT l1.l_orderkey, l1.l_linenumber, l2.l_partkey FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber = l2.l_linenumber WHERE l2.l_quantity > 45")
sql("join_three_way", "SELECT n_name, count(o_orderkey) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
sql("join_null_keys", "SELECT a.c_custkey AS x, b.s_suppkey AS y FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT s_suppkey, NULLIF(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k", deal=("customer",))
sql("join_nested", "SELECT c_custkey, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
sql("join_derived", "SELECT t.o_custkey, t.total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t JOIN customer ON t.o_custkey = c_custkey WHERE c_acctbal < 0")


@frame("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 2")
def join_theta(t):
    return R.theta_join(t("supplier"), t("nation"), (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("n_regionkey") == 2)).select("s_suppkey", "n_nationkey")


sql("join_or_condition", "SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_nationkey = r_regionkey OR s_suppkey = r_regionkey")
sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 200000)")
sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 150000)")


@frame("join_straight", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_straight(t):
    return R.straight_join(t("orders"), t("customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "c_mktsegment")


sql("join_using", "SELECT k, n, s FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY s_nationkey) b USING (k)")
sql("join_natural", "SELECT k, n, s FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY s_nationkey) b")
sql(
    "join_lateral",
    "SELECT n_nationkey, top FROM nation, LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey) t",
)
sql("join_outer_apply", "SELECT r_name, big FROM region LEFT JOIN LATERAL (SELECT max(n_nationkey) AS big FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) t ON TRUE")

_ASOF = """
SELECT event_id, prev_id, round(prev_value, 6) AS prev_value FROM (
  SELECT v.event_id, p.event_id AS prev_id, p.value AS prev_value,
         row_number() OVER (PARTITION BY v.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC NULLS LAST) AS rn
  FROM (SELECT * FROM events WHERE event_type = 'purchase') v
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON v.user_id = p.user_id AND p.ts <= v.ts
) WHERE rn = 1
"""


@frame("join_asof", _ASOF)
def join_asof(t):
    e = t("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("r_ts"), F.col("event_id").alias("prev_id"), F.col("value").alias("prev_value"))
    out = R.asof_join(left, right, ["user_id"], "ts", "r_ts", ["prev_id", "prev_value"], slices="month")
    return out.select("event_id", "prev_id", F.round("prev_value", 6).alias("prev_value"))


@frame("join_range", "SELECT p_partkey, lo FROM part JOIN (VALUES (0.0, 950.0), (950.0, 1200.0), (1100.0, 1500.0), (1500.0, 99999.0)) AS b(lo, hi) ON p_retailprice >= lo AND p_retailprice < hi".replace("SELECT p_partkey, lo", "SELECT p_partkey, CAST(lo AS DOUBLE) AS lo"))
def join_range(t):
    bands = t("part").sparkSession.createDataFrame([(0.0, 950.0), (950.0, 1200.0), (1100.0, 1500.0), (1500.0, 99999.0)], "lo double, hi double")
    return R.range_join(t("part"), bands, "p_retailprice", "lo", "hi", 500.0).select("p_partkey", "lo")
