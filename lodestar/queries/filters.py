"""Scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import functions as L
from lodestar.queries.registry import Registry

registry = Registry()
sql, frame = registry.sql, registry.frame

sql("scan_project", "SELECT c_custkey, c_name, c_acctbal * 2 AS twice, c_mktsegment AS segment FROM customer")
sql("values_inline", "SELECT id, name FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(id, name)")
sql("select_without_from", "SELECT 1 + 2 AS three, 'x' AS letter")
sql("qualified_wildcard", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name < 'B'")
sql("filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderstatus <> 'P'")
sql("filter_logic", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_brand = 'Brand#11')")
sql("filter_unary", "SELECT l_orderkey, l_linenumber, -l_quantity AS neg FROM lineitem WHERE NOT l_returnflag = 'N' AND -l_quantity < -30")
sql(
    "filter_is_check",
    "SELECT event_id, (value > 50) IS TRUE AS is_t, (value > 50) IS NOT FALSE AS not_f, (CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END) IS UNKNOWN AS is_u, value IS NOT NULL AS known FROM events WHERE event_type IS NOT NULL",
    "SELECT event_id, (value > 50) IS TRUE AS is_t, (value > 50) IS NOT FALSE AS not_f, (CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END) IS NULL AS is_u, value IS NOT NULL AS known FROM events WHERE event_type IS NOT NULL",
)
sql("filter_is_distinct", "SELECT event_id FROM events WHERE NULLIF(event_type, 'click') IS DISTINCT FROM NULLIF(event_type, 'view') AND NULLIF(user_id, 1) IS NOT DISTINCT FROM user_id")
sql("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04 AND l_quantity NOT BETWEEN 10 AND 40")
sql("filter_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql("filter_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, NULL) OR c_nationkey NOT IN (2, NULL)")
sql("filter_like_ilike", "SELECT p_partkey, p_name LIKE '%a_' AS sensitive, p_name ILIKE '%A_' AS insensitive FROM part WHERE p_type LIKE '%E%' OR p_name ILIKE '%RE%'")
sql("filter_like_escape", "SELECT v FROM (VALUES ('10%'), ('100'), ('a_b'), ('acb')) AS t(v) WHERE v LIKE '10!%' ESCAPE '!' OR v LIKE 'a!_b' ESCAPE '!'")


@frame("filter_rlike", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'A.*E', 'i') AND NOT regexp_matches(p_brand, '#1[0-3]', 'i')")
def filter_rlike(t):
    return t("part").where(L.regexp(F.col("p_name"), "A.*E") & ~L.regexp(F.col("p_brand"), "#1[0-3]")).select("p_partkey")


@frame("filter_regex_operators", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M]') OR regexp_matches(p_name, 'ZZ', 'i')")
def filter_regex_operators(t):
    return t("part").where(L.regexp(F.col("p_type"), "^[A-M]", case_sensitive=True) | L.regexp(F.col("p_name"), "ZZ")).select("p_partkey")


@frame("filter_similar_to", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].') OR regexp_full_match(p_name, '.*a.*')")
def filter_similar_to(t):
    return t("part").where(L.similar_to(F.col("p_brand"), "Brand#[12]_") | L.similar_to(F.col("p_name"), "%a%")).select("p_partkey")


sql(
    "case_searched",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 END AS f FROM orders",
)


@frame("case_simple", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS status, CASE WHEN NULLIF(o_orderstatus, 'P') IS NULL THEN 'null' ELSE 'known' END AS matched FROM orders")
def case_simple(t):
    s = F.col("o_orderstatus")
    nulled = F.nullif(s, F.lit("P"))
    return t("orders").select("o_orderkey", L.simple_case(s, ("F", "done"), ("O", "open"), default="other").alias("status"), L.simple_case(nulled, (None, "null"), default="known").alias("matched"))


sql("row_value", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 8))")
sql("prepared_params", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")


def _prepared(spark, sf_dir):
    from lodestar.session import Engine

    engine = Engine(spark, sf_dir)
    engine.prepare("by_status", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = ?")
    return engine.execute_prepared("by_status", "F")


registry.queries["prepared_params"] = _prepared
sql("in_unnest", "SELECT n_nationkey, n_name FROM nation WHERE array_contains(array(1, 5, 9), n_nationkey)", "SELECT n_nationkey, n_name FROM nation WHERE list_contains([1, 5, 9], n_nationkey)")


@frame("any_all_array", "SELECT p_partkey, p_size = 1 OR p_size = 7 OR p_size = 15 AS eq_any, p_size > 10 AND p_size > 20 AS gt_all, TRUE AS all_empty, FALSE AS any_empty FROM part")
def any_all_array(t):
    arr = F.array(F.lit(1), F.lit(7), F.lit(15))
    none = F.array().cast("array<int>")
    s = F.col("p_size")
    return t("part").select("p_partkey", L.any_of(s, "=", arr).alias("eq_any"), L.all_of(s, ">", F.array(F.lit(10), F.lit(20))).alias("gt_all"), L.all_of(s, ">", none).alias("all_empty"), L.any_of(s, "=", none).alias("any_empty"))
