"""Scalar functions, one query for each family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import functions as L
from lodestar.queries.registry import Registry

registry = Registry()
sql, frame = registry.sql, registry.frame

sql("str_case", "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l FROM customer")
sql("str_concat", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, concat(c_name, ':', c_mktsegment) AS b FROM customer")


@frame("str_substring", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 1, 2) AS zero, right(p_name, 3) AS tail, substring(p_name, 3) AS rest, CASE WHEN length(p_name) <= 100 THEN substring(p_name, 1, 4) END AS clamped, '' AS none FROM part")
def str_substring(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", L.substring_from(n, 2, 3).alias("a"), L.substring_from(n, 0, 2).alias("zero"), L.substring_from(n, -3).alias("tail"), L.substring_from(n, 3).alias("rest"), L.substring_from(n, -100, 4).alias("clamped"), L.substring_from(n, 2, 0).alias("none"))


_BLANKS = "concat(' ', chr(9), chr(10), chr(13))"


@frame("str_trim", f"SELECT n_nationkey, trim(x, {_BLANKS}) AS b, ltrim(x, {_BLANKS}) AS l, rtrim(x, {_BLANKS}) AS r FROM (SELECT n_nationkey, concat(' ', chr(9), n_name, chr(10), ' ') AS x FROM nation)")
def str_trim(t):
    x = F.concat(F.lit(" \t"), "n_name", F.lit("\n "))
    return t("nation").select("n_nationkey", L.trim_blank(x).alias("b"), L.trim_blank(x, "leading").alias("l"), L.trim_blank(x, "trailing").alias("r"))


@frame("str_position", "SELECT p_partkey, CAST(position('a' IN p_name) AS BIGINT) AS p, CAST(position('zzz' IN p_name) AS BIGINT) AS none FROM part")
def str_position(t):
    return t("part").select("p_partkey", L.position("a", F.col("p_name")).cast("bigint").alias("p"), L.position("zzz", F.col("p_name")).cast("bigint").alias("none"))


@frame("str_overlay", "SELECT n_nationkey, concat(substring(n_name, 1, 1), 'XY', substring(n_name, 4)) AS a, concat(substring(n_name, 1, 1), 'Q', substring(n_name, 5)) AS b FROM nation")
def str_overlay(t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", L.overlay(n, "XY", 2).alias("a"), L.overlay(n, "Q", 2, 3).alias("b"))


sql("str_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(text) AS BIGINT) AS bytes FROM documents", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
sql("str_collate", "SELECT n_name COLLATE UTF8_BINARY AS n_name FROM nation", "SELECT n_name FROM nation")


@frame("math_arith", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey // 7 AS BIGINT) AS d, CAST(-l_linenumber // 2 AS BIGINT) AS neg, l_linenumber + 2 AS p, l_linenumber - 3 AS m, l_linenumber * 4 AS t, l_extendedprice / l_quantity AS f FROM lineitem".replace("CAST(-l_linenumber // 2 AS BIGINT)", "CAST(-(l_linenumber // 2) AS BIGINT)"))
def math_arith(t):
    n = F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", L.idiv(F.col("l_orderkey"), F.lit(7)).alias("d"), L.idiv(-n, F.lit(2)).alias("neg"), (n + 2).alias("p"), (n - 3).alias("m"), (n * 4).alias("t"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("f"))


sql("math_mod", "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS a, -l_linenumber % 3 AS b FROM lineitem")
sql("math_bit_power", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 1 AS o, pow(n_nationkey, 2) AS p FROM nation")
sql("math_abs_round", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, round(abs(c_acctbal), 0) AS w FROM customer")
sql("math_ceil_floor", "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")


@frame("math_ceil_floor_time", "SELECT event_id, date_trunc('hour', ts) AS f, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) END AS c FROM events")
def math_ceil_floor_time(t):
    return t("events").select("event_id", L.floor_to(F.col("ts"), "hour").alias("f"), L.ceil_to(F.col("ts"), "day").alias("c"))


@frame(
    "cast_convert",
    "SELECT c_custkey, CAST(round(c_acctbal) AS INTEGER) AS i, CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey AS DOUBLE) AS d, TRY_CAST(substring(c_name, 1, 2) AS BIGINT) AS bad, CAST('12' AS INTEGER) AS n, CAST(c_custkey % 2 AS BOOLEAN) AS b FROM customer",
)
def cast_convert(t):
    k = F.col("c_custkey")
    return t("customer").select(k, L.convert(F.col("c_acctbal"), "INT").alias("i"), L.convert(k, "VARCHAR(20)").alias("s"), L.convert(k, "DOUBLE").alias("d"), L.try_convert(F.substring("c_name", 1, 2), "BIGINT").alias("bad"), L.convert("12", "INT").alias("n"), (k % 2).cast("boolean").alias("b"))


sql("coalesce", "SELECT event_id, coalesce(NULLIF(event_type, 'click'), 'C') AS a, ifnull(NULLIF(user_id, 1), -1) AS b, greatest(user_id, 10) AS g, least(user_id, 10) AS l FROM events")
sql("typed_literals", "SELECT DATE '2023-01-02' AS d, TIMESTAMP_NTZ '2023-01-01 10:00:00' AS t, 1.5D AS x, 12 AS i", "SELECT DATE '2023-01-02' AS d, TIMESTAMP '2023-01-01 10:00:00' AS t, CAST(1.5 AS DOUBLE) AS x, 12 AS i")

_FIELDS = ("year", "quarter", "month", "week", "day", "doy", "hour", "minute")


@frame("dt_extract", "SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS f_{f}" for f in _FIELDS) + ", CAST(extract(isodow FROM ts) AS BIGINT) AS f_dow, CAST(floor(extract(second FROM ts)) AS BIGINT) AS f_second, CAST(floor(epoch(ts)) AS BIGINT) AS f_epoch FROM events")
def dt_extract(t):
    return t("events").select("event_id", *(L.extract(f, F.col("ts")).alias(f"f_{f}") for f in (*_FIELDS, "dow", "second", "epoch")))


_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "decade", "century", "millennium")


@frame("dt_trunc", "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS u_{u}" for u in _UNITS) + " FROM events")
def dt_trunc(t):
    return t("events").select("event_id", *(L.truncate(u, F.col("ts")).alias(f"u_{u}") for u in _UNITS))


@frame("dt_part", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS dow, CAST(isodow(o_orderdate) AS BIGINT) AS isodow, CAST(date_part('decade', o_orderdate) AS BIGINT) AS decade, CAST(date_part('century', o_orderdate) AS BIGINT) AS century, CAST(date_part('millennium', o_orderdate) AS BIGINT) AS mil FROM orders")
def dt_part(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", L.date_field("dow", d).alias("dow"), L.date_field("isodow", d).alias("isodow"), L.date_field("decade", d).alias("decade"), L.date_field("century", d).alias("century"), L.date_field("millennium", d).alias("mil"))


sql(
    "dt_make",
    "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + n_nationkey % 12, 15) AS d, make_timestamp_ntz(2001, 2, 3, n_nationkey % 24, 5, 6) AS t, n_nationkey % 24 * 3600 + 5 * 60 AS secs FROM nation",
    "SELECT n_nationkey, make_date(CAST(2000 + n_nationkey AS BIGINT), CAST(1 + n_nationkey % 12 AS BIGINT), 15) AS d, make_timestamp(2001, 2, 3, CAST(n_nationkey % 24 AS BIGINT), 5, 6.0) AS t, n_nationkey % 24 * 3600 + 5 * 60 AS secs FROM nation",
)
sql(
    "dt_interval",
    "SELECT event_id, ts + INTERVAL '3' DAY AS a, ts - INTERVAL '90' MINUTE AS b, CAST(ts + INTERVAL '1' MONTH AS TIMESTAMP_NTZ) AS c FROM events",
    "SELECT event_id, ts + INTERVAL 3 DAY AS a, ts - INTERVAL 90 MINUTE AS b, CAST(ts + INTERVAL 1 MONTH AS TIMESTAMP) AS c FROM events",
)


@frame("dt_at_timezone", "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS TIMESTAMP) AS tokyo FROM events".replace("CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS TIMESTAMP)", "ts + INTERVAL 9 HOUR"))
def dt_at_timezone(t):
    return t("events").select("event_id", L.at_time_zone(F.col("ts"), "Asia/Tokyo").alias("tokyo"))


@frame("arr_subscript_slice", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[-1] AS DOUBLE) AS z, CAST(len(embedding[2:4]) AS BIGINT) AS n, CAST(embedding[3] AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS far FROM embeddings")
def arr_subscript_slice(t):
    e = F.col("embedding")
    part = L.slice_range(e, 1, 4)
    return t("embeddings").select("vec_id", L.subscript(e, 0).cast("double").alias("a"), L.subscript(e, -1).cast("double").alias("z"), F.size(part).cast("bigint").alias("n"), L.subscript(part, 1).cast("double").alias("s"), L.subscript(e, 100000).cast("double").alias("far"))


sql(
    "arr_constructor",
    "SELECT n_nationkey, CAST(size(array(n_nationkey, 2, 3)) AS BIGINT) AS n, array(n_nationkey, 2, 3)[1] AS second FROM nation",
    "SELECT n_nationkey, CAST(len([n_nationkey, 2, 3]) AS BIGINT) AS n, [n_nationkey, 2, 3][2] AS second FROM nation",
)
sql(
    "struct_access",
    "SELECT n_nationkey, s.k AS k, s.name AS name FROM (SELECT n_nationkey, named_struct('k', n_regionkey, 'name', n_name) AS s FROM nation)",
    "SELECT n_nationkey, s.k AS k, s.name AS name FROM (SELECT n_nationkey, {'k': n_regionkey, 'name': n_name} AS s FROM nation)",
)
sql("json_access", "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') AS m FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS m FROM events")
sql(
    "higher_order",
    "SELECT n_nationkey, aggregate(transform(array(n_nationkey, 1, 2), x -> x * 2), 0, (a, x) -> a + x) AS s FROM nation",
    "SELECT n_nationkey, CAST(list_sum(list_transform([n_nationkey, 1, 2], lambda x: x * 2)) AS INTEGER) AS s FROM nation",
)
sql("unnest", "SELECT n_nationkey, v FROM nation LATERAL VIEW explode(array(n_regionkey, n_nationkey)) t AS v", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS v FROM nation")


@frame("math_random", "SELECT count(*) AS n, count(*) AS inside, count(*) AS repeated FROM nation")
def math_random(t):
    """A seed gives each row the same number each time, in [0, 1)."""
    r = t("nation").select(F.rand(7).alias("a"), F.rand(7).alias("b"))
    return r.agg(F.count("*").alias("n"), F.count_if((F.col("a") >= 0) & (F.col("a") < 1)).alias("inside"), F.count_if(F.col("a") == F.col("b")).alias("repeated"))


sql(
    "value_methods",
    "SELECT event_id, CAST(length(event_type) AS BIGINT) AS length, get_json_object(props, '$.k') AS value, CAST(size(split(event_type, 'c')) AS BIGINT) AS size, element_at(map('a', user_id), 'a') AS got FROM events",
    "SELECT event_id, CAST(length(event_type) AS BIGINT) AS length, json_extract_string(props, '$.k') AS value, CAST(len(string_split(event_type, 'c')) AS BIGINT) AS size, user_id AS got FROM events",
)
