"""SQL text through the engine: the dialect's own semantics, and statements that change tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.checkpoints import checkpoint_dir
from lodestar.queries.registry import Registry
from lodestar.session import Engine
from lodestar.sources.tables import read_files, read_table, write_files
from lodestar.streaming import windowed_counts

registry = Registry()
sql = registry.sql

sql("sql_int_div", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS a, l_orderkey / 7 / l_linenumber AS b, l_extendedprice / 7 AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS a, l_orderkey // 7 // l_linenumber AS b, l_extendedprice / 7 AS c FROM lineitem")
sql("sql_cast_round", "SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS a, c_acctbal::INT AS b, CAST(c_custkey AS DOUBLE) AS d FROM customer", "SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS a, CAST(round(c_acctbal) AS INTEGER) AS b, CAST(c_custkey AS DOUBLE) AS d FROM customer")
sql("sql_cast_join", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON CAST(c_custkey AS STRING) = CAST(o_custkey AS STRING) AND CAST(c_acctbal AS INT) > 5000", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND round(c_acctbal) > 5000")
sql("sql_rlike", "SELECT p_partkey FROM part WHERE p_name RLIKE 'A.*E' AND p_brand NOT REGEXP '#1[0-3]'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'A.*E', 'i') AND NOT regexp_matches(p_brand, '#1[0-3]')")
sql("sql_regex_operators", "SELECT p_partkey FROM part WHERE (p_type ~ '^[A-M]' OR p_name ~* 'ZZ') AND p_brand !~ '5$' AND p_name !~* '^Q'", "SELECT p_partkey FROM part WHERE (regexp_matches(p_type, '^[A-M]') OR regexp_matches(p_name, 'ZZ', 'i')) AND NOT regexp_matches(p_brand, '5$') AND NOT regexp_matches(p_name, '^Q', 'i')")
sql("sql_similar_to", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#[12]_' OR p_name NOT SIMILAR TO '%e%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].') OR NOT regexp_full_match(p_name, '.*e.*')")
sql("sql_dow", "SELECT o_orderkey, CAST(EXTRACT(DOW FROM o_orderdate) AS BIGINT) AS dow, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS year FROM orders", "SELECT o_orderkey, CAST(isodow(o_orderdate) AS BIGINT) AS dow, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders")
sql("sql_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 3 ROWS FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3")
sql("sql_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 4", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 5")
sql("sql_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey")
sql("sql_qualify", "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) <= 2")
sql("sql_having_no_group", "SELECT s_suppkey, s_acctbal FROM supplier HAVING s_acctbal > 5000", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
sql("sql_any_all", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier) AND c_acctbal <= ALL (SELECT c_acctbal + 9000 FROM customer) AND c_nationkey = SOME (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("sql_any_all_array", "SELECT p_partkey FROM part WHERE p_size = ANY (array(1, 7, 15)) OR p_size > ALL (array(10, 45))", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 15) OR p_size > 45")
sql("sql_trim", "SELECT n_nationkey, trim(concat(' \\t', n_name, '\\n ')) AS b, trim(LEADING FROM concat(' ', n_name, ' ')) AS l, trim('A' FROM n_name) AS a FROM nation", "SELECT n_nationkey, n_name AS b, concat(n_name, ' ') AS l, trim(n_name, 'A') AS a FROM nation")
sql("sql_convert", "SELECT c_custkey, CONVERT(INT, c_acctbal) AS i, TRY_CONVERT(BIGINT, substring(c_name, 1, 2)) AS bad FROM customer", "SELECT c_custkey, CAST(round(c_acctbal) AS INTEGER) AS i, CAST(NULL AS BIGINT) AS bad FROM customer")
sql("agg_approx_distinct", "SELECT n_regionkey, approx_count_distinct(n_nationkey, 0.01) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(DISTINCT n_nationkey) AS n FROM nation GROUP BY n_regionkey")
sql("dt_now", "SELECT now() = current_timestamp() AS same, current_date() = CAST(now() AS DATE) AS today, count(*) AS n FROM region WHERE now() > TIMESTAMP '2020-01-01 00:00:00'", "SELECT TRUE AS same, TRUE AS today, count(*) AS n FROM region")
sql("map_dynamic_key", "SELECT n_nationkey, element_at(map('0', 'zero', '1', 'one', '2', 'two'), CAST(n_regionkey % 3 AS STRING)) AS v FROM nation", "SELECT n_nationkey, CASE n_regionkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END AS v FROM nation")


def script(name: str, tables: tuple[str, ...], text: str, oracle: str) -> None:
    """Statements over these tables; the last one's rows are the query's."""

    def run(spark, sf_dir):
        return Engine(spark).register(sf_dir, tables).execute(text)

    run.__name__ = name
    registry.queries[name], registry.oracles[name] = run, oracle


script(
    "sql_insert",
    ("region", "nation"),
    "INSERT INTO region VALUES (100, 'ATLANTIS'), (101, NULL); INSERT INTO region (r_name, r_regionkey) SELECT n_name, n_nationkey / 2 + 200 FROM nation WHERE n_regionkey = 1; SELECT r_regionkey, r_name FROM region",
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, NULL UNION ALL SELECT CAST(n_nationkey // 2 + 200 AS INTEGER), n_name FROM nation WHERE n_regionkey = 1",
)
script(
    "sql_update",
    ("customer", "nation"),
    "UPDATE customer SET c_mktsegment = 'DEBT', c_acctbal = -c_acctbal WHERE c_acctbal < 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3); SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
    """
    SELECT c_custkey, CASE WHEN h THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN h THEN -c_acctbal ELSE c_acctbal END AS c_acctbal
    FROM (SELECT *, c_acctbal < 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AS h FROM customer)
    """,
)
script("sql_update_swap", ("nation",), "UPDATE nation SET n_nationkey = n_regionkey, n_regionkey = n_nationkey; SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")
script("sql_delete", ("events",), "DELETE FROM events WHERE NULLIF(event_type, 'click') = 'view'; SELECT event_id FROM events", "SELECT event_id FROM events WHERE NOT coalesce(NULLIF(event_type, 'click') = 'view', FALSE)")
script(
    "sql_merge",
    ("nation", "supplier"),
    """
    MERGE INTO nation AS n USING (SELECT s_nationkey AS k, max(s_name) AS name FROM supplier GROUP BY s_nationkey) AS s ON n.n_nationkey = s.k
    WHEN MATCHED AND s.k < 5 THEN DELETE WHEN MATCHED THEN UPDATE SET n_name = s.name WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name) VALUES (s.k, s.name);
    SELECT n_nationkey, n_name FROM nation
    """,
    "SELECT n_nationkey, coalesce(s.name, n_name) AS n_name FROM nation LEFT JOIN (SELECT s_nationkey AS k, max(s_name) AS name FROM supplier GROUP BY s_nationkey) AS s ON n_nationkey = s.k WHERE s.k IS NULL OR s.k >= 5",
)
script(
    "sql_create_table",
    ("nation",),
    """
    CREATE TABLE land (id INT PRIMARY KEY, name VARCHAR(30) NOT NULL, region INT DEFAULT 7 CHECK (region < 10), size DECIMAL(10, 2));
    INSERT INTO land (id, name) SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey < 9;
    INSERT INTO land VALUES (50, 'x', DEFAULT, 1.5);
    SELECT id, name, region, size FROM land
    """,
    "SELECT n_nationkey AS id, lower(n_name) AS name, 7 AS region, CAST(NULL AS DECIMAL(10, 2)) AS size FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 50, 'x', 7, 1.5",
)
script(
    "sql_cascade",
    ("region", "nation"),
    """
    CREATE TABLE area (id INT PRIMARY KEY, name TEXT);
    CREATE TABLE land (id INT PRIMARY KEY, area INT REFERENCES area(id) ON DELETE CASCADE ON UPDATE CASCADE);
    INSERT INTO area SELECT r_regionkey, r_name FROM region; INSERT INTO land SELECT n_nationkey, n_regionkey FROM nation;
    DELETE FROM area WHERE name > 'B'; UPDATE area SET id = id + 100;
    SELECT id, area FROM land
    """,
    "SELECT n_nationkey AS id, n_regionkey + 100 AS area FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <= 'B'",
)
script("ddl_alter", ("nation",), "ALTER TABLE nation ADD COLUMN note TEXT DEFAULT 'n'; ALTER TABLE nation RENAME COLUMN n_name TO name; ALTER TABLE nation DROP COLUMN n_regionkey; ALTER TABLE nation RENAME TO land; SELECT * FROM land", "SELECT n_nationkey, n_name AS name, 'n' AS note FROM nation")
script("ddl_drop", ("region", "nation"), "CREATE TABLE a (x INT); CREATE INDEX i ON a (x); DROP INDEX i; DROP TABLE a; DROP TABLE IF EXISTS a; SHOW TABLES", """SELECT * FROM (VALUES ('default', 'nation', 3), ('default', 'region', 2)) AS t("database", "table", "columns")""")
script("ddl_databases", (), "CREATE DATABASE work; CREATE SCHEMA IF NOT EXISTS work; CREATE DATABASE spare; USE work; DROP DATABASE spare; SHOW DATABASES", """SELECT * FROM (VALUES ('default'), ('work')) AS t("database")""")
script("txn_rollback", ("region",), "BEGIN; DELETE FROM region WHERE r_regionkey > 1; ALTER TABLE region ADD COLUMN z INT; ROLLBACK; SELECT * FROM region", "SELECT * FROM region")
script("txn_savepoint", ("region",), "BEGIN; DELETE FROM region WHERE r_regionkey = 0; SAVEPOINT a; UPDATE region SET r_name = 'x'; ROLLBACK TO SAVEPOINT a; RELEASE SAVEPOINT a; COMMIT; SELECT * FROM region", "SELECT * FROM region WHERE r_regionkey <> 0")
script("multi_statement", ("region",), "CREATE OR REPLACE TEMP VIEW few AS SELECT r_regionkey / 2 AS h FROM region; SELECT h, count(*) AS n FROM few GROUP BY h", "SELECT CAST(r_regionkey // 2 AS BIGINT) AS h, count(*) AS n FROM region GROUP BY 1")
script("sql_prepare_execute", ("orders",), "PREPARE p AS SELECT count(*) AS n FROM orders WHERE o_orderstatus = ?; EXECUTE p ('F')", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")


def util_explain(spark, sf_dir):
    """The plan says that the filter reaches the scan."""
    plan = Engine(spark).register(sf_dir, ("orders",)).sql("EXPLAIN FORMATTED SELECT o_orderkey FROM orders WHERE o_orderkey > 10")
    return plan.where("plan LIKE '%PushedFilters%GreaterThan(o_orderkey,10)%'").selectExpr("count(*) AS n")


registry.queries["util_explain"] = util_explain
registry.oracles["util_explain"] = "SELECT CAST(1 AS BIGINT) AS n"


def _files(name: str, form: str) -> None:
    """customer written and scanned in another format; the files lie in the shared folder."""

    def run(spark, sf_dir):
        rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
        path = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
        write_files(rows, path, form)
        return read_files(spark, path, form, rows.schema).where("c_acctbal > 0")

    run.__name__ = name
    registry.queries[name] = run
    registry.oracles[name] = "SELECT c_custkey, c_name, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE c_acctbal > 0"


for _form in ("csv", "json", "orc"):
    _files(f"scan_{_form}", _form)


def stream_windowed_counts(spark, sf_dir):
    """The streaming extension's aggregation over a table, as a batch."""
    counts = windowed_counts(read_table(spark, sf_dir, "events"), width="6 hours")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


registry.queries["stream_windowed_counts"] = stream_windowed_counts
registry.oracles["stream_windowed_counts"] = "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
