"""INSERT, UPDATE, DELETE, constraints and utility statements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.catalog import Catalog
from lodestar.operators import constraints as C
from lodestar.operators import dml
from lodestar.queries.registry import Registry
from lodestar.sources.tables import clustered, mock, read_table

registry = Registry()
sql, frame = registry.sql, registry.frame


@frame("dml_insert_values", "SELECT * FROM region UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, NULL")
def dml_insert_values(t):
    r = t("region")
    new = r.sparkSession.createDataFrame([(100, "ATLANTIS"), (101, None)], "r_regionkey int, r_name string")
    return dml.insert(r, new)


@frame("dml_insert_select", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(1000 + s_suppkey AS INTEGER), s_name, 9 FROM supplier WHERE s_acctbal > 5000")
def dml_insert_select(t):
    s = t("supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("b"), (1000 + F.col("s_suppkey")).alias("a"))
    return dml.insert(t("nation"), s, ["n_name", "n_nationkey"], {"n_regionkey": F.lit(9)})


@frame("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(t):
    c = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return dml.update(c, {"c_mktsegment": F.lit("DEBT"), "c_acctbal": -F.col("c_acctbal")}, F.col("c_acctbal") < 0)


@frame("dml_update_swap", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")
def dml_update_swap(t):
    return dml.update(t("nation"), {"n_nationkey": F.col("n_regionkey"), "n_regionkey": F.col("n_nationkey")})


@frame("dml_delete", "SELECT event_id FROM events WHERE NOT coalesce(NULLIF(event_type, 'click') = 'view', FALSE)")
def dml_delete(t):
    return dml.delete(t("events"), F.nullif("event_type", F.lit("click")) == "view").select("event_id")


@frame("dml_merge", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, max(s_name) FROM supplier GROUP BY s_nationkey")
def dml_merge(t):
    s = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("n_name"))
    return dml.merge(t("nation").select("n_nationkey", "n_name"), s, ["n_nationkey"])


@frame("constraint_not_null", "SELECT event_id FROM events WHERE NULLIF(event_type, 'click') IS NULL")
def constraint_not_null(t):
    return C.null_violations(t("events").withColumn("k", F.nullif("event_type", F.lit("click"))), "k").select("event_id")


@frame("constraint_unique", "SELECT k, count(*) AS n FROM (SELECT NULLIF(c_nationkey, 3) AS k FROM customer) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1")
def constraint_unique(t):
    return C.unique_violations(t("customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k")), ["k"])


@frame("constraint_pk", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL")
def constraint_pk(t):
    return C.primary_key_violations(t("lineitem").select("l_orderkey"), ["l_orderkey"])


@frame("constraint_fk", "SELECT c_custkey FROM customer WHERE c_nationkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_nationkey < 20)")
def constraint_fk(t):
    return C.foreign_key_violations(t("customer"), ["c_nationkey"], t("nation").where("n_nationkey < 20"), ["n_nationkey"]).select("c_custkey")


@frame("constraint_check", "SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 7) BETWEEN 1 AND 30)")
def constraint_check(t):
    return C.check_violations(t("part").withColumn("p_size", F.nullif("p_size", F.lit(7))), F.col("p_size").between(1, 30)).select("p_partkey")


@frame("constraint_cascade", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name > 'B')")
def constraint_cascade(t):
    return C.cascade_delete(t("nation"), ["n_regionkey"], t("region").where("r_name > 'B'"), ["r_regionkey"]).select("n_nationkey")


def ddl_catalog(spark, sf_dir):
    """Create, insert, alter and roll back through the catalog; the table as it stands at the end."""
    c = Catalog(spark)
    c.create_database("work")
    c.use("work")
    c.create_table("staff", {"id": "INT", "name": "VARCHAR(20)", "pay": "DOUBLE"}, C.TableConstraints(primary_key=["id"], checks={"pay": "pay > 0"}), {"pay": "100.0D"})
    c.insert("staff", [(1, "Ann"), (2, "Bo")], ["id", "name"])
    c.insert("staff", [(3, "Cy", 5.0)])
    c.create_index("by_name", "staff", ["name"])
    c.begin()
    c.delete("staff", F.col("id") == 1)
    c.rollback()
    c.update("staff", {"pay": F.col("pay") * 2}, F.col("id") > 1)
    c.add_column("staff", "grade", "INT", "7")
    c.rename_column("staff", "name", "label")
    return c.tables["staff"].rows


registry.queries["ddl_catalog"] = ddl_catalog
registry.oracles["ddl_catalog"] = "SELECT * FROM (VALUES (1, 'Ann', CAST(100.0 AS DOUBLE), 7), (2, 'Bo', CAST(200.0 AS DOUBLE), 7), (3, 'Cy', CAST(10.0 AS DOUBLE), 7)) AS t(id, label, pay, grade)"


def ddl_view(spark, sf_dir):
    read_table(spark, sf_dir, "customer").where("c_acctbal > 9000").createOrReplaceTempView("rich_customers")
    return spark.sql("SELECT c_custkey, c_name FROM rich_customers")


registry.queries["ddl_view"] = ddl_view
registry.oracles["ddl_view"] = "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000"


@frame("index_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def index_scan(t):
    return t("orders").where(F.col("o_orderkey").between(100, 200)).select("o_orderkey", "o_totalprice")


@frame("index_layout", "SELECT o_orderkey, o_orderdate FROM orders")
def index_layout(t):
    return clustered(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


def _work_catalog(spark):
    c = Catalog(spark)
    c.create_table("tools", {"id": "INT", "label": "VARCHAR(9)", "price": "DECIMAL(10,2)"}, C.TableConstraints(primary_key=["id"]), {"label": "'none'"})
    c.create_table("parts", {"tool": "INT", "n": "BIGINT"}, C.TableConstraints(foreign_keys=[(["tool"], "tools", ["id"])]))
    return c


registry.queries["util_show_tables"] = lambda spark, sf_dir: _work_catalog(spark).show_tables()
registry.oracles["util_show_tables"] = """SELECT * FROM (VALUES ('default', 'parts', 2), ('default', 'tools', 3)) AS t("database", "table", "columns")"""
registry.queries["util_show_columns"] = lambda spark, sf_dir: _work_catalog(spark).show_columns("tools")
registry.oracles["util_show_columns"] = """
SELECT * FROM (VALUES ('id', 'int', FALSE, NULL), ('label', 'string', TRUE, chr(39) || 'none' || chr(39)), ('price', 'decimal(10,2)', TRUE, NULL)) AS t("column", "type", nullable, "default")
"""


def mock_scan(spark, sf_dir):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("x", T.DoubleType())])
    return mock(spark, 40, schema).where("n % 3 = 1")


registry.queries["mock_scan"] = mock_scan
registry.oracles["mock_scan"] = "SELECT CAST(i AS INTEGER) AS n, 'label_' || i AS label, CAST(i AS DOUBLE) AS x FROM range(40) AS r(i) WHERE i % 3 = 1"


def transaction(spark, sf_dir):
    """Nested transactions: the inner is rolled back, the outer commits."""
    c = _work_catalog(spark)
    c.insert("tools", [(1, "saw"), (2, "axe")], ["id", "label"])
    c.begin()
    c.update("tools", {"label": F.upper("label")})
    c.begin()
    c.delete("tools")
    c.rollback()
    c.commit()
    return c.tables["tools"].rows.select("id", "label")


registry.queries["transaction"] = transaction
registry.oracles["transaction"] = "SELECT * FROM (VALUES (1, 'SAW'), (2, 'AXE')) AS t(id, label)"
