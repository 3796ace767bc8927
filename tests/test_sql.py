"""The engine's SQL text: the dialect, and statements that change tables."""

import os

import pytest

from lodestar.catalog import ConstraintViolation
from lodestar.session import Engine
from lodestar.sql.dialect import by_grammar
from lodestar.sql.tokens import grouped, render, statements


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    return e.register_rows("t", spark.createDataFrame([(1, 7, 2.5, "Abc", None), (1, 3, -2.5, "xyz", 5), (2, 9, 0.5, "abd", 1)], "k int, a int, x double, s string, q int"))


def rows(df):
    return [tuple(r) for r in df.collect()]


QUERIES = [
    ("SELECT 7/2, 7.0/2, -7/2", [(3, 3.5, -3)]),
    ("SELECT a/2, a/2/2, x/2, (a+1)/2*2, CASE WHEN a/2 > 1 THEN 5 END/2 FROM t WHERE a = 7", [(3, 1, 1.25, 8, 2)]),
    ("WITH c AS (SELECT a/2 AS h FROM t) SELECT h/2 FROM c WHERE h IN (SELECT a/3 FROM t) ORDER BY 1", [(0,), (1,)]),
    ("SELECT CAST(2.5 AS INT), CAST(x AS BIGINT), x::INT, CAST(-0.5D AS INT), CAST('12' AS INT) FROM t WHERE a = 3", [(3, -3, -3, -1, 12)]),
    ("SELECT CAST(x AS DOUBLE), CAST(a AS BIGINT) FROM t WHERE a = 3", [(-2.5, 3)]),
    ("SELECT s FROM t WHERE s RLIKE '^AB' ORDER BY s", [("Abc",), ("abd",)]),
    ("SELECT s FROM t WHERE s NOT REGEXP concat('^', 'ab')", [("xyz",)]),
    ("SELECT s FROM t WHERE s ~ '^ab' OR s ~* 'X.Z' ORDER BY s", [("abd",), ("xyz",)]),
    ("SELECT s FROM t WHERE s !~ '^ab' AND s !~* 'x'", [("Abc",)]),
    ("SELECT ~5", [(-6,)]),
    ("SELECT s FROM t WHERE s SIMILAR TO 'A_c' OR s NOT SIMILAR TO '%b%' ORDER BY s", [("Abc",), ("xyz",)]),
    ("SELECT extract(dow FROM DATE'2024-01-01'), EXTRACT(DOW FROM DATE'2024-01-07'), extract(year FROM DATE'2024-01-07')", [(1, 7, 2024)]),
    ("SELECT a FROM t ORDER BY a LIMIT 1, 2", [(7,), (9,)]),
    ("SELECT a FROM t ORDER BY a OFFSET 1 ROWS FETCH FIRST 1 ROWS ONLY", [(7,)]),
    ("SELECT a FROM t ORDER BY a FETCH NEXT ROW ONLY", [(3,)]),
    ("SELECT a FROM (SELECT a FROM t ORDER BY a DESC FETCH FIRST 2 ROWS ONLY) ORDER BY a LIMIT 1", [(7,)]),
    ("SELECT DISTINCT ON (k) k, s FROM t ORDER BY k DESC, a DESC", [(2, "abd"), (1, "Abc")]),
    ("SELECT DISTINCT ON (k) s FROM t ORDER BY k, a LIMIT 1", [("xyz",)]),
    ("SELECT k, s FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY a) = 1 ORDER BY a", [(1, "xyz"), (2, "abd")]),
    ("SELECT a, rank() OVER (ORDER BY a) AS r FROM t QUALIFY r > 1 ORDER BY r DESC", [(9, 3), (7, 2)]),
    ("SELECT k, sum(a) AS n FROM t GROUP BY k QUALIFY rank() OVER (ORDER BY sum(a) DESC) = 1", [(1, 10)]),
    ("SELECT a FROM t HAVING a > 5 ORDER BY a", [(7,), (9,)]),
    ("SELECT count(*) FROM t HAVING count(*) > 9", []),
    ("SELECT a FROM t WHERE a + 1 > ANY (SELECT q FROM t) ORDER BY a", [(3,), (7,), (9,)]),
    ("SELECT a FROM t WHERE a >= ALL (SELECT a FROM t)", [(9,)]),
    ("SELECT a FROM t WHERE a > ALL (SELECT q FROM t)", []),
    ("SELECT count(*) FROM t WHERE a > ALL (SELECT q FROM t WHERE q > 99)", [(3,)]),
    ("SELECT a FROM t WHERE a = SOME (SELECT q + 2 FROM t) OR a <> ALL (SELECT a FROM t) ORDER BY a", [(3,), (7,)]),
    ("SELECT a FROM t WHERE a <> ANY (SELECT 3) AND NOT a = ALL (SELECT 9)", [(7,)]),
    ("SELECT a FROM t WHERE a = ANY (array(3, 9)) AND a < ALL (array(5, 6))", [(3,)]),
    ("SELECT trim(' \\t a\\n'), trim(leading from '  b '), trim('x' from 'xax'), CONVERT(INT, '12'), TRY_CONVERT('z', INT)", [("a", "b ", "a", 12, None)]),
    ("SELECT a FROM t WHERE k = 1 UNION ALL SELECT q FROM t WHERE s ~ 'xyz' ORDER BY 1 LIMIT 1, 2", [(5,), (7,)]),
    ("SELECT 'a / b -- c', \"quoted ; text\" -- / note", [("a / b -- c", "quoted ; text")]),
]


@pytest.mark.parametrize("text, want", QUERIES)
def test_dialect(engine, text, want):
    assert rows(engine.sql(text)) == want


@pytest.mark.parametrize("text", ["SELECT sum(max(a)) FROM t", "SELECT a FROM t GROUP BY k", "SELECT nothing FROM t", "SELECT 1/0", "SELECT a FROM t WHERE a > ALL (SELECT a, k FROM t)"])
def test_rejected(engine, text):
    with pytest.raises(Exception):
        engine.sql(text).collect()


def test_plain_text_stays_as_it_is():
    text = "SELECT  a.b, arr[0], f(x) FROM t AS a /* note */ WHERE a.b LIKE 'x%' -- end"
    assert by_grammar(text) == text
    assert render(grouped("SELECT /*+ BROADCAST(t) */ 1.5e3, .5, t.* FROM t")).count("BROADCAST") == 1
    assert statements("a; 'b;' ; -- c;\n ;d") == ["a", "'b;'", "d"]
    with pytest.raises(ValueError):
        grouped("SELECT (1")
    with pytest.raises(ValueError):
        by_grammar("SELECT s SIMILAR TO p FROM t")


@pytest.fixture
def farm(spark):
    e = Engine(spark)
    e.execute("""
        CREATE TABLE field (id INT PRIMARY KEY, crop VARCHAR(20) NOT NULL UNIQUE, hectares DOUBLE DEFAULT 1.5 CHECK (hectares > 0));
        CREATE TABLE IF NOT EXISTS harvest (field INT REFERENCES field(id) ON DELETE CASCADE, year INT, tons DECIMAL(10, 2),
            CONSTRAINT years CHECK (year BETWEEN 1990 AND 2100), PRIMARY KEY (field, year));
        INSERT INTO field (id, crop) VALUES (1, 'rye'), (2, 'oats');
        INSERT INTO field VALUES (3, 'peas', 4.0), (4, 'hops', DEFAULT);
        INSERT INTO harvest SELECT id, 2020, hectares * 10 FROM field WHERE id < 4;
    """)
    return e


def test_insert(farm):
    assert rows(farm.sql("SELECT * FROM field ORDER BY id")) == [(1, "rye", 1.5), (2, "oats", 1.5), (3, "peas", 4.0), (4, "hops", 1.5)]
    assert farm.sql("SELECT sum(tons) AS n FROM harvest").first()["n"] == 70
    for text, what in [
        ("INSERT INTO field VALUES (1, 'corn', 1)", "PRIMARY KEY"),
        ("INSERT INTO field (id, crop) VALUES (9, 'rye')", "UNIQUE"),
        ("INSERT INTO field (id) VALUES (9)", "NOT NULL crop"),
        ("INSERT INTO field VALUES (9, 'corn', -1)", "CHECK hectares"),
        ("INSERT INTO harvest VALUES (9, 2020, 1)", "FOREIGN KEY"),
        ("INSERT INTO harvest VALUES (1, 1980, 1)", "CHECK years"),
    ]:
        with pytest.raises(ConstraintViolation, match=what):
            farm.sql(text)
    assert farm.table("field").count() == 4


def test_update_and_delete(farm):
    farm.sql("UPDATE field SET hectares = hectares + id / 2, crop = upper(crop) WHERE id IN (SELECT field FROM harvest) AND crop ~ '^[pr]'")
    assert rows(farm.sql("SELECT id, crop, hectares FROM field ORDER BY id")) == [(1, "RYE", 1.5), (2, "oats", 1.5), (3, "PEAS", 5.0), (4, "hops", 1.5)]
    farm.sql("UPDATE field AS f SET hectares = (SELECT max(tons) FROM harvest h WHERE h.field = f.id) WHERE f.id = 3")
    assert farm.sql("SELECT hectares FROM field WHERE id = 3").first()[0] == 40.0
    farm.sql("UPDATE harvest SET year = field, field = year - 2019 WHERE FALSE")
    farm.sql("DELETE FROM field WHERE crop = 'oats' OR hectares > 30")
    assert rows(farm.sql("SELECT field FROM harvest")) == [(1,)]
    farm.sql("DELETE FROM harvest")
    assert farm.table("harvest").count() == 0
    with pytest.raises(ConstraintViolation):
        farm.sql("UPDATE field SET id = NULL")


def test_transactions(farm):
    farm.execute("BEGIN; DELETE FROM harvest; SAVEPOINT s; DROP TABLE harvest; ALTER TABLE field ADD COLUMN note TEXT DEFAULT 'n'; ROLLBACK TO SAVEPOINT s")
    assert farm.table("harvest").count() == 0 and "note" not in farm.table("field").columns
    farm.execute("RELEASE SAVEPOINT s; ROLLBACK")
    assert farm.table("harvest").count() == 3
    farm.execute("START TRANSACTION; DELETE FROM harvest WHERE field = 1; COMMIT AND CHAIN; DELETE FROM harvest; ROLLBACK")
    assert farm.table("harvest").count() == 2


def test_definitions(farm):
    farm.execute("ALTER TABLE field RENAME COLUMN hectares TO size; ALTER TABLE field ADD COLUMN soil TEXT DEFAULT 'loam'; ALTER TABLE field ALTER COLUMN soil SET DEFAULT 'clay'; INSERT INTO field (id, crop) VALUES (7, 'flax')")
    assert rows(farm.sql("SELECT size, soil FROM field WHERE id IN (1, 7) ORDER BY id")) == [(1.5, "loam"), (1.5, "clay")]
    with pytest.raises(ConstraintViolation, match="CHECK"):
        farm.sql("INSERT INTO field (id, crop, size) VALUES (8, 'hemp', 0)")
    farm.execute("ALTER TABLE field DROP COLUMN soil; ALTER TABLE field RENAME TO plot; CREATE INDEX by_crop ON plot (crop); DROP INDEX by_crop; CREATE TABLE big AS SELECT * FROM plot WHERE size > 2")
    assert [tuple(r) for r in farm.sql("SHOW TABLES").collect()] == [("default", "big", 3), ("default", "harvest", 3), ("default", "plot", 3)]
    assert [r["column"] for r in farm.sql("DESCRIBE plot").collect()] == ["id", "crop", "size"]
    farm.execute("CREATE DATABASE IF NOT EXISTS spare; USE spare; CREATE TABLE plot (z INT)")
    assert farm.sql("SELECT * FROM plot").columns == ["z"]
    farm.execute("USE default; DROP DATABASE spare; DROP TABLE IF EXISTS nothing, big")
    assert farm.sql("SHOW DATABASES").collect() == [("default",)]
    assert "Scan" in farm.sql("EXPLAIN SELECT * FROM plot WHERE id = 1").first()[0] or farm.sql("EXPLAIN FORMATTED SELECT 1/1").count() > 1
    for text in ("CREATE TABLE plot (a INT)", "DROP TABLE nothing", "ALTER TABLE plot DROP COLUMN crop", "CREATE TABLE x (a WIDGET)", "ALTER TABLE plot SHUFFLE", "UPDATE plot SET nothing = 1", "INSERT INTO nothing VALUES (1)"):
        with pytest.raises(ValueError):
            farm.sql(text)


def test_merge(farm):
    farm.register_rows("news", farm.spark.createDataFrame([(1, "rye", 9.0), (2, "oats", -1.0), (5, "corn", 2.0), (6, "beet", -1.0)], "id int, crop string, size double"))
    farm.sql("DELETE FROM harvest WHERE field = 2")
    farm.sql("""
        MERGE INTO field AS f USING news AS n ON f.id = n.id
        WHEN MATCHED AND n.size < 0 THEN DELETE
        WHEN MATCHED THEN UPDATE SET hectares = n.size / 2, crop = upper(n.crop)
        WHEN NOT MATCHED AND n.size > 0 THEN INSERT (id, crop, hectares) VALUES (n.id, n.crop, n.size)
    """)
    assert rows(farm.sql("SELECT * FROM field ORDER BY id")) == [(1, "RYE", 4.5), (3, "peas", 4.0), (4, "hops", 1.5), (5, "corn", 2.0)]
    farm.register_rows("news", farm.spark.createDataFrame([(1, "a"), (1, "b")], "id int, crop string"))
    with pytest.raises(ValueError, match="several rows"):
        farm.sql("MERGE INTO field USING news AS n ON field.id = n.id WHEN MATCHED THEN UPDATE SET crop = n.crop")


def test_prepared(engine):
    engine.sql("PREPARE p AS SELECT a / 2 AS h FROM t WHERE k = ? AND s RLIKE ? ORDER BY a")
    assert rows(engine.sql("EXECUTE p (1, 'A')")) == [(3,)]
    assert rows(engine.execute_prepared("P", 2, "")) == [(4,)]
    engine.sql("DEALLOCATE p")
    with pytest.raises(KeyError):
        engine.sql("EXECUTE p (1, 'A')")
    assert rows(engine.sql("SELECT a FROM t WHERE k = :k ORDER BY a", k=2)) == [(9,)]


def test_prepared_changes(farm):
    farm.sql("PREPARE add AS INSERT INTO field (id, crop) VALUES (?, ?)")
    farm.sql("EXECUTE add (9, 'corn')")
    farm.sql("UPDATE field SET hectares = ?, crop = concat(crop, ?) WHERE id = ?", 7.5, "!", 9)
    farm.sql("DELETE FROM harvest WHERE field = :f", f=1)
    assert rows(farm.sql("SELECT crop, hectares FROM field WHERE id = 9")) == [("corn!", 7.5)]
    assert farm.table("harvest").count() == 2


def test_source_files_are_never_written(spark, tmp_path):
    folder = str(tmp_path / "region.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS r_regionkey", "'x' AS r_name").write.parquet(folder)
    before = sorted(os.listdir(folder))
    e = Engine(spark).register(str(tmp_path), ("region",))
    e.execute("INSERT INTO region VALUES (9, 'y'); UPDATE region SET r_name = 'z'; DELETE FROM region WHERE r_regionkey = 0")
    assert rows(e.sql("SELECT * FROM region ORDER BY 1")) == [(1, "z"), (2, "z"), (9, "z")]
    assert sorted(os.listdir(folder)) == before and spark.read.parquet(folder).count() == 3
