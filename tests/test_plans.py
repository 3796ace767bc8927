"""Plans are the ones wanted: pushed filters, pruned columns, no Python in the engine's own queries."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.plans import explain, operators, pushed_filters
from lodestar.queries import ORACLES, QUERIES
from tests.compare import assert_same


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    df = QUERIES["filter_between"](spark, sf_dir)
    assert "GreaterThanOrEqual(l_discount,0.02)" in " ".join(pushed_filters(df))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>", explain(df))


def test_top_n_is_a_heap(spark, sf_dir):
    assert operators(QUERIES["topn"](spark, sf_dir))[:3].count("TakeOrderedAndProject") == 1


def test_top_n_per_group_limits_before_the_shuffle(spark, sf_dir):
    text = explain(QUERIES["topn_per_group"](spark, sf_dir), "simple")
    assert text.count("WindowGroupLimit") == 2


def test_rows_that_a_join_multiplies_are_dealt_over_tasks(spark, sf_dir, tmp_path):
    """One small file of 9,000 customers is one task to read, but not one task to join."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = customers.count()
    copies = customers.crossJoin(spark.range(-(-9000 // n))).withColumn("c_custkey", F.col("c_custkey") + n * F.col("id")).drop("id")
    copies.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet.d")
    (file,) = (tmp_path / "customer.parquet.d").glob("*.parquet")
    file.rename(tmp_path / "customer.parquet")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").toPandas().to_parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["join_null_keys"](spark, str(tmp_path))
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 3 and max(tasks) < 0.5 * sum(tasks)
    assert_same(df, str(tmp_path), ORACLES["join_null_keys"])


def test_semi_join(spark, sf_dir):
    assert "LeftSemi" in explain(QUERIES["subq_exists"](spark, sf_dir), "simple")


def test_range_join_is_an_equality_join(spark, sf_dir):
    text = explain(QUERIES["join_range"](spark, sf_dir), "simple")
    assert "HashJoin" in text and "NestedLoop" not in text


def test_asof_makes_no_pairs(spark, sf_dir):
    text = explain(QUERIES["join_asof"](spark, sf_dir), "simple")
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_broadcast_only_what_is_small(spark, sf_dir):
    big = spark.range(10**9)
    assert not R.small(big)
    assert R.small(spark.read.parquet(f"{sf_dir}/nation.parquet"))
    assert "ResolvedHint" not in R.maybe_broadcast(big)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_on_executors(spark, sf_dir, name):
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow", explain(QUERIES[name](spark, sf_dir), "simple"))


def test_asof_with_and_without_slices(spark):
    left = spark.createDataFrame([(1, "2024-01-05", 1), (2, "2024-03-01", 1), (3, "2024-01-01", 2), (4, "2024-02-01", None)], "id int, t string, k int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([("2024-01-05", 1, 10), ("2024-01-09", 1, 11), ("2024-01-09", 1, 12), ("2024-06-01", 2, 13)], "u string, k int, v int").withColumn("u", F.col("u").cast("timestamp_ntz"))
    for slices in (None, "month", "day"):
        got = {r["id"]: r["v"] for r in R.asof_join(left, right, ["k"], "t", "u", ["v"], slices).collect()}
        assert got == {1: 10, 2: 12, 3: None, 4: None}


def test_all_subquery_edges(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    empty = spark.createDataFrame([], "y int")
    nulls = spark.createDataFrame([(0,), (None,)], "y int")
    assert R.all_subquery(df, "x", ">", empty, "y").count() == 2
    assert R.all_subquery(df, "x", ">", nulls, "y").count() == 0
    assert R.any_subquery(df, "x", ">", empty, "y").count() == 0
    assert R.any_subquery(df, "x", "=", spark.createDataFrame([(5,), (5,)], "y int"), "y").collect() == [(5,)]


def test_range_join_of_many_widths(spark):
    """Ranges from tiny to huge, empty ones and nulls; a range meets two bins at most, whatever its length."""
    import random

    r = random.Random(2)
    points = [(i, r.uniform(-1e4, 1e4)) for i in range(300)] + [(900, None), (901, 0.0)]
    ranges = [(i, lo, lo + r.choice([0.0, -1.0, 0.5, 3.0, 700.0, 1e9])) for i in range(60) for lo in [r.uniform(-1e4, 1e4)]] + [(99, None, 1.0), (98, 0.0, 1e-9)]
    p = spark.createDataFrame(points, "id int, level double")
    b = spark.createDataFrame(ranges, "rid int, cell double, hi double")
    got = sorted((x["id"], x["rid"]) for x in R.range_join(p, b, "level", "cell", "hi", 2.0).collect())
    assert got == sorted((i, j) for i, x in points for j, lo, hi in ranges if None not in (x, lo) and lo <= x < hi)


def test_range_join_broadcasts_the_ranges(spark, sf_dir):
    text = explain(QUERIES["join_range"](spark, sf_dir), "simple")
    assert "BuildRight" in text and "BuildLeft" not in text


def test_theta_join_of_two_large_sides_raises(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_BYTES", 10)
    a, b = spark.range(10**8).toDF("x"), spark.range(10**8).toDF("y")
    monkeypatch.setattr(R, "small", lambda df: False)
    with pytest.raises(ValueError, match="range_join"):
        R.theta_join(a, b, F.col("x") < F.col("y"))
    assert R.theta_join(a, b, (F.col("x") == F.col("y")) & (F.col("x") > 5)) is not None


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_quantified_subqueries(spark, op):
    import operator

    f = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    xs = [1, 2, 3, 4, None]
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    for ys in ([], [2], [2, 3], [2, 2], [None, 3]):
        sub = spark.createDataFrame([(y,) for y in ys], "y int")
        known = [y for y in ys if y is not None]
        some = sorted(x for x in xs if x is not None and any(f(x, y) for y in known))
        every = sorted((x for x in xs if not ys or (x is not None and None not in ys and all(f(x, y) for y in ys))), key=str)
        assert sorted(r["x"] for r in R.any_subquery(df, "x", op, sub, "y").collect()) == some
        assert sorted((r["x"] for r in R.all_subquery(df, "x", op, sub, "y").collect()), key=str) == every


def test_helper_columns_clash_with_none(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 1, 4)], "k int, rank int, rank_ int")
    assert R.top_n_per_group(df, ["k"], 1, F.asc("rank")).collect() == [(1, 1, 4)]
