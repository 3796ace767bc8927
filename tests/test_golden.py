"""Rows written by hand for small tables: what queries of the dialect intend."""

import pytest

from lodestar.session import Engine

LINES = [("red", "Harbour", 12), ("blue", "Hill", 7), ("night", "Hill", 7), ("grey", None, 0)]
RIDES = [("red", 1, 40), ("red", 2, 25), ("blue", 1, 40), ("blue", 2, None), ("night", 1, 10), ("ghost", 1, 99)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register_rows("lines", spark.createDataFrame(LINES, "line string, zone string, stops int"))
    e.register_rows("rides", spark.createDataFrame(RIDES, "line string, day int, people int"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_left_join_counts_no_nulls(engine):
    got = rows(engine.sql("SELECT l.line, count(r.people) FROM lines l LEFT JOIN rides r ON l.line = r.line GROUP BY l.line ORDER BY l.line"))
    assert got == [("blue", 1), ("grey", 0), ("night", 1), ("red", 2)]


def test_scalar_subquery(engine):
    assert rows(engine.sql("SELECT line FROM lines WHERE stops > (SELECT avg(stops) FROM lines) ORDER BY stops DESC, line")) == [("red",), ("blue",), ("night",)]


def test_ranks_with_ties(engine):
    got = rows(engine.sql("SELECT line, rank() OVER (ORDER BY stops DESC), dense_rank() OVER (ORDER BY stops DESC) FROM lines ORDER BY stops DESC, line"))
    assert got == [("red", 1, 1), ("blue", 2, 2), ("night", 2, 2), ("grey", 4, 3)]


def test_rank_in_a_partition(engine):
    got = rows(engine.sql("SELECT day, line, row_number() OVER (PARTITION BY day ORDER BY people DESC, line) FROM rides WHERE people IS NOT NULL ORDER BY 1, 3"))
    assert got == [(1, "ghost", 1), (1, "blue", 2), (1, "red", 3), (1, "night", 4), (2, "red", 1)]


def test_people_a_stop_is_an_integer(engine):
    got = rows(engine.sql("SELECT l.line, sum(r.people) / l.stops FROM lines l JOIN rides r ON l.line = r.line GROUP BY l.line, l.stops HAVING count(r.people) > 1"))
    assert got == [("red", 5)]


def test_union_is_distinct(engine):
    assert rows(engine.sql("SELECT zone FROM lines WHERE stops > 5 UNION SELECT zone FROM lines WHERE zone = 'Hill' ORDER BY zone")) == [("Harbour",), ("Hill",)]


def test_lag_and_lead(engine):
    got = rows(engine.sql("SELECT line, lag(stops) OVER (ORDER BY stops, line), lead(stops) OVER (ORDER BY stops, line) FROM lines ORDER BY stops, line"))
    assert got == [("grey", None, 7), ("blue", 0, 7), ("night", 7, 12), ("red", 7, None)]


def test_not_in_with_null_is_empty(engine):
    assert rows(engine.sql("SELECT line FROM lines WHERE stops NOT IN (12, NULL)")) == []


def test_aggregates_over_nothing(engine):
    assert rows(engine.sql("SELECT count(*), sum(people), max(people) FROM rides WHERE day > 9")) == [(0, None, None)]


def test_script(engine):
    got = engine.execute("CREATE OR REPLACE TEMP VIEW v AS SELECT 'a;b' AS x; -- note; no statement\nSELECT x FROM v;")
    assert rows(got) == [("a;b",)]
    with pytest.raises(KeyError):
        engine.execute_prepared("missing")
