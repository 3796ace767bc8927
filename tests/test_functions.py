"""Semantics that differ from Spark's defaults."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import functions as L
from lodestar.types import sql_type


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("a, b, q", [(7, 2, 3), (-7, 2, -3), (7, -2, -3), (9, 3, 3)])
def test_integer_division(spark, a, b, q):
    assert value(spark, L.idiv(a, b)) == q


def test_division_by_zero_raises(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        value(spark, L.idiv(F.col("id") + 1, F.col("id")))


@pytest.mark.parametrize("x, n", [(2.5, 3), (-2.5, -3), (2.4, 2), (None, None)])
def test_cast_rounds(spark, x, n):
    assert value(spark, L.cast_integer(F.lit(x).cast("double"))) == n


@pytest.mark.parametrize(
    "text, pattern, hit",
    [("abc", "a%", True), ("abc", "a_c", True), ("abc", "b%", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("abc", "[a-b]%", True), ("ABC", "abc", False), ("a|b", "a|b", True), ("a", "a|b", False), ("a\nc", "a%", True), ("a[", "a[", True)],
)
def test_similar_to(spark, text, pattern, hit):
    assert value(spark, L.similar_to(F.lit(text), pattern)) is hit


def test_similar_to_null(spark):
    assert value(spark, L.similar_to(F.lit(None).cast("string"), "a%")) is None


def test_regexp_ignores_case(spark):
    assert value(spark, L.regexp(F.lit("HELLO"), "ell")) is True
    assert value(spark, L.regexp(F.lit("HELLO"), "ell", case_sensitive=True)) is False


@pytest.mark.parametrize("start, n, out", [(1, 2, "he"), (0, 2, "he"), (-3, 2, "ll"), (-10, 6, "hello"), (3, None, "llo"), (2, 0, ""), (2, -1, ""), (9, 2, "")])
def test_substring(spark, start, n, out):
    assert value(spark, L.substring_from(F.lit("hello"), start, n)) == out


def test_trim(spark):
    x = F.lit(" \t\r\nab \n")
    assert value(spark, L.trim_blank(x)) == "ab"
    assert value(spark, L.trim_blank(x, "leading")) == "ab \n"
    assert value(spark, L.trim_blank(x, "trailing")) == " \t\r\nab"


def test_simple_case_matches_null(spark):
    assert value(spark, L.simple_case(F.lit(None).cast("int"), (1, "one"), (None, "null"), default="other")) == "null"


@pytest.mark.parametrize("field, n", [("dow", 7), ("year", 2023), ("week", 52), ("doy", 1), ("epoch", 1672567200), ("hour", 10)])
def test_extract(spark, field, n):
    assert value(spark, L.extract(field, ts("2023-01-01 10:00:00"))) == n


def test_extract_unknown():
    with pytest.raises(ValueError):
        L.extract("timezone", F.col("x"))


def test_date_part_sunday(spark):
    assert value(spark, L.date_field("dow", ts("2023-01-01 00:00:00"))) == 6
    assert value(spark, L.date_field("isodow", ts("2023-01-01 00:00:00"))) == 7


def test_truncate_and_ceil(spark):
    x = ts("2023-05-17 10:20:30")
    assert value(spark, L.truncate("decade", x)) == dt.datetime(2020, 1, 1)
    assert value(spark, L.truncate("quarter", x)) == dt.datetime(2023, 4, 1)
    assert value(spark, L.ceil_to(x, "quarter")) == dt.datetime(2023, 7, 1)
    assert value(spark, L.ceil_to(ts("2023-05-17 00:00:00"), "day")) == dt.datetime(2023, 5, 17)


def test_arrays(spark):
    a = F.array(*map(F.lit, (10, 20, 30)))
    assert [value(spark, L.subscript(a, i)) for i in (0, 2, -1, 5)] == [10, 30, 30, None]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        value(spark, L.subscript(a, 5, strict=True))
    assert value(spark, L.slice_range(a, 1)) == [20, 30]
    assert value(spark, L.slice_range(a, -2, -1)) == [20]
    assert value(spark, L.slice_range(a, 2, 1)) == []


def test_convert(spark):
    assert value(spark, L.convert(F.lit(2.5), "INT")) == 3
    assert value(spark, L.try_convert(F.lit("x"), "INT")) is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(spark, L.convert(F.concat(F.lit("x"), F.col("id").cast("string")), "DOUBLE"))


@pytest.mark.parametrize(
    "text, kind",
    [("INT UNSIGNED", T.IntegerType()), ("varchar(20)", T.StringType()), ("DECIMAL(10,2)", T.DecimalType(10, 2)), ("numeric", T.DoubleType()), ("INT[]", T.ArrayType(T.IntegerType())), ("double precision", T.DoubleType()), ("HUGEINT", T.LongType()), ("TIMESTAMP", T.TimestampNTZType()), ("BYTEA", T.BinaryType())],
)
def test_types(text, kind):
    assert sql_type(text) == kind


@pytest.mark.parametrize("text", ["MAP", "TUPLE", "NOPE"])
def test_rejected_types(text):
    with pytest.raises(ValueError):
        sql_type(text)
