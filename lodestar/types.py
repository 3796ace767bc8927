"""SQL type names and the Spark types they stand for."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The SQL spellings of each type.
SPELLINGS: dict[T.DataType, tuple[str, ...]] = {
    T.BooleanType(): ("BOOLEAN", "BOOL"),
    T.ByteType(): ("TINYINT", "UINT8"),
    T.ShortType(): ("SMALLINT", "INT2"),
    T.IntegerType(): ("INT", "INTEGER", "INT4", "MEDIUMINT"),
    T.LongType(): ("BIGINT", "INT8", "INT64", "HUGEINT", "INT128", "INT256"),
    T.FloatType(): ("FLOAT", "REAL", "FLOAT4"),
    T.DoubleType(): ("DOUBLE", "DOUBLE PRECISION", "FLOAT8"),
    T.StringType(): ("VARCHAR", "TEXT", "CLOB", "NVARCHAR", "CHAR", "CHARACTER", "JSON", "JSONB", "UUID", "ENUM"),
    T.BinaryType(): ("BINARY", "VARBINARY", "BLOB", "BYTEA", "BIT"),
    T.DateType(): ("DATE",),
    T.TimestampNTZType(): ("TIMESTAMP", "DATETIME"),
    T.DayTimeIntervalType(): ("INTERVAL",),
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]): ("POINT",),
}

_BY_NAME = {name: kind for kind, names in SPELLINGS.items() for name in names}
#: Seconds of the day.
_BY_NAME["TIME"] = T.IntegerType()

REJECTED = ("MAP", "TUPLE", "NESTED", "SET", "UNION", "TSVECTOR")


def sql_type(spelling: str) -> T.DataType:
    """The Spark type of a SQL spelling, e.g. 'DECIMAL(10,2)', 'VARCHAR(20)', 'INT UNSIGNED', 'INT[]'.

    DECIMAL and NUMERIC without digits are doubles; unsigned types keep their
    width; a length is no part of a type.
    """
    text = re.sub(r"\s+", " ", spelling.strip().upper())
    if text.endswith("[]"):
        return T.ArrayType(sql_type(text[:-2]))
    if m := re.fullmatch(r"(?:ARRAY|VECTOR)(?:<(.+)>)?", text):
        return T.ArrayType(sql_type(m[1])) if m[1] else T.ArrayType(T.DoubleType())
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)(?: ?\((\d+)(?: ?, ?(\d+))?\))?", text):
        return T.DecimalType(int(m[1]), int(m[2] or 0)) if m[1] else T.DoubleType()
    base = re.sub(r" ?\(.*\)", "", text).removesuffix(" UNSIGNED").strip()
    if base in REJECTED:
        raise ValueError(f"type {spelling} is not supported")
    if base not in _BY_NAME:
        raise ValueError(f"unknown type {spelling}")
    return _BY_NAME[base]
