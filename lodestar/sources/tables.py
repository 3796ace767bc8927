"""Scans, inline values, mock sources and result sinks."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Rows of a task whose rows a join multiplies, and at most so many tasks.
DEALT_ROWS, DEALT_TASKS = 4096, 8192


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Sequential scan; filters and columns reach the parquet reader."""
    if name not in TABLES:
        raise KeyError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over tasks of DEALT_ROWS rows, for a join in which a row meets very many.

    Files of a few megabytes are one task, however many rows the join then makes of
    each.  The number of tasks is given, so AQE doesn't merge them by their bytes.
    """
    tasks = min(DEALT_TASKS, math.ceil(df.count() / DEALT_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def read_files(spark: SparkSession, path: str, form: str, schema: str | T.StructType, **options) -> DataFrame:
    """CSV, JSON, ORC, text or parquet files with a given schema: nothing is read to infer one, and broken records raise."""
    defaults = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}}
    return spark.read.schema(schema).options(**defaults.get(form, {}) | options).format(form).load(path)


def write_files(df: DataFrame, path: str, form: str, **options) -> None:
    """A result as files of a format."""
    df.write.mode("overwrite").options(**({"header": "true"} if form == "csv" else {}) | options).format(form).save(path)


def values(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """Inline rows."""
    return spark.createDataFrame(list(rows), schema)


def one_row(spark: SparkSession) -> DataFrame:
    """The source of a SELECT without FROM."""
    return spark.range(1).select()


def mock(spark: SparkSession, n: int, schema: T.StructType) -> DataFrame:
    """n made-up rows of a schema: numbers count up, texts name their row."""
    row = F.col("id")
    cols = [(F.concat(F.lit(f"{f.name}_"), row) if isinstance(f.dataType, T.StringType) else row).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(n).select(*cols)


def clustered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """The layout an index gives: rows ranged and sorted by its keys, so that row groups' bounds prune scans."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_rows(df: DataFrame, limit: int = 1000) -> str:
    """A text table of a result's first rows, as a console prints it."""
    names, rows = df.columns, [["NULL" if v is None else str(v) for v in r] for r in df.take(limit)]
    width = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    return "\n".join([line(names), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)])
