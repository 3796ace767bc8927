"""What the operators share: plan sizes, partition counts, row keys."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.checkpoints import checkpoint_dir, cut, freed, tidy

__all__ = ["bounded_batches", "checkpoint_dir", "cut", "fresh", "keyed_text", "lean", "lean_pair", "map_columns", "merged", "partitions_for", "plan_bytes", "removed", "rows_for", "written"]


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for a plan; for a scan the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, mb: int = 8, most: int = 4096) -> int:
    """Partitions for a plan's rows: one for each mb megabytes of input, and beyond `most` so many times the root of what is more.

    So what chunks and hash ranges exchange, a row for each pair, grows with the
    input and not with its square; a task's share grows with the root (100 TB:
    235,000 partitions of 450 MB).  A smaller input gets up to the session's
    number, but none of under a megabyte; where Catalyst doesn't know the size,
    the session's number counts.
    """
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    if size > 1 << 50:
        return base
    n = size / (mb << 20)
    return max(1, min(base, math.ceil(size / (1 << 20))), math.ceil(n if n <= most else most * math.sqrt(n / most)))


def merged(df: DataFrame) -> DataFrame:
    """A side of a join on several columns, with a hint to merge sorted shuffles.

    Left alone, AQE makes a broadcast of a small side, and each such map takes a
    memory page (tens of megabytes) on every executor until the driver forgets it;
    an operator of many small joins would fill the heap with them.
    """
    return df.hint("merge")


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again."""
    with freed(df) as own:
        own.write.mode("overwrite").parquet(path)
    del own
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, none of which df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most `rows` rows in an Arrow batch, unless the session already asks for fewer.

    A batch of whole texts is held by the JVM and by the worker at once, so
    Spark's 10,000 rows would be tens of megabytes several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Returns memory that was freed to the system.

    Python workers live on from stage to stage beside the JVM: without this each
    keeps the most that any of its tasks has needed.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """f, a function of batches that yields batches, and afterwards give_back()."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def lean_pair(f: Callable) -> Callable:
    """f, a function of two tables that returns one, and afterwards give_back()."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return run


def map_columns(docs: DataFrame, text_col: str, columns: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """docs with new columns made from its texts, an Arrow batch at a time.

    All other columns pass through; those named as a new one are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [f.name for f in fields]
    if text_col in names:
        raise ValueError(f"{text_col} is both read and made")
    docs = docs.select([c for c in docs.columns if c not in names])
    schema = T.StructType([*docs.schema.fields, *fields])
    arrow = T.StructType(fields)

    def run(batches):
        types = [f.type for f in to_arrow_schema(arrow)]
        for batch in batches:
            step = rows_for(batch.column(text_col))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = [x if x.type == t else x.cast(t) for x, t in zip(columns(part.column(text_col)), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return docs.mapInArrow(lean(run), schema)


def rows_for(text: pa.Array, most: int = 4 << 20) -> int:
    """Rows of a slice so that it holds about `most` bytes of text."""
    return max(1, int(len(text) * most / max(most, text.nbytes)))
