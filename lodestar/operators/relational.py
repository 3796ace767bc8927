"""Joins, top-k, distinct-on and quantified subqueries as compositions of DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if Catalyst's estimate is at most this.
BROADCAST_BYTES = 32 << 20


#: Where Catalyst knows no size, a side of at most this many rows is broadcast.
BROADCAST_ROWS = 100_000


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """By Catalyst's estimate; where it has none (rows that came from the driver), by counting up to BROADCAST_ROWS."""
    size = estimated_bytes(df)
    if size >= 1 << 60 and not df.isStreaming:
        return df.select().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return size <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its size allows; else a shuffle join is left to Catalyst."""
    return F.broadcast(df) if small(df, most) else df


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, none of which df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def straight_join(left: DataFrame, right: DataFrame, on: list[str] | Column) -> DataFrame:
    """An inner join in the order it is written in."""
    return left.join(right.hint("merge"), on, "inner")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, take: list[str], slices: str | None = None) -> DataFrame:
    """Each left row with `take` of the latest right row of equal `by` whose time is not later; nulls without one.

    One shuffle over the union of both sides and one ordered window; no pairs
    are made.  Of right rows with equal times the largest `take` counts.  A hot
    key is a problem of one window partition: `slices` may name a date_trunc
    unit, which splits keys by time and carries each slice's last right row
    into the next through a window over the slices only.
    """
    value = F.struct(F.col(right_ts).alias("_ts"), *[F.col(c) for c in take])
    cols = list(left.columns)
    l = left.select(*[F.col(c).alias(f"l_{i}") for i, c in enumerate(cols)], *[F.col(b).alias(f"k_{i}") for i, b in enumerate(by)], F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    r = right.select(*[F.col(b).alias(f"k_{i}") for i, b in enumerate(by)], F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), value.alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    keys = [f"k_{i}" for i in range(len(by))]
    if slices:
        both = both.withColumn("_slice", F.date_trunc(slices, "_at"))
        w = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
        last = both.where("_side = 0").groupBy(*keys, "_slice").agg(F.max("_v").alias("_last"))
        every = both.select(*keys, "_slice").distinct().join(last, [*keys, "_slice"], "left")
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        both = both.join(carried, [*keys, "_slice"], "left")
        found = F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carried"))
    else:
        w = Window.partitionBy(*keys).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_v", ignorenulls=True).over(w)
    out = both.withColumn("_found", found).where("_side = 1")
    return out.select(*[F.col(f"l_{i}").alias(c) for i, c in enumerate(cols)], *[F.col("_found")[c].alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, by bins: a range is listed in the bins it meets, a point in its own.

    An equality join instead of a nested loop.  Bins come in sizes: `width`
    times a power of two, the least that a range fits in, so a range meets two
    bins at most however long it is, and a point has one bin for each size in
    use (64 at most, one if all ranges are about of a width).  A pair comes once,
    since a range has one size.  Ranges that end before they begin, and nulls,
    meet nothing.
    """
    level, cell = own_names(points.crossJoin(ranges), "level", "cell")
    size = lambda c: F.lit(float(width)) * F.pow(F.lit(2.0), F.col(c))
    fits = F.greatest(F.lit(0), F.ceil(F.log2((F.col(low) - F.col(high)) / -float(width)))).cast("int")
    r = ranges.where(F.col(low) < F.col(high)).withColumn(level, fits)
    first, last = (F.floor(F.col(c) / size(level)).cast("bigint") for c in (low, high))
    r = r.withColumn(cell, F.explode(F.array_distinct(F.array(first, last))))
    sizes = sorted(x[0] for x in r.select(level).distinct().limit(2048).collect())  # exponents of doubles: fewer than 2,048
    if len(sizes) == 1:
        p = points.withColumn(level, F.lit(sizes[0]))
    else:
        p = points.withColumn(level, F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    p = p.withColumn(cell, F.floor(F.col(point) / size(level)).cast("bigint"))
    return p.join(maybe_broadcast(r), [level, cell]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(level, cell)


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Any predicate; without an equality in it one side must be small enough to be broadcast, else it raises."""
    if small(right):
        return left.join(F.broadcast(right), condition)
    if small(left):
        return F.broadcast(left).join(right, condition)
    out = left.join(right, condition)
    if "CartesianProduct" in (plan := out._jdf.queryExecution().executedPlan().toString()) or "NestedLoopJoin" in plan:
        raise ValueError("neither side can be broadcast and the condition has no equality: give it one, or use range_join")
    return out


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order: a bounded heap in each task, not a global sort."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; Catalyst limits groups before the shuffle."""
    (rank,) = own_names(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n).drop(rank)


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """DISTINCT ON: the first row of each key."""
    return top_n_per_group(df, keys, 1, *order)


def qualify(df: DataFrame, name: str, window: Column, keep: Column) -> DataFrame:
    """QUALIFY: a filter on a window function."""
    return df.withColumn(name, window).where(keep).drop(name)


def _bounds(sub: DataFrame, y: str, taken: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row: the least and the greatest y, the rows, and those whose y is known."""
    names = own_names(taken, "least", "most", "rows", "known")
    lo, hi, n, known = names
    return sub.agg(F.min(y).alias(lo), F.max(y).alias(hi), F.count("*").alias(n), F.count(y).alias(known)), names


_TESTS = {
    "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def any_subquery(df: DataFrame, x: str, op: str, sub: DataFrame, y: str) -> DataFrame:
    """Rows with x op ANY (sub): by the least and the greatest of sub, by a semi join for =."""
    if op == "=":
        return df.join(sub.select(F.col(y).alias(x)), x, "left_semi")
    bounds, names = _bounds(sub, y, df)
    lo, hi = F.col(names[0]), F.col(names[1])
    test = (F.col(x) != lo) | (F.col(x) != hi) if op == "<>" else _TESTS[op](F.col(x), hi if op[0] == "<" else lo)
    return df.join(F.broadcast(bounds)).where(test).drop(*names)


def all_subquery(df: DataFrame, x: str, op: str, sub: DataFrame, y: str) -> DataFrame:
    """Rows with x op ALL (sub): all rows if sub is empty, none if it holds a null that could decide."""
    bounds, names = _bounds(sub, y, df)
    lo, hi, n, known = map(F.col, names)
    if op == "<>":
        (key,) = own_names(df, "other")
        rest = df.join(sub.select(F.col(y).alias(key)), F.col(x) == F.col(key), "left_anti")
        return rest.join(F.broadcast(bounds)).where((n == 0) | ((n == known) & F.col(x).isNotNull())).drop(*names)
    test = (F.col(x) == lo) & (F.col(x) == hi) if op == "=" else _TESTS[op](F.col(x), lo if op[0] == "<" else hi)
    return df.join(F.broadcast(bounds)).where((n == 0) | ((n == known) & test)).drop(*names)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, dfs)


def having(df: DataFrame, condition: Column) -> DataFrame:
    """HAVING, with or without groups: a filter on what was aggregated or projected."""
    return df.where(condition)
