"""INSERT, UPDATE and DELETE as snapshot transforms: the table before in, the table after out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, source: DataFrame, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """target and the rows of source."""
    return target.unionAll(mapped(target, source, columns, defaults))


def mapped(target: DataFrame, source: DataFrame, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The rows of source as rows of target.

    Columns map by the given list in order; without one by name, if every
    source name is a target name, else by position.  Others take their default,
    or null.
    """
    defaults = defaults or {}
    names = target.columns
    if columns is None:
        columns = source.columns if set(source.columns) <= set(names) else names[: len(source.columns)]
    if len(columns) != len(source.columns) or not set(columns) <= set(names):
        raise ValueError("the source does not fit the target's columns")
    place = dict(zip(columns, source.columns))
    kind = {f.name: f.dataType for f in target.schema.fields}
    new = [(F.col(f"`{place[n]}`") if n in place else defaults.get(n, F.lit(None))).cast(kind[n]).alias(n) for n in names]
    return source.select(*new)


def update(target: DataFrame, set_: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Rows that satisfy the predicate take new values; all right-hand sides read the old row."""
    kind = {f.name: f.dataType for f in target.schema.fields}
    if not set(set_) <= set(kind):
        raise ValueError(f"no column {sorted(set(set_) - set(kind))}")
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return target.select([F.when(hit, set_[n].cast(kind[n])).otherwise(F.col(f"`{n}`")).alias(n) if n in set_ else F.col(f"`{n}`") for n in target.columns])


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows of which the predicate is not true stay; without one none does."""
    return target.where(~F.coalesce(where, F.lit(False))) if where is not None else target.where(F.lit(False))


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: source rows replace target rows of equal keys, others are added."""
    return target.join(source, keys, "left_anti").unionByName(source.select(target.columns))
