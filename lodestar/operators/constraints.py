"""Constraints as set-based queries: each gives the rows that violate it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintViolation(ValueError):
    """A change would break a constraint."""


def null_violations(df: DataFrame, column: str) -> DataFrame:
    """NOT NULL."""
    return df.where(F.col(f"`{column}`").isNull())


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """UNIQUE: keys that occur more than once, with their count; keys that hold a null don't count."""
    known = df.dropna(subset=columns)
    return known.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def primary_key_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRIMARY KEY: repeated keys, and keys that hold a null."""
    some_null = ~F.coalesce(*[F.when(F.col(c).isNull(), F.lit(False)) for c in columns], F.lit(True))
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where((F.col("n") > 1) | some_null)


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """CHECK: a condition that is null passes."""
    return df.where(~condition)


def _keys(df: DataFrame, columns: list[str], taken: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The columns under names that are none of those taken."""
    base = "key"
    while any(t.startswith(base) for t in taken):
        base += "_"
    names = [f"{base}{i}" for i in range(len(columns))]
    return df.select([F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)]), names


def without_partner(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], how: str = "left_anti") -> DataFrame:
    """Rows of child that no row of parent has the key of; with 'left_semi' those that one has."""
    keys, names = _keys(parent, parent_columns, child.columns)
    return child.join(keys, [F.col(f"`{c}`") == F.col(n) for c, n in zip(columns, names)], how)


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """FOREIGN KEY: child rows without a parent; a null in the key passes."""
    return without_partner(child.dropna(subset=columns), columns, parent, parent_columns)


def cascade_delete(child: DataFrame, columns: list[str], gone: DataFrame, parent_columns: list[str]) -> DataFrame:
    """ON DELETE CASCADE: child rows whose parent is not among those gone."""
    return without_partner(child, columns, gone, parent_columns)


@dataclass
class ForeignKey:
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass
class TableConstraints:
    """What a table declares.

    violations() judges a change by the rows it brings, so a statement costs
    what it changes: keys are looked up among the rows that stay.
    """

    not_null: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[ForeignKey | tuple] = field(default_factory=list)

    def __post_init__(self):
        self.foreign_keys = [f if isinstance(f, ForeignKey) else ForeignKey(*f) for f in self.foreign_keys]

    def columns(self) -> set[str]:
        """Columns that a key or a foreign key names."""
        return {*self.primary_key, *(c for u in self.unique for c in u), *(c for f in self.foreign_keys for c in f.columns)}

    def violations(self, new: DataFrame, stay: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, changed: set[str] | None = None) -> dict[str, DataFrame]:
        """Of rows `new` beside rows that `stay`; changed: the columns that a statement set (all, if not given)."""
        touched = lambda columns: changed is None or bool(changed & set(columns))
        out = {f"NOT NULL {c}": null_violations(new, c) for c in self.not_null if touched([c])}
        for name, keys, repeated in [("PRIMARY KEY", self.primary_key, primary_key_violations)] * bool(self.primary_key) + [("UNIQUE", u, unique_violations) for u in self.unique]:
            if touched(keys):
                bad = repeated(new, keys).select(F.lit(1).alias("n"))
                if stay is not None:
                    bad = bad.unionAll(without_partner(new, keys, stay, keys, "left_semi").select(F.lit(1).alias("n")))
                out[f"{name} ({', '.join(keys)})"] = bad
        if changed is None or changed:
            out |= {f"CHECK {name}": check_violations(new, F.expr(text)) for name, text in self.checks.items()}
        for f in self.foreign_keys:
            if touched(f.columns):
                out[f"FOREIGN KEY ({', '.join(f.columns)})"] = foreign_key_violations(new, f.columns, (tables or {})[f.parent], f.parent_columns)
        return out

    def validate(self, new: DataFrame, stay: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, changed: set[str] | None = None) -> None:
        """Raises if a row breaks something."""
        raise_first(self.violations(new, stay, tables, changed))


def raise_first(violations: dict[str, DataFrame]) -> None:
    """One job over all of a statement's checks; each gives one row at most."""
    if not violations:
        return
    found = [bad.limit(1).select(F.lit(i).alias("i")) for i, bad in enumerate(violations.values())]
    broken = sorted(r["i"] for r in reduce(DataFrame.unionAll, found).collect())
    if broken:
        raise ConstraintViolation(list(violations)[broken[0]])
