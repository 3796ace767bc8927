"""The embedded engine: tables as views, SQL text in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.catalog import Catalog
from lodestar.sources.tables import TABLES, read_table
from lodestar.sql.dialect import by_grammar, by_type
from lodestar.sql.statements import Statements
from lodestar.sql.tokens import Group, grouped, render, split, statements, tokens


def session_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that the engine's semantics and scale assume: UTC, ANSI errors, runtime re-planning."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )


class Engine:
    """One catalog of named tables over a SparkSession, and SQL text on it.

    sql() takes one statement: a query in the engine's dialect, or a statement
    that defines or changes tables, which works on the catalog's snapshots and
    never on the files a table was read from.  execute() takes several.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark)
        self._statements = Statements(self.catalog, self.query)
        self._prepared: dict[str, str] = {}
        self._args: list | dict | None = None
        if sf_dir is not None:
            self.register(sf_dir)

    def register(self, sf_dir: str, names: tuple[str, ...] = TABLES) -> Engine:
        for name in names:
            self.register_rows(name, read_table(self.spark, sf_dir, name))
        return self

    def register_rows(self, name: str, rows: DataFrame) -> Engine:
        """rows under a name; statements may change what the name stands for, not where rows came from."""
        self.catalog.tables.pop(name, None)
        self.catalog.create_table_as(name, rows)
        return self

    def query(self, text: str) -> DataFrame:
        """The rows of a query in the dialect, with the parameters of the statement at hand."""
        args = self._args if any(t.text in ("?", ":") for t in tokens(text)) else None
        run = lambda x: self.spark.sql(x, args=args or None)
        return run(by_type(by_grammar(text), run, self.spark))

    def sql(self, text: str, *params, **named) -> DataFrame:
        """One statement's rows; a statement without rows gives its name."""
        items = grouped(text)
        word = items[0].word if items else ""
        if word == "PREPARE":
            at = next(i for i, x in enumerate(items) if x.word == "AS")
            self.prepare(items[1].name, render(items[at + 1 :]))
        elif word == "EXECUTE":
            given = [x for x in items[2:] if isinstance(x, Group)]
            values = split(given[0].items) if given else split([x for x in items[2:] if x.word != "USING"])
            row = self.query("SELECT " + ", ".join(map(render, values))).first() if values else ()
            return self.execute_prepared(items[1].name, *row)
        elif word == "DEALLOCATE":
            self._prepared.pop([x for x in items[1:] if x.word != "PREPARE"][0].name.lower(), None)
        else:
            self._args = list(params) or named
            try:
                done = self._statements.run(text)
                return done if done is not None else self.query(text)
            finally:
                self._args = None
        return self.spark.createDataFrame([(word,)], "status string")

    def execute(self, text: str) -> DataFrame | None:
        """Statements separated by semicolons; the last one's result."""
        out = None
        for statement in statements(text):
            out = self.sql(statement)
        return out

    def prepare(self, name: str, text: str) -> None:
        self._prepared[name.lower()] = text

    def execute_prepared(self, name: str, *params) -> DataFrame:
        if name.lower() not in self._prepared:
            raise KeyError(f"no prepared statement {name}")
        return self.sql(self._prepared[name.lower()], *params)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)
