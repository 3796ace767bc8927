"""How the query modules register."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.session import Engine
from lodestar.sources.tables import TABLES, dealt, read_table


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None, deal: tuple[str, ...] = ()) -> None:
        """A query in Spark SQL; oracle: the same in DuckDB's, if the text differs; deal: tables whose rows a join multiplies."""

        used = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = Engine(spark).register(sf_dir, used)
            for t in deal:
                engine.register_rows(t, dealt(read_table(spark, sf_dir, t)))
            return engine.sql(text)

        run.__name__ = name
        self.queries[name] = run
        self.oracles[name] = oracle or text

    def frame(self, name: str, oracle: str):
        """A query in DataFrame operations; the function takes a reader of tables by name."""

        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda table: read_table(spark, sf_dir, table))

            run.__name__ = name
            self.queries[name] = run
            self.oracles[name] = oracle
            return f

        return add
