"""Plans as text and as facts that tests can assert."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN: the physical plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def operators(df: DataFrame) -> list[str]:
    """Names of the plan's operators, top first."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+\-|*()\d]*([A-Z]\w+)", text, re.M)


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", explain(df))
