"""Looking at physical plans: what a query shuffles, sorts, broadcasts or hands to Python."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> dict[str, int]:
    """Number of each kind of costly node in the plan."""
    text = physical(df).split("== Initial Plan ==")[0]
    kinds = ("Exchange", "BroadcastExchange", "Sort", "Window", "SortMergeJoin", "BroadcastHashJoin", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow", "ArrowEvalPython", "Generate", "HashAggregate", "ObjectHashAggregate")
    return {k: n for k in kinds if (n := len(re.findall(rf"(?<![A-Za-z]){k}\b", text)))}


def uses_python(df: DataFrame) -> bool:
    return bool(re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMap\w+In", physical(df)))


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans of a plan read."""
    return sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)", physical(df)) for c in m.split(",")})
