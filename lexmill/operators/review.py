"""Structured reviews: merging the clauses of windows, pivoting contracts, quote gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing


def merge_clauses(rows: DataFrame) -> DataFrame:
    """contract, name, value: of each clause's values in windows the first that says something, else the first."""
    order = F.struct(is_missing(F.col("value")).cast("int"), "window", "value")
    return rows.groupBy("contract", "name").agg(F.min_by("value", order).alias("value"), F.min_by("window", order).alias("window"))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the distinct values in the order of their first occurrence."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def clause_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row a contract, one column a name: the last value of each; empty where there is none."""
    wide = rows.groupBy("contract").pivot("name", names).agg(F.max_by("value", F.struct("window", "value")))
    return wide.select("contract", *(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))
