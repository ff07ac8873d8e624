"""Row-level access and metadata filters. Filters come before every top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(df: DataFrame, allowed: list[str] | None, client: str = "client") -> DataFrame:
    """None: everything; a list: rows of those clients (a null client is nobody's); an empty list: nothing."""
    if allowed is None:
        return df
    return df.filter(F.col(client).isin(allowed)) if allowed else df.filter(F.lit(False))


def matching(**wanted: str | None) -> Column:
    """Equality with every value that is given; empty ones don't filter."""
    given = [F.col(c) == v for c, v in wanted.items() if v]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def contains_item(column: str, value: str) -> Column:
    return F.array_contains(column, value)


def excluding(df: DataFrame, column: str, ids: list[int]) -> DataFrame:
    return df.filter(~F.col(column).isin(ids)) if ids else df


def library_search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def users_with_clients(users: DataFrame, grants: DataFrame) -> DataFrame:
    """users with the sorted list of their clients, empty where they have none."""
    return users.join(grants, "user_id", "left").groupBy("user_id").agg(F.sort_array(F.collect_list("client")).alias("clients"))


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now).join(users, "user_id")
