"""Sorting, limits and unions of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_result(table: DataFrame, metric: str, key: str = "function", total: object = "<Total>", reverse: bool = False, first_seen: str | None = None) -> DataFrame:
    """Numbers fall, names rise, reverse flips both; the total comes first, in
    reverse last. Ties keep the order in which rows were first seen, or that of
    their keys."""
    falls = (dict(table.dtypes)[metric] != "string") != reverse
    pin = F.when(F.col(key) == F.lit(total), 0).otherwise(1)
    return table.orderBy(pin.desc() if reverse else pin, F.col(metric).desc() if falls else F.col(metric).asc(), F.col(first_seen or key))


def sort_events(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By at most ten columns, absent ones left out, then by row number."""
    return df.orderBy(*[c for c in list(columns)[:10] if c in df.columns], "row_id")


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; all for 0."""
    return df.limit(n) if n else df


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
