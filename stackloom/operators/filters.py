"""View filters and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.expressions import passes


def view_filter(df: DataFrame, expression: Column | str) -> DataFrame:
    """Rows where the expression is NULL or not 0."""
    return df.where(passes(F.expr(expression) if isinstance(expression, str) else expression))


def keep_selected(df: DataFrame, selected: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among the keys of selected result rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(selected.select(*keys).distinct(), keys, "left_semi")


def drop_null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())
