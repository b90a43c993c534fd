"""Running values over a whole order, without one task for all of it or for a key.

Rows are dealt by ranges of their keys and order, so that a key with many rows lies in
many ranges. Each range is worked through by itself, and what the ranges before
hold of its first key is added: of the pairs of a key and a range that the key
comes into from the one before there is at most one for each range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.tables import stored


@dataclass(frozen=True)
class Over:
    """A value of the rows up to one: the ``total`` or ``least`` of an expression,
    or the ``latest`` that isn't null. With before, the row itself is left out.
    ``next`` is the value of the one row after it."""

    how: str
    value: Column
    before: bool = False

    def whole(self, v: str, order: Sequence[str]) -> Column:
        """Of all rows of a group."""
        if self.how == "total":
            return F.sum(v)
        if self.how == "next":
            return F.min_by(F.struct(F.col(v).alias("x")), F.struct(*order))
        return F.min(v) if self.how == "least" else F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order)))

    def running(self, v: Column, over: Window) -> Column:
        return {"total": F.sum, "least": F.min}[self.how](v).over(over) if self.how != "latest" else F.last(v, ignorenulls=True).over(over)

    def carried(self, v: Column, by: Window) -> Column:
        """What a range is given by those before it, or by the one after it."""
        return F.lead(v).over(by) if self.how == "next" else self.running(v, by.rowsBetween(Window.unboundedPreceding, -1))

    def inside(self, v: str, by: Window) -> Column:
        """What the rows of its own range give a row."""
        return F.lead(F.struct(F.col(v).alias("x"))).over(by) if self.how == "next" else self.running(F.col(v), by.rowsBetween(Window.unboundedPreceding, -1 if self.before else 0))

    def joined(self, inside: Column, carried: Column) -> Column:
        """What is so far in the range, and what came before it."""
        if self.how == "total":
            return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if self.how == "next":
            return F.coalesce(inside, carried).getField("x")
        return F.least(inside, carried) if self.how == "least" else F.coalesce(inside, carried)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], made: Mapping[str, Over], ranges: str | None = None) -> DataFrame:
    """df with the values in made, over the rows of the same keys (null is a key
    like any other) in order, which must tell rows apart but for ``latest`` and
    ``least``. ranges: a column that already numbers ranges of that order."""
    named = {f"__v{i}": over.value for i, over in enumerate(made.values())}
    rows = df.withColumns(named)
    rows = rows.withColumn("__range", F.col(ranges)) if ranges else rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    rows = stored(rows, "ranges")
    by = Window.partitionBy(*keys).orderBy("__range")
    parts = rows.groupBy(*keys, "__range").agg(*[over.whole(v, order).alias(v) for v, over in zip(named, made.values(), strict=True)])
    carried = [over.carried(F.col(v), by).alias(f"{v}_before") for v, over in zip(named, made.values(), strict=True)]
    parts = parts.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"), *carried)
    # keys of several ranges: a range can only be entered by one key from the range before it, and left by one
    parts = parts.where("__n > 1").drop("__n")
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    rows = rows.withColumns({f"{v}_inside": over.inside(v, inside) for v, over in zip(named, made.values(), strict=True)})
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    both = rows.join(F.broadcast(parts), same, "left")  # two rows for each range at most
    values = [over.joined(F.col(f"{v}_inside"), F.col(f"{v}_before")).alias(name) for (name, over), v in zip(made.items(), named, strict=True)]
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *values)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds to each row, for each name in sums, the sum of its expression over
    the rows of the same keys up to this one. The order must tell rows apart."""
    return scan(df, keys, order, {name: Over("total", value) for name, value in sums.items()})
