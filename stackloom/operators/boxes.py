"""Joins of points with intervals in several dimensions at once.

In each dimension one side has a point and the other an interval. An interval is
entered on the level of buckets on which it touches fewer than ``FANOUT``; levels
are ``FANOUT`` times as wide one as the other, so that short and long intervals
find theirs at any scale. A row is entered in the product of its buckets, and the other side asks
the bucket of its point on each combination of levels that is in use. A pair that
meets does so in one bucket of each dimension, so no pair comes out twice. With a
second dimension intervals that share their place in the first, such as the
lives of one address, are told apart by the join itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 8
#: Widths of the levels; on the last, any two longs are less than FANOUT buckets apart.
_WIDTHS = [FANOUT**i for i in range(21)] + [2**62]


def _bucket(at: Column, width: Column) -> Column:
    """Floor of at / width."""
    return F.call_function("div", at - F.pmod(at, width), width)


def _level(low: Column, last: Column) -> Column:
    """The first level, from 0, on which low and last are fewer than FANOUT buckets apart."""
    # a level has 3 bits more than the one before; where low and last are further apart than a long goes, the last one serves
    bits = F.length(F.bin(F.try_subtract(last, low)))
    first = F.coalesce(F.call_function("div", bits - 1, F.lit(3)).cast("int"), F.lit(len(_WIDTHS) - 1))
    width = _width(first)
    return F.when(_bucket(last, width) - _bucket(low, width) < FANOUT, first).otherwise(first + 1)


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("bigint") for w in _WIDTHS]), level + 1)


def box_join(left: DataFrame, right: DataFrame, dims: Sequence[tuple[str, str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Inner join of the rows with equal keys and, for each (at, low, high) of
    dims, low <= at < high. at is a column of one side, low and high (NULL for no end)
    of the other. All are longs; columns other than the keys must differ."""
    forever = F.lit(2**63 - 1).cast("bigint")
    sides, holds = [left, right], ([], [])  # the dimensions of which a side has the intervals
    for n, (at, low, high) in enumerate(dims):
        mine = 1 if at in left.columns else 0
        holds[mine].append(n)
        last = (F.coalesce(F.col(high), forever) - 1).cast("bigint")
        sides[1 - mine] = sides[1 - mine].where(F.col(at).isNotNull())
        sides[mine] = sides[mine].where(F.col(low) <= last).withColumn(f"__level{n}", _level(F.col(low), last))
    # combinations of levels, at most (levels) ** dims, of a few rows here
    used = [[tuple(r) for r in side.select(*[f"__level{n}" for n in mine]).distinct().collect()] if mine else [] for side, mine in zip(sides, holds, strict=True)]
    for i, (side, mine) in enumerate(zip(sides, holds, strict=True)):
        if mine:  # a small file of many intervals is one task, which would make all their entries
            side = side.repartition(*keys, *[c for n in mine for c in dims[n][1:]])
        for n in mine:  # enters its own intervals
            _, low, high = dims[n]
            width = _width(F.col(f"__level{n}"))
            last = F.coalesce(F.col(high), forever) - 1
            side = side.withColumn(f"__bucket{n}", F.explode(F.sequence(_bucket(F.col(low), width), _bucket(last, width))))
        if holds[1 - i]:  # asks the buckets of its points on the levels of the other
            asked = [F.struct(*[c for n, level in zip(holds[1 - i], levels, strict=True) for c in (F.lit(level).alias(f"__level{n}"), _bucket(F.col(dims[n][0]), F.lit(_WIDTHS[level]).cast("bigint")).alias(f"__bucket{n}"))]) for levels in used[1 - i]]
            none = F.struct(*[c for n in holds[1 - i] for c in (F.lit(None).cast("int").alias(f"__level{n}"), F.lit(None).cast("bigint").alias(f"__bucket{n}"))])
            side = side.select("*", F.inline(F.array(*(asked or [none]))))
        sides[i] = side
    places = [f"__{what}{n}" for n in range(len(dims)) for what in ("level", "bucket")]
    # a row stands for all its buckets here, but Spark would take the side for as small as the table that it comes
    # from, and broadcast it: both sides are shuffled, whatever their size
    met = sides[0].hint("shuffle_merge").join(sides[1], [*keys, *places])
    for at, low, high in dims:
        met = met.where((F.col(low) <= F.col(at)) & (F.col(at) < F.coalesce(F.col(high), forever)))
    return met.drop(*places)
