"""Operators over call stacks.

A stack is an array from root to leaf. Samples with equal stacks are summed
before a stack is taken apart, so that what follows is as large as the number
of distinct stacks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.operators.ranges import running
from stackloom.tables import stored

TOTAL = "<Total>"


def by_stack(df: DataFrame, weight: str, keys: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """(keys, stack, w[, first]): weight and first order of equal stacks."""
    first = [F.min(order).alias("first")] if order else []
    return df.groupBy(*keys, "stack").agg(F.sum(weight).alias("w"), *first)


def _path(total: object) -> Column:
    return F.concat(F.array(F.lit(total)), F.col("stack"))


def function_totals(df: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, function, excl, incl): a sample counts once for each function in
    its stack, and as exclusive for its leaf."""
    rows = by_stack(df, weight, keys)
    leaf = F.element_at("stack", -1).alias("__leaf")
    each = rows.where(F.size("stack") > 0).select(*keys, "w", leaf, F.explode(F.array_distinct("stack")).alias("function"))
    return each.groupBy(*keys, "function").agg(F.sum(F.when(F.col("function") == F.col("__leaf"), F.col("w")).otherwise(0)).alias("excl"), F.sum("w").alias("incl"))


def grand_total(df: DataFrame, weight: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total"))


def function_table(df: DataFrame, weight: str, total: str = TOTAL) -> DataFrame:
    """function_totals and a row for the total, exclusive equal to inclusive."""
    whole = grand_total(df, weight).select(F.lit(total).alias("function"), F.col("total").alias("excl"), F.col("total").alias("incl"))
    return whole.unionByName(function_totals(df, weight))


def _matched(df: DataFrame, chain: Sequence, weight: str, total: object) -> DataFrame:
    """(path, w, ms): ms are the depths, from 0, at which the chain ends."""
    k = len(chain)
    rows = by_stack(df, weight).select("w", _path(total).alias("path"))
    wanted = F.array(*map(F.lit, chain))
    depths = F.when(F.size("path") >= k, F.sequence(F.lit(k - 1), F.size("path") - 1)).otherwise(F.array().cast("array<int>"))
    ms = F.filter(depths, lambda d: F.slice(F.col("path"), d - k + 2, F.lit(k)) == wanted)
    return rows.withColumn("ms", ms).where(F.size("ms") > 0)


def callers(df: DataFrame, chain: Sequence, weight: str, total: object = TOTAL) -> DataFrame:
    """(neighbour, attributed): who calls the chain. The weight of a sample
    goes to the caller of the innermost match; outer ones get a row with 0."""
    k = len(chain)
    each = _matched(df, chain, weight, total).select("path", "w", F.array_max("ms").alias("last"), F.explode("ms").alias("d")).where(F.col("d") >= k)
    return each.groupBy(F.element_at("path", F.col("d") - k + 1).alias("neighbour")).agg(F.sum(F.when(F.col("d") == F.col("last"), F.col("w")).otherwise(0)).alias("attributed"))


def callees(df: DataFrame, chain: Sequence, weight: str, total: object = TOTAL) -> DataFrame:
    """(neighbour, attributed): whom the chain calls."""
    each = _matched(df, chain, weight, total).select("path", "w", F.array_max("ms").alias("last"), F.explode("ms").alias("d")).where(F.col("d") + 1 < F.size("path"))
    return each.groupBy(F.element_at("path", F.col("d") + 2).alias("neighbour")).agg(F.sum(F.when(F.col("d") == F.col("last"), F.col("w")).otherwise(0)).alias("attributed"))


def self_values(df: DataFrame, chain: Sequence, weight: str, total: object = TOTAL) -> DataFrame:
    """(attributed, excl, incl) of a function or chain: exclusive where it ends
    at the leaf, inclusive once for each sample that holds it; attributed is
    exclusive, but for the total itself inclusive."""
    hit = _matched(df, chain, weight, total)
    at_leaf = F.array_max("ms") == F.size("path") - 1
    sums = hit.agg(F.coalesce(F.sum(F.when(at_leaf, F.col("w")).otherwise(0)), F.lit(0)).alias("excl"), F.coalesce(F.sum("w"), F.lit(0)).alias("incl"))
    return sums.select(F.col("incl" if list(chain) == [total] else "excl").alias("attributed"), "excl", "incl")


def caller_callee_report(df: DataFrame, weight: str, total: object = TOTAL) -> DataFrame:
    """(center, role, neighbour, attributed) for all functions at once; roles
    are caller, self and callee."""
    rows = by_stack(df, weight).select("w", _path(total).alias("path"))
    each = rows.select("path", "w", F.posexplode("path").alias("d", "center"))
    last = ~F.array_contains(F.slice("path", F.col("d") + 2, F.size("path")), F.col("center"))
    w = F.when(last, F.col("w")).otherwise(0)
    at_leaf = F.when(F.col("d") == F.size("path") - 1, F.col("w")).otherwise(0)
    around = F.array(
        F.struct(F.lit("caller").alias("role"), F.when(F.col("d") > 0, F.element_at("path", F.greatest(F.col("d"), F.lit(1)))).alias("neighbour"), w.alias("v")),
        F.struct(F.lit("callee").alias("role"), F.get("path", F.col("d") + 1).alias("neighbour"), w.alias("v")),
        F.struct(F.lit("self").alias("role"), F.col("center").alias("neighbour"), at_leaf.alias("v")),
    )
    rows = each.select("center", F.inline(around)).where(F.col("neighbour").isNotNull())
    return rows.groupBy("center", "role", "neighbour").agg(F.sum("v").alias("attributed"))


def _prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """(row, w[, first], size, d, function, a, b, pa, pb): a row for each prefix
    of each stack, of d functions; a, b are its hash of 128 bits, pa, pb that of
    the prefix before. A prefix's hash is the one before it combined with its last
    function and depth, so a stack costs as many rows as it is deep."""
    each = rows.repartition("row").select(*[c for c in rows.columns if c != "stack"], F.size("stack").alias("size"), F.posexplode(F.concat(F.array(F.lit(None)), "stack")).alias("d", "function"))
    own = lambda k: F.when(F.col("d") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(seed + k), "d", F.col("function").isNull(), "function"))
    upto = Window.partitionBy("row").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("x", own(0)).withColumn("y", own(1)).withColumn("a", F.bit_xor("x").over(upto)).withColumn("b", F.bit_xor("y").over(upto))
    return each.withColumn("pa", F.col("a").bitwiseXOR(F.col("x"))).withColumn("pb", F.col("b").bitwiseXOR(F.col("y"))).drop("x", "y")


def _nodes(each: DataFrame, order: bool) -> DataFrame:
    """(a, b, pa, pb, level, function, row, incl, excl[, first]): prefixes summed
    up. Where two prefixes had one hash, that hash would have two parents, levels
    or functions, which is an error: take another seed."""
    same = lambda c: F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))
    # a parent of one hash is one node, down from the root, so a hash is a node if its parent and function are one
    sound = same("pa") & same("pb") & same("d") & same("function")
    leaf = F.col("d") == F.col("size")
    nodes = each.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("d").alias("level"), F.min("function").alias("function"), F.min("row").alias("row"),
        F.sum("w").alias("incl"), F.sum(F.when(leaf, F.col("w")).otherwise(0)).alias("excl"), *([F.min("first").alias("first")] if order else []), sound.alias("sound"),
    )
    kept = F.when(F.col("sound"), F.col("incl")).otherwise(F.raise_error(F.lit("two paths have one hash: take another seed")))
    return nodes.withColumn("incl", kept).drop("sound")


def _numbered(df: DataFrame, weight: str, order: str | None) -> DataFrame:
    # stored with their numbers, which then stay
    return stored(by_stack(df, weight, order=order).withColumn("row", F.monotonically_increasing_id()), "stacks")


def path_trie(df: DataFrame, weight: str, order: str | None = None, seed: int = 0) -> DataFrame:
    """(a, b, pa, pb, level, function, incl, excl[, first]): the nodes of the
    path tree under hashes of 128 bits, with those of their parents; the root is
    0, 0 on level 0. A stack of n functions costs n rows."""
    return _nodes(_prefixes(_numbered(df, weight, order), seed), bool(order)).drop("row")


def path_tree(df: DataFrame, weight: str, order: str | None = None, seed: int = 0) -> DataFrame:
    """(path, level, incl, excl[, first]): every prefix of every stack, the
    empty one, the root, included. Paths are written out at the end, each once."""
    rows = _numbered(df, weight, order)
    nodes = _nodes(_prefixes(rows, seed), bool(order))
    told = nodes.join(rows.select("row", "stack"), "row")
    return told.select(F.slice("stack", F.lit(1), F.col("level")).alias("path"), "level", "incl", "excl", *(["first"] if order else []))


def flame_levels(df: DataFrame, weight: str, order: str, total: object = TOTAL, seed: int = 0) -> DataFrame:
    """(idx, parent_idx, level, function, value): nodes of the path tree in
    breadth-first order, children in the order in which they were first seen.
    The root is 1 on level 0, its parent 0.

    Stacks are sorted by when their prefixes were first seen, one after the other.
    Those whose prefixes of some depth were seen alike then stand together, so the first
    place among them puts the nodes of a level in order; nodes that tie
    (where rows share a number of the order) go by their paths, which only they need."""
    rows = _numbered(df, weight, order)
    each = stored(_prefixes(rows, seed), "prefixes")
    nodes = _nodes(each, True)
    seen = each.where("d > 0").select("row", "a", "b", "d").join(nodes.select("a", "b", F.col("first").alias("__first")), ["a", "b"])
    upto = Window.partitionBy("row").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    alike = [F.bit_xor(F.xxhash64(F.lit(seed + k), "d", "__first")).over(upto).alias(n) for k, n in enumerate(("__fa", "__fb"))]
    seen = stored(seen.select("row", "a", "b", "d", "__first", *alike), "seen")
    keyed = seen.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "__first"))), lambda s: s["__first"]).alias("__key"))
    places = running(keyed, [], ["__key", "row"], {"__place": F.lit(1).cast("long")}).select("row", "__place")
    first = seen.select("row", "a", "b", "__fa", "__fb").join(places, "row").groupBy("a", "b").agg(F.min("__fa").alias("__fa"), F.min("__fb").alias("__fb"), F.min("__place").alias("__place"))
    groups = first.groupBy("__fa", "__fb").agg(F.min("__place").alias("__group"), (F.count("*") > 1).alias("__tied"))
    placed = nodes.join(first.drop("__place").join(groups, ["__fa", "__fb"]), ["a", "b"], "left")
    told = rows.select(F.col("row").alias("__row"), "stack")
    path = F.slice("stack", F.lit(1), F.col("level")).alias("__path")
    placed = placed.join(told, (F.col("row") == F.col("__row")) & F.col("__tied"), "left").select("a", "b", "pa", "pb", "level", "function", "incl", F.coalesce("__group", F.lit(0)).alias("__group"), path)
    numbered = running(placed, [], ["level", "__group", "__path"], {"idx": F.lit(1).cast("long")})
    parents = numbered.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("level") + 1).alias("level"), F.col("idx").alias("parent_idx"))
    out = numbered.join(parents, ["pa", "pb", "level"], "left")
    return out.select("idx", F.coalesce("parent_idx", F.lit(0)).alias("parent_idx"), "level", F.when(F.col("level") > 0, F.col("function")).otherwise(F.lit(total)).alias("function"), F.col("incl").alias("value"))


def flame_children(levels: DataFrame, nodes: Sequence[int]) -> DataFrame:
    """The children of nodes; 0 has the root for its child."""
    return levels.where(F.col("parent_idx").isin(list(nodes)))


def tree_depth(df: DataFrame) -> DataFrame:
    """Levels of the path tree, the root's included."""
    return df.agg((F.coalesce(F.max(F.size("stack")), F.lit(0)) + 1).alias("depth"))


def functions_in_levels(levels: DataFrame, low: int, high: int) -> DataFrame:
    """(idx, function): one row for each node on levels low to high."""
    return levels.where(F.col("level").between(low, high)).select("idx", "function")


def distinct_functions(df: DataFrame, order: str, total: object = TOTAL) -> DataFrame:
    """(function, first): functions with the first row and depth they were seen
    at; ordering by it gives first-seen order."""
    rows = df.groupBy("stack").agg(F.min(order).alias("__ord"))
    each = rows.select("__ord", F.posexplode(_path(total)).alias("__d", "function"))
    return each.groupBy("function").agg(F.min(F.struct(F.col("__ord").alias("ord"), F.col("__d").alias("depth"))).alias("first"))
