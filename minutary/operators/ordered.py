"""Order within groups of any size: numbers, neighbours and running sums without a window over a whole large group.

Groups of at most ``block`` rows take one window. Where a group is larger, the rows are put in order by range once and settled,
numbered exactly from the sizes of the ranges, and cut into blocks of so many rows; what a block needs of its neighbours is sent
there (edge rows, or the sums of the blocks before), so that no task holds more than a range or a block.

``order`` must tell the rows of a group apart: rows that are equal in it are numbered in any order, and stay in one range. Null keys
are one group. The results are the same either way; the check of sizes is one count by key. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..sources import scratch

#: Rows that one window may hold.
BLOCK = 1 << 18
_AT = 1 << 33  # the ids that Spark gives rows: the task above, the place in it below


def large(rows: DataFrame, keys: list[str], block: int = BLOCK) -> bool:
    """Whether a group has more than so many rows."""
    if not keys:
        return rows.limit(block + 1).count() > block
    return not rows.groupBy(*keys).count().filter(F.col("count") > block).isEmpty()


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "place", block: int = BLOCK) -> DataFrame:
    """Adds the row's number, from 1, in its group."""
    if not large(rows, keys, block):
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w).cast("long"))
    return _numbered(rows, keys, order, name)


def _numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    by = [*keys, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.settle(dealt, "ordered")  # ranges are drawn from a sample: what rests on them must be made once
    dealt = dealt.withColumns({"_range": F.floor(F.col("_at") / _AT), "_at": F.col("_at") % _AT})
    starts = dealt.groupBy("_range", *keys).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    # one row for each range of a key: the rows of the key in the ranges before, less the place at which the key begins in this one
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = starts.withColumn("_shift", before - F.col("_from")).select(F.col("_range").alias("_r"), "_shift", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return dealt.join(shift, same).withColumn(name, F.col("_at") + F.col("_shift") + 1).select(*rows.columns, name)


def neighbours(rows: DataFrame, keys: list[str], order: list[Column | str], around: int, made: Callable[[WindowSpec], dict[str, Column]], place: str | None = None, block: int = BLOCK) -> DataFrame:
    """Adds the columns that ``made`` gives over a window of the group in order; they must look no more than ``around`` rows back and ahead.

    ``place`` names a column for the row's number in its group. The edge rows of a block, ``around`` at each end, go to the block
    beside it as well, where they are seen and then left out.
    """
    if not large(rows, keys, block):
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns(made(w) | ({place: F.row_number().over(w).cast("long")} if place else {}))
    block = max(block, around)  # then no row looks past the block beside its own
    out = _numbered(rows, keys, order, "_place")
    at, own = (F.col("_place") - 1) % block, F.floor((F.col("_place") - 1) / block)
    seen = F.array_compact(F.array(own, F.when((at < around) & (own > 0), own - 1), F.when(at >= block - around, own + 1)))
    out = out.withColumns({"_own": own, "_block": F.explode(seen)})
    out = out.withColumns(made(Window.partitionBy(*keys, "_block").orderBy("_place"))).filter(F.col("_own") == F.col("_block"))
    return (out.withColumn(place, F.col("_place")) if place else out).drop("_own", "_block", "_place")


def running(rows: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of a whole-number value over the rows of the group up to this one."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if not large(rows, keys, block):
        return rows.withColumn(name, F.sum(value).over(upto(Window.partitionBy(*keys).orderBy(*order))))
    out = _numbered(rows, keys, order, "_place").withColumns({"_block": F.floor((F.col("_place") - 1) / block), "_value": value})
    sums = out.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))  # one row for each block of a key
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = F.sum("_value").over(upto(Window.partitionBy(*keys, "_block").orderBy("_place")))
    return out.withColumn("_inner", inner).join(sums, same).withColumn(name, F.col("_inner") + F.col("_before")).select(*rows.columns, name)
