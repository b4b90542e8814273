"""Ordered computations over groups of any size: each group is cut into blocks of its order, blocks are summed up on their own,
and a prefix over the blocks (one small row each) gives what every block starts from. No task ever holds a group.

A block is given as a column that never falls along the order (a time block), or, without one, is a range of Spark's range
partitioner over group and order; that cuts groups of equal times as well, by the later columns of the order, and is written once so
that all passes see the same blocks. A null group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Columns that the passes add: the group, the block, the place in the block.
G, B, I = "_group", "_block", "_at"  # noqa: E741


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with its group as one struct and its block. ``ranges`` sets a number in place of the size that Spark chooses."""
    grouped = df.withColumn(G, F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("all")))
    if block is not None:
        return grouped.withColumn(B, block)
    return materialise(grouped.repartitionByRange(*([ranges] if ranges else []), *[F.col(c) for c in by], *[F.col(c) for c in order]).withColumn(B, F.spark_partition_id()), "ranges")


def within(order: Sequence[str]):
    return Window.partitionBy(G, B).orderBy(*[F.col(c) for c in order])


def _earlier():
    return Window.partitionBy(G).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(placed: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over a group's rows up to each row. The blocks' sums are made where their rows are read."""
    totals = placed.groupBy(G, B).agg(F.sum(value).alias("_total"))
    before = totals.select(G, B, F.coalesce(F.sum("_total").over(_earlier()), F.lit(0)).alias("_before"))
    local = placed.withColumn(out, F.sum(value).over(within(order).rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(before, [G, B]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def numbered(placed: DataFrame, order: Sequence[str], out: str, base: int = 0) -> DataFrame:
    """Gap-free numbers from ``base`` + 1 within each group."""
    return running_sum(placed, order, F.lit(1).cast("long"), "_number").withColumn(out, F.col("_number") + F.lit(base).cast("long")).drop("_number")


def carried(summaries: DataFrame, start: str, step: Column, kind: str, out: str) -> DataFrame:
    """A state handed from block to block of each group, folded over one row a block: ``step`` makes the next state of
    ``state`` and ``block`` (a struct of the block's columns). ``out`` is the state that a block starts from; ``start`` is the
    first one, as SQL of type ``kind``. The rows of one group are as many as its blocks."""
    rest = [c for c in summaries.columns if c != G]
    ordered = summaries.groupBy(G).agg(F.array_sort(F.collect_list(F.struct(B, *[c for c in rest if c != B]))).alias("_all"))
    first = F.struct(F.expr(start).cast(kind).alias("state"), F.array().cast(f"array<struct<b:{dict(summaries.dtypes)[B]},s:{kind}>>").alias("made"))
    fold = F.aggregate(
        "_all", first, lambda a, x: F.struct(step(a["state"], x).cast(kind).alias("state"), F.concat(a["made"], F.array(F.struct(x[B].alias("b"), a["state"].alias("s")))).alias("made")), lambda a: a["made"]
    )
    return ordered.select(G, F.explode(fold).alias("m")).select(G, F.col("m.b").alias(B), F.col("m.s").alias(out))
