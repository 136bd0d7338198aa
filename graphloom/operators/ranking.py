"""Exact row numbers without pushing a whole group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.session import cut_lineage


# rows one task numbers at a time, at most
SLICE = 1 << 21


def over_earlier(rows: DataFrame, groups: list[str], order: str, value: str, agg, out: str, width: int) -> DataFrame:
    """``agg`` (``F.sum`` or ``F.max``) of ``value`` over the earlier rows of the group, null for the first.

    Earlier blocks of ``width`` order values are combined first, then the rows of
    the own block, so a task sees one block or one row per block.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / width))
    totals = blocked.groupBy(*groups, "_block").agg(agg(value).alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*groups, "_block", agg("_total").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*groups, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = F.array_compact(F.array("_carried", "_own"))
    combined = F.when(F.size(both) == 2, F.col("_carried") + F.col("_own")) if agg is F.sum else F.array_max(both)
    return (
        blocked.join(carried, [*groups, "_block"])
        .withColumn("_own", agg(value).over(inside))
        .withColumn(out, F.coalesce(combined, F.get(both, F.lit(0))))
        .drop("_block", "_carried", "_own")
    )


def running_index(df: DataFrame, groups: list[str], order: str, out: str, width: int = SLICE) -> DataFrame:
    """0-based position of every row in its group, ordered by an integer column.

    The integer range is cut into slices of ``width`` values. A slice is numbered
    on its own, and the sizes of the earlier slices are added, so a group that
    holds a third of the table still spreads over many tasks. ``order`` must be
    unique within a group, which bounds a slice by ``width`` rows.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    sizes = sliced.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    offsets = over_earlier(sizes, groups, "_slice", "_n", F.sum, "_offset", width).drop("_n")
    inside = Window.partitionBy(*groups, "_slice").orderBy(order)
    return (
        sliced.join(offsets, [*groups, "_slice"])
        .withColumn(out, F.coalesce("_offset", F.lit(0)) + F.row_number().over(inside) - 1)
        .drop("_slice", "_offset")
    )


def previous_value(df: DataFrame, groups: list[str], order: str, out: str, width: int = SLICE) -> DataFrame:
    """The next smaller value of an integer column in the group, null for the first; sliced as above."""
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    tops = sliced.groupBy(*groups, "_slice").agg(F.max(order).alias("_top"))
    links = over_earlier(tops, groups, "_slice", "_top", F.max, "_last", width).drop("_top")
    inside = Window.partitionBy(*groups, "_slice").orderBy(order)
    return (
        sliced.join(links, [*groups, "_slice"])
        .withColumn(out, F.coalesce(F.lag(order).over(inside), F.col("_last")))
        .drop("_slice", "_last")
    )


def sorted_index(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """0-based position in a global sort by any columns.

    Rows are range-partitioned and written once, so the second pass sees the same
    partitions; only one row count per partition is accumulated.
    """
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    # one row per partition of the sort: bounded by the partition count
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_part", "_offset")
    )
