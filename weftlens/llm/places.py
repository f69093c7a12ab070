"""Places of rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import beside, fresh, written

#: spark's monotonically increasing ids hold the partition above so many bits.
PARTITION_BITS = 33


def numbered(table: DataFrame, group: list[str], order: list[str | Column], place: str = "place", of: str = "of") -> DataFrame:
    """The rows of table with their place from 0 inside their group, and how many rows the group has.

    Rows are sorted into ranges of (group, order), so a group of any size falls to several tasks; a range's count of a group, added to
    those of the ranges before it, gives the places.  Columns of group hold no nulls.  Rows that are equal in group and order take their
    places in the order of the written table.
    """
    row, at, part, first, held, before = (fresh(table.columns, f"_{c}") for c in ("row", "at", "part", "first", "held", "before"))
    keys = [*group, *order, row]
    fixed = written(table.withColumn(row, F.monotonically_increasing_id()))
    ranged = fixed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(row).withColumn(at, F.monotonically_increasing_id())
    ranged = written(ranged.withColumn(part, F.shiftright(at, PARTITION_BITS)))
    runs = ranged.groupBy(part, *group).agg(F.count("*").alias(held), F.min(at).alias(first))
    inside = Window.partitionBy(*group)
    runs = runs.withColumn(before, F.coalesce(F.sum(held).over(inside.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn(of, F.sum(held).over(inside)).drop(held)
    out = ranged.join(beside(written(runs)), [part, *group])
    return out.withColumn(place, F.col(at) - F.col(first) + F.col(before)).drop(at, part, first, before)
