"""Places and running sums over a whole order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def dealt(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows dealt to ranges of the order, written once with the number of their range in ``_part``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *order)
    return store.saved(ranges.withColumn("_part", F.spark_partition_id()), name)


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the sum of each column over all rows up to and with a row, in the order.

    ``rows`` come from ``dealt`` under the same order.  A row's sum is that of its range up to it
    and those of the ranges before, which are a row a range.
    """
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as ranges
    starts = totals.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(starts), "_part")
    return out.withColumns({n: (F.col(n) + F.col(f"_{n}")).cast("long") for n in sums}).drop(*(f"_{n}" for n in sums))


def places(rows: DataFrame, by: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the place of a row among those of its key, where a key may hold most rows.

    ``part`` cuts a key's order into slices of bounded number; rows are counted by slice, and sorted within one only.
    """
    cut = rows.withColumn("_slice", part)
    counts = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    placed = cut.withColumn("_in", F.row_number().over(inside)).join(starts, [*by, "_slice"])
    return placed.withColumn(name, F.col("_before") + F.col("_in")).drop("_slice", "_in", "_before")
