"""Running sums and neighbours over a whole table without a task that sees all of it, or all of a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.sources.checkpoints import cut


def with_sum_before(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows and the sum of value over all rows before each, by order; ties in any order.

    Rows are dealt to ranges and written once; sums of ranges, one row for each, give where a range starts.
    """
    ranged = rows.withColumn("_v", value).repartitionByRange(*order)
    placed = cut(ranged.withColumn("_range", F.spark_partition_id()))
    starts = placed.groupBy("_range").agg(F.sum("_v").alias("_s"))
    starts = starts.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_start"))
    own = F.sum("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_v")
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_v", "_own", "_start")


def with_neighbours(rows: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with before and after: structs of values of the rows before and after in the group `by`; null at its ends.

    Rows are dealt to ranges of (by, *order) and written once, so that no window sees a whole group. The first and the
    last row of each range, one row a range, are handed to the ranges beside it.
    """
    place = F.struct(by, *order)
    ranged = rows.withColumn("_own", F.struct(F.col(by).alias("_by"), *values)).repartitionByRange(by, *order)
    placed = cut(ranged.withColumn("_range", F.spark_partition_id()))
    every = Window.orderBy("_range")
    ends = placed.groupBy("_range").agg(F.min_by("_own", place).alias("_first"), F.max_by("_own", place).alias("_last"))
    ends = ends.select("_range", F.lag("_last").over(every).alias("_earlier"), F.lead("_first").over(every).alias("_later"))
    w = Window.partitionBy("_range").orderBy(by, *order)
    near = placed.withColumns({"before": F.lag("_own").over(w), "after": F.lead("_own").over(w)}).join(F.broadcast(ends), "_range")
    same = lambda x: F.when(x["_by"].eqNullSafe(F.col(by)), F.struct(*[x[v].alias(v) for v in values]))
    found = {"before": same(F.coalesce("before", "_earlier")), "after": same(F.coalesce("after", "_later"))}
    return near.withColumns(found).drop("_own", "_range", "_earlier", "_later")
