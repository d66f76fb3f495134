"""Exact order statistics without a task that holds what it selects from.

A median by two histograms, each of a bounded number of rows, and the first
rows of an order by a sort whose partitions tell how many rows each holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: values in a class of the first histogram
CLASS = 2048


def median_of_steps(df: DataFrame, value: Column, step: float) -> DataFrame:
    """One row with ``median``: of values that are whole numbers of ``step``s; null without any. Null values don't
    count, nor do NaN and infinite ones.

    The first histogram counts classes of CLASS steps and names those that
    hold the middle ranks; the second counts the steps of these alone. Rows
    that meet in one task are a class or a step each, never a value."""
    steps = df.select(F.round(value / F.lit(step)).try_cast("long").alias("k")).filter(F.col("k").isNotNull())
    steps = steps.withColumn("class", F.floor(F.col("k") / F.lit(CLASS)))
    everything = Window.orderBy("class")
    classes = (steps.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
               .select("class", "n", (F.sum("n").over(everything) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")))
    # the two middle ranks, counted from 0; equal for an odd number
    ranks = F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
    wanted = (classes.select("class", "n", "before", F.posexplode(ranks).alias("which", "rank"))
              .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
              .select("class", "which", (F.col("rank") - F.col("before")).alias("rank")))
    cells = (steps.join(F.broadcast(wanted.select("class").distinct()), "class").groupBy("class", "k").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("k")) - F.col("n")))
    found = cells.join(F.broadcast(wanted), "class").filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    return found.agg(F.avg(F.col("k") * F.lit(step)).alias("median"))


def write_first(df: DataFrame, order: list[Column], limit: int, path: str) -> DataFrame:
    """The first ``limit`` rows of ``df`` by ``order``, written below ``path``.

    The rows are sorted over all tasks and written with their places; a
    partition's number of rows tells how many stand before the next one, so
    each row knows its rank, and no task holds more than its range of the
    order, however many rows are equal in its first column."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    spark = df.sparkSession
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(f"{path}/sorted")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/sorted")
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
             .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)
    first = placed.withColumn("_part", part).join(F.broadcast(parts), "_part").filter(rank < limit).drop("_part", "_before", "_place")
    first.write.parquet(f"{path}/first")
    return spark.read.schema(first.schema).parquet(f"{path}/first")
