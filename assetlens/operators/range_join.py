"""Range joins by buckets: an equi-join on exploded cells with the exact predicate behind it. Rows in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import written

#: Rows of a block of an order.
BLOCK = 4096


def cells(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def within_1d(a: DataFrame, b: DataFrame, value_a: str, value_b: str, width: float, condition: Column) -> DataFrame:
    """Pairs of a and b whose values lie within width; condition is the exact predicate over both sides.

    b is copied to its own cell and the two beside it, a stays in its own: each pair meets once. A plain range
    condition would be a nested-loop join.
    """
    left = a.withColumn("_cell", cells(F.col(value_a), width))
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cells(F.col(value_b), width) + d))
    right = b.withColumn("_cell2", near)
    return left.join(right, (F.col("_cell") == F.col("_cell2")) & condition).drop("_cell", "_cell2")


def within_2d(a: DataFrame, b: DataFrame, xy_a: tuple[str, str], xy_b: tuple[str, str], width: float, condition: Column) -> DataFrame:
    """The same for a box: b is copied to the nine cells around it."""
    left = a.withColumn("_cx", cells(F.col(xy_a[0]), width)).withColumn("_cy", cells(F.col(xy_a[1]), width))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.withColumn("_d", F.explode(around))
    right = right.withColumn("_cx2", cells(F.col(xy_b[0]), width) + F.col("_d.i")).withColumn("_cy2", cells(F.col(xy_b[1]), width) + F.col("_d.j")).drop("_d")
    met = (F.col("_cx") == F.col("_cx2")) & (F.col("_cy") == F.col("_cy2")) & condition
    return left.join(right, met).drop("_cx", "_cy", "_cx2", "_cy2")


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """df with _index, its rows' places in the order of `by`, from 0: places within range partitions, plus the sizes of
    those before. One row per partition is all that one task holds."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_begin"))
    parts = parts.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    return placed.join(F.broadcast(parts), "_part").withColumn("_index", F.col("_at") - F.col("_begin") + F.col("_before")).drop("_part", "_at", "_n", "_begin", "_before")
