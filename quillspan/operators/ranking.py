"""Numbers along an order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with the number (from 1) of each row along ``keys``.

    Rows are dealt out in ranges; a row's number is its place in its range plus the sizes of the ranges before, of
    which there is one each partition.  Rows equal in all keys are numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = durable(df, "unordered")  # the range partitioner reads its input twice
    rows = durable(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    joined = placed.join(offsets, placed["__part"] == offsets["__p"])
    return joined.withColumn(name, F.col("__offset") + F.col("__k")).drop("__part", "__p", "__offset", "__k")
