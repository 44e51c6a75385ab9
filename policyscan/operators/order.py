"""Results in order, with each row's place in it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyscan.sources.sinks import shared_folder

#: ``monotonically_increasing_id`` counts rows in so many low bits, below the partition.
ROW_BITS = 33


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the number of each row, from 1, in the given order, which should leave no ties.

    Rows are dealt to ranges and sorted within them; a row's number is its place there plus
    the rows of the ranges before, so no task holds or counts them all. The sorted rows are
    written to the shared folder first, so that both steps see the same ranges.
    """
    spark, place = df.sparkSession, "_place"
    while place in df.columns:
        place = f"_{place}"
    path = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright(place, ROW_BITS)
    # A row per range.
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.join(offsets, part == F.col("part"))
    number = (F.col("before") + F.col(place).bitwiseAND((1 << ROW_BITS) - 1) + 1).alias(name)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], number)
