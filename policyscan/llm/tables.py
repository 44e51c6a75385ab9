"""Reading the given tables and writing intermediate ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``,
    or a folder in the warehouse where that is unset, as in a plain local session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate").rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    It cuts the lineage: an executor that is lost later costs no recomputation of what
    came before, and a result used twice is computed once. All tables of an application
    are in one folder there, which can be removed when the application has ended.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/policyscan-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends only on the texts of ``parts``; 52 bits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def hash_share(*columns: str) -> Column:
    """A number from 0 to 1 by the hash of the columns."""
    return F.xxhash64(*columns).cast("double") / F.lit(float(2**64)) + 0.5


def smallest_hashes(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the smallest hashes of the columns.

    Rows are counted first, and only about twice as many as wanted are sorted, so that what
    meets in one task does not grow with the partitions.
    """
    total = max(1, df.count())
    few = df.where(hash_share(*columns) <= min(1.0, 2.0 * rows / total))
    return few.orderBy(F.xxhash64(*columns), *columns).limit(rows)
