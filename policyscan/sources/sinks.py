"""Where results go: replaced tables, snapshots and the partitions of daily runs.

A table is replaced and a run is reported in one step, after its data are complete: readers
see what was there before or what is there after, and a failed write changes nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from policyscan.sources import commits

RUN_DATE = "run_date"
#: How the names of the versions of a catalog table begin; ``{}`` is its own.
VERSIONS = "{}__version_"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and run output that every executor can reach:
    ``spark.checkpoint.dir``, or one in the warehouse where that is not set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/runs").rstrip("/")


def replace_table(
    df: DataFrame, target: str, by: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Replace a catalog table, or a folder when ``target`` is a path; the new rows are read back.

    A folder holds versions, and ``tables.read_table`` reads the published one. In a
    catalog the name is a view of the latest version, a table, so that replacing the view is
    what readers notice; the version before it stays for those that began with it.

    ``by`` and ``buckets`` store the rows of a catalog table hashed and sorted by a column, so
    that later jobs group and join by it without moving the table.
    """
    if "/" in target:
        if by:
            raise ValueError("only catalog tables can be stored by a column")
        return _replace_folder(df, target)
    return _replace_view(df, target, by, buckets)


def _replace_folder(df: DataFrame, target: str) -> DataFrame:
    spark, folder = df.sparkSession, commits.fresh()
    df.write.parquet(f"{target}/{folder}")
    before = commits.published(spark, target)
    commits.publish(spark, target, {"table": folder}, before)
    commits.tidy(spark, target)
    return read_folder(spark, target)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a folder, or its Parquet files where none was published."""
    state = commits.published(spark, path)
    return spark.read.parquet(f"{path}/{state['table']}" if state else path)


def versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of a catalog table, oldest first."""
    prefix = VERSIONS.format(name.rpartition(".")[2])
    database = name.rpartition(".")[0] or spark.catalog.currentDatabase()
    found = spark.catalog.listTables(database, f"{prefix}*")
    return sorted(f"{database}.{t.name}" for t in found if t.name.startswith(prefix.lower()))


def _replace_view(df: DataFrame, name: str, by: str | None, buckets: int | None) -> DataFrame:
    spark = df.sparkSession
    before = versions(spark, name)
    last = int(before[-1].rpartition("_")[2]) if before else 0
    version = f"{VERSIONS.format(name)}{last + 1:09d}"
    location = f"{shared_folder(spark)}/tables/{version}-{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", location)
    if by:
        writer = writer.bucketBy(buckets or 64, by).sortBy(by)
    writer.saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in before[:-1]:
        drop_version(spark, old)
    return spark.table(name)


def drop_version(spark: SparkSession, version: str) -> None:
    """Drop a stored version together with its files."""
    about = spark.sql(f"DESCRIBE FORMATTED {version}").filter("col_name = 'Location'")
    location = about.first()["data_type"]
    spark.sql(f"DROP TABLE {version}")
    commits.remove(spark, location)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a replaced catalog table with all its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for version in versions(spark, name):
        drop_version(spark, version)


def snapshot(df: DataFrame, target: str) -> DataFrame:
    """Keep a copy of a table that is going to expire."""
    return replace_table(df, target)


def write_runs(df: DataFrame, dates: Iterable[dt.date], target: str) -> None:
    """Replace what the runs of the given dates reported, also by nothing, all at once.

    ``df`` has a column ``run_date``; rows of other dates are left out.
    """
    spark, folder = df.sparkSession, commits.fresh()
    dates = sorted(set(dates))
    # Kept as a column beside the partition, as runs are read by their own folders.
    rows = df.filter(F.col(RUN_DATE).isin(dates)).withColumn("day", F.col(RUN_DATE))
    # Rebalancing gathers small results and splits large ones.
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(f"{target}/{folder}")
    filled = set(commits.children(spark, f"{target}/{folder}"))
    before = commits.published(spark, target)
    runs = dict(before["runs"]) if before else {}
    for date in dates:
        part = f"day={date}"
        runs[str(date)] = f"{folder}/{part}" if part in filled else None
    commits.publish(spark, target, {"runs": runs, "schema": df.schema.json()}, before)
    commits.tidy(spark, target)


def write_run(df: DataFrame, run_date: dt.date, target: str) -> None:
    """Replace what the run of one date reported, also by nothing."""
    write_runs(df.withColumn(RUN_DATE, F.lit(run_date)), [run_date], target)


def run_dates(spark: SparkSession, target: str) -> list[dt.date]:
    """The dates that were run to the end, with or without a result."""
    state = commits.published(spark, target)
    return sorted(dt.date.fromisoformat(d) for d in state["runs"]) if state else []


def last_run(spark: SparkSession, target: str) -> dt.date | None:
    """The last date that was run; the next run follows it."""
    return max(run_dates(spark, target), default=None)


def read_runs(spark: SparkSession, target: str) -> DataFrame:
    """The reports of all runs that came to their end, with their date."""
    state = commits.published(spark, target)
    if state is None:
        raise FileNotFoundError(f"no run was reported in {target}")
    schema = StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{target}/{folder}" for folder in state["runs"].values() if folder]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
