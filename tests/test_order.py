"""Ranks over ranges equal a plain sort."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from policyscan.operators.order import ranked
from policyscan.plans import changes
from tests import tables as t

ROWS = [(n * 37 % 101, None if n % 7 == 0 else n * 13 % 29 / 2, f"t{n}") for n in range(300)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_ranks_equal_a_plain_sort(spark, partitions):
    df = spark.createDataFrame(ROWS, "a bigint, b double, c string").repartition(partitions)
    got = {r.c: r.place for r in ranked(df, F.desc_nulls_last("b"), F.col("a"), F.col("c"), name="place").collect()}
    order = sorted(ROWS, key=lambda r: (r[1] is None, -(r[1] or 0), r[0], r[2]))
    assert got == {c: at for at, (_, _, c) in enumerate(order, 1)}


def test_ranks_of_empty_and_equal_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "a bigint, _place string")
    assert ranked(empty, F.col("a")).dtypes == [("a", "bigint"), ("_place", "string"), ("rank", "bigint")]
    assert ranked(empty, F.col("a")).isEmpty()
    equal = spark.createDataFrame([(1, "x")] * 50, "a bigint, _place string").repartition(5)
    assert sorted(r["rank"] for r in ranked(equal, F.col("a")).collect()) == list(range(1, 51))


def test_no_task_ranks_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 10_000, 1, 4).selectExpr("id * 7919 % 10007 AS a")
        rows = ranked(df, F.col("a")).withColumn("part", F.spark_partition_id())
        assert rows.groupBy("part").count().agg(F.max("count")).first()[0] < 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_histogram_is_ranked_by_what_it_does_not_show(spark):
    edits = [t.entry(n, day, n, title=("a", "b")) for n, day in enumerate([1, 9, 20, 60, 11, 12])]
    edits = changes_of(spark, edits)
    flagged, reviewed = t.ids(spark, *range(6)), t.reviewed(spark, {n: 10 for n in range(5)})
    rows = changes.timing_vs_review(flagged, edits, reviewed, numbered=True).orderBy("rank").collect()
    shown = [(r.change_timing, r.days_bucket) for r in changes.timing_vs_review(flagged, edits, reviewed).collect()]
    assert [(r.change_timing, r.days_bucket) for r in rows] == shown
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 5
    assert "nearest" not in rows[0]


def changes_of(spark, entries):
    from policyscan.operators.edits import content_edits

    return content_edits(t.change_log(spark, entries), t.DAY0.date())
