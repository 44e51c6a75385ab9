from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from policyscan.operators.edits import content_edits
from policyscan.operators.reactivations import reactivation_rollup, reactivations
from policyscan.sources import commits, sinks, tables
from tests import tables as t


def test_replace_and_snapshot_by_path(spark, tmp_path):
    source, copy = str(tmp_path / "flagged"), str(tmp_path / "copy")
    sinks.replace_table(t.ids(spark, 1, 2, 3), source)
    sinks.replace_table(t.ids(spark, 4, 5), source)
    kept = sinks.snapshot(tables.read_table(spark, "flagged", source), copy)
    assert sorted(r.listing_id for r in kept.collect()) == [4, 5]


@pytest.fixture
def name(spark):
    yield (name := "policyscan_flagged_test")
    sinks.drop_table(spark, name)
    assert sinks.versions(spark, name) == [] and not spark.catalog.tableExists(name)


def listed(df):
    return sorted(r.listing_id for r in df.collect())


def failing(spark):
    return t.ids(spark, 1, 2, 3, 4).select(F.expr("IF(listing_id < 4, listing_id, raise_error('lost'))").cast("bigint").alias("listing_id"))


def test_replace_catalog_table(spark, name):
    for numbers in ((1, 2), (3,), (4, 5), (6,)):
        sinks.replace_table(t.ids(spark, *numbers), name)
        assert listed(tables.read_table(spark, "flagged", name)) == list(numbers)
    # The version before stays, for readers that began with it.
    assert [listed(spark.table(v)) for v in sinks.versions(spark, name)] == [[4, 5], [6]]
    # Other columns are a matter of the new version alone.
    sinks.replace_table(t.ids(spark, 7).withColumn("more", F.lit("x")), name)
    assert [tuple(r) for r in spark.table(name).collect()] == [(7, "x")]


def test_a_failed_write_keeps_the_old_table(spark, tmp_path, name):
    for target in (name, str(tmp_path / "table")):
        sinks.replace_table(t.ids(spark, 1, 2), target)
        with pytest.raises(Exception, match="lost"):
            sinks.replace_table(failing(spark), target)
        assert listed(tables.read_table(spark, "flagged", target)) == [1, 2]
        sinks.replace_table(t.ids(spark, 9), target)
        assert listed(tables.read_table(spark, "flagged", target)) == [9]


def test_a_reader_in_between_sees_the_old_or_the_new_table(spark, tmp_path, name):
    for target in (name, str(tmp_path / "table")):
        old = sinks.replace_table(t.ids(spark, 1, 2), target)
        new = sinks.replace_table(t.ids(spark, 3), target)
        assert listed(old) == [1, 2] and listed(new) == [3]


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    path = str(tmp_path / "state")
    commits.publish(spark, path, {"n": 1}, None)
    before = commits.published(spark, path)
    commits.publish(spark, path, {"n": 2}, before)
    with pytest.raises(RuntimeError, match="another writer"):
        commits.publish(spark, path, {"n": 3}, before)
    assert commits.published(spark, path) == {"n": 2}


def test_a_failed_run_is_not_the_last_run(spark, tmp_path):
    target, day = str(tmp_path / "runs"), dt.date(2020, 1, 2)
    (tmp_path / "runs" / "run_date=2020-01-09" / "_temporary").mkdir(parents=True)
    assert sinks.last_run(spark, target) is None
    sinks.write_run(t.ids(spark, 5), day, target)
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(failing(spark), day + dt.timedelta(days=1), target)
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(failing(spark), day, target)
    assert sinks.last_run(spark, target) == day
    assert [tuple(r) for r in sinks.read_runs(spark, target).collect()] == [(5, day)]


def test_runs_of_several_dates_are_replaced_at_once(spark, tmp_path):
    target, day = str(tmp_path / "runs"), dt.date(2020, 1, 2)
    dates = [day + dt.timedelta(days=n) for n in range(3)]
    rows = [(1, dates[0]), (2, dates[1]), (3, day + dt.timedelta(days=9))]
    sinks.write_runs(spark.createDataFrame(rows, "listing_id bigint, run_date date"), dates, target)
    assert sorted(map(tuple, sinks.read_runs(spark, target).collect())) == rows[:2]
    sinks.write_runs(spark.createDataFrame([(4, dates[1])], "listing_id bigint, run_date date"), dates[:2], target)
    assert [tuple(r) for r in sinks.read_runs(spark, target).collect()] == [(4, dates[1])]
    assert sinks.run_dates(spark, target) == dates
    sinks.write_run(t.ids(spark), dates[1], target)
    assert sinks.read_runs(spark, target).dtypes == [("listing_id", "bigint"), ("run_date", "date")]
    assert sinks.read_runs(spark, target).isEmpty()


def test_only_the_days_of_the_bounds_are_read_from_a_partitioned_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [t.entry(n % 3, n, n, title=("a", f"b{n}"), state=(1, 0), hour=n) for n in range(20)]
    log = t.change_log(spark, rows)
    log.withColumn("event_date", F.to_date("event_ts")).write.partitionBy("event_date").parquet(path)
    stored = tables.read_table(spark, "change_log", path)
    since, until = dt.date(2020, 1, 5), dt.datetime(2020, 1, 9)
    found = {
        "edits": (content_edits(stored, since), content_edits(log, since)),
        "back": (reactivations(stored, since, until), reactivations(log, since, until)),
        "within": (reactivations(stored, since, dt.datetime(2020, 1, 9, 12)), reactivations(log, since, dt.datetime(2020, 1, 9, 12))),
    }
    for pruned, whole in found.values():
        names = whole.columns
        assert sorted(map(str, pruned.select(*names).collect())) == sorted(map(str, whole.collect()))
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "event_date" in filters and "2020-01-05" in filters
    assert "<= 2020-01-08" in found["back"][0]._jdf.queryExecution().executedPlan().toString()


def test_conform_renames_and_casts(spark):
    df = spark.sql("SELECT 7 AS id, 'x' AS other")
    got = tables.conform(df, "flagged", {"listing_id": "id"})
    assert got.dtypes == [("listing_id", "bigint")] and got.first()[0] == 7


def test_scan_reads_used_fields_of_a_wide_log(spark, tmp_path):
    path = str(tmp_path / "log")
    t.change_log(spark, [t.entry(1, 1, 1, state=(1, 0))]).withColumns(
        {
            "before": F.col("before").withField("extra", F.lit("x")),
            "after": F.col("after").withField("extra", F.lit("x")),
        }
    ).write.parquet(path)
    log = tables.read_table(spark, "change_log", path)
    rollup = reactivation_rollup(reactivations(log, t.DAY0.date()))
    assert rollup.count() == 1
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "title" not in read and "extra" not in read and "description" not in read
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "event_ts" in pushed and "after.state" in pushed


def test_shared_folder_comes_from_the_session(spark, shared):
    assert sinks.shared_folder(spark) == shared


def test_without_a_checkpoint_folder_the_warehouse_is_used():
    class Session:
        conf = {"spark.sql.warehouse.dir": "hdfs://x/warehouse"}

    assert sinks.shared_folder(Session) == "hdfs://x/warehouse/runs"


def test_a_rerun_replaces_a_day_also_by_nothing(spark, tmp_path):
    target, day = str(tmp_path / "runs"), dt.date(2020, 1, 2)
    assert sinks.last_run(spark, target) is None
    for n in range(3):
        sinks.write_run(t.ids(spark, n, n + 10), day + dt.timedelta(days=n), target)
    sinks.write_run(t.ids(spark), day + dt.timedelta(days=1), target)
    sinks.write_run(t.ids(spark), day + dt.timedelta(days=3), target)
    rows = sorted((r.run_date.day, r.listing_id) for r in sinks.read_runs(spark, target).collect())
    assert rows == [(2, 0), (2, 10), (4, 2), (4, 12)]
    # Days without a result were run too.
    assert sinks.last_run(spark, target) == dt.date(2020, 1, 5)


@pytest.mark.parametrize("table", sorted(tables.CONTRACTS))
def test_contracts_are_valid_schemas(spark, table):
    assert spark.createDataFrame([], t.schema_of(table)).count() == 0
