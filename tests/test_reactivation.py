"""Reactivations in batch, day by day, and as a stream."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.compare import spark_rows
from policyscan.operators import edits as E
from policyscan.operators import reactivations as R
from policyscan.plans import reactivation
from policyscan.sources import commits, sinks, tables
from policyscan.streaming import monitor
from tests import tables as t

SINCE = t.DAY0.date()
ROWS = [
    t.entry(1, 1, 1, title=("Fox", "Real Fox Coat"), state=(1, 0)),
    t.entry(1, 1, 2, title=("Fox", "Real Fox Coat"), state=(3, 0), hour=5),
    t.entry(1, 4, 3, title=("Fox", "Mink Coat"), state=(4, 0)),
    t.entry(2, 2, 4, title=("a", "Genuine Leather"), state=(5, 0)),
    t.entry(2, 3, 5, title=("a", "Natural Fur Hat"), state=(2, 0)),
    t.entry(3, 2, 6, title=("a", "Real Fur"), state=(1, 0)),
    t.entry(4, 2, 7, title=("a", "Real Fur"), state=(1, 0)),
    t.entry(1, 2, 8, title=("a", "Real Fur"), state=(0, 0)),
    t.entry(2, 2, 9, title=("a", None), state=(1, 0)),
    t.entry(2, 2, 10, title=("a", "Plain Hat"), state=(None, 0)),
]
OWNERS = [(1, 10, 0), (2, 10, 0), (3, 10, 1), (4, 20, 0)]


@pytest.fixture(scope="module")
def inputs(spark):
    return t.change_log(spark, ROWS), t.ids(spark, 1), t.master(spark, OWNERS)


def test_summary(inputs):
    got = [tuple(r) for r in reactivation.reactivation_summary(*inputs, SINCE).collect()]
    assert sorted(got) == sorted(
        [
            (True, "INACTIVE", "strong_signal", 1, 1),
            (True, "DRAFT", "strong_signal", 1, 1),
            (True, "4", "species_or_fur", 1, 1),
            (False, "EXPIRED", "other", 1, 1),
            (False, "SOLDOUT", "strong_signal", 1, 1),
        ]
    )


def test_detail_has_change_counts(inputs):
    edits = E.content_edits(inputs[0], SINCE)
    detail = reactivation.reactivation_detail(*inputs, edits, SINCE, ordered=True).collect()
    assert [(r.listing_id, r.came_from_state, r.change_count) for r in detail] == [
        (1, "DRAFT", 4),
        (1, "INACTIVE", 4),
    ]


def test_summary_is_ordered(inputs):
    rows = reactivation.reactivation_summary(*inputs, SINCE).collect()
    order = [(not r.was_flagged, -r.listings, r.came_from_state, r.fur_signal_strength) for r in rows]
    assert order == sorted(order)


def test_rollup_takes_state_of_first_reactivation(inputs):
    rollup = R.reactivation_rollup(R.reactivations(inputs[0], SINCE)).collect()
    got = {r.listing_id: (r.reactivated_date.day, r.state_before, r.reactivation_count) for r in rollup}
    assert got == {1: (2, 1, 3), 2: (3, 5, 3), 3: (3, 1, 1), 4: (3, 1, 1)}


def test_daily_runs_equal_the_whole_span(spark, inputs, tmp_path):
    log, flagged, owners = inputs
    edits, target = E.content_edits(log, SINCE), str(tmp_path / "daily")
    runs = [(t.DAY0 + dt.timedelta(days=d)).date() for d in range(1, 8)]
    for day in runs + runs[2:4]:
        reactivation.run_daily_job(log, flagged, owners, edits, day, target)
    whole = reactivation.daily_reactivations(*inputs, edits, t.DAY0, runs[-1])
    report = sinks.read_runs(spark, target)
    assert report.filter("run_date <> date_add(reactivated_date, 1)").isEmpty()
    assert spark_rows(report.drop("run_date")) == spark_rows(whole)
    assert sinks.last_run(spark, target) == runs[-1]
    # Listing 1 goes off sale; a rerun no longer reports it.
    left = t.master(spark, [(1, 10, 1), *OWNERS[1:]])
    assert not report.filter("listing_id = 1 and run_date = date'2020-01-03'").isEmpty()
    reactivation.run_daily_job(log, flagged, left, edits, dt.date(2020, 1, 3), target)
    assert sinks.read_runs(spark, target).filter("run_date = date'2020-01-03' and listing_id = 1").isEmpty()


LATE = [
    (t.entry(1, 1, 1, title=("Fox", "Real Fox Coat"), state=(1, 0)), 0),
    (t.entry(2, 1, 2, title=("Fox", "Real Mink"), state=(1, 0)), 3),
    (t.entry(2, 3, 3, title=("Fox", "Real Beaver"), state=(1, 0)), 1),
    (t.entry(1, 2, 4, title=("Fox", "Plain"), state=(1, 0)), 1),
    (t.entry(1, 5, 5, title=("Fox", "Fox Hat"), state=(1, 0)), 0),
    (t.entry(1, 0, 6, title=("Fox", "Rabbit Fur"), state=(1, 0)), 30),
]


@pytest.mark.parametrize("partitioned", [False, True])
def test_entries_that_come_late_are_reported_once(spark, tmp_path, partitioned):
    rows = [(*row, row[0] + dt.timedelta(days=days)) for row, days in LATE]
    log = spark.createDataFrame(rows, f"{t.schema_of('change_log')}, arrival_ts timestamp")
    if partitioned:
        log.withColumn("event_date", F.to_date("event_ts")).write.partitionBy("event_date").parquet(str(tmp_path / "log"))
        log = tables.read_table(spark, "change_log", str(tmp_path / "log"))
        assert {"event_date", "arrival_ts"} < set(log.columns)
    flagged, owners, target = t.ids(spark, 1), t.master(spark, OWNERS), str(tmp_path / "runs")
    edits = E.content_edits(log, SINCE)
    days = [(t.DAY0 + dt.timedelta(days=d)).date() for d in range(1, 8)]

    def reported():
        return sorted((r.run_date.day, r.listing_id, r.current_title) for r in sinks.read_runs(spark, target).collect())

    def job(day):
        return reactivation.run_daily_job(log, flagged, owners, edits, day, target, retained=20)

    assert [job(day) for day in days[:4]] == [[days[0]], [days[1]], [days[2]], [days[2], days[3]]]
    assert reported() == [(3, 1, "Real Fox Coat")]
    # Three days late, and one day late: the runs of their days are reported anew.
    assert job(days[4]) == [days[1], days[3], days[4]]
    late = [(3, 1, "Real Fox Coat"), (3, 2, "Real Mink"), (5, 2, "Real Beaver")]
    assert reported() == late
    for day in days[5:] + days[1:4]:  # and reruns know what the last run knew
        job(day)
    assert reported() == [*late, (7, 1, "Fox Hat")]
    assert sinks.run_dates(spark, target) == days
    # Beyond the retained days an entry is lost, unless more days are read.
    job((t.DAY0 + dt.timedelta(days=31)).date())
    assert len(reported()) == 4
    reactivation.run_daily_job(log, flagged, owners, edits, (t.DAY0 + dt.timedelta(days=31)).date(), target)
    assert (2, 1, "Rabbit Fur") in reported()


def test_the_window_of_a_run_is_the_day_before():
    assert R.one_day(dt.date(2020, 3, 1)) == (dt.datetime(2020, 2, 29), dt.datetime(2020, 3, 1))
    assert R.one_day(dt.datetime(2020, 3, 1, 6)) == (dt.datetime(2020, 2, 29, 6), dt.datetime(2020, 3, 1, 6))


def test_stream_in_two_runs_equals_batch(spark, inputs, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    watched = reactivation.watched_listings(*inputs[1:])
    for part in (ROWS[::2], ROWS[1::2]):
        t.change_log(spark, part).coalesce(1).write.mode("append").parquet(folder)
        changes = tables.stream_table(spark, "change_log", folder)
        monitor.monitor_reactivations(changes, watched, SINCE, target, state).awaitTermination()
    batch = reactivation.watched_events(R.reactivations(inputs[0], SINCE), watched)
    assert spark_rows(monitor.current_alerts(spark, target).drop("batch_id")) == spark_rows(batch)


def streamed(spark, rows, folder, target, state, watched):
    t.change_log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    changes = tables.stream_table(spark, "change_log", folder)
    monitor.monitor_reactivations(changes, watched, SINCE, target, state).awaitTermination()


def test_readers_see_finished_batches_only(spark, inputs, tmp_path):
    folder, target = (str(tmp_path / n) for n in ("log", "out"))
    watched = reactivation.watched_listings(*inputs[1:])
    streamed(spark, ROWS[:6], folder, target, str(tmp_path / "a"), watched)
    alerts = spark_rows(monitor.current_alerts(spark, target))
    # What a stopped batch leaves: files without a published state, whole or not.
    stream = next((tmp_path / "out").glob("stream=*"))
    monitor.current_alerts(spark, target).drop("batch_id").write.parquet(f"{stream}/batch_id=1")
    (stream / "batch_id=2" / "_temporary").mkdir(parents=True)
    assert spark_rows(monitor.current_alerts(spark, target)) == alerts
    # The next run writes that batch anew, and an empty checkpoint makes the stream begin again.
    streamed(spark, ROWS[6:], folder, target, str(tmp_path / "a"), watched)
    batch = spark_rows(reactivation.watched_events(R.reactivations(inputs[0], SINCE), watched))
    assert spark_rows(monitor.current_alerts(spark, target).drop("batch_id")) == batch
    streamed(spark, ROWS[:0], folder, target, str(tmp_path / "b"), watched)
    assert spark_rows(monitor.current_alerts(spark, target).drop("batch_id")) == batch


def rolled_up(spark, rows, folder, target, state, **options):
    t.change_log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    changes = tables.stream_table(spark, "change_log", folder)
    monitor.roll_up_reactivations(changes, SINCE, target, state, **options).awaitTermination()


def test_files_of_a_batch_do_not_follow_its_days(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    rows = [t.entry(n % 7, n, n, state=(1, 0)) for n in range(700)]
    rolled_up(spark, rows, folder, target, state)
    assert 1 <= len(list((tmp_path / "out").rglob("*.parquet"))) <= 8
    assert monitor.current_rollup(spark, target).agg({"reactivation_count": "sum"}).first()[0] == 700


def test_an_unfinished_batch_or_merge_changes_nothing(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    for part in (ROWS[:4], ROWS[4:7]):
        rolled_up(spark, part, folder, target, state, folders=2)
    held = spark_rows(monitor.current_rollup(spark, target))
    monitor.current_rollup(spark, target).write.parquet(f"{target}/data-0")
    (tmp_path / "out" / "data-1" / "_temporary").mkdir(parents=True)
    (tmp_path / "out" / "_states" / ".draft-0").write_text("{")
    assert spark_rows(monitor.current_rollup(spark, target)) == held
    rolled_up(spark, ROWS[7:], folder, target, state, folders=2)
    batch = R.reactivation_rollup(R.reactivations(t.change_log(spark, ROWS), SINCE))
    assert spark_rows(monitor.current_rollup(spark, target)) == spark_rows(batch)
    # What no state names is removed by the next batch.
    assert not (tmp_path / "out" / "data-0").exists()


def test_folders_of_a_rollup_are_merged_by_levels(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    for n in range(7):
        rolled_up(spark, [t.entry(n % 3, n, n, state=(1, 0))], folder, target, state, folders=2)
    live = commits.published(spark, target)
    assert [level for level, _ in live["entries"]] == [level for level, _ in live["sums"]] == [2, 1, 0]
    got = {r.listing_id: r.reactivation_count for r in monitor.current_rollup(spark, target).collect()}
    assert got == {0: 3, 1: 2, 2: 2}


def test_a_rollup_without_entries_is_empty(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    rolled_up(spark, [t.entry(1, 1, 1, state=(0, 0))], folder, target, state)
    assert monitor.current_rollup(spark, target).dtypes == R.reactivation_rollup(
        R.reactivations(t.change_log(spark, ROWS), SINCE)
    ).dtypes
    assert monitor.current_rollup(spark, target).isEmpty()


@pytest.mark.parametrize("folders", [8, 3, 2])
def test_streamed_rollup_counts_late_entries_once(spark, inputs, tmp_path, folders):
    folder, target, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    late = [
        t.entry(1, 400, 20, title=("a", "Real Fur"), state=(2, 0)),
        t.entry(3, 30, 21, title=("a", "Real Fur"), state=(3, 0)),
        t.entry(9, 0, 22, title=("a", "Real Fur"), state=(5, 0)),
    ]
    everything = ROWS + late
    # Weeks apart in either direction, and some delivered again in the same or a later run.
    for part in (late[:1] + ROWS[4:], ROWS[:6] + ROWS[4:6], late[1:], late + ROWS[:2], ROWS[:1]):
        t.change_log(spark, part).coalesce(1).write.mode("append").parquet(folder)
        changes = tables.stream_table(spark, "change_log", folder)
        monitor.roll_up_reactivations(
            changes, SINCE, target, state, folders=folders
        ).awaitTermination()
    batch = R.reactivation_rollup(R.reactivations(t.change_log(spark, everything), SINCE))
    assert spark_rows(monitor.current_rollup(spark, target)) == spark_rows(batch)


def test_a_retried_batch_replaces_its_own_sums(spark, tmp_path):
    folder, target = (str(tmp_path / n) for n in ("log", "out"))
    t.change_log(spark, ROWS).coalesce(1).write.parquet(folder)
    for run in ("a", "b"):  # a lost checkpoint makes the stream begin again
        changes = tables.stream_table(spark, "change_log", folder)
        monitor.roll_up_reactivations(changes, SINCE, target, str(tmp_path / run)).awaitTermination()
    batch = R.reactivation_rollup(R.reactivations(t.change_log(spark, ROWS), SINCE))
    assert spark_rows(monitor.current_rollup(spark, target)) == spark_rows(batch)


def review(listing, first, latest, policy="p", kind="listing"):
    day = lambda n: None if n is None else t.DAY0 + dt.timedelta(days=n)
    return (listing, kind, policy, day(first), day(first).date(), day(latest))


def test_review_gap_by_review_and_by_listing(spark):
    back = dt.date(2020, 1, 10)
    screened = spark.createDataFrame(
        [(n, n * 10, back, "HIGH" if n < 9 else "REVIEW") for n in (1, 2, 3, 4, 5, 9)],
        "listing_id bigint, user_id bigint, reactivated_date date, confidence_band string",
    )
    reviews = spark.createDataFrame(
        [
            review(2, 1, 5),
            review(2, 1, 20, "q"),
            review(3, 1, 9),
            review(4, 1, None),
            review(5, 1, 3, kind="shop"),
            review(3, 1, 2, "q"),
            review(9, 1, 2),
        ],
        t.schema_of("reviews"),
    )
    view = spark.createDataFrame([(1, True), (3, False)], t.schema_of("listing_view"))
    rows = reactivation.review_gap(screened, reviews, view).collect()
    got = sorted(
        (r.listing_id, r.in_scope_policy, r.days_from_reactivation_to_review, r.is_active)
        for r in rows
        if r.listing_id in (2, 3)
    )
    assert got == [(2, "p", -4, None), (3, "q", -7, False)]
    assert {r.listing_id for r in rows} == {1, 2, 3, 4, 5}
    per_listing = reactivation.review_gap(screened, reviews, view, per_listing=True).collect()
    assert {r.listing_id for r in per_listing} == {1, 4, 5}
