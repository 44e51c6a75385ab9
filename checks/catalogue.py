"""Every analysis as a query over one folder of driver Parquet."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.standins import (
    EDITS_SINCE,
    LAUNCH,
    POLICY,
    REACTIVATED_SINCE,
    REACTIVATED_UNTIL,
    StandIns,
)
from policyscan.operators import edits as edit_ops
from policyscan.operators import reactivations as reactivation_ops
from policyscan.operators.order import ranked
from policyscan.plans import changes, evasion, reactivation, screen, sellers, words
from policyscan.rules import table as rule_tables
from policyscan.rules.bank import BUILT_IN
from policyscan.sources import sinks, tables
from policyscan.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(StandIns(spark, folder))
    return build


def _edits(s: StandIns) -> DataFrame:
    return edit_ops.content_edits(s.change_log(), EDITS_SINCE)


def _reviewed(s: StandIns) -> DataFrame:
    return edit_ops.first_review(s.reviews(), POLICY)


def _edit_inputs(s: StandIns) -> tuple[DataFrame, DataFrame, DataFrame]:
    return s.flagged(), _edits(s), _reviewed(s)


def _seller_inputs(s: StandIns) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return s.flagged(), s.listings(), _edits(s), _reviewed(s)


def _screen_inputs(s: StandIns) -> tuple[DataFrame, DataFrame, DataFrame]:
    return s.active_listings(), s.listing_tags(), s.listing_taxonomy()


def _run_folder(s: StandIns) -> str:
    return f"{sinks.shared_folder(s.spark)}/policyscan-{uuid.uuid4().hex}"


def _table_name(name: str) -> str:
    return f"policyscan_{name}_{uuid.uuid4().hex}"


@_query
def screen_listings(s: StandIns) -> DataFrame:
    return screen.screen_listings(*_screen_inputs(s))


@_query
def screen_listings_rule_table(s: StandIns) -> DataFrame:
    """The screen by a rule bank that was stored as a table."""
    stored = sinks.replace_table(rule_tables.bank_table(s.spark, BUILT_IN), _run_folder(s))
    return screen.screen_listings(*_screen_inputs(s), rules=rule_tables.read_bank(stored))


@_query
def screen_rule_counts(s: StandIns) -> DataFrame:
    return screen.rule_counts(*_screen_inputs(s))


@_query
def screen_diagnostics(s: StandIns) -> DataFrame:
    return screen.diagnose_listings(*_screen_inputs(s))


@_query
def flagged_snapshot(s: StandIns) -> DataFrame:
    return sinks.snapshot(s.flagged(), _run_folder(s))


@_query
def flagged_snapshot_catalog(s: StandIns) -> DataFrame:
    """A catalog table that is replaced: first by half of the ids, then by all of them."""
    name, flagged = _table_name("flagged"), s.flagged()
    sinks.snapshot(flagged.filter("listing_id % 2 = 0"), name)
    return sinks.snapshot(flagged, name)


@_query
def first_review(s: StandIns) -> DataFrame:
    return _reviewed(s)


@_query
def first_change(s: StandIns) -> DataFrame:
    first = edit_ops.of_listings(edit_ops.first_edit(_edits(s)), s.flagged())
    return first.select(
        "listing_id",
        F.to_date("first_change_ts").alias("first_change_date"),
        "title_changed",
        "desc_changed",
    )


@_query
def change_timing_summary(s: StandIns) -> DataFrame:
    return changes.change_timing_summary(*_edit_inputs(s))


@_query
def segment_summary(s: StandIns) -> DataFrame:
    return changes.segment_summary(change_timing_summary(s))


@_query
def change_history(s: StandIns) -> DataFrame:
    return changes.change_history(*_edit_inputs(s))


@_query
def change_history_ranked(s: StandIns) -> DataFrame:
    history = change_history(s).select("listing_id", "change_num", "change_date", "change_timing")
    return ranked(history, *changes.history_order())


@_query
def timing_vs_review_ranked(s: StandIns) -> DataFrame:
    """The histogram in the order of a column that it does not show."""
    return changes.timing_vs_review(*_edit_inputs(s), numbered=True)


@_query
def reactivation_screen_ranked(s: StandIns) -> DataFrame:
    """By band, then by sales with unknown ones last."""
    unknown = F.when(F.col("listing_id") % 5 != 0, F.col("past_year_gms"))
    screened = reactivation_screen(s).withColumn("past_year_gms", unknown)
    rows = screened.select("listing_id", "confidence_band", "past_year_gms")
    return ranked(rows, *reactivation.screen_order())


@_query
def change_history_long_texts(s: StandIns) -> DataFrame:
    """Histories that carry whole documents as descriptions; the result has their hashes."""
    edits = edit_ops.content_edits(s.change_log(long=True), EDITS_SINCE)
    history = changes.change_history(s.flagged(), edits, _reviewed(s), long_texts=True)
    return history.select(
        "listing_id",
        "change_num",
        "desc_changed",
        F.md5(F.col("desc_before").cast("binary")).alias("desc_before_md5"),
        F.md5(F.col("desc_after").cast("binary")).alias("desc_after_md5"),
    )


@_query
def timing_vs_review(s: StandIns) -> DataFrame:
    return changes.timing_vs_review(*_edit_inputs(s))


@_query
def timing_vs_launch(s: StandIns) -> DataFrame:
    return changes.timing_vs_launch(*_edit_inputs(s), LAUNCH)


@_query
def word_swaps(s: StandIns) -> DataFrame:
    return words.word_swaps(*_edit_inputs(s))


@_query
def seller_signals(s: StandIns) -> DataFrame:
    return sellers.seller_signals(*_seller_inputs(s))


@_query
def seller_signals_parity(s: StandIns) -> DataFrame:
    return sellers.seller_signals(*_seller_inputs(s), parity=True)


@_query
def seller_breakdown(s: StandIns) -> DataFrame:
    return sellers.seller_breakdown(*_seller_inputs(s))


@_query
def evasion_summary(s: StandIns) -> DataFrame:
    return evasion.evasion_summary(*_edit_inputs(s))


@_query
def evasion_detail(s: StandIns) -> DataFrame:
    return evasion.evasion_detail(change_history(s))


@_query
def unflagged_evasion_monthly(s: StandIns) -> DataFrame:
    return evasion.unflagged_evasion_monthly(_edits(s), s.flagged(), s.listings())


@_query
def unflagged_evasion_detail(s: StandIns) -> DataFrame:
    return evasion.unflagged_evasion_detail(_edits(s), s.flagged(), s.listings())


@_query
def seller_relabel_profile(s: StandIns) -> DataFrame:
    return sellers.seller_relabel_profile(*_seller_inputs(s))


@_query
def reactivation_summary(s: StandIns) -> DataFrame:
    return reactivation.reactivation_summary(
        s.change_log(), s.flagged(), s.listings(), REACTIVATED_SINCE
    )


@_query
def reactivation_detail(s: StandIns) -> DataFrame:
    return reactivation.reactivation_detail(
        s.change_log(), s.flagged(), s.listings(), _edits(s), REACTIVATED_SINCE
    )


@_query
def reactivation_daily(s: StandIns) -> DataFrame:
    return reactivation.daily_reactivations(
        s.change_log(),
        s.flagged(),
        s.listings(),
        _edits(s),
        REACTIVATED_SINCE,
        REACTIVATED_UNTIL,
    )


@_query
def reactivation_daily_job(s: StandIns) -> DataFrame:
    """Five runs, and two reruns after listings went off sale; the reports of all runs."""
    target = _run_folder(s)
    days = [dt.date(2001, 3, 1) + dt.timedelta(days=n) for n in range(5)]
    off_sale = F.lit(1).cast("int")
    none = s.listings().withColumn("state", off_sale)
    odd = s.listings().withColumn("state", F.when(F.col("listing_id") % 2 == 1, F.col("state")).otherwise(off_sale))
    runs = [(day, s.listings()) for day in days] + [(days[2], none), (days[4], odd)]
    for day, listings in runs:
        reactivation.run_daily_job(s.change_log(), s.flagged(), listings, _edits(s), day, target)
    return sinks.read_runs(s.spark, target)


@_query
def reactivation_daily_job_late(s: StandIns) -> DataFrame:
    """Four runs over a log whose entries arrive up to three days late, one of them twice."""
    target = _run_folder(s)
    late = F.make_dt_interval(F.pmod(F.col("event_seq.l_orderkey"), F.lit(4)))
    log = s.change_log().withColumn("arrival_ts", F.col("event_ts") + late)
    days = [dt.date(2001, 3, 1) + dt.timedelta(days=n) for n in range(4)]
    for day in [*days, days[1]]:
        reactivation.run_daily_job(log, s.flagged(), s.listings(), _edits(s), day, target)
    return sinks.read_runs(s.spark, target)


@_query
def reactivation_rollup(s: StandIns) -> DataFrame:
    events = reactivation_ops.reactivations(s.change_log(), REACTIVATED_SINCE)
    return reactivation_ops.reactivation_rollup(events)


@_query
def reactivation_screen(s: StandIns) -> DataFrame:
    listings, tags, taxonomy = _screen_inputs(s)
    return reactivation.reactivation_screen(
        s.change_log(), listings, s.listings(), tags, taxonomy, REACTIVATED_SINCE
    )


@_query
def reactivation_screen_gap(s: StandIns) -> DataFrame:
    return reactivation.review_gap(reactivation_screen(s), s.reviews(), s.listing_view())


@_query
def reactivation_screen_gap_per_listing(s: StandIns) -> DataFrame:
    return reactivation.review_gap(
        reactivation_screen(s), s.reviews(), s.listing_view(), per_listing=True
    )


@_query
def reactivation_stream(s: StandIns) -> DataFrame:
    folder = _run_folder(s)
    watched = reactivation.watched_listings(s.flagged(), s.listings())
    monitor.monitor_reactivations(
        s.change_log_stream(), watched, REACTIVATED_SINCE, f"{folder}/out", f"{folder}/state"
    ).awaitTermination()
    return monitor.current_alerts(s.spark, f"{folder}/out").drop("batch_id")


@_query
def reactivation_rollup_stream(s: StandIns) -> DataFrame:
    """The log in three runs, each with entries of all times and some delivered again."""
    folder = _run_folder(s)
    log, turn = s.change_log(), F.pmod(F.xxhash64("event_seq"), F.lit(30))
    for run in range(3):
        # Entries of all times arrive in any order; a tenth of the run before once more.
        again = (turn % 3 == run - 1) & (turn < 9)
        log.filter((turn % 3 == run) | again).write.mode("append").parquet(f"{folder}/log")
        arrived = tables.stream_table(s.spark, "change_log", f"{folder}/log")
        monitor.roll_up_reactivations(
            arrived, REACTIVATED_SINCE, f"{folder}/out", f"{folder}/state"
        ).awaitTermination()
    return monitor.current_rollup(s.spark, f"{folder}/out")


def _stored_history(s: StandIns) -> DataFrame:
    """The history as a job hands it over: by listing, so that its readers need not move it."""
    return sinks.replace_table(change_history(s), _table_name("history"), by="listing_id", buckets=16)


@_query
def stored_timing_vs_review(s: StandIns) -> DataFrame:
    return changes.timing_vs_review(s.flagged(), _stored_history(s), _reviewed(s))


@_query
def stored_word_swaps(s: StandIns) -> DataFrame:
    return words.word_swaps(s.flagged(), _stored_history(s), _reviewed(s))


@_query
def stored_seller_signals(s: StandIns) -> DataFrame:
    return sellers.seller_signals(s.flagged(), s.listings(), _stored_history(s), _reviewed(s))


@_query
def stored_evasion_summary(s: StandIns) -> DataFrame:
    return evasion.evasion_summary(s.flagged(), _stored_history(s), _reviewed(s))


@_query
def seller_signals_repeated_ids(s: StandIns) -> DataFrame:
    """The flagged ids twice and the master's rows three times."""
    flagged, listings, edits, reviewed = _seller_inputs(s)
    thrice = listings.unionAll(listings).unionAll(listings)
    return sellers.seller_signals(flagged.unionAll(flagged), thrice, edits, reviewed)
