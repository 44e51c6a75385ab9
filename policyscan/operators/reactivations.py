"""Listings that went from any other state back to active."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.functions.buckets import first_match
from policyscan.functions.listing import ACTIVE, prior_state
from policyscan.functions.text import has_word
from policyscan.operators.edits import happened, since_bound
from policyscan.rules import bank


def reactivations(
    change_log: DataFrame,
    since: dt.date | dt.datetime,
    until: dt.date | dt.datetime | None = None,
) -> DataFrame:
    """Log entries in ``[since, until)`` that made a listing active."""
    return happened(change_log, since, until).filter(
        (F.col("before.state") != ACTIVE) & (F.col("after.state") == ACTIVE)
    )


def one_day(as_of: dt.datetime | dt.date) -> tuple[dt.datetime, dt.datetime]:
    """The window ``[as_of - 1 day, as_of)`` of a daily run; a date is its midnight."""
    if not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    return as_of - dt.timedelta(days=1), as_of


def signal_strength(title: Column) -> Column:
    fur = has_word(title, bank.FUR_OR_SPECIES_WORDS)
    claim = has_word(title, bank.EVIDENT_CLAIM_WORDS)
    return first_match([(claim & fur, "strong_signal"), (fur, "species_or_fur")], "other")


def risky_reactivations(events: DataFrame) -> DataFrame:
    """Reactivations whose title names fur, a species or an authenticity claim."""
    title = F.col("after.title")
    risky = events.filter(has_word(title, (*bank.FUR_OR_SPECIES_WORDS, *bank.AUTHENTIC_WORDS)))
    return risky.select(
        F.col("before.listing_id").alias("listing_id"),
        F.to_date("event_ts").alias("reactivated_date"),
        prior_state(F.col("before.state")).alias("came_from_state"),
        signal_strength(title).alias("fur_signal_strength"),
        title.alias("current_title"),
    )


def reactivation_rollup(events: DataFrame, *extra_keys: Column) -> DataFrame:
    """Per listing: first reactivation, the state before it, and how many there were."""
    return events.groupBy(F.col("before.listing_id").alias("listing_id"), *extra_keys).agg(
        F.min(F.to_date("event_ts")).alias("reactivated_date"),
        F.min_by("before.state", F.struct("event_ts", "event_seq")).alias("state_before"),
        F.count("*").alias("reactivation_count"),
    )
