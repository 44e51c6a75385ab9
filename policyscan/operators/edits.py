"""Content edits out of a before/after change log, and their timing.

A listing may hold a large share of the log, so nothing here puts all edits of
one listing into one task: edits are summed up per listing and day before any
join, and numbering works on slots of time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyscan.functions.listing import days_between, review_timing
from policyscan.functions.text import computed_once


def since_bound(since: dt.date | dt.datetime) -> Column:
    return F.lit(since).cast("timestamp")


def happened(
    change_log: DataFrame,
    since: dt.date | dt.datetime,
    until: dt.date | dt.datetime | None = None,
) -> DataFrame:
    """Log entries in ``[since, until)``. Of a log with a column ``event_date``, the day of the
    entry, by which it may be partitioned, other days are not read."""
    days = "event_date" in change_log.columns
    entries = change_log.filter(F.col("event_ts") >= since_bound(since))
    if days:
        entries = entries.filter(F.col("event_date") >= F.lit(_day(since)))
    if until is not None:
        entries = entries.filter(F.col("event_ts") < since_bound(until))
        if days:
            entries = entries.filter(F.col("event_date") <= F.lit(_last_day(until)))
    return entries


def _day(bound: dt.date | dt.datetime) -> dt.date:
    return bound.date() if isinstance(bound, dt.datetime) else bound


def _last_day(until: dt.date | dt.datetime) -> dt.date:
    """The day of the last instant before a bound."""
    if isinstance(until, dt.datetime):
        return (until - dt.timedelta(microseconds=1)).date()
    return until - dt.timedelta(days=1)


def title_changed() -> Column:
    """NULL when either title is NULL."""
    return F.col("before.title") != F.col("after.title")


def description_changed() -> Column:
    return F.col("before.description") != F.col("after.description")


def content_edits(change_log: DataFrame, since: dt.date) -> DataFrame:
    """One row per log entry that changed the title or the description."""
    edited = happened(change_log, since).filter(title_changed() | description_changed())
    return edited.select(
        F.col("before.listing_id").alias("listing_id"),
        F.col("event_ts").alias("change_ts"),
        F.col("event_seq").alias("event_seq"),
        F.to_date("event_ts").alias("change_date"),
        title_changed().alias("title_changed"),
        F.col("before.title").alias("title_before"),
        F.when(title_changed(), F.col("after.title")).alias("title_after"),
        description_changed().alias("desc_changed"),
        F.col("before.description").alias("desc_before"),
        F.when(description_changed(), F.col("after.description")).alias("desc_after"),
    )


def retitled(edits: DataFrame) -> DataFrame:
    """Edits that changed a title into another."""
    return edits.filter(
        F.col("title_changed")
        & F.col("title_before").isNotNull()
        & F.col("title_after").isNotNull()
    )


def of_listings(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows of the given listings.

    No broadcast hint: Spark broadcasts the ids when they are small enough and,
    over an aggregate, then also moves this join below it; otherwise it joins
    the aggregated rows.
    """
    return rows.join(listings.select("listing_id"), "listing_id", "left_semi")


def first_review(
    reviews: DataFrame, policy: str, content_type: str = "listing"
) -> DataFrame:
    """Date of the first decision per listing under one policy."""
    return (
        reviews.filter(
            (F.col("content_type") == content_type) & (F.col("in_scope_policy") == policy)
        )
        .groupBy(F.col("reference_id").alias("listing_id"))
        .agg(F.min(F.to_date("earliest_in_scope_date")).alias("first_review_date"))
    )


def first_edit(edits: DataFrame) -> DataFrame:
    """First edit per listing; the changed flags cover all its edits."""
    return edits.groupBy("listing_id").agg(
        F.min("change_ts").alias("first_change_ts"),
        F.bool_or("title_changed").alias("title_changed"),
        F.bool_or("desc_changed").alias("desc_changed"),
    )


def per_listing_day(edits: DataFrame, *extra_keys: str, **measures: Column) -> DataFrame:
    """Sum edits up to listing and day before they meet any other table."""
    return edits.groupBy("listing_id", "change_date", *extra_keys).agg(
        F.count("*").alias("edits"), *[c.alias(name) for name, c in measures.items()]
    )


def with_timing(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Attach the first review of the listing and where ``change_date`` stands to it.

    Callers pass the reviews of their own listings, which Spark can often broadcast
    where it could not broadcast those of all listings.
    """
    return rows.join(reviewed, "listing_id", "left").withColumns(
        {
            "days_vs_review": days_between(F.col("change_date"), F.col("first_review_date")),
            "change_timing": review_timing(F.col("change_date"), F.col("first_review_date")),
        }
    )


def numbered_with_timing(edits: DataFrame, reviewed: DataFrame, slot: str = "MINUTE") -> DataFrame:
    """Edits with their number within the listing, in time order, and their timing.

    Numbers are the position within a time slot plus the edits in earlier slots,
    so the largest sort is one listing's edits in one slot, and the running sum
    per listing covers at most one row per slot of the calendar (130,000 minutes
    in 90 days).
    """
    slotted = edits.withColumn("slot", F.date_trunc(slot, "change_ts")).filter(
        F.col("slot").isNotNull() & F.col("listing_id").isNotNull()
    )
    spread = slotted.repartition("listing_id", "slot")
    # Every column passes the generator, so both branches below read the same
    # shuffle: the log is scanned and moved once.
    carried = {name: F.col(name) for name in edits.columns if name != "listing_id"}
    spread = computed_once(spread, ["listing_id", "slot"], **carried)

    in_slot = spread.groupBy("listing_id", "slot").agg(F.count("*").alias("in_slot"))
    earlier = F.sum("in_slot").over(Window.partitionBy("listing_id").orderBy("slot"))
    offsets = (
        in_slot.select("listing_id", "slot", (earlier - F.col("in_slot")).alias("earlier"))
        .join(reviewed, "listing_id", "left")
    )
    position = F.row_number().over(
        Window.partitionBy("listing_id", "slot").orderBy("change_ts", "event_seq")
    )
    numbered = spread.withColumn("position", position).join(offsets, ["listing_id", "slot"])
    return numbered.select(
        *edits.columns,
        (F.col("earlier") + F.col("position")).cast("bigint").alias("change_num"),
        "first_review_date",
        days_between(F.col("change_date"), F.col("first_review_date")).alias("days_vs_review"),
        review_timing(F.col("change_date"), F.col("first_review_date")).alias("change_timing"),
    )
