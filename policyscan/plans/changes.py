"""When flagged listings were edited: summary, history, histograms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyscan.functions.buckets import AROUND_LAUNCH, AROUND_REVIEW
from policyscan.functions.listing import days_between
from policyscan.functions.packed import packed, unpacked
from policyscan.functions.text import computed_once
from policyscan.operators.edits import (
    first_edit,
    numbered_with_timing,
    of_listings,
    per_listing_day,
    with_timing,
)
from policyscan.operators.order import ranked

#: Listing ids that are sent to all executors for long texts; 8 bytes each, before hashing.
BROADCAST = 2_000_000

HISTORY_COLUMNS = (
    "listing_id",
    "first_review_date",
    "change_date",
    "days_vs_review",
    "change_num",
    "title_changed",
    "title_before",
    "title_after",
    "desc_changed",
    "desc_before",
    "desc_after",
    "change_timing",
)


def change_timing_summary(
    flagged: DataFrame, edits: DataFrame, reviewed: DataFrame
) -> DataFrame:
    """One row per flagged listing: its first edit against its first review."""
    first = (
        of_listings(first_edit(edits), flagged)
        .withColumn("change_date", F.to_date("first_change_ts"))
    )
    timed = with_timing(
        flagged.select("listing_id").join(first, "listing_id", "left"),
        of_listings(reviewed, flagged),
    )
    return timed.select(
        "listing_id",
        "first_review_date",
        F.col("change_date").alias("first_change_date"),
        "days_vs_review",
        "title_changed",
        "desc_changed",
        F.when(F.col("first_change_ts").isNull(), F.lit("no_change"))
        .otherwise(F.col("change_timing"))
        .alias("change_timing"),
    )


def segment_summary(timing_summary: DataFrame) -> DataFrame:
    """Listings, share of all and mean distance to the review by timing."""
    segments = timing_summary.groupBy("change_timing").agg(
        F.count("*").alias("listings"),
        F.avg("days_vs_review").alias("mean_days_vs_review"),
    )
    # One row per timing label is left here, four at most.
    total = F.sum("listings").over(Window.partitionBy())
    return segments.select(
        "change_timing",
        "listings",
        F.round(F.try_divide(F.col("listings"), total) * 100, 1).alias("pct_of_listings"),
        F.round("mean_days_vs_review", 1).alias("mean_days_vs_review"),
    )


def change_history(
    flagged: DataFrame,
    edits: DataFrame,
    reviewed: DataFrame,
    ordered: bool = False,
    long_texts: bool = False,
) -> DataFrame:
    """One row per edit of a flagged listing, numbered, with contents and timing.

    With ``long_texts`` descriptions are packed while edits are moved and sorted.
    """
    if long_texts:
        numbered = _numbered_long(flagged, edits, of_listings(reviewed, flagged))
    else:
        numbered = numbered_with_timing(of_listings(edits, flagged), of_listings(reviewed, flagged))
    history = numbered.select(*HISTORY_COLUMNS)
    return history.orderBy(*history_order()) if ordered else history


def _numbered_long(flagged: DataFrame, edits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Numbered edits whose descriptions are packed once and unpacked when they are in place.

    Up to ``BROADCAST`` ids go to all executors, so that only edits of those listings are
    packed and moved; with more ids, edits are packed before they are moved to them.
    """
    names = [name for name in edits.columns if name not in ("desc_before", "desc_after")]
    ids = flagged.select("listing_id")

    def short(rows: DataFrame) -> DataFrame:
        return rows.select(*names, packed(F.col("desc_before"), F.col("desc_after")).alias("texts"))

    if ids.count() <= BROADCAST:
        mine = short(of_listings(edits, F.broadcast(ids)))
    else:
        mine = of_listings(short(edits), ids)
    numbered = numbered_with_timing(mine, reviewed)
    kept = [name for name in numbered.columns if name != "texts"]
    return computed_once(numbered, kept, texts=unpacked(F.col("texts"))).select(
        *kept, F.col("texts.before").alias("desc_before"), F.col("texts.after").alias("desc_after")
    )


def history_order() -> tuple[Column, ...]:
    return F.col("listing_id"), F.col("change_num")


def _histogram(
    days: DataFrame, distance: Column, label: Column, name: str, numbered: bool
) -> DataFrame:
    counted = (
        days.withColumns({name: label, "distance": distance})
        .groupBy("change_timing", name)
        .agg(
            F.countDistinct("listing_id").alias("listings"),
            F.sum("edits").alias("total_edits"),
            F.min("distance").alias("nearest"),
        )
    )
    # By a column that is not shown; unknown distances come first, as the least values.
    order = F.asc_nulls_first("change_timing"), F.asc_nulls_first("nearest")
    shown = ranked(counted, *order) if numbered else counted.orderBy(*order)
    return shown.drop("nearest")


def timing_vs_review(
    flagged: DataFrame, edits: DataFrame, reviewed: DataFrame, numbered: bool = False
) -> DataFrame:
    """Edits of flagged listings by distance to the listing's first review; sorted, or with
    the ``rank`` of each row."""
    days = with_timing(
        of_listings(per_listing_day(edits), flagged), of_listings(reviewed, flagged)
    )
    distance = F.col("days_vs_review")
    return _histogram(days, distance, AROUND_REVIEW.label(distance), "days_bucket", numbered)


def timing_vs_launch(
    flagged: DataFrame,
    edits: DataFrame,
    reviewed: DataFrame,
    launch: dt.date,
    numbered: bool = False,
) -> DataFrame:
    """Edits of flagged listings by distance to the day enforcement began; sorted, or with
    the ``rank`` of each row."""
    days = with_timing(
        of_listings(per_listing_day(edits), flagged), of_listings(reviewed, flagged)
    )
    distance = days_between(F.col("change_date"), F.lit(launch))
    return _histogram(days, distance, AROUND_LAUNCH.label(distance), "days_from_launch", numbered)
