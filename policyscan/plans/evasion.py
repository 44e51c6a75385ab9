"""How titles were altered: towards faux, towards neutral, or otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.functions.buckets import first_match
from policyscan.functions.text import computed_once, has_word
from policyscan.operators.edits import of_listings, per_listing_day, retitled, with_timing
from policyscan.operators.sellers import unflagged_listings
from policyscan.rules import bank


def had_signal(title: Column) -> Column:
    return has_word(title, bank.FUR_OR_SPECIES_WORDS) | has_word(title, bank.CLAIM_WORDS)


def is_clean(title: Column) -> Column:
    return ~has_word(title, (*bank.FUR_OR_SPECIES_WORDS, *bank.AUTHENTIC_WORDS))


def evasion_type(before: Column, after: Column) -> Column:
    """``natural`` counts as a signal before, but may stay in a neutral title after."""
    return first_match(
        [
            (has_word(after, ("faux",)), "real_to_faux"),
            (is_clean(after) & had_signal(before), "real_to_neutral"),
        ],
        "other_change",
    )


def with_evasion_type(edits: DataFrame) -> DataFrame:
    return computed_once(
        retitled(edits),
        edits.columns,
        evasion_type=evasion_type(F.col("title_before"), F.col("title_after")),
    )


def evasion_summary(flagged: DataFrame, edits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Flagged listings and their title edits by evasion type and timing."""
    days = of_listings(per_listing_day(with_evasion_type(edits), "evasion_type"), flagged)
    return (
        with_timing(days, of_listings(reviewed, flagged))
        .groupBy("evasion_type", "change_timing")
        .agg(F.countDistinct("listing_id").alias("listings"), F.sum("edits").alias("total_edits"))
        .orderBy("evasion_type", "change_timing")
    )


def evasion_detail(history: DataFrame, ordered: bool = False) -> DataFrame:
    """Edits that left a clean title behind; a clean title may still say "faux"."""
    escaped = retitled(history).filter(
        is_clean(F.col("title_after")) & had_signal(F.col("title_before"))
    )
    detail = escaped.select(
        "listing_id",
        "change_num",
        "change_timing",
        "change_date",
        "days_vs_review",
        "title_before",
        "title_after",
    )
    return detail.orderBy("change_timing", "listing_id", "change_num") if ordered else detail


def _month() -> Column:
    return F.date_format("change_date", "yyyy-MM")


def _evading(edits: DataFrame, *types: str) -> DataFrame:
    return (
        with_evasion_type(edits)
        .filter(F.col("evasion_type").isin(*types))
        .withColumn("change_month", _month())
    )


def unflagged_evasion_monthly(
    edits: DataFrame, flagged: DataFrame, master: DataFrame
) -> DataFrame:
    """Evading edits on unflagged listings of known sellers, by type and month."""
    # Counts per listing and month meet the listings, not single edits.
    months = (
        _evading(edits, "real_to_faux", "real_to_neutral")
        .groupBy("listing_id", "evasion_type", "change_month")
        .agg(F.count("*").alias("edits"))
    )
    return (
        months.join(unflagged_listings(flagged, master), "listing_id")
        .groupBy("evasion_type", "change_month")
        .agg(
            # A listing has one row per type and month, so rows are listings here.
            F.count("*").alias("listings"),
            F.countDistinct("seller_user_id").alias("sellers"),
            F.sum("edits").alias("total_edits"),
        )
        .orderBy("evasion_type", "change_month")
    )


def unflagged_evasion_detail(
    edits: DataFrame, flagged: DataFrame, master: DataFrame, ordered: bool = False
) -> DataFrame:
    """The edits towards neutral on unflagged listings of known sellers."""
    detail = (
        _evading(edits, "real_to_neutral")
        .join(unflagged_listings(flagged, master), "listing_id")
        .select("listing_id", "seller_user_id", "change_month", "title_before", "title_after")
    )
    return detail.orderBy("change_month", "seller_user_id", "listing_id") if ordered else detail
