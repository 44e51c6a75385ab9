"""Seller roll-ups.

Edits are summed up per listing and day, then per listing, before they meet the
sellers. No step counts distinct values, because each keeps one row per listing,
and no many-to-many join of listings and edits is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.functions.text import has_word
from policyscan.operators.edits import of_listings, per_listing_day, with_timing
from policyscan.operators.sellers import flagged_listings
from policyscan.plans.evasion import with_evasion_type
from policyscan.rules import bank

TIMINGS = {
    "before_review": "changed_before_review",
    "after_review": "changed_after_review",
    "never_reviewed": "changed_never_reviewed",
}
# What each signal looks for in an altered title.
ADDED_WORDS = {
    "added_faux": ("faux",),
    "added_taxidermy": ("taxidermy",),
    "added_costume": ("costume",),
    "pivoted_material": ("sheepskin", "shearling"),
}
REMOVED_WORDS = {
    "removed_fur": ("fur",),
    "removed_species": bank.SPECIES_WORDS,
    "removed_real_genuine": bank.AUTHENTIC_WORDS,
}


def _title_signals() -> dict[str, Column]:
    before, after = F.col("title_before"), F.col("title_after")
    signals = {name: has_word(after, words) for name, words in ADDED_WORDS.items()}
    signals |= {
        name: has_word(before, words) & ~has_word(after, words)
        for name, words in REMOVED_WORDS.items()
    }
    signals["had_pelz"] = has_word(before, ("pelz",))
    # NULL where the title did not change, so that a seller without any title
    # edit has no value rather than "no".
    return {
        f"any_{name}": F.bool_or(F.when(F.col("title_changed"), test))
        for name, test in signals.items()
    }


def _edits_when(timing: str) -> Column:
    counted = F.when(F.col("change_timing") == timing, F.col("edits")).otherwise(0)
    return F.sum(counted)


def _listing_timing(days: DataFrame, reviewed: DataFrame, *measures: Column) -> DataFrame:
    """One row per edited listing from rows per listing and day."""
    return (
        with_timing(days, reviewed)
        .groupBy("listing_id")
        .agg(
            F.sum("edits").alias("edits"),
            *[_edits_when(timing).alias(f"edits_{name}") for name, timing in TIMINGS.items()],
            *measures,
        )
    )


def seller_signals(
    flagged: DataFrame,
    master: DataFrame,
    edits: DataFrame,
    reviewed: DataFrame,
    parity: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """One row per seller of flagged listings, with seven evasion signals.

    ``parity`` multiplies the three edit counts by the seller's flagged listings
    and retitled listings, which is what joining the three sets on the seller
    alone would count; the default counts every edit once.
    """
    signals = _title_signals()
    days = of_listings(per_listing_day(edits, **signals), flagged)
    per_listing = _listing_timing(
        days,
        of_listings(reviewed, flagged),
        F.min("days_vs_review").alias("first_days"),
        F.max("days_vs_review").alias("last_days"),
        *[F.bool_or(name).alias(name) for name in signals],
    )
    # Rows without a seller are counted, but no edit belongs to them.
    owned = flagged_listings(flagged, master).alias("owned")
    joined = owned.join(
        per_listing.alias("edited"),
        (F.col("owned.listing_id") == F.col("edited.listing_id"))
        & F.col("owned.seller_user_id").isNotNull(),
        "left",
    )
    totals = joined.groupBy("seller_user_id").agg(
        F.count("owned.listing_id").alias("total_fur_listings"),
        F.count("edited.listing_id").alias("listings_with_changes"),
        *[F.coalesce(F.sum(f"edits_{t}"), F.lit(0)).alias(f"edits_{t}") for t in TIMINGS],
        F.max("edits").alias("max_edits_on_one_listing"),
        F.min("first_days").alias("earliest_edit_days_vs_review"),
        F.max("last_days").alias("latest_edit_days_vs_review"),
        *[F.bool_or(name).alias(name) for name in signals],
        F.count("any_added_faux").alias("retitled"),
    )
    times = (
        F.col("total_fur_listings") * F.greatest("retitled", F.lit(1)) if parity else F.lit(1)
    )
    counted = [name for name in signals if name != "any_had_pelz"]
    signal_count = sum((F.col(name).cast("bigint") for name in counted[1:]), F.col(counted[0]).cast("bigint"))
    result = totals.select(
        "seller_user_id",
        "total_fur_listings",
        "listings_with_changes",
        F.try_divide("listings_with_changes", "total_fur_listings").alias("pct_listings_changed"),
        *[(F.col(f"edits_{t}") * times).cast("bigint").alias(f"edits_{t}") for t in TIMINGS],
        "max_edits_on_one_listing",
        "earliest_edit_days_vs_review",
        "latest_edit_days_vs_review",
        *signals,
        signal_count.alias("evasion_signal_count"),
    )
    if not ordered:
        return result
    return result.orderBy(
        F.desc("evasion_signal_count"), F.desc("listings_with_changes"), "seller_user_id"
    )


def seller_breakdown(
    flagged: DataFrame,
    master: DataFrame,
    edits: DataFrame,
    reviewed: DataFrame,
    ordered: bool = False,
) -> DataFrame:
    """One row per seller with edited flagged listings, by timing and listing state."""
    days = of_listings(per_listing_day(edits), flagged)
    per_listing = _listing_timing(days, of_listings(reviewed, flagged))
    owned = flagged_listings(flagged, master).filter(F.col("seller_user_id").isNotNull())
    joined = owned.join(per_listing, "listing_id", "left")
    by_timing = []
    for name in TIMINGS:
        in_group = F.col(f"edits_{name}") > 0
        by_timing += [
            F.count_if(in_group).alias(f"listings_{name}"),
            F.sum(f"edits_{name}").alias(f"edits_{name}"),
            F.count_if(in_group & (F.col("state") == 0)).alias(f"active_{name}"),
            F.count_if(in_group & (F.col("state") != 0)).alias(f"not_active_{name}"),
        ]
    totals = joined.groupBy("seller_user_id").agg(
        F.count("*").alias("total_fur_listings"),
        F.count("edits").alias("listings_with_changes"),
        *by_timing,
        F.max("edits").alias("max_edits_one_listing"),
    )
    share = F.try_divide("listings_with_changes", "total_fur_listings") * 100
    result = totals.filter(F.col("listings_with_changes") > 0).withColumn(
        "pct_changed", F.round(share, 1)
    )
    if not ordered:
        return result
    return result.orderBy(
        F.desc("listings_with_changes"), F.desc("edits_never_reviewed"), "seller_user_id"
    )


def seller_relabel_profile(
    flagged: DataFrame,
    master: DataFrame,
    edits: DataFrame,
    reviewed: DataFrame,
    types: tuple[str, ...] = ("real_to_faux",),
    ordered: bool = False,
) -> DataFrame:
    """Per seller: how many listings were relabelled, when, and what became of them."""
    relabelled = with_evasion_type(edits).filter(F.col("evasion_type").isin(*types))
    still_claims = has_word(F.col("title_after"), bank.AUTHENTIC_WORDS)
    per_listing = of_listings(
        relabelled.groupBy("listing_id").agg(
            F.count("*").alias("edits"),
            F.min("change_date").alias("first_date"),
            F.max("change_date").alias("last_date"),
            F.bool_or(still_claims).alias("still_claims"),
        ),
        flagged,
    )
    joined = (
        flagged_listings(flagged, master)
        .join(per_listing, "listing_id")
        .join(of_listings(reviewed, flagged), "listing_id", "left")
    )
    result = joined.groupBy("seller_user_id").agg(
        F.count("*").alias("listings_relabelled"),
        F.sum("edits").alias("relabelling_edits"),
        F.min("first_date").alias("first_relabel_date"),
        F.max("last_date").alias("last_relabel_date"),
        F.count_if(F.col("state") == 0).alias("active_listings"),
        F.count_if(F.col("state") == 4).alias("removed_listings"),
        F.count_if(~F.col("state").isin(0, 4)).alias("inactive_listings"),
        F.count_if("still_claims").alias("listings_still_claiming"),
        F.count_if(F.col("first_review_date").isNull()).alias("listings_never_reviewed"),
    )
    return result.orderBy(F.desc("listings_relabelled"), "seller_user_id") if ordered else result
