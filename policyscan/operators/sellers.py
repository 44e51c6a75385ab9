"""Sellers of flagged listings and their other listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged_listings(flagged: DataFrame, master: DataFrame) -> DataFrame:
    """Flagged listings that still exist, with seller and state, each once.

    The ids are made distinct by a cheap partial aggregate, and repeated rows of the
    master after the join, when they are few.
    """
    listings = master.select("listing_id", F.col("user_id").alias("seller_user_id"), "state")
    return flagged.select("listing_id").distinct().join(listings, "listing_id").distinct()


def known_sellers(flagged: DataFrame, master: DataFrame) -> DataFrame:
    return flagged_listings(flagged, master).select("seller_user_id").distinct()


def known_seller_listings(flagged: DataFrame, master: DataFrame) -> DataFrame:
    """Every listing of a seller with a flagged listing, each once."""
    listings = master.select("listing_id", F.col("user_id").alias("seller_user_id"), "state")
    known = listings.join(known_sellers(flagged, master), "seller_user_id", "left_semi")
    return known.distinct()


def unflagged_listings(flagged: DataFrame, master: DataFrame) -> DataFrame:
    """The listings of known sellers that are not flagged."""
    return known_seller_listings(flagged, master).join(
        flagged.select("listing_id"), "listing_id", "left_anti"
    )


def with_flagged_marker(listings: DataFrame, flagged: DataFrame) -> DataFrame:
    marker = flagged.select("listing_id").distinct().withColumn("hit", F.lit(True))
    return (
        listings.join(marker, "listing_id", "left")
        .withColumn("was_flagged", F.col("hit").isNotNull())
        .drop("hit")
    )
