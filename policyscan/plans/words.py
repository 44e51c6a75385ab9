"""Which words title edits removed and added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policyscan.functions.listing import review_timing
from policyscan.functions.text import title_words
from policyscan.operators.edits import of_listings, retitled

SHORTEST_WORD = 3


def swapped_words(edits: DataFrame) -> DataFrame:
    """One row per word that a title edit removed or added."""
    split = retitled(edits).select(
        "listing_id",
        "change_date",
        title_words(F.col("title_before")).alias("before"),
        title_words(F.col("title_after")).alias("after"),
    )
    either_way = F.array(
        F.struct(
            F.lit("removed").alias("direction"), F.array_except("before", "after").alias("words")
        ),
        F.struct(
            F.lit("added").alias("direction"), F.array_except("after", "before").alias("words")
        ),
    )
    return (
        split.select("listing_id", "change_date", F.inline(either_way))
        .select("listing_id", "change_date", "direction", F.explode("words").alias("word"))
        .filter(F.char_length("word") >= SHORTEST_WORD)
    )


def word_swaps(
    flagged: DataFrame, edits: DataFrame, reviewed: DataFrame, top: int = 50, ordered: bool = True
) -> DataFrame:
    """The words most flagged listings removed from, or added to, their titles."""
    # Titles are narrower than their words, so other listings go before the split.
    # Listings are counted, and timing only moves from before to after a review,
    # so the first and last day a listing swapped a word hold all that is needed.
    spans = (
        swapped_words(of_listings(edits, flagged))
        .groupBy("listing_id", "direction", "word")
        .agg(F.min("change_date").alias("first_day"), F.max("change_date").alias("last_day"))
    )
    reviewed_on = F.col("first_review_date")
    timings = F.array_distinct(
        F.array(
            review_timing(F.col("first_day"), reviewed_on),
            review_timing(F.col("last_day"), reviewed_on),
        )
    )
    counted = (
        spans.join(of_listings(reviewed, flagged), "listing_id", "left")
        .select("direction", "word", F.explode(timings).alias("change_timing"))
        .groupBy("direction", "change_timing", "word")
        .agg(F.count("*").alias("listings_affected"))
    )
    # Two partitions only, but each task passes on its own best rows at most.
    rank = F.row_number().over(
        Window.partitionBy("direction").orderBy(
            F.desc("listings_affected"), "change_timing", "word"
        )
    )
    best = counted.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "direction", "change_timing", "word", "listings_affected"
    )
    if not ordered:
        return best
    return best.orderBy("direction", F.desc("listings_affected"), "change_timing", "word")
