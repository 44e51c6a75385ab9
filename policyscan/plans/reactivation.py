"""Listings back on sale with risky titles, and whether a review has seen them since."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.functions.listing import ACTIVE, days_between, prior_state
from policyscan.functions.text import computed_once
from policyscan.operators.edits import of_listings, since_bound
from policyscan.operators.reactivations import (
    one_day,
    reactivation_rollup,
    reactivations,
    risky_reactivations,
)
from policyscan.operators.sellers import known_seller_listings, with_flagged_marker
from policyscan.plans.screen import (
    REACTIVATED,
    candidates,
    classify,
    description_claims,
    emitted,
    is_positive,
    sellable,
    simple_band,
)
from policyscan.rules.bank import BUILT_IN, Bank
from policyscan.sources import sinks

SCREENED_COLUMNS = (
    "listing_id",
    "user_id",
    "title",
    "top_category",
    "past_year_gms",
    "past_year_orders",
)


def watched_listings(flagged: DataFrame, master: DataFrame) -> DataFrame:
    """Listings of known sellers that are on sale today."""
    on_sale = known_seller_listings(flagged, master).filter(F.col("state") == ACTIVE)
    return with_flagged_marker(on_sale.select("listing_id", "seller_user_id"), flagged)


def with_change_counts(listings: DataFrame, edits: DataFrame, flagged: DataFrame) -> DataFrame:
    """Add how often a flagged listing was edited."""
    counts = of_listings(
        edits.groupBy("listing_id").agg(F.count("*").alias("change_count")), flagged
    )
    return (
        listings.join(counts, "listing_id", "left")
        .withColumn("had_changes", F.col("change_count").isNotNull())
        .withColumn("change_count", F.coalesce("change_count", F.lit(0)))
    )


def reactivation_summary(
    change_log: DataFrame, flagged: DataFrame, master: DataFrame, since: dt.date
) -> DataFrame:
    """Listings and sellers by flagged state, prior state and title signal."""
    kinds = (
        risky_reactivations(reactivations(change_log, since))
        .select("listing_id", "came_from_state", "fur_signal_strength")
        .distinct()
    )
    return (
        kinds.join(watched_listings(flagged, master), "listing_id")
        .groupBy("was_flagged", "came_from_state", "fur_signal_strength")
        .agg(
            # Rows are distinct by listing and kind already.
            F.count("*").alias("listings"),
            F.countDistinct("seller_user_id").alias("sellers"),
        )
        .orderBy(F.desc("was_flagged"), F.desc("listings"), "came_from_state", "fur_signal_strength")
    )


def reactivation_detail(
    change_log: DataFrame,
    flagged: DataFrame,
    master: DataFrame,
    edits: DataFrame,
    since: dt.date,
    ordered: bool = False,
) -> DataFrame:
    """Single reactivations of flagged listings with a strong title signal."""
    events = risky_reactivations(reactivations(change_log, since)).filter(
        F.col("fur_signal_strength") == "strong_signal"
    )
    listings = watched_listings(flagged, master).filter("was_flagged")
    detail = events.join(with_change_counts(listings, edits, flagged), "listing_id").select(
        "listing_id",
        "seller_user_id",
        "reactivated_date",
        "came_from_state",
        "fur_signal_strength",
        "current_title",
        "had_changes",
        "change_count",
    )
    if not ordered:
        return detail
    return detail.orderBy(F.desc("reactivated_date"), "listing_id", "came_from_state", "current_title")


def watched_events(events: DataFrame, listings: DataFrame) -> DataFrame:
    """Risky reactivations of watched listings; serves batches and streams alike."""
    alerts = risky_reactivations(events).filter(
        F.col("fur_signal_strength").isin("strong_signal", "species_or_fur")
    )
    return alerts.join(listings, "listing_id")


def daily_reactivations(
    change_log: DataFrame,
    flagged: DataFrame,
    master: DataFrame,
    edits: DataFrame,
    since: dt.date | dt.datetime,
    until: dt.date | dt.datetime,
) -> DataFrame:
    """What the daily job reports for the log entries in ``[since, until)``."""
    listings = with_change_counts(watched_listings(flagged, master), edits, flagged)
    return watched_events(reactivations(change_log, since, until), listings).select(
        "listing_id",
        "seller_user_id",
        "reactivated_date",
        "came_from_state",
        "fur_signal_strength",
        "was_flagged",
        "current_title",
        "had_changes",
        "change_count",
    )


def _shared(rows: DataFrame, *spread: str) -> DataFrame:
    """Rows that several branches of a plan read from one shuffle.

    All columns pass a generator, so each branch asks the shuffle for the same ones.
    """
    key, *rest = rows.columns
    carried = {name: F.col(name) for name in rest}
    return computed_once(rows.repartition(*spread), [key], **carried)


def arrived_days(change_log: DataFrame, as_of: dt.date, retained: int) -> list[dt.date]:
    """Days before ``as_of`` with reactivations that reached the log on the day before it.

    One value per day of the calendar; of the log the last ``retained`` days are read.
    """
    since, until = one_day(as_of)
    new = reactivations(change_log, as_of - dt.timedelta(days=retained), as_of).filter(
        (F.col("arrival_ts") >= since_bound(since)) & (F.col("arrival_ts") < since_bound(until))
    )
    return sorted(r[0] for r in new.select(F.to_date("event_ts")).distinct().collect())


def run_daily_job(
    change_log: DataFrame,
    flagged: DataFrame,
    master: DataFrame,
    edits: DataFrame,
    as_of: dt.date,
    target: str,
    retained: int = 90,
) -> list[dt.date]:
    """Report the last day before ``as_of`` and store it as the run of that date.

    Where the log says when entries arrived (``arrival_ts``), days of the ``retained`` ones
    with entries that arrived late, on that last day, are reported anew as the runs of their
    dates, with all that has arrived. So an entry is reported once however late it comes. The
    dates of the runs that were written are returned, and all of them are replaced at once.

    A rerun replaces a run's report, so what is no longer reported is gone; it knows all
    entries that the last run knew.
    """
    since, until = one_day(as_of)
    days, known = [since.date()], change_log
    if "arrival_ts" in change_log.columns:
        last = sinks.last_run(change_log.sparkSession, target)
        known_until = max(as_of, last) if last else as_of
        known = change_log.filter(F.col("arrival_ts") < since_bound(known_until))
        days = sorted({*days, *arrived_days(change_log, as_of, retained)})
        if "event_date" in known.columns:
            known = known.filter(F.col("event_date").isin(days))
        known = known.filter(F.to_date("event_ts").isin(days))
    report = daily_reactivations(known, flagged, master, edits, days[0], until)
    report = report.withColumn(sinks.RUN_DATE, F.date_add("reactivated_date", 1))
    dates = [day + dt.timedelta(days=1) for day in days]
    sinks.write_runs(report, dates, target)
    return dates


def reactivation_screen(
    change_log: DataFrame,
    listings: DataFrame,
    master: DataFrame,
    tags: DataFrame,
    taxonomy: DataFrame,
    since: dt.date,
    ordered: bool = False,
    rules: Bank = BUILT_IN,
) -> DataFrame:
    """Screening of reactivated listings, on the master's full descriptions."""
    back = reactivation_rollup(reactivations(change_log, since))
    returned = sellable(listings).select(*SCREENED_COLUMNS).join(back, "listing_id")
    found = _shared(candidates(returned, tags, taxonomy, rules), "listing_id")
    # Long descriptions are looked at last, and those of other listings not at all:
    # a small set of candidates filters the master where it is read.
    texts = of_listings(master.select("listing_id", "description"), found)
    claims = description_claims(texts, REACTIVATED, "listing_id", rules=rules)
    described = (
        found.join(claims, "listing_id", "left")
        .withColumn("says_faux", F.coalesce("says_faux", F.lit(False)))
        .withColumn("says_real", F.coalesce("says_real", F.lit(False)))
    )
    screened = emitted(classify(described, rules), REACTIVATED).select(
        "listing_id",
        "user_id",
        "reactivated_date",
        prior_state(F.col("state_before")).alias("came_from_state"),
        "reactivation_count",
        "title",
        "match_rule",
        simple_band(rules).alias("confidence_band"),
        "top_category",
        "full_path",
        "past_year_gms",
        "past_year_orders",
        is_positive().alias("is_fur_trade"),
    )
    return screened.orderBy(*screen_order()) if ordered else screened


def screen_order() -> tuple[Column, ...]:
    """The surest bands first, within them the largest sales, unknown ones last."""
    bands = F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("REVIEW"), F.lit("OTHER"))
    rank = F.array_position(bands, F.col("confidence_band"))
    return rank, F.desc_nulls_last("past_year_gms"), F.col("listing_id")


def review_gap(
    screened: DataFrame, reviews: DataFrame, view: DataFrame, per_listing: bool = False
) -> DataFrame:
    """High-confidence reactivated listings no review has seen since they came back.

    One row per review older than the reactivation, or one without a review;
    ``per_listing`` looks at the latest review of a listing only.
    """
    high = (
        screened.filter((F.col("confidence_band") == "HIGH") & F.col("listing_id").isNotNull())
        .select("listing_id", "user_id", "reactivated_date")
        .join(view.select("listing_id", "is_active"), "listing_id", "left")
    )
    high = _shared(high, "listing_id", "user_id")
    # Of the reviews only those of these few listings are moved.
    seen = of_listings(
        reviews.filter(F.col("content_type") == "listing").select(
            F.col("reference_id").alias("listing_id"),
            "first_review_date",
            F.to_date("latest_review_date").alias("latest_review_date"),
            "in_scope_policy",
        ),
        high,
    )
    if per_listing:
        seen = seen.groupBy("listing_id").agg(
            F.min("first_review_date").alias("first_review_date"),
            F.max("latest_review_date").alias("latest_review_date"),
            F.max_by("in_scope_policy", F.struct("latest_review_date", "in_scope_policy")).alias(
                "in_scope_policy"
            ),
        )
    seen = _shared(seen, "listing_id", "latest_review_date")
    # An outer join could not split the reviews of one listing over tasks; an
    # inner join can, and listings without any review are added.
    outdated = high.join(seen, "listing_id").filter(
        F.col("latest_review_date").isNull()
        | (F.col("reactivated_date") > F.col("latest_review_date"))
    )
    # Not an anti join, which Spark would move below the shared shuffle.
    marker = seen.select("listing_id").distinct().withColumn("any_review", F.lit(True))
    unseen = high.join(marker, "listing_id", "left").filter(F.col("any_review").isNull())
    unseen = unseen.drop("any_review")
    both = outdated.unionByName(unseen, allowMissingColumns=True)
    return both.select(
        "listing_id",
        "user_id",
        "reactivated_date",
        "first_review_date",
        "latest_review_date",
        "in_scope_policy",
        "is_active",
        days_between(F.col("latest_review_date"), F.col("reactivated_date")).alias(
            "days_from_reactivation_to_review"
        ),
    )
