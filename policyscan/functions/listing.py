"""Listing states and small listing-level labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyscan.functions.buckets import first_match

# Listing state codes.
ACTIVE, INACTIVE, SOLDOUT, DRAFT, REMOVED, EXPIRED = range(6)
NAMED_PRIOR_STATES = {
    INACTIVE: "INACTIVE",
    SOLDOUT: "SOLDOUT",
    DRAFT: "DRAFT",
    EXPIRED: "EXPIRED",
}


def prior_state(state: Column) -> Column:
    """Name of the state a listing came from; other codes print as the number."""
    named = F.create_map(
        *[F.lit(v) for code, name in NAMED_PRIOR_STATES.items() for v in (code, name)]
    )
    return F.coalesce(F.try_element_at(named, state.cast("int")), state.cast("string"))


def review_timing(changed_on: Column, reviewed_on: Column) -> Column:
    """Where an edit stands to the first review; the review day counts as after."""
    return first_match(
        [
            (reviewed_on.isNull(), "changed_never_reviewed"),
            (changed_on < reviewed_on, "changed_before_review"),
        ],
        "changed_after_review",
    )


def days_between(later: Column, earlier: Column) -> Column:
    """Signed whole days from ``earlier`` to ``later``."""
    return F.datediff(later, earlier).cast("bigint")
