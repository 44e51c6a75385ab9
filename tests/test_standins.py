"""The stand-in tables use every row of the driver's tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.catalogue import QUERIES
from checks.standins import StandIns


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_nothing_is_left_out(spark, scale):
    s = StandIns(spark, f"/root/testdata/{scale}")
    parts = s.source("part").count()
    assert s.change_log().count() == s.source("lineitem").count()
    assert s.listings().count() == s.listing_tags().count() == s.listing_taxonomy().count() == parts
    assert s.active_listings().count() > 0.75 * parts
    assert s.reviews().count() == s.source("orders").count()
    documents = s.source("documents").count()
    assert s.described().select("document").distinct().count() == min(parts, documents)
    assert s.described().filter(F.col("text").isNull()).isEmpty()


def test_some_flagged_listings_have_no_change(spark, folder):
    summary = QUERIES["change_timing_summary"](spark, folder)
    assert not summary.filter("change_timing = 'no_change'").isEmpty()


def test_ordered_screens_are_sorted(spark, folder):
    from policyscan.plans import reactivation, screen
    from checks.standins import REACTIVATED_SINCE

    s = StandIns(spark, folder)
    inputs = s.active_listings(), s.listing_tags(), s.listing_taxonomy()
    rows = screen.screen_listings(*inputs, ordered=True).collect()
    order = [(-r.past_year_gms, r.listing_id) for r in rows]
    assert rows and order == sorted(order)
    screened = reactivation.reactivation_screen(
        s.change_log(), inputs[0], s.listings(), *inputs[1:], REACTIVATED_SINCE, ordered=True
    ).collect()
    bands = ("HIGH", "MEDIUM", "REVIEW", "OTHER")
    order = [(bands.index(r.confidence_band), -r.past_year_gms, r.listing_id) for r in screened]
    assert screened and order == sorted(order)
