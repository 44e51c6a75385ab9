"""The physical plans keep the properties the design relies on."""

from __future__ import annotations

import re

import pytest

from checks.catalogue import QUERIES
from tests.conftest import executed_plan, optimized_plan


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffled"])
def joins(spark, request):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, request.param)
    yield request.param
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", ["change_history", "reactivation_screen_gap"])
def test_both_branches_read_one_shuffle(spark, folder, joins, name):
    plan = executed_plan(QUERIES[name](spark, folder))
    spread = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    made = [re.search(r"hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", l))[1] for l in spread if "Reused" not in l]
    assert len(made) == len(set(made)) and len(spread) > len(made)


def _above(lines: list[str], at: int) -> list[str]:
    """The operators that a line of a plan feeds, the nearest first."""
    depth, found = re.match(r"[ :+|-]*", lines[at]).end(), []
    for line in reversed(lines[:at]):
        here = re.match(r"[ :+|-]*", line).end()
        if here < depth:
            depth = here
            found.append(line)
    return found


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stored_")))
def test_a_stored_history_is_not_moved(spark, folder, joins, name):
    lines = executed_plan(QUERIES[name](spark, folder)).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert scans
    for scan in scans:
        above = _above(lines, scan)
        summed = [i for i, line in enumerate(above) if "HashAggregate" in line][1]
        assert not any("Exchange" in line for line in above[:summed])


def test_change_log_is_summed_before_it_is_joined(spark, folder, joins):
    plan = executed_plan(QUERIES["timing_vs_review"](spark, folder))
    semi, total = plan.index("LeftSemi"), plan.index("keys=[listing_id")
    log_scan = plan.index("l_partkey")
    partial = plan.rindex("partial_count", 0, log_scan)
    # Small id sets filter the log itself; large ones meet the daily sums.
    assert (semi > partial) == (joins == "10MB")
    assert total < log_scan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_or_python_in_plans(spark, folder, name):
    plan = optimized_plan(QUERIES[name](spark, folder))
    assert "Join Cross" not in plan and "Python" not in plan and "Pandas" not in plan
    assert not re.search(r"Join (Inner|LeftOuter)\n", plan)


def test_top_words_are_limited_per_task(spark, folder):
    assert executed_plan(QUERIES["word_swaps"](spark, folder)).count("WindowGroupLimit") == 2


def test_titles_of_other_listings_are_not_split_into_words(spark, folder, joins):
    lines = executed_plan(QUERIES["word_swaps"](spark, folder)).splitlines()
    explode = next(i for i, line in enumerate(lines) if "Generate explode(words" in line)
    semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    scan = next(i for i, line in enumerate(lines) if "l_partkey" in line and "FileScan" in line)
    # The plan is read from the result down to the scans.
    assert any(explode < i < scan for i in semi)


def test_descriptions_of_candidates_only_are_tested(spark, folder, joins):
    plan = optimized_plan(QUERIES["reactivation_screen"](spark, folder))
    lines = plan.splitlines()
    claims = next(i for i, line in enumerate(lines) if "RLIKE(lower(coalesce(description" in line)
    assert "Join LeftSemi" in "\n".join(lines[claims : claims + 3])


def test_reviews_of_high_listings_only_are_moved(spark, folder, joins):
    lines = executed_plan(QUERIES["reactivation_screen_gap"](spark, folder)).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "o_custkey" in line]
    shuffled = next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line and "latest_review_date" in line)
    assert len(scans) == 1 and any("LeftSemi" in line for line in lines[shuffled : scans[0]])


def test_unflagged_listings_come_from_an_anti_join(spark, folder):
    assert "LeftAnti" in optimized_plan(QUERIES["unflagged_evasion_monthly"](spark, folder))


def test_match_rule_is_decided_once(spark, folder):
    plan = optimized_plan(QUERIES["screen_listings"](spark, folder))
    assert plan.count("THEN EXCLUDED_PET_MEMORIAL") == 1
    assert plan.count("faux|synthetic|vegan|fake") == 1


def test_descriptions_do_not_cross_a_shuffle(spark, folder, joins):
    plan = optimized_plan(QUERIES["screen_listings"](spark, folder))
    tags_join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    above = plan[: plan.index("says_faux")]
    assert tags_join and "description" not in above


def test_only_used_columns_are_read(spark, folder):
    plan = executed_plan(QUERIES["first_review"](spark, folder))
    assert "o_totalprice" not in plan.split("ReadSchema")[1]
    assert "PushedFilters: [" in plan
