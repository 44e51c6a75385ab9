"""Seller roll-ups on hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest

from checks.compare import spark_rows
from policyscan.operators import edits as E
from policyscan.plans import changes, evasion, reactivation, sellers, words
from tests import tables as t


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [
        t.entry(1, 1, 1, title=("Real Fox Fur", "Faux Costume")),
        t.entry(1, 2, 2, title=("Faux Costume", "Sheepskin Pelz")),
        t.entry(1, 9, 3, desc=("a", "b")),
        t.entry(2, 3, 4, title=("Pelz", "Real Pelz")),
        t.entry(3, 3, 5, desc=("a", "b")),
        t.entry(5, 3, 6, title=("Fox", "Faux")),
        t.entry(6, 3, 7, title=("Fox", "Faux")),
    ]
    edits = E.content_edits(t.change_log(spark, rows), t.DAY0.date())
    owners = t.master(
        spark, [(1, 10, 0), (2, 10, 1), (3, 20, None), (4, 30, 0), (5, None, 0), (6, 40, 4)]
    )
    return t.ids(spark, 1, 2, 3, 4, 5, 6, 99), owners, edits, t.reviewed(spark, {1: 2, 6: 3})


def by_seller(df):
    return {r.seller_user_id: r for r in df.collect()}


def test_signals_count_every_edit_once(inputs):
    got = by_seller(sellers.seller_signals(*inputs))
    assert set(got) == {10, 20, 30, 40, None}
    first = got[10]
    assert (first.total_fur_listings, first.listings_with_changes) == (2, 2)
    assert first.pct_listings_changed == 1.0
    assert (first.edits_before_review, first.edits_after_review, first.edits_never_reviewed) == (1, 2, 1)
    assert first.max_edits_on_one_listing == 3
    assert (first.earliest_edit_days_vs_review, first.latest_edit_days_vs_review) == (-1, 7)
    assert first.any_added_faux and first.any_added_costume and first.any_pivoted_material
    assert first.any_removed_fur and first.any_removed_species and first.any_removed_real_genuine
    assert not first.any_added_taxidermy and first.any_had_pelz
    assert first.evasion_signal_count == 6


def test_no_title_edit_means_no_score(inputs):
    got = by_seller(sellers.seller_signals(*inputs, ordered=True))
    assert got[20].evasion_signal_count is None and got[20].any_added_faux is None
    assert got[20].edits_never_reviewed == 1
    assert (got[30].listings_with_changes, got[30].edits_never_reviewed) == (0, 0)
    assert got[30].max_edits_on_one_listing is None


def test_listings_without_a_seller_get_no_edits(inputs):
    got = by_seller(sellers.seller_signals(*inputs))
    assert (got[None].total_fur_listings, got[None].listings_with_changes) == (1, 0)


def test_parity_multiplies_by_listings_and_retitled_listings(inputs):
    plain = by_seller(sellers.seller_signals(*inputs))
    parity = by_seller(sellers.seller_signals(*inputs, parity=True))
    assert parity[10].edits_after_review == plain[10].edits_after_review * 2 * 2
    assert parity[20].edits_never_reviewed == 1
    assert parity[10].max_edits_on_one_listing == plain[10].max_edits_on_one_listing


def test_breakdown_by_timing_and_state(inputs):
    got = by_seller(sellers.seller_breakdown(*inputs, ordered=True))
    assert set(got) == {10, 20, 40}
    first = got[10]
    assert first.pct_changed == 100.0
    assert (first.listings_before_review, first.active_before_review) == (1, 1)
    assert (first.listings_after_review, first.edits_after_review) == (1, 2)
    assert (first.listings_never_reviewed, first.not_active_never_reviewed) == (1, 1)
    unknown_state = got[20]
    assert unknown_state.listings_never_reviewed == 1
    assert unknown_state.active_never_reviewed == unknown_state.not_active_never_reviewed == 0


def test_relabel_profile(inputs):
    got = by_seller(sellers.seller_relabel_profile(*inputs, ordered=True))
    first = got[10]
    assert (first.listings_relabelled, first.relabelling_edits) == (1, 1)
    assert first.first_relabel_date == dt.date(2020, 1, 2)
    assert (first.active_listings, first.listings_still_claiming) == (1, 0)
    assert (got[40].removed_listings, got[40].listings_never_reviewed) == (1, 0)
    wider = sellers.seller_relabel_profile(*inputs, types=("real_to_faux", "real_to_neutral"))
    assert by_seller(wider)[10].relabelling_edits >= first.relabelling_edits


def test_repeated_ids_and_master_rows_do_not_count_again(spark, inputs):
    flagged, owners, edits, reviewed = inputs
    twice = (flagged.unionAll(flagged), owners.unionAll(owners), edits, reviewed)
    for plan in (sellers.seller_signals, sellers.seller_breakdown, sellers.seller_relabel_profile):
        assert spark_rows(plan(*twice)) == spark_rows(plan(*inputs))
    for plan in (evasion.unflagged_evasion_monthly, evasion.unflagged_evasion_detail):
        some = t.ids(spark, 1, 1, 3)
        assert spark_rows(plan(edits, some, owners.unionAll(owners))) == spark_rows(plan(edits, t.ids(spark, 1, 3), owners))


def test_repeated_rows_do_not_count_again_in_reactivations(spark):
    log = t.change_log(spark, [t.entry(n, 1, n, title=("a", "Real Fur"), state=(1, 0)) for n in (1, 2, 3)])
    owners = t.master(spark, [(1, 10, 0), (2, 10, 0), (3, 20, 0)])
    once = reactivation.reactivation_summary(log, t.ids(spark, 1, 3), owners, t.DAY0.date())
    again = reactivation.reactivation_summary(
        log, t.ids(spark, 1, 1, 3), owners.unionAll(owners), t.DAY0.date()
    )
    assert spark_rows(again) == spark_rows(once)


def ranks(df, *keys):
    """The sort keys of the rows in the order they came; nulls last where descending."""
    return [tuple(key(row) for key in keys) for row in df.collect()]


def test_ordered_results_are_sorted(inputs):
    flagged, owners, edits, reviewed = inputs
    high = lambda name: lambda r: (r[name] is None, -(r[name] or 0))
    low = lambda name: lambda r: (r[name] is not None, r[name] or 0)
    for df, keys in (
        (
            sellers.seller_signals(*inputs, ordered=True),
            (high("evasion_signal_count"), high("listings_with_changes"), low("seller_user_id")),
        ),
        (
            sellers.seller_breakdown(*inputs, ordered=True),
            (high("listings_with_changes"), high("edits_never_reviewed"), low("seller_user_id")),
        ),
        (
            sellers.seller_relabel_profile(*inputs, ordered=True),
            (high("listings_relabelled"), low("seller_user_id")),
        ),
        (
            changes.change_history(flagged, edits, reviewed, ordered=True),
            (low("listing_id"), low("change_num")),
        ),
        (
            words.word_swaps(flagged, edits, reviewed),
            (lambda r: r.direction, high("listings_affected"), lambda r: r.change_timing, lambda r: r.word),
        ),
        (
            evasion.evasion_detail(changes.change_history(flagged, edits, reviewed), ordered=True),
            (lambda r: r.change_timing, low("listing_id"), low("change_num")),
        ),
    ):
        found = ranks(df, *keys)
        assert found and found == sorted(found)
