"""Every registered query agrees with its SQL twin."""

from __future__ import annotations

import pytest

from checks.catalogue import QUERIES
from checks.compare import connect, differences, type_differences
from checks.twins import TWINS


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_twin(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    assert type_differences(df, duck, TWINS[name]) == []
    assert differences(df, duck, TWINS[name]) == []


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
