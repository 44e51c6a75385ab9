"""Distance-in-days histogram labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DayBuckets:
    """Labels for day distances around an anchor date.

    ``before`` pairs an exclusive upper edge with its label, ``after`` an
    inclusive upper edge; ``same`` is distance zero, ``beyond`` is anything
    later. ``missing`` labels a NULL distance when the anchor can be absent.
    """

    before: tuple[tuple[int, str], ...]
    same: str
    after: tuple[tuple[int, str], ...]
    beyond: str
    missing: str | None = None

    def label(self, days: Column) -> Column:
        tests = [(days < edge, text) for edge, text in self.before]
        tests.append((days == 0, self.same))
        tests += [(days <= edge, text) for edge, text in self.after]
        if self.missing is not None:
            tests.insert(0, (days.isNull(), self.missing))
        return first_match(tests, self.beyond)


def first_match(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first test that holds."""
    (test, label), *rest = tests
    chain = F.when(test, F.lit(label))
    for test, label in rest:
        chain = chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def case_sql(tests: list[tuple[str, str]], otherwise: str) -> Column:
    """``first_match`` over SQL conditions; builds a long chain in one call."""
    branches = " ".join(f"WHEN {test} THEN '{label}'" for test, label in tests)
    return F.expr(f"CASE {branches} ELSE '{otherwise}' END")


# Edges and labels of the two histograms.
AROUND_REVIEW = DayBuckets(
    missing="N/A (never reviewed)",
    before=(
        (-30, "< -30 days"),
        (-14, "-30 to -15 days"),
        (-7, "-14 to -8 days"),
        (0, "-7 to -1 days"),
    ),
    same="same day as review",
    after=((7, "+1 to +7 days"), (14, "+8 to +14 days"), (30, "+15 to +30 days")),
    beyond="> +30 days",
)
AROUND_LAUNCH = DayBuckets(
    before=(
        (-30, "< -30 days before launch"),
        (-14, "-30 to -15 days before"),
        (-7, "-14 to -8 days before"),
        (0, "-7 to -1 days before"),
    ),
    same="launch day",
    after=(
        (7, "+1 to +7 days after"),
        (14, "+8 to +14 days after"),
        (30, "+15 to +30 days after"),
    ),
    beyond="> +30 days after",
)
