from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from policyscan.llm import mixing
from policyscan.llm.mixing import Mixture

from .tables import documents


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("big", 400), ("mid", 120), (None, 60), ("small", 30)):
        rows += [(source, "w " * rng.randrange(1, 60)) for _ in range(n)]
    df = documents(spark, [t for _, t in rows])
    sources = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, own string")
    return df.join(sources, "doc_id").withColumn("source", F.col("own")).drop("own")


def totals(df):
    out = Counter()
    for r in df.collect():
        out[r.source] += max(1, len((r.text or "").split()))
    return out


@pytest.mark.parametrize("repetition", [1.0, 1.5, 3.0, 1e6])
def test_the_exponent_meets_the_repetition_limit(spark, repetition):
    df = corpus(spark)
    found = mixing.plan(df, Mixture(repetition=repetition), mixing.words())
    tokens = totals(df)
    wanted = max(0.0, 1 - math.log(repetition) / math.log(max(tokens.values()) / min(tokens.values())))
    assert found.exponent == pytest.approx(wanted, abs=2e-6)
    rows = found.sources.collect()
    assert sum(r.weight for r in rows) == pytest.approx(1)
    assert all(r.budget <= repetition * r.tokens + 1 for r in rows)
    assert all(r.budget >= r.tokens for r in rows if r.source == "big")


def test_the_exponent_meets_the_entropy(spark):
    df = corpus(spark)
    tokens = totals(df)
    found = mixing.plan(df, Mixture(entropy=1.25, budget=50_000), mixing.words())
    powers = {s: t**found.exponent for s, t in tokens.items()}
    shares = [p / sum(powers.values()) for p in powers.values()]
    assert -sum(p * math.log(p) for p in shares) == pytest.approx(1.25, abs=1e-4)
    assert sum(r.budget for r in found.sources.collect()) == pytest.approx(50_000, abs=4)


def test_uses_are_whole_epochs_and_budgets_in_blocks(spark):
    df = corpus(spark)
    how = Mixture(repetition=2.0, block=500)
    found = mixing.plan(df, how, mixing.words())
    uses = mixing.placed(df, how, found, mixing.words()).collect()
    budgets = {r.source: r for r in found.sources.collect()}
    by_source = defaultdict(list)
    for u in uses:
        by_source[u.source].append(u)
    for source, own in by_source.items():
        own.sort(key=lambda u: u.start)
        at = 0
        for u in own:
            assert u.start == at and u.start < budgets[source].budget
            at += u.tokens
        assert at >= budgets[source].budget
        ids = {u.doc_id for u in own}
        for epoch in range(budgets[source].epochs - 1):
            assert {u.doc_id for u in own if u.epoch == epoch} == ids
        blocks = Counter()
        for u in own:
            blocks[u.block] += u.tokens
        even = budgets[source].budget / found.blocks
        assert set(blocks) == set(range(found.blocks)) or even < 120
        assert all(abs(n - even) <= 120 for n in blocks.values())
    slots = defaultdict(list)
    for u in uses:
        slots[u.block].append(u.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    orders = [[u.doc_id for u in by_source["small"] if u.epoch == e] for e in (0, 1)]
    assert orders[0] != orders[1][: len(orders[0])]


def test_mixed_rows_equal_the_uses(spark):
    df = corpus(spark).withColumn("_source", F.lit("x")).withColumn("_EPOCH", F.lit(1)).withColumn("_end", F.lit(1))
    how = Mixture(repetition=2.5)
    uses = mixing.placed(df, how, mixing.plan(df, how, mixing.words()), mixing.words())
    rows = mixing.mixed(df, how)
    assert rows.columns == df.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in uses.collect())


def test_repeated_empty_and_null_rows(spark):
    df = documents(spark, ["a b"] * 30 + [None, "", "c " * 5000], ids=[1] * 30 + [None, 2, 3])
    how = Mixture(repetition=2.0)
    uses = mixing.placed(df, how, mixing.plan(df, how, mixing.words()), mixing.words()).collect()
    assert Counter(u.doc_id for u in uses) == {1: 30, None: 1, 2: 1, 3: 1}
    assert len({u.start for u in uses}) == 33
    assert mixing.mixed(df, how).count() == 33
    empty = documents(spark, [])
    assert mixing.mixed(empty, how).count() == 0
