from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from policyscan.llm import sharding

from .tables import documents


def test_slots_are_gapless_and_growth_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.shard_documents(documents(spark, [f"text {i % 50}" for i in range(3000)]), 5).collect()
    assert len(rows) == 3000
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
        assert r.size == len(f"text {r.doc_id % 50}") + 8
        assert r.text_crc32 == zlib.crc32(f"text {r.doc_id % 50}".encode())
    assert sorted(slots) == [0, 1, 2, 3, 4]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 5 for r in rows)
    assert 380 < moved < 620  # one sixth of the rows


def test_the_shard_depends_on_the_key_alone_and_growth_equals_a_new_deal(spark):
    keys = spark.range(2000).withColumnRenamed("id", "doc_id")
    old = sharding.with_shard(keys, "doc_id", [1.0] * 7, grown="more")
    new = sharding.with_shard(keys.repartition(9), "doc_id", [1.0] * 8)
    both = old.join(new.withColumnRenamed("shard", "fresh"), "doc_id")
    assert both.where("more <> fresh").isEmpty()


def test_weights_set_the_shares(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "key")
    found = dict(sharding.with_shard(keys, "key", [1.0, 2.0, 5.0]).groupBy("shard").count().collect())
    assert [round(found[s] / 20_000, 1) for s in (0, 1, 2)] == [0.1, 0.2, 0.6] or abs(found[2] / 20_000 - 0.625) < 0.02
    with pytest.raises(ValueError):
        sharding.with_shard(keys, "key", [1.0, 0.0])


def test_nulls_repeats_empty_texts_and_clashing_columns(spark):
    df = documents(spark, [None, "", "x", "x", "x", "long " * 50_000], ids=[None, 1, 2, 2, 2, 3])
    df = df.withColumn("shard", F.lit("own")).withColumn("_block", F.lit(1)).withColumn("_drawn", F.lit(1))
    rows = sharding.shard_documents(df, 3).collect()
    assert Counter(r.doc_id for r in rows) == {None: 1, 1: 1, 2: 3, 3: 1}
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[None].size, by_id[None].text_crc32) == (8, None)
    assert (by_id[1].size, by_id[1].text_crc32) == (8, 0)
    assert len({r.slot for r in rows if r.doc_id == 2}) == 3
    dealt = sharding.with_shard(df, "doc_id", [1.0] * 3, grown="more")
    assert dealt.columns == [*df.columns, "more"] and dict(dealt.dtypes)["shard"] == "int"


def test_an_empty_table(spark):
    assert sharding.shard_documents(documents(spark, []), 3).count() == 0
