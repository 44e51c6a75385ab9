"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyscan.llm.tables import uniform, unused_name

#: Hexadecimal digits of a hash that pick the block in which a slot is numbered.
BLOCK_DIGITS = 3


def _key_text(key: str) -> Column:
    """A null key is a key of its own, different from the empty text."""
    column = F.col(f"`{key}`").cast("string")
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column))


def _draw(key: str, shard: Column, weight: Column) -> Column:
    """How much a shard wants a key, smallest first: exponential with the weight as rate."""
    return -F.log(uniform(_key_text(key), shard.cast("string"))) / weight


def with_shard(
    df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0
) -> DataFrame:
    """Every row with the shard of its key, 0 to ``len(weights) - 1``.

    Each shard draws a number for each key; the smallest gets it. A shard so gets keys in
    proportion to its weight, and a shard that is added or removed moves only the keys that
    it wins or had. ``grown``, if named, holds the shard after one more shard of
    ``grown_weight`` was added: its own number or the old shard.

    No shuffle. Rows with one key share a shard; a null key counts as one key. Columns
    named ``shard`` and ``grown`` are replaced, all others stay.
    """
    if not weights or min([*weights, grown_weight]) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights)
    heaviness = F.array(*[F.lit(float(w)) for w in weights])
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda s: F.struct(_draw(key, s, F.get(heaviness, s)).alias("draw"), s.alias("shard")),
    )
    best = F.array_min(draws)
    if grown is None:
        return df.withColumn(shard, best["shard"])
    drawn = unused_name(df, "_drawn")
    wins = _draw(key, F.lit(n), F.lit(float(grown_weight))) < best["draw"]
    # One generated row, so that the draws are made once and not for each use.
    return (
        df.select("*", F.explode(F.array(F.struct(best["shard"].alias("own"), F.when(wins, F.lit(n)).otherwise(best["shard"]).alias("more")))).alias(drawn))
        .withColumn(shard, F.col(drawn)["own"])
        .withColumn(grown, F.col(drawn)["more"])
        .drop(drawn)
    )


def numbered(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row with its slot in its shard, gapless from 0.

    Slots follow the hash of the row and then its columns, so they depend on the rows of a
    shard alone and not on files or tasks. Equal rows are counted first and spread again at
    the end; distinct rows are numbered in ``16 ** BLOCK_DIGITS`` blocks a shard, each of
    which starts where the sum of the blocks before it ends. So neither a large shard nor a
    key that is repeated often meets in one task.
    """
    columns = [f"`{c}`" for c in df.columns]
    whole = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]).cast("binary"))
    kinds = df.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_hash", whole).withColumn("_block", F.substring("_hash", 1, BLOCK_DIGITS))
    blocks = kinds.groupBy(F.col(f"`{shard}`"), "_block").agg(F.sum("_copies").alias("_rows"))
    before = Window.partitionBy(f"`{shard}`").orderBy("_block")
    starts = blocks.select(
        F.col(f"`{shard}`").alias("_of"), F.col("_block").alias("_at"), (F.sum("_rows").over(before) - F.col("_rows")).alias("_start")
    )
    within = Window.partitionBy(f"`{shard}`", "_block").orderBy("_hash", *columns)
    first = F.sum("_copies").over(within) - F.col("_copies")
    return (
        kinds.withColumn("_first", first)
        .join(starts, F.col(f"`{shard}`").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
        .select(*columns, F.col("_start"), F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias("_slot"))
        .select(*columns, (F.col("_start") + F.col("_slot")).alias(slot))
    )


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """Sizes, checksums, shards and slots of documents; the text itself is not shuffled.

    ``size`` is the UTF-8 length of the text plus 8, 8 for a null text, whose checksum is
    null. An empty table gives no rows; repeated rows get slots of their own.
    """
    measured = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = with_shard(measured, "doc_id", [1.0] * shards, grown="grown_shard")
    return numbered(placed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
