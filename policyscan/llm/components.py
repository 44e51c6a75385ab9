"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyscan.llm.tables import materialized


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for all nodes of ``links``.

    ``links`` has long columns ``a`` and ``b``. Each round hangs the larger neighbours of
    every node, and then its smaller ones, onto its smallest neighbour, until nothing
    changes; the links then point straight to the smallest node. Rounds grow with the
    logarithm of the longest path. Neighbours are never gathered: the smallest is an
    aggregate that is joined back, and a node with very many links is split by the join.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialized(links, "links")
    state = _state(links)
    while state[0]:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")
        )
        links = materialized(smaller.select("l.a", "l.b").where("a <> b").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
