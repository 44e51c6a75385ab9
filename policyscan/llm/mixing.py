"""Mixing sources to target weights by temperature, as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyscan.llm.tables import materialized, unused_name

#: A word, the unit in which texts are counted: a run of characters that are no white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a hash that pick the block in which positions are summed.
BLOCK_DIGITS = 3
#: Exponents that one pass over the sources' totals tries.
TRIED = 15


@dataclass(frozen=True)
class Mixture:
    """What the weights, shares of the sources raised to an exponent, must meet.

    ``entropy`` (in nats) is reached with the largest exponent that does, ``repetition``
    bounds how often a source's text is used with the smallest exponent that does; one of
    the two is given. ``budget`` is the size of the mixture in tokens; without one it is the
    least in which every source is used whole at least once. ``block`` is the size of a
    block in tokens, ``seed`` picks the permutations.
    """

    entropy: float | None = None
    repetition: float | None = None
    budget: int | None = None
    block: int = 1 << 20
    seed: int = 0


def words(text: str = "text") -> Column:
    """Tokens of a text column: its words, at least 1 so that every row has a place."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))).cast("long")


def _bisected(low: float, high: float, holds: Callable[[Sequence[float]], list[bool]]) -> float:
    """The least number at which a condition holds that holds from some number on; ``high``
    if none does. Each call tries ``TRIED`` numbers between the ends."""
    if holds([low])[0]:
        return low
    while high - low > 1e-12:
        tried = [low + (high - low) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
        first = next((i for i, met in enumerate(holds(tried)) if met), TRIED)
        low, high = tried[first - 1] if first else low, tried[first] if first < TRIED else high
    return high


def exponent(sources: DataFrame, how: Mixture) -> tuple[float, int]:
    """The exponent, to six places, and the budget, from the sources' ``tokens``.

    Only sums over all sources come to the driver, a few per exponent that is tried.
    """
    least, most, total = sources.agg(F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    if not total:
        return 1.0, 0
    log = F.log(F.col("tokens") / F.lit(float(most)))

    def sums(exponents: Sequence[float]) -> list[tuple[float, float]]:
        row = sources.agg(*[s for e in exponents for s in (F.sum(F.exp(log * e)), F.sum(F.exp(log * e) * log))]).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def spread(e: float, z: float, weighted: float) -> float:
        return math.log(z) - e * weighted / z

    def repeated(e: float, z: float) -> float:
        budget = how.budget or most * z
        return max(budget * (t / most) ** e / z / t for t in (least, most))

    def met(exponents: Sequence[float]) -> list[bool]:
        found = sums(exponents)
        if how.repetition is not None:
            return [repeated(e, z) <= how.repetition * (1 + 1e-12) for e, (z, _) in zip(exponents, found, strict=True)]
        return [spread(e, *f) <= how.entropy for e, f in zip(exponents, found, strict=True)]

    best = round(_bisected(0.0, 1.0, met), 6)
    return best, how.budget or math.ceil(most * sums([best])[0][0])


@dataclass(frozen=True)
class Plan:
    """``sources``: source, tokens, weight, budget, epochs; ``blocks`` of the whole mixture."""

    sources: DataFrame
    exponent: float
    budget: int
    blocks: int


def plan(documents: DataFrame, how: Mixture, tokens: Column) -> Plan:
    """Weights and token budgets of the sources of ``documents``; null is a source."""
    totals = materialized(documents.groupBy("source").agg(F.sum(tokens).alias("tokens")), "sources")
    best, budget = exponent(totals, how)
    whole = totals.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(best)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens").cast("double"), F.lit(best)) / F.lit(whole)
    share = F.round(F.col("weight") * F.lit(float(budget)))
    if how.repetition is not None:
        # Neither the rounded exponent nor the rounded share goes beyond the limit.
        share = F.least(share, F.floor(F.lit(how.repetition) * F.col("tokens")))
    weighted = totals.withColumn("weight", weight).withColumn("budget", share.cast("long"))
    sources = weighted.withColumn("epochs", F.ceil(F.col("budget") / F.col("tokens")).cast("int"))
    return Plan(materialized(sources, "weights"), best, budget, max(1, -(-budget // how.block)))


def _rank(seed: int, epoch: Column) -> Column:
    """The hash that orders a document in an epoch."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def placed(documents: DataFrame, how: Mixture, plan: Plan, tokens: Column) -> DataFrame:
    """Every use of a document: doc_id, source, epoch, tokens, start, block and slot.

    Each epoch of a source is a permutation of all its documents by their hash; ``start`` is
    the number of the source's tokens before. A source is used until its budget is spent, the
    last document whole. It is spread evenly over the blocks of the mixture, so that each
    block has the weights of the whole; ``slot`` permutes a block.

    Sums run within hash blocks of an epoch and then over the blocks' totals, so a large
    source never meets in one task, and equal rows (doc_id, source, tokens) are counted first.
    """
    kinds = documents.select("doc_id", "source", tokens.alias("tokens")).groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("_copies"))
    budgets = plan.sources.select(F.col("source").alias("_source"), F.col("tokens").alias("_total"), "budget", "epochs")
    used = (
        kinds.join(budgets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epoch", F.explode(F.expr("sequence(0, epochs - 1)")))
        .withColumn("_rank", _rank(how.seed, F.col("epoch")))
        .withColumn("_part", F.substring("_rank", 1, BLOCK_DIGITS))
    )
    group = ["source", "epoch", "_part"]
    sums = used.groupBy(*group).agg(F.sum(F.col("tokens") * F.col("_copies")).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source", "epoch").orderBy("_part")) - F.col("_sum")
    starts = sums.select(*[F.col(g).alias(f"{g}_") for g in group], before.alias("_before"))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("epoch") == F.col("epoch_")) & (F.col("_part") == F.col("_part_"))
    own = F.col("tokens") * F.col("_copies")
    within = F.sum(own).over(Window.partitionBy(*group).orderBy("_rank", "doc_id", "tokens")) - own
    first = F.col("epoch") * F.col("_total") + F.col("_before") + F.col("_within")
    uses = (
        used.withColumn("_within", within).join(starts, same).withColumn("_first", first)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .withColumn("start", F.col("_first") + F.col("_copy") * F.col("tokens"))
        .where("start < budget")
        .withColumn("block", F.least(F.floor(F.col("start").cast("double") * F.lit(plan.blocks) / F.col("budget")), F.lit(plan.blocks - 1)).cast("long"))
    )
    inside = Window.partitionBy("block").orderBy(F.md5(F.concat_ws(":", "_rank", "_copy").cast("binary")), "source", "doc_id", "tokens", "_copy")
    slots = uses.withColumn("slot", F.row_number().over(inside) - 1)
    return slots.select("doc_id", "source", "epoch", "tokens", "start", "block", "slot")


def mixed(documents: DataFrame, how: Mixture) -> DataFrame:
    """The rows of ``documents``, each as often as the mixture uses it, with all columns.

    The texts are not shuffled: what decides over a row in its source's last epoch is only
    whether its hash comes before the hash at which the budget is spent. Equal rows there
    come and go together.
    """
    count = words()
    found = plan(documents, how, count)
    uses = placed(documents, how, found, count)
    last = found.sources.select(F.col("source").alias("_source"), (F.col("epochs") - 1).alias("_last"))
    ends = (
        uses.withColumn("_rank", _rank(how.seed, F.col("epoch"))).join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_last")))
        .groupBy("_source", "_last").agg(F.max("_rank").alias("_end"))
    )
    names = {n: unused_name(documents, n) for n in ("_source", "_last", "_end", "_epoch")}
    ends = materialized(ends, "mixture-ends").withColumnsRenamed({n: names[n] for n in ("_source", "_last", "_end")})
    epoch, final = F.col(names["_epoch"]), F.col(names["_last"])
    again = documents.join(ends, documents["source"].eqNullSafe(F.col(names["_source"])))
    again = again.withColumn(names["_epoch"], F.explode(F.sequence(F.lit(0), final)))
    taken = again.where((epoch < final) | (_rank(how.seed, epoch) <= F.col(names["_end"])))
    return taken.select(*[f"`{c}`" for c in documents.columns])
