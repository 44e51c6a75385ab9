"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policyscan.llm.tables import materialized
from policyscan.llm.vectors import matrix, usable

#: Vectors of a block of the file, and queries that are searched together.
FILE_BLOCK, QUERY_BLOCK = 4096, 2048
#: Parts of the file at most, and blocks of queries that meet a part together.
FILE_PARTS, QUERIES_AT_ONCE = 32, 8
#: Cells of a dimension, at most 256.
CELLS = 64
#: Queries whose bounds are held at a time.
BOUNDS_AT_ONCE = 128
#: Candidates of a block of queries that are held back while their part of the file is read.
HELD = 1 << 18
#: Exact vectors read for a query at first, times k.
READ_FIRST = 4
#: The scores that a long holds.
LONGEST = 2**63 - 1


def _scaled(column: pd.Series, scale: float) -> np.ndarray:
    """The floor of ``scale`` times each component: integers, as doubles, which hold them exactly."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * matrix(column))
    if not np.isfinite(scaled).all():
        raise ValueError("a scaled component leaves the range of doubles")
    return scaled


def _edges(exact: np.ndarray) -> np.ndarray:
    """The borders of the cells of each dimension (a row), integers; a value is below the next."""
    low, high = exact.min(axis=0), exact.max(axis=0)
    step = np.floor(high / CELLS - low / CELLS) + 1
    edges = low[:, None] + step[:, None] * np.arange(CELLS + 1)
    edges[:, -1] = np.maximum(edges[:, -1], np.nextafter(high, np.inf))
    return edges


def _scores(ones: np.ndarray, twos: np.ndarray) -> list[int]:
    """Exact inner products of the rows of two matrices."""
    largest = max(np.abs(ones).max(initial=0.0), np.abs(twos).max(initial=0.0))
    if largest * largest * max(1, ones.shape[1]) < 2.0**62:
        return (ones.astype(np.int64) * twos.astype(np.int64)).sum(axis=1).tolist()
    return [sum(int(a) * int(b) for a, b in zip(one, two, strict=True)) for one, two in zip(ones, twos, strict=True)]


def _narrow(exact: np.ndarray) -> tuple[str, bytes]:
    """Integers that came as doubles in the shortest type that holds them all, with its name."""
    low, high = exact.min(initial=0), exact.max(initial=0)
    kind = next((t for t in ("int8", "int16", "int32") if np.iinfo(t).min <= low and high <= np.iinfo(t).max), "float64")
    return kind, exact.astype(kind).tobytes()


def _dealt(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Vectors with the block, of about ``size`` rows, that their hash picks."""
    blocks = max(1, -(-vectors.count() // size))
    whole = F.xxhash64("vec_id", "embedding")
    return vectors.withColumn("dims", F.size("embedding")).withColumn("block", F.pmod(whole, F.lit(blocks)).cast("int")), blocks


def approximation_file(vectors: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """One row per block of vectors (row, vec_id, embedding) of one length, and the number of blocks.

    It holds the cells' borders per dimension, the cell numbers of its vectors as bytes, and
    their rows and ids. The exact vectors stay where they are.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        exact = _scaled(pdf["embedding"], scale)
        edges = _edges(exact)
        cells = np.empty(exact.shape, np.uint8)
        for d, borders in enumerate(edges):
            cells[:, d] = np.clip(np.searchsorted(borders, exact[:, d], side="right") - 1, 0, CELLS - 1)
        held = [pdf[c].to_numpy(np.int64).tobytes() for c in ("row", "vec_id")]
        return pd.DataFrame([[*key, edges.tobytes(), cells.tobytes(), *held]], columns=["dims", "block", "edges", "cells", "rows", "ids"])

    dealt, blocks = _dealt(vectors, FILE_BLOCK)
    schema = "dims int, block int, edges binary, cells binary, rows binary, ids binary"
    return dealt.groupBy("dims", "block").applyInPandas(build, schema), blocks


def _query_blocks(queries: DataFrame, scale: float) -> tuple[DataFrame, int]:
    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = [pdf[c].to_numpy(np.int64).tobytes() for c in ("asked", "vec_id")]
        row = [*key, *held, *_narrow(_scaled(pdf["embedding"], scale))]
        return pd.DataFrame([row], columns=["dims", "block", "asked", "query_ids", "kind", "query_vectors"])

    dealt, blocks = _dealt(queries, QUERY_BLOCK)
    schema = "dims int, block int, asked binary, query_ids binary, kind string, query_vectors binary"
    return dealt.groupBy("dims", "block").applyInPandas(gather, schema), blocks


class _Asking:
    """A block of queries that meets a part of the file, block by block."""

    def __init__(self, row, k: int):
        self.asked, self.ids = np.frombuffer(row.asked, np.int64), np.frombuffer(row.query_ids, np.int64)
        self.vectors = np.frombuffer(row.query_vectors, row.kind).reshape(len(self.asked), row.dims)
        #: The k best lower bounds that each query has met.
        self.best = np.full((len(self.asked), k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []

    def meet(self, rows: np.ndarray, ids: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> Iterator[pd.DataFrame]:
        """Hold the vectors of a block that may be among the k best so far, with the bounds of
        their scores; what is too much to hold comes back."""
        for at in range(0, len(self.asked), BOUNDS_AT_ONCE):
            own = slice(at, at + BOUNDS_AT_ONCE)
            part = self.vectors[own].astype(np.float64)
            plus, minus = np.maximum(part, 0), np.minimum(part, 0)
            # Sums of doubles beyond 2^53 are rounded; both bounds give way by more than that.
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.abs(part).sum(axis=1) * max(1.0, np.abs(floor).max(initial=0), np.abs(ceiling).max(initial=0))
                slack = np.where(size < 2.0**52, 0, size * 2.0**-40)[:, None]
                most, least = plus @ ceiling.T + minus @ floor.T + slack, plus @ floor.T + minus @ ceiling.T - slack
            # Bounds that overflow say nothing.
            unknown = ~(np.isfinite(most) & np.isfinite(least) & np.isfinite(slack))
            most[unknown], least[unknown] = np.finfo(np.float64).max, np.finfo(np.float64).min
            other = ids != self.ids[own, None]
            met = np.concatenate([self.best[own], np.where(other, least, -np.inf)], axis=1)
            n = met.shape[1] - self.best.shape[1]
            self.best[own] = np.partition(met, n, axis=1)[:, n:]
            query, vector = np.nonzero(other & (most >= self.best[own].min(axis=1)[:, None]))
            self.held.append((at + query, rows[vector], most[query, vector], least[query, vector]))
            if sum(len(x[0]) for x in self.held) > HELD:
                found = self._open()
                if len(found[0]) > HELD // 2:
                    yield self._frame(found)
                    found = tuple(x[:0] for x in found)
                self.held = [found]

    def left(self) -> pd.DataFrame:
        """The held vectors that may be among the k best of all that were met."""
        return self._frame(self._open())

    def _open(self) -> tuple[np.ndarray, ...]:
        query, rows, most, least = map(np.concatenate, zip(*self.held, strict=True))
        still = most >= self.best.min(axis=1)[query]
        return query[still], rows[still], most[still], least[still]

    def _frame(self, found: tuple[np.ndarray, ...]) -> pd.DataFrame:
        query, rows, most, least = found
        return pd.DataFrame({"asked": self.asked[query], "row": rows, "most": most, "least": least})


def _bounds(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The candidates of the cells of a partition, in each of which blocks of queries come first."""
    cell: tuple = ()
    asking: list[_Asking] = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if cell != (row.dims, row.part, row.queries):
                yield from (block.left() for block in asking if block.held)
                cell, asking = (row.dims, row.part, row.queries), []
            if row.edges is None:
                asking.append(_Asking(row, k))
                continue
            rows, ids = np.frombuffer(row.rows, np.int64), np.frombuffer(row.ids, np.int64)
            edges = np.frombuffer(row.edges, np.float64).reshape(row.dims, CELLS + 1)
            cells = np.frombuffer(row.cells, np.uint8).reshape(len(ids), row.dims)
            places = np.arange(row.dims)
            floor, ceiling = edges[places, cells], edges[places, cells + np.int64(1)] - 1
            for block in asking:
                yield from block.meet(rows, ids, floor, ceiling)
    yield from (block.left() for block in asking if block.held)


def _candidates(vectors: DataFrame, queries: DataFrame, k: int, scale: float) -> DataFrame:
    """For each query the vectors that may be among its k best of a part of the file, with the
    bounds of their scores.

    Blocks are dealt, never joined: a join could send what its sides are copied to by way of the driver.
    """
    file, blocks = approximation_file(vectors, scale)
    asking, query_blocks = _query_blocks(queries, scale)
    parts, groups = min(blocks, FILE_PARTS), -(-query_blocks // QUERIES_AT_ONCE)
    file = materialized(file, "file").withColumn("part", F.col("block") % parts)
    file = file.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asking = asking.withColumn("queries", F.col("block") % groups)
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = file.drop("block").unionByName(asking.drop("block"), allowMissingColumns=True)
    met = met.repartitionById(parts * groups, F.col("queries") * parts + F.col("part"))
    met = met.sortWithinPartitions("dims", "part", "queries", F.col("edges").isNotNull())
    return met.mapInPandas(lambda batches: _bounds(batches, k), "asked long, row long, most double, least double")


def _read(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """The exact scores of candidates (asked, row)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["embedding"].map(len)):
                found = _scores(_scaled(part["embedding"], scale), _scaled(part["asking"], scale))
                if any(abs(s) > LONGEST for s in found):
                    raise ValueError("a score leaves 64 bits")
                yield pd.DataFrame({"query_id": part["query_id"], "asked": part["asked"], "vec_id": part["vec_id"], "score": found})

    pairs = candidates.select("asked", "row").join(vectors, "row").join(
        queries.select("asked", F.col("vec_id").alias("query_id"), F.col("embedding").alias("asking")), "asked"
    )
    return pairs.select("asked", "query_id", "vec_id", "embedding", "asking").mapInPandas(
        score, "query_id long, asked long, vec_id long, score long"
    )


def _kth(rows: DataFrame, k: int, by: str, name: str) -> DataFrame:
    """The kth largest value of a column for each query that has so many rows."""
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(by)))
    return rows.select("asked", by).withColumn("_place", place).where(F.col("_place") <= k).where(F.col("_place") == k).select("asked", F.col(by).alias(name))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """For each query its k highest integer inner products with other vectors.

    Components are floor(``scale`` * x). Both tables have ``vec_id`` and ``embedding``; a
    query is never compared with rows of its own vec_id, nor with vectors of another length.
    Ties go to the smaller vec_id. Fewer than k rows come back where there are fewer others.
    Vectors that are null, have no id, or hold null or non-finite components take no part;
    a score among the best of a block that a long cannot hold is an error. Equal rows are each a
    candidate; a repeated query is answered once.

    Each part of the file, cells only, meets some blocks of queries in a task of its own, block
    by block. Vectors whose upper bound reaches the kth lower bound of their part, and then
    that of all parts, are candidates. Of these the exact vectors with the highest upper bounds
    are read first, and then those whose upper bound reaches the kth score found.
    """
    kept = vectors.where(usable(vectors)).select(F.col("vec_id").cast("long"), "embedding")
    # More than k equal rows cannot all be among the best.
    kept = kept.groupBy("vec_id", "embedding").agg(F.count("*").alias("n"))
    kept = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k))))).select("vec_id", "embedding")
    kept = materialized(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = queries.where(usable(queries)).select(F.col("vec_id").cast("long"), "embedding").distinct()
    asked = materialized(asked.withColumn("asked", F.monotonically_increasing_id()), "queries")
    near = materialized(_candidates(kept, asked, k, scale), "bounds")
    near = near.join(materialized(_kth(near, k, "least", "sure"), "sure"), "asked", "left").where("sure is null or most >= sure")
    turn = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("most"), "row"))
    near = materialized(near.withColumn("turn", turn).select("asked", "row", "most", "turn"), "candidates")
    first = materialized(_read(near.where(F.col("turn") <= READ_FIRST * k), kept, asked, scale), "scores")
    rest = near.where(F.col("turn") > READ_FIRST * k).join(_kth(first, k, "score", "reached"), "asked", "left")
    scores = first.unionByName(_read(rest.where("reached is null or most >= reached"), kept, asked, scale))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
