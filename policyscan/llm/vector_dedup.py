"""Near-duplicate embeddings by product quantisation over coarse inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyscan.llm.components import components
from policyscan.llm.groups import Forest
from policyscan.llm.tables import materialized, smallest_hashes
from policyscan.llm.vectors import matrix, unpacked, usable


@dataclass(frozen=True)
class VectorDuplicates:
    """Vectors are linked at a cosine of ``least`` or more.

    The index is fitted on ``sample`` distinct vectors, those of the smallest hashes: one
    coarse centroid per ``sqrt(n)`` vectors, ``lists`` at most, and ``parts`` codebooks of
    ``codes`` centroids each for the residuals. A vector is searched for in every list whose
    border is within half the distance at the threshold. One of two linked vectors in different
    lists is so near to the border between these, so every pair meets in a list, in any number
    of dimensions.
    """

    least: float = 0.95
    sample: int = 32_768
    lists: int = 4096
    parts: int = 8
    codes: int = 256
    rounds: int = 8
    entries: int = 2048
    queries: int = 4096

    @property
    def reach(self) -> float:
        """The largest distance of unit vectors that are linked."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.least)))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    out = [np.argmax(x[at : at + 4096] @ centroids.T - half, axis=1) for at in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most k centroids, started from evenly spaced rows of ``x``."""
    centroids = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        label = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, x)
        counts = np.bincount(label, minlength=len(centroids))
        some = counts > 0
        centroids[some] = sums[some] / counts[some, None]
    return centroids


@dataclass(frozen=True)
class Index:
    """Coarse centroids and, per subspace, the codebook of residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]
    edges: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, total: int, how: VectorDuplicates) -> Index:
        coarse = _k_means(x, max(1, min(how.lists, int(np.sqrt(total)))), how.rounds)
        rest = x - coarse[_nearest(x, coarse)]
        edges = np.linspace(0, x.shape[1], min(how.parts, max(1, x.shape[1])) + 1).astype(int)
        books = [_k_means(rest[:, a:b], how.codes, how.rounds) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return cls(coarse, books, edges)

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.coarse.shape[1]))
        out[:, : x.shape[1]] = x[:, : out.shape[1]]
        return out

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each decoded residual is off."""
        codes = np.empty((len(rest), len(self.books)), np.uint8)
        off = np.zeros(len(rest))
        for s, book in enumerate(self.books):
            part = rest[:, self.edges[s] : self.edges[s + 1]]
            codes[:, s] = _nearest(part, book)
            off += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
        return codes, np.sqrt(off)

    def probes(self, x: np.ndarray, margin: float | np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The home list of each row, and all lists whose border is within its ``margin``."""
        sizes = (self.coarse**2).sum(axis=1)
        away = (x**2).sum(axis=1)[:, None] - 2 * x @ self.coarse.T + sizes
        home = np.argmin(away, axis=1)
        apart = sizes[home][:, None] - 2 * self.coarse[home] @ self.coarse.T + sizes
        # How far a vector is from the plane between its home and another centroid.
        border = (away - away[np.arange(len(x)), home][:, None]) / (2 * np.sqrt(np.maximum(apart, 1e-12)))
        border[np.arange(len(x)), home] = 0
        return home, [np.flatnonzero(b <= m) for b, m in zip(border, np.broadcast_to(margin, len(x)), strict=True)]

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to coded ones, from tables per subspace."""
        total = np.zeros((len(rest), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            part = rest[:, self.edges[s] : self.edges[s + 1]]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)
            total += table.astype(np.float32)[:, codes[:, s]]
        return total


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(largest > 0, largest, 1)  # squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


PLACED = "first_id long, n long, dims int, home int, probes array<int>, codes binary, off double, vector binary"
PAIRS = "a long, b long, n long"


def _placed(distinct: DataFrame, index: Index, how: VectorDuplicates, kind: str) -> DataFrame:
    """Every distinct vector with its lists and codes, and its components as they were."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                dims = part["embedding"].map(len).to_numpy()
                raw = index.padded(matrix(part["embedding"]))
                x = _unit(raw)
                # A little more than the half, which rounding must not cut.
                margin = np.full(len(part), how.reach * (0.5 + 1e-6) + 1e-9)
                home, probes = index.probes(x, margin)
                codes, off = index.encode(x - index.coarse[home])
                yield pd.DataFrame(
                    {
                        "first_id": part["first_id"].array,
                        "n": part["n"].array,
                        "dims": dims,
                        "home": home,
                        "probes": [p.astype(np.int32) for p in probes],
                        "codes": [c.tobytes() for c in codes],
                        "off": off,
                        "vector": [v.tobytes() for v in raw.astype(kind)],
                    }
                )

    return distinct.select("first_id", "n", "embedding").mapInPandas(place, PLACED)


def _meetings(placed: DataFrame, how: VectorDuplicates) -> DataFrame:
    """Entries and queries of each list, dealt to block pairs of bounded size."""
    asking = placed.withColumn("list", F.explode("probes"))
    keys = ["dims", "list"]
    entries = placed.withColumn("list", F.col("home"))
    counts = (
        entries.groupBy(*keys).agg(F.ceil(F.count("*") / how.entries).cast("int").alias("entry_blocks"))
        .join(asking.groupBy(*keys).agg(F.ceil(F.count("*") / how.queries).cast("int").alias("query_blocks")), keys)
    )
    counts = materialized(counts, "lists")
    hashed = F.xxhash64("first_id")
    stored = (
        entries.join(counts, keys).withColumn("asks", F.lit(False))
        .withColumn("entry_block", F.pmod(hashed, "entry_blocks").cast("int"))
        .withColumn("query_block", F.explode(F.expr("sequence(0, query_blocks - 1)")))
    )
    asked = (
        asking.join(counts, keys).withColumn("asks", F.lit(True))
        .withColumn("query_block", F.pmod(hashed, "query_blocks").cast("int"))
        .withColumn("entry_block", F.explode(F.expr("sequence(0, entry_blocks - 1)")))
        .withColumn("codes", F.lit(None).cast("binary"))
        .withColumn("probes", F.lit(None).cast("array<int>"))
    )
    return stored.unionByName(asked).drop("entry_blocks", "query_blocks")


def _compared(index: Index, how: VectorDuplicates, kind: str):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_id", kind="stable")
        asks = pdf["asks"].to_numpy()
        entries, queries = pdf[~asks], pdf[asks]
        width = index.coarse.shape[1]
        ids, asking = entries["first_id"].to_numpy(), queries["first_id"].to_numpy()
        weight, own_weight = entries["n"].to_numpy(), queries["n"].to_numpy()
        x, q = (_unit(unpacked(rows["vector"], kind, width).astype("f8")) for rows in (entries, queries))
        codes = unpacked(entries["codes"], "u1", len(index.books))
        bound = (how.reach + entries["off"].to_numpy() + 1e-4) ** 2
        here = int(pdf["list"].iloc[0])
        lists = len(index.coarse)
        probed = np.sort(np.concatenate([[-1], *(j * lists + p.astype(np.int64) for j, p in enumerate(entries["probes"]))]))
        home = queries["home"].to_numpy().astype(np.int64)
        names = np.unique(np.concatenate([ids, asking]))
        forest, label, sums = Forest(len(names)), np.arange(len(names)), np.zeros(len(names), np.int64)
        at_entry, at_query = np.searchsorted(names, ids), np.searchsorted(names, asking)
        for low in range(0, len(q), 256):
            part = q[low : low + 256]
            near = index.distances(part - index.coarse[here], codes) <= bound
            near &= ids[None, :] != asking[low : low + 256, None]
            rows, columns = np.nonzero(near)
            for first in range(0, len(rows), 1 << 15):
                r, c = rows[first : first + (1 << 15)], columns[first : first + (1 << 15)]
                linked = np.einsum("ij,ij->i", part[r], x[c]) >= how.least
                i, j = r[linked] + low, c[linked]
                # A pair that meets in both lists counts where the smaller id asks.
                key = j * lists + home[i]
                both = probed[np.minimum(np.searchsorted(probed, key), len(probed) - 1)] == key
                once = (asking[i] < ids[j]) | ~both
                i, j = i[once], j[once]
                np.add.at(sums, at_query[i], weight[j])
                np.add.at(sums, at_entry[j], own_weight[i])
                trees = np.unique(label[at_query[i]] * len(names) + label[at_entry[j]])
                if sum([forest.link(*divmod(t, len(names))) for t in trees.tolist()]):
                    label = np.array([forest.root(n) for n in range(len(names))], np.int64)
        some = np.flatnonzero(sums)
        return pd.DataFrame({"a": names[some], "b": names[label[some]], "n": sums[some]})

    return compare


def vector_duplicates(vectors: DataFrame, how: VectorDuplicates = VectorDuplicates()) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    ``n_links`` counts the other rows at a cosine of ``how.least`` or more, ``component_id``
    is the smallest vec_id that links reach and ``kept`` marks the row that is it. Cosines
    are taken in double precision. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Equal vectors enter
    the index once and count as often as they occur. A row without an id gets a null
    component and is kept.

    Every distinct vector is stored in the list of its nearest centroid as residual codes,
    and looked up in all lists near it; table distances leave out what the quantisation error
    proves to be too far, and the rest is decided by exact cosines. Only sums and a forest of
    links leave a task, never all pairs.
    """
    good = vectors.where(usable(vectors) & F.exists("embedding", lambda x: x != 0))
    rows = good.select(F.col("vec_id").cast("long"), "embedding")
    distinct = materialized(rows.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    shape = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if shape[0]:
        sample = smallest_hashes(distinct, how.sample, "first_id").select("embedding").toPandas()
        x = np.zeros((len(sample), shape[1]))
        fitted = matrix(sample["embedding"])
        x[:, : fitted.shape[1]] = fitted
        index = Index.fit(_unit(x), shape[0], how)
        kind = "f4" if dict(distinct.dtypes)["embedding"] == "array<float>" else "f8"
        placed = materialized(_placed(distinct, index, how, kind), "placed")
        found = _meetings(placed, how).groupBy("dims", "list", "entry_block", "query_block").applyInPandas(_compared(index, how, kind), PAIRS)
        found = materialized(found, "found")
    else:
        found = vectors.sparkSession.createDataFrame([], PAIRS)
    links = found.groupBy(F.col("a").alias("first_id")).agg(F.sum("n").alias("others"))
    joined = components(found.select("a", "b")).select(F.col("node").alias("first_id"), "component")
    groups = distinct.join(links, "first_id", "left").join(joined, "first_id", "left").select(
        "embedding",
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "first_id").alias("component_id"),
    )
    linked = rows.join(groups, "embedding").select("vec_id", "n_links", "component_id")
    bad = vectors.where(~(usable(vectors) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))))
    alone = bad.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
