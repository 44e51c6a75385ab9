"""Whitening of embeddings by a bit-sliced scatter matrix.

Components become integers, ``floor(scale * c)``, and are shifted by the least of their
dimension, so that they are small and not negative. Each bit of a dimension is packed across
rows into 64-bit words, a bit plane. The sum of the products of two dimensions is then a
weighted sum of the set bits of their planes' conjunctions, exact whatever the order. A plane
of ones gives the sums of the dimensions and the number of rows. Scatter matrices of tasks are
added up as integers, centred as integers, and only then divided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products of bits with weights 2^(16 k) to 2^(16 k + 15) are summed up as one number.
LIMB = 16
#: A prime for ranks; products of two remainders fit 64 bits.
PRIME = 2**31 - 1
#: Entries beyond this, after scaling, are not taken.
LARGEST = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """At most ``components`` of the largest variance are kept; ``bits_at_once`` bounds the
    bits that a task unpacks at a time."""

    components: int = 32
    scale: float = 64.0
    bits_at_once: int = 1 << 22


@dataclass(frozen=True)
class Model:
    """What is learned: per dimension the shift and the sum after it, and per component its
    axis (a column), its variance and its share of the whole variance."""

    rows: int
    scale: float
    shift: np.ndarray
    sums: list[int]
    bits: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    explained: list[float]
    identity_error: float | None = None

    def shifted(self, batch: pa.RecordBatch) -> np.ndarray:
        return _integers(batch, self.scale, len(self.shift)) - self.shift

    def whitened(self, shifted: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.rows for s in self.sums])
        return (shifted - mean) @ self.axes / np.sqrt(self.variances)

    def deviations(self, shifted: np.ndarray) -> list[Decimal | None]:
        """For each row the sum over dimensions of (rows * value - sum)^2; null beyond 38 digits."""
        most = max((self.rows << int(b) for b in self.bits), default=0)
        if len(self.sums) * most * most < 1 << 63:
            away = shifted * self.rows - np.array(self.sums, np.int64)
        else:
            away = shifted.astype(object) * self.rows - np.array(self.sums, object)
        found = [int(d) for d in (away * away).sum(axis=1)] if len(self.sums) else [0] * len(shifted)
        return [Decimal(d) if d < 10**38 else None for d in found]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of the vectors without null or non-finite entries."""
    entries = F.col("embedding").cast("array<double>")
    fine = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", entries.alias("embedding"))


def _integers(batch: pa.RecordBatch, scale: float, width: int | None = None) -> np.ndarray:
    """The scaled entries of a batch; what a shorter vector lacks is 0."""
    lists = batch.column("embedding")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    scaled = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError("a scaled component leaves 62 bits")
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = scaled.astype(np.int64)
    return out


def _ranges(vectors: DataFrame, scale: float) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, and the least and the greatest integer of each dimension."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _integers(batch, scale)
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            dims = range(found.shape[1])
            rows = [int((lengths > d).sum()) for d in dims]
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([-1, *dims], pa.int32()),
                    "low": pa.array([0, *found.min(axis=0, initial=2**62)], pa.int64()),
                    "high": pa.array([0, *found.max(axis=0, initial=-(2**62))], pa.int64()),
                    "rows": pa.array([len(found), *rows], pa.int64()),
                }
            )

    parts = vectors.mapInArrow(scan, "dim int, low long, high long, rows long")
    found = parts.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
    # One row per dimension.
    known = {r.dim: r for r in found.collect()}
    total = known.pop(-1).rows if known else 0
    dims = [known[d] for d in range(len(known))]
    low = [min(r.low, 0) if r.rows < total else r.low for r in dims]
    high = [max(r.high, 0) if r.rows < total else r.high for r in dims]
    return total, np.array(low, np.int64), np.array(high, np.int64)


def bit_planes(values: np.ndarray, dims: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Row p holds bit ``bits[p]`` of column ``dims[p]`` for all rows, 64 rows to a word."""
    rows = -(-len(values) // 64) * 64
    flags = np.zeros((rows, len(dims)), np.uint8)
    flags[: len(values)] = (values[:, dims] >> bits) & 1
    return np.ascontiguousarray(np.packbits(flags, axis=0).T).view(np.uint64)


class Scatter:
    """Sums of products of dimensions, as limbs, over the rows added so far."""

    def __init__(self, bits: np.ndarray):
        """``bits`` has the number of bits of each dimension; the last one is a column of ones."""
        self._dims = np.repeat(np.arange(len(bits)), bits)
        self._bits = np.concatenate([np.arange(b) for b in bits]).astype(np.int64)
        self._present, self._starts = np.unique(self._dims, return_index=True)
        most = 2 * int(bits.max(initial=1)) // LIMB + 1
        self.limbs = np.zeros((most, len(bits), len(bits)), np.int64)

    def add(self, values: np.ndarray) -> None:
        planes = bit_planes(values, self._dims, self._bits)
        for at, (dim, begin) in enumerate(zip(self._present, self._starts, strict=True)):
            later, cuts = self._present[at:], self._starts[at:] - begin
            for p in np.flatnonzero(self._dims == dim):
                both = np.bitwise_count(planes[p] & planes[begin:]).sum(axis=1, dtype=np.int64)
                weight = self._bits[p] + self._bits[begin:]
                for limb in np.unique(weight // LIMB):
                    held = np.where(weight // LIMB == limb, both << weight % LIMB, 0)
                    self.limbs[limb, dim, later] += np.add.reduceat(held, cuts)

    def rows(self) -> pd.DataFrame:
        limb, i, j = np.nonzero(self.limbs)
        return pd.DataFrame({"i": i, "j": j, "limb": limb, "value": self.limbs[limb, i, j]})


def scatter(vectors: DataFrame, shift: np.ndarray, bits: np.ndarray, how: Whitening) -> np.ndarray:
    """The exact sums of products of shifted dimensions, the last of which is all ones."""
    with_ones = np.append(bits, 1)
    step = max(64, how.bits_at_once // int(with_ones.sum()) // 64 * 64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, count = Scatter(with_ones), [], 0
        for batch in batches:
            shifted = _integers(batch, how.scale, len(shift)) - shift
            held.append(np.column_stack([shifted, np.ones(len(shifted), np.int64)]))
            count += len(shifted)
            if count >= step:
                values = np.concatenate(held)
                for at in range(0, len(values) - step + 1, step):
                    found.add(values[at : at + step])
                held = [values[len(values) // step * step :]]
                count = len(held[0])
        if count:
            found.add(np.concatenate(held))
        yield pa.RecordBatch.from_pandas(found.rows(), preserve_index=False)

    parts = vectors.mapInArrow(scan, "i long, j long, limb long, value long")
    total = np.zeros((len(with_ones), len(with_ones)), object)
    # A row per pair of dimensions and limb, however many vectors there are.
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] += r.value << LIMB * r.limb
    return np.triu(total) + np.triu(total, 1).T


def rank(matrix: np.ndarray) -> int:
    """The rank of a matrix of integers, by elimination modulo a prime."""
    rest, found = (matrix % PRIME).astype(np.int64), 0
    for column in range(rest.shape[1]):
        below = np.flatnonzero(rest[found:, column])
        if not len(below):
            continue
        pivot = found + below[0]
        rest[[found, pivot]] = rest[[pivot, found]]
        rest[found] = rest[found] * pow(int(rest[found, column]), -1, PRIME) % PRIME
        lower = rest[found + 1 :]
        lower -= lower[:, column : column + 1] * rest[found] % PRIME
        lower %= PRIME
        found += 1
    return found


def principal_axes(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Rotations in extended precision follow ``eigh`` where two axes are still correlated, as
    happens when variances differ by many orders of magnitude.
    """
    _, axes = np.linalg.eigh(covariance)
    axes = axes[:, ::-1][:, :count].astype(np.longdouble)
    whole = covariance.astype(np.longdouble)
    inner = axes.T @ whole @ axes
    for _ in range(30):
        size = np.sqrt(np.abs(np.diag(inner)))
        pairs = np.argwhere(np.triu(np.abs(inner) > 1e-13 * np.outer(size, size), 1))
        if not len(pairs):
            break
        for i, j in pairs:
            if not inner[i, j]:
                continue
            turn = (inner[j, j] - inner[i, i]) / (2 * inner[i, j])
            t = (1 if turn >= 0 else -1) / (abs(turn) + np.sqrt(turn * turn + 1))
            c = 1 / np.sqrt(t * t + 1)
            rotation = np.array([[c, t * c], [-t * c, c]])
            axes[:, [i, j]] = axes[:, [i, j]] @ rotation
            inner[:, [i, j]] = inner[:, [i, j]] @ rotation
            inner[[i, j]] = rotation.T @ inner[[i, j]]
            inner[i, j] = inner[j, i] = 0
    axes /= np.sqrt((axes * axes).sum(axis=0))
    values = np.diag(axes.T @ whole @ axes).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    return values[order], axes[:, order].astype(np.float64)


def _identity_error(vectors: DataFrame, model: Model) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured."""
    count = len(model.variances)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            z = np.column_stack([model.whitened(model.shifted(batch)), np.ones(batch.num_rows)])
            total += z.T @ z
        i, j = np.triu_indices(count + 1)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "value": total[i, j]})

    parts = vectors.mapInArrow(scan, "i long, j long, value double")
    total = np.zeros((count + 1, count + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] = total[r.j, r.i] = r.value
    mean = total[:count, count] / model.rows
    found = total[:count, :count] / model.rows - np.outer(mean, mean)
    return float(np.abs(found - np.eye(count)).max(initial=0.0))


def fit(vectors: DataFrame, how: Whitening = Whitening()) -> Model | None:
    """What all usable vectors together teach; None where there are none.

    Components without variance are left out: a table of one vector, or of equal ones, has none.
    """
    vectors = usable(vectors)
    rows, low, high = _ranges(vectors, how.scale)
    if not rows:
        return None
    bits = np.array([(int(h) - int(b)).bit_length() for b, h in zip(low, high, strict=True)], np.int64)
    found = scatter(vectors, low, bits, how)
    sums = found[:-1, -1]
    centred = rows * found[:-1, :-1] - np.outer(sums, sums)
    count = min(how.components, rank(centred))
    covariance = np.array([[int(c) / (rows * rows) for c in line] for line in centred]).reshape(centred.shape)
    values, axes = principal_axes(covariance, len(centred)) if count else (np.zeros(0), np.zeros((len(low), 0)))
    values, axes = values[:count], axes[:, :count]
    whole = sum(int(centred[d, d]) for d in range(len(low))) / (rows * rows)
    learned = (rows, how.scale, low, [int(s) for s in sums], bits, axes, values, [float(v / whole) for v in values])
    return Model(*learned, _identity_error(vectors, Model(*learned)) if count else None)


def whiten(vectors: DataFrame, model: Model | None) -> DataFrame:
    """Per usable vector: vec_id, deviation (exact, decimal) and its whitened components.

    Rows with one vec_id, or none, stay rows of their own. A vector that is shorter than
    others counts as if it ended in zeros. Other columns are ignored.
    """
    kept = usable(vectors)
    if model is None:
        return kept.where("false").selectExpr("vec_id", "cast(null as decimal(38,0)) deviation", "embedding whitened")
    whole = kept.schema["vec_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifted = model.shifted(batch)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "deviation": pa.array(model.deviations(shifted), pa.decimal128(38, 0)),
                    "whitened": pa.array(list(model.whitened(shifted)), pa.list_(pa.float64())),
                }
            )

    return kept.mapInArrow(scan, f"vec_id {whole}, deviation decimal(38,0), whitened array<double>")
