"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def usable(vectors: DataFrame, column: str = "embedding") -> Column:
    """True for a vector that is not null and holds neither null nor non-finite components."""
    return F.coalesce(F.col("vec_id").isNotNull() & F.forall(column, _finite), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors as the rows of a matrix of doubles; shorter ones end in zeros."""
    rows = [np.asarray(v, np.float64) for v in column]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def unpacked(column: pd.Series, kind: str, width: int) -> np.ndarray:
    """The rows of a matrix that were stored as bytes."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)
