"""Whole groups out of sorted batches, for ``mapInPandas`` over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The batches of a partition sorted by ``key``, cut so that no key is split."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        last = int(np.flatnonzero(keys == keys[-1])[0])
        if last or (kept and kept[0][key].iloc[0] != keys[0]):
            if last:
                kept.append(batch.iloc[:last])
            if kept:
                yield pd.concat(kept, ignore_index=True)
            kept = []
        kept.append(batch.iloc[last:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end of the last."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


class Forest:
    """Which of some positions are linked so far."""

    def __init__(self, size: int):
        self._parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self._parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, x: int, y: int) -> bool:
        """Link two positions; whether that joined two trees."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self._parent[max(x, y)] = min(x, y)
        return True
