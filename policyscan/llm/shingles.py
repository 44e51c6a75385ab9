"""Word shingles of texts as sets of 64-bit hashes, and their minwise signatures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: White space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\v\f\r"
#: Texts of this many bytes together are hashed at a time; a longer text alone.
BYTES_AT_ONCE = 1 << 20
#: Rows of a large set that are hashed at a time for its signature.
ROWS_AT_ONCE = 1 << 13

_random = np.random.Generator(np.random.PCG64(20_011))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
#: A random number for each byte; words are hashed as written.
AS_WRITTEN = _random.integers(1, 2**64, 256, np.uint64)
_BYTE = AS_WRITTEN.copy()
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # lower case
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(count: int, seed: int) -> np.ndarray:
    return mixed((np.arange(count, dtype=np.uint64) + np.uint64(seed)) * _STEP) | np.uint64(1)


def spans(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``most``."""
    low = total = 0
    for at, size in enumerate(sizes):
        total += size
        if total >= most:
            yield low, at + 1
            low, total = at + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def word_hashes(encoded: list[bytes], byte: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text; ``byte`` has a
    random number for each byte and so says which bytes are taken as equal."""
    buffer = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    inside = _IS_WORD[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    text_ends = np.cumsum([len(e) + 1 for e in encoded])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], text_ends])))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = odd(1, 5)[0] ** np.arange(int(lengths.max()) + 1, dtype=np.uint64)
    weighted = byte[buffer[inside]] * powers[within]
    return mixed(np.add.reduceat(weighted, first) + lengths.astype(np.uint64)), counts


def shingle_sets(texts: Sequence[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``words`` words as sorted hashes.

    Words are runs of characters other than white space, with A-Z in lower case. A text
    with fewer words has its whole sequence as its only shingle; one without, or null, has
    none.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    factors = odd(words, 77)
    for low, high in spans([len(e) + 1 for e in encoded], BYTES_AT_ONCE):
        hashes, counts = word_hashes(encoded[low:high])
        joined = np.empty(0, np.uint64)
        if len(hashes) >= words:
            total = np.zeros(len(hashes) - words + 1, np.uint64)
            for j in range(words):
                total += hashes[j : len(hashes) - words + 1 + j] * factors[j]
            joined = mixed(total)
        at = 0
        for count in counts.tolist():
            if count >= words:
                yield np.unique(joined[at : at + count - words + 1])
            elif count:
                # The number of words keeps it apart from a full shingle.
                short = np.append(hashes[at : at + count] * factors[:count], np.full(1, count, np.uint64) * _STEP)
                yield mixed(short.sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.empty(0, np.uint64)
            at += count


class Signatures:
    """Minwise signatures: for each of ``size`` functions the smallest hash of a set, 32 bits.
    Two sets agree in a place with the probability of their Jaccard similarity.
    """

    def __init__(self, size: int):
        self._factor = (odd(size, 1_001) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self._term = (odd(size, 5_003) >> np.uint64(32)).astype(np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        narrow = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self._factor), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(narrow), ROWS_AT_ONCE):
            part = narrow[at : at + ROWS_AT_ONCE, None] * self._factor + self._term
            np.minimum(least, part.min(axis=0), out=least)
        return least


def narrowed(least: np.ndarray) -> np.ndarray:
    """16 bits for each smallest hash, enough to compare a pair: by chance they agree once in
    65,536 places."""
    return (mixed(least.astype(np.uint64)) >> np.uint64(48)).astype("<u2")


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; equal for equal sets."""
    one = int(mixed(hashes).sum(dtype=np.uint64))
    two = int(mixed(hashes ^ _STEP).sum(dtype=np.uint64))
    return one - (1 << 63), two - (1 << 63)
