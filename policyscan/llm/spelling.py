"""Spelling variants: words at one edit, found in tries of letter counts.

Letters fall into groups, and a word is arranged in a trie by how often each group occurs in
it, one group per level. One edit raises the count of one group by one at most and lowers
that of one at most, so a depth-first search may spend a surplus of one and a deficit of one
on its way down; words that it reaches are verified letter by letter. The first levels deal
the words to cells, as deep as needed for cells of bounded size. A word is searched for in its
own cell and in the greater ones of those that its budget reaches, so each pair meets once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyscan.llm.tables import materialized

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The order of the levels: letters that are often in words, and so part them best, come first.
ORDER = "etaoinsrlhdcumfpgwybvkxjqz"
#: Letters beyond ASCII share this many groups, the last levels.
OTHERS = 6
LEVELS = len(ORDER) + OTHERS
PAIRS = "word string, near string, near_n long"


@dataclass(frozen=True)
class Spelling:
    """Words of at least ``letters`` code points and ``occurrences`` occurrences; one run in
    ``changed`` loses a letter.

    ``cell`` words are searched in one task at a time, ``leaf`` are compared without going
    further down, and ``queries`` words go down a trie together.
    """

    letters: int = 5
    occurrences: int = 3
    changed: int = 97
    times: int = 2
    cell: int = 32_768
    leaf: int = 16
    queries: int = 4096


def word_counts(documents: DataFrame, how: Spelling) -> DataFrame:
    """``word`` and ``n``: runs of letters in lower case, some without a letter that the
    checksum of doc_id (null: none) and run selects."""
    run = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1)))
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.where(F.char_length("run") >= how.letters).select("id", F.translate("run", CAPITALS, CAPITALS.lower()).alias("run"))
    summed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = summed.select(F.when(F.col("h") % how.changed == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= how.letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= how.occurrences)


_GROUP = np.array([len(ORDER) + c % OTHERS for c in range(256)])
for _level, _letter in enumerate(ORDER):
    _GROUP[ord(_letter)] = _level


def letter_counts(words: list[bytes]) -> np.ndarray:
    """A row per word with the count of each group, by level, at most 255.

    Cutting counts off there brings no two of them further apart, so no word is missed.
    """
    letters = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    found = np.bincount(row * LEVELS + _GROUP[letters], minlength=len(words) * LEVELS)
    return np.minimum(found, 255).astype(np.uint8).reshape(len(words), LEVELS)


class Letters:
    """Words as rows of letters from the left and from the right, for comparison by the pair."""

    WIDTH = 48

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        width = int(min(self.WIDTH, self.lengths.max(initial=0)))
        self.left = np.array([w[:width].ljust(width, b"\0") for w in words], f"S{max(1, width)}").view(np.uint8).reshape(len(words), -1)
        self.right = np.array([w[::-1][:width].ljust(width, b"\0") for w in words], f"S{max(1, width)}").view(np.uint8).reshape(len(words), -1)


def _same(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many places each pair of rows agrees before it first differs."""
    width = min(one.shape[1], two.shape[1])
    differs = one[:, :width] != two[:, :width]
    return np.where(differs.any(axis=1), differs.argmax(axis=1), width)


def _one_edit(one: bytes, two: bytes) -> bool:
    if len(one) < len(two):
        one, two = two, one
    if one == two or len(one) > len(two) + 1:
        return False
    at = next((i for i in range(len(two)) if one[i] != two[i]), len(two))
    return one[at + 1 :] == two[at + (len(one) == len(two)) :]


def one_edit(ones: Letters, twos: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of different words differ by one inserted, deleted or replaced letter."""
    longer = np.maximum(ones.lengths[i], twos.lengths[j])
    shorter = np.minimum(ones.lengths[i], twos.lengths[j])
    ahead = np.minimum(_same(ones.left[i], twos.left[j]), shorter)
    behind = np.minimum(_same(ones.right[i], twos.right[j]), shorter)
    near = (longer - shorter <= 1) & (ahead + behind >= longer - 1)
    for k in np.flatnonzero(longer > Letters.WIDTH).tolist():
        near[k] = _one_edit(ones.words[i[k]], twos.words[j[k]])
    return near


class Trie:
    """The words of a cell, sorted by their letter counts: a node is a range of them."""

    def __init__(self, words: list[bytes], numbers: np.ndarray, how: Spelling):
        counts = letter_counts(words)
        order = np.lexsort(counts.T[::-1])
        self.counts, self.numbers, self._how = counts[order].astype(np.int16), numbers[order], how
        self.letters = Letters([words[k] for k in order.tolist()])

    def reached(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query, by its letter counts, and a word that its budget reaches."""
        none = np.zeros(len(queries), np.int16)
        stack = [(0, len(self.counts), 0, np.arange(len(queries)), none, none)]
        while stack:
            low, high, level, who, surplus, deficit = stack.pop()
            if high - low <= self._how.leaf or level == LEVELS:
                i, j = np.repeat(who, high - low), np.tile(np.arange(low, high), len(who))
                rest = queries[i, level:] - self.counts[j, level:]
                more = np.maximum(rest, 0).sum(axis=1) + np.repeat(surplus, high - low)
                less = np.maximum(-rest, 0).sum(axis=1) + np.repeat(deficit, high - low)
                fits = (more <= 1) & (less <= 1)
                yield i[fits], j[fits]
                continue
            counts = self.counts[low:high, level]
            cuts = [0, *(np.flatnonzero(counts[1:] != counts[:-1]) + 1).tolist(), high - low]
            wanted = queries[who, level]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                rest = wanted - counts[begin]
                more, less = surplus + np.maximum(rest, 0), deficit + np.maximum(-rest, 0)
                fits = np.flatnonzero((more <= 1) & (less <= 1))
                if len(fits):
                    stack.append((low + begin, low + end, level + 1, who[fits], more[fits], less[fits]))

    def near(self, words: Letters, numbers: np.ndarray, counts: np.ndarray, begin: int | None) -> Iterator[pd.DataFrame]:
        """Both directions of each near pair of the words given and those of the trie; those
        given are the trie's own from ``begin`` on, or others."""
        held, size = [], 0
        for i, j in self.reached(counts):
            if begin is not None:
                later = j > i + begin
                i, j = i[later], j[later]
            if len(i):
                held.append((i, j))
                size += len(i)
            if size >= 1 << 17:
                yield from self._verified(words, numbers, held)
                held, size = [], 0
        if held:
            yield from self._verified(words, numbers, held)

    def _verified(self, words: Letters, numbers: np.ndarray, held: list) -> Iterator[pd.DataFrame]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        near = one_edit(words, self.letters, i, j)
        if not near.any():
            return
        i, j = i[near], j[near]
        ones = [words.words[k].decode("latin-1") for k in i.tolist()]
        twos = [self.letters.words[k].decode("latin-1") for k in j.tolist()]
        yield pd.DataFrame({"word": ones + twos, "near": twos + ones, "near_n": np.concatenate([self.numbers[j], numbers[i]])})


def _dealt(words: DataFrame, depth: int) -> DataFrame:
    """Words in their own cells (side 0), and in the greater ones that they may be near (side 1)."""
    steps = [np.zeros(depth, np.int16)]
    for up in range(depth):
        for down in [None, *range(up + 1, depth)]:
            step = np.zeros(depth, np.int16)
            step[up] = 1
            if down is not None:
                step[down] = -1
            steps.append(step)
    steps = np.array(steps).reshape(len(steps), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = letter_counts([w.encode("latin-1") for w in batch["word"]])[:, :depth].astype(np.int16)
            for side, step in enumerate(steps):
                cells = own + step
                exists = ((cells >= 0) & (cells <= 255)).all(axis=1)
                if exists.any():
                    out = batch[exists].copy()
                    out["cell"] = [c.tobytes() for c in cells[exists].astype(np.uint8)]
                    out["side"] = int(side > 0)
                    yield out

    return words.select("word", "n").mapInPandas(deal, "word string, n long, cell binary, side int")


def near_pairs(words: DataFrame, how: Spelling) -> DataFrame:
    """Rows (word, near, near_n) for each of ``words`` (word, n) and each word at one edit."""

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"counts": [c.tobytes() for c in letter_counts([w.encode("latin-1") for w in batch["word"]])]})

    counts = materialized(words.select("word").mapInPandas(prefix, "counts binary"), "letter-counts")
    depth, sizes = 0, counts.groupBy(F.lit(b"").alias("cell")).agg(F.count("*").alias("n"))
    while depth < LEVELS and not sizes.where(F.col("n") > how.cell).isEmpty():
        depth += 1
        sizes = counts.groupBy(F.substring("counts", 1, depth).alias("cell")).agg(F.count("*").alias("n"))
    dealt = _dealt(words, depth).withColumn("block", F.lit(0))
    large = materialized(sizes.where(F.col("n") > how.cell), "large-cells")
    if not large.isEmpty():
        # Words with all counts equal: blocks of them, each searched for the words of those before.
        blocks = dealt.drop("block").join(large.select("cell", F.ceil(F.col("n") / how.cell).cast("int").alias("blocks")), "cell", "left")
        block = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
        first = F.when(F.col("side") == 0, F.col("block")).otherwise(0)
        to = F.explode(F.sequence(first, F.coalesce("blocks", F.lit(1)) - 1))
        dealt = blocks.withColumn("block", block).withColumn("to", to).select(
            "word", "n", "cell",
            F.when((F.col("side") == 0) & (F.col("to") > F.col("block")), 1).otherwise(F.col("side")).alias("side"),
            F.col("to").alias("block"),
        )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, trie = None, [], None

        def built(held: list[pd.DataFrame]) -> Trie:
            own = pd.concat(held, ignore_index=True)
            return Trie([w.encode("latin-1") for w in own["word"]], own["n"].to_numpy(), how)

        def own_pairs(trie: Trie) -> Iterator[pd.DataFrame]:
            for low in range(0, len(trie.counts), how.queries):
                part = slice(low, low + how.queries)
                yield from trie.near(Letters(trie.letters.words[part]), trie.numbers[part], trie.counts[part], low)

        for batch in batches:
            for here, rows in batch.groupby(["cell", "block"], sort=False):
                if here != place:
                    if held:
                        yield from own_pairs(built(held))
                    place, held, trie = here, [], None
                own, others = rows[rows["side"] == 0], rows[rows["side"] == 1]
                if len(own):
                    held.append(own)
                if len(others) and (held or trie):
                    if held:
                        trie, held = built(held), []
                        yield from own_pairs(trie)
                    words = [w.encode("latin-1") for w in others["word"]]
                    for low in range(0, len(words), how.queries):
                        part = words[low : low + how.queries]
                        numbers = others["n"].to_numpy()[low : low + how.queries]
                        yield from trie.near(Letters(part), numbers, letter_counts(part).astype(np.int16), None)
        if held:
            yield from own_pairs(built(held))

    rows = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    return rows.mapInPandas(search, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for rows (word, form): the last word that forms lead to.

    Each round doubles the steps taken, and a form occurs more often than its word, so the
    rounds are few.
    """
    found = materialized(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialized(found.join(further, "root", "left").select("word", "root", "next"), "roots")
        if step.where("next is not null").isEmpty():
            return found
        found = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(documents: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    A word's form is its near word of the largest n (of equal ones the smallest), if that is
    ``times`` the word's own n at least; its root is where forms lead to, or the word itself.
    A null text has no words, and a null doc_id counts as the empty text. Repeated rows count
    each. Other columns are ignored.
    """
    words = materialized(word_counts(documents, how), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best")
    near = near_pairs(words, how).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.n"))
    fits = F.col("form_n") >= how.times * F.col("n")
    found = found.select(
        "word",
        F.when(fits, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("form_n")).alias("form_n"),
    )
    found = materialized(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
