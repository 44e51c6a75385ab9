"""Language identification by nearest centroids of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyscan.llm.shingles import mixed, spans
from policyscan.llm.tables import hash_share, materialized

UNDETERMINED = "und"
CHARS_AT_ONCE = 1 << 19
#: Lengths in characters at which the distances of cut training texts are measured.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024)


@dataclass(frozen=True)
class NearestCentroids:
    """Parameters. At most ``sample`` labelled texts of each language, those of the smallest
    hashes, are learned from, and the ``languages`` with the most texts at most; ``longest``
    n-grams are hashed to ``slots``."""

    sample: int = 400
    languages: int = 500
    longest: int = 3
    slots: int = 4096
    centroids: int = 4
    rounds: int = 12
    #: Texts further away than this quantile of cut training texts, less a tenth, are rejected.
    rejected: float = 0.002


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def counts(texts: Sequence[str], how: NearestCentroids) -> Iterator[np.ndarray]:
    """Blocks of n-gram counts, a row per text; whole texts, in lower case, with runs of
    characters that are no letters as one blank."""
    for low, high in spans([len(t) + 2 for t in texts], CHARS_AT_ONCE):
        for at in range(low, high, 256):
            part = texts[at : min(high, at + 256)]
            yield _block(part, how)


def _block(texts: Sequence[str], how: NearestCentroids) -> np.ndarray:
    points = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
    points = np.where(_letters(points), points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (rows[1:] != rows[:-1])
    points, rows = points[keep].astype(np.uint64), rows[keep]
    total = np.zeros(len(texts) * how.slots, np.float32)
    grams = np.zeros(len(points), np.uint64)
    for n in range(1, how.longest + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        grams = grams[:size] * np.uint64(0x110000) + points[n - 1 :]
        whole = (rows[n - 1 :] == rows[:size]) & (points[n - 1 :] != 32 if n == 1 else True)
        slot = mixed(grams + np.uint64(n << 60)) % np.uint64(how.slots)
        key = rows[:size] * how.slots + slot.astype(np.int64)
        total += np.bincount(key[whole], minlength=len(total)).astype(np.float32)
    return total.reshape(len(texts), how.slots)


_LETTER = np.zeros(0, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    global _LETTER
    top = int(points.max(initial=0)) + 1
    if top > len(_LETTER):
        more = np.fromiter((chr(c).isalpha() for c in range(len(_LETTER), top)), bool, top - len(_LETTER))
        _LETTER = np.concatenate([_LETTER, more])
    return _LETTER[points]


def _weighted(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log term frequencies and inverse document frequencies."""
    x = np.log1p(block) * idf
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


def _clustered(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids by k-means with cosines, started from evenly spaced rows."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        label = np.argmax(x @ centroids.T, axis=1)
        for c in range(len(centroids)):
            if (label == c).any():
                total = x[label == c].sum(axis=0)
                centroids[c] = total / max(float(np.sqrt((total**2).sum())), 1e-12)
    return centroids


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their centroids (rows of one matrix), and the least cosine by text length."""

    how: NearestCentroids
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    radius: np.ndarray

    def judge(self, texts: Sequence[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language, score and whether the text is near enough, for each text."""
        clean = [t or "" for t in texts]
        lettered = [has_letters(t) for t in clean]
        done = 0
        for block in counts(clean, self.how):
            near = _weighted(block, self.idf) @ self.centroids.T if self.languages else np.zeros((len(block), 1))
            best = np.argmax(near, axis=1)
            for i, b in enumerate(best.tolist()):
                text, letters = clean[done + i], lettered[done + i]
                cosine = float(min(1.0, max(0.0, near[i, b])))
                if not letters or not self.languages:
                    yield UNDETERMINED, 0.0, False
                else:
                    owner = int(self.owner[b])
                    least = np.interp(np.log(max(len(text), 1)), np.log(LENGTHS), self.radius[owner])
                    # Texts shorter than the shortest measured length tell too little to reject.
                    yield self.languages[owner], cosine, bool(len(text) < LENGTHS[0] or cosine >= least)
            done += len(block)


def _sampled(labelled: DataFrame, how: NearestCentroids) -> DataFrame:
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # About three times as many as wanted are sorted, whatever the partitions. The languages, at
    # most ``languages`` rows, go to the texts, which stay where they are.
    sizes = ids.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_all"))
    sizes = materialized(sizes.orderBy(F.desc("_all"), "_lang").limit(how.languages), "languages")
    ids = ids.join(F.broadcast(sizes), F.col("lang") == F.col("_lang"))
    ids = ids.where(hash_share("doc_id") <= 3.0 * how.sample / F.col("_all"))
    first = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= how.sample).select("doc_id", "lang").distinct()
    # At most ``sample`` ids of each language; an id may be repeated, so the texts are ranked too.
    texts = labelled.join(F.broadcast(chosen), ["doc_id", "lang"])
    again = Window.partitionBy("lang").orderBy("_h", "text")
    ranked = texts.withColumn("_h", F.xxhash64("doc_id", "text")).withColumn("_n", F.row_number().over(again))
    return ranked.where(F.col("_n") <= how.sample).select("lang", "text")


def fit(labelled: DataFrame, how: NearestCentroids = NearestCentroids()) -> LanguageModel:
    """Learn from rows (doc_id, text, lang); rows without a text, letters or lang are left out."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sample = materialized(_sampled(rows, how), "language-sample")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(how.slots, np.int64), 0
        for batch in batches:
            for block in counts(batch["text"].tolist(), how):
                total += (block > 0).sum(axis=0)
                seen += len(block)
        yield pd.DataFrame({"slot": np.arange(-1, how.slots), "n": np.concatenate([[seen], total])})

    found = sample.mapInPandas(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas().set_index("slot")["n"]
    seen = np.array([found.get(s, 0) for s in range(-1, how.slots)], np.float64)
    idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1).astype(np.float32)

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in sorted(pdf["text"]) if has_letters(t)][: how.sample]
        if not texts:
            return pd.DataFrame([], columns=["lang", "centroids", "radius"])
        x = np.concatenate([_weighted(b, idf) for b in counts(texts, how)])
        centroids = _clustered(x, how.centroids, how.rounds)
        radius = []
        for length in LENGTHS:
            cut = [t[at : at + length] for t in texts for at in (0, len(t) // 2)]
            near = [(_weighted(b, idf) @ centroids.T).max(axis=1) for b in counts([c for c in cut if has_letters(c)], how)]
            radius.append(0.9 * float(np.quantile(np.concatenate(near), how.rejected)))
        return pd.DataFrame([[key[0], centroids.astype(np.float32).tobytes(), radius]], columns=["lang", "centroids", "radius"])

    # A few centroids for each language.
    learned = sample.groupBy("lang").applyInPandas(learn, "lang string, centroids binary, radius array<double>").toPandas().sort_values("lang")
    blocks = [np.frombuffer(c, np.float32).reshape(-1, how.slots) for c in learned["centroids"]]
    return LanguageModel(
        how,
        learned["lang"].tolist(),
        np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]),
        np.concatenate(blocks) if blocks else np.zeros((0, how.slots), np.float32),
        idf,
        np.array(learned["radius"].tolist()),
    )


def language(model: LanguageModel, text: str = "text") -> Column:
    """A struct of ``lang_pred``, ``score`` (the cosine) and ``accepted`` for a text column.

    Empty, null and letterless texts are ``und`` with score 0 and not accepted. Ties go to
    the language that sorts first.
    """

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(model.judge(texts.tolist())), columns=["lang_pred", "score", "accepted"])

    return judge(F.col(text))
