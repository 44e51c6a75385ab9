"""Document quality by a regularised quadratic discriminant over text statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.llm.tables import materialized, smallest_hashes

STATISTICS = (
    "word_length", "capitals", "marks", "digits", "kinds_of_words", "repeated_neighbours", "odd_words",
    "repeated_lines", "sentence_length", "marked_ends",
)
#: Words of plain prose that every text is given, so that shares of a short one say little:
#: their length, shares of capitals, of marks and of words with a mark at the end, and the
#: words of a sentence.
GIVEN, LETTERS, CAPITALS, MARKS, ENDS, SENTENCE = 20, 5, 0.04, 0.03, 0.1, 12

_SENTENCE_ENDS = str.maketrans({"!": ".", "?": ".", "\n": "."})
_PLAIN_ENDS = frozenset(".,;:!?\"')»”’…")


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty one has those of the given words."""
    words = text.split()
    n = len(words)
    letters = capitals = digits = marks = 0
    for c, times in _characters(text).items():
        if c.isalpha():
            letters += times
            capitals += times * c.isupper()
        elif c.isdigit():
            digits += times
        elif not c.isspace():
            marks += times
    visible = letters + digits + marks
    lines = [line for line in text.split("\n") if line.strip()]
    sentences = sum(1 for s in text.translate(_SENTENCE_ENDS).split(".") if s.strip())
    odd = sum(1 for w in words if not w.isalnum() and _odd(w))
    neighbours = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(1 for w in words if w[-1] in _PLAIN_ENDS)
    return [
        np.log1p((letters + LETTERS * GIVEN) / (n + GIVEN)),
        _share(capitals, letters, LETTERS * GIVEN, CAPITALS),
        _share(marks, visible, LETTERS * GIVEN, MARKS),
        _share(digits, visible, LETTERS * GIVEN, 0),
        np.log1p(len(set(words))) / np.log1p(max(n, 1)),
        _share(neighbours, n, GIVEN, 0),
        _share(odd, n, GIVEN, 0),
        _share(len(lines) - len(set(lines)), len(lines), GIVEN / 5, 0),
        np.log1p((n + 2 * SENTENCE) / (max(1, sentences) + 2)),
        _share(marked, n, GIVEN, ENDS),
    ]


def _share(part: int, whole: int, given: float, usual: float) -> float:
    return np.log(0.01 + (part + given * usual) / (whole + given))


def _characters(text: str) -> dict[str, int]:
    points, times = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    return {chr(p): t for p, t in zip(points.tolist(), times.tolist(), strict=True)}


def _odd(word: str) -> bool:
    """Whether a word has marks other than one plain one at its end, or no letter or digit."""
    core = word[:-1] if word[-1] in _PLAIN_ENDS else word
    return not core.replace("-", "").replace("'", "").replace("’", "").isalnum()


def matrix(texts: Sequence[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Discriminant:
    """Parameters. Learning takes at most ``sample`` labelled rows, those of the smallest
    hashes. Class covariances shrink by ``to_common`` to the common one, and by
    ``to_diagonal`` to their own diagonal; ``floor`` is added to all variances."""

    sample: int = 20_000
    to_common: float = 0.1
    to_diagonal: float = 0.1
    floor: float = 0.05


@dataclass(frozen=True)
class QualityModel:
    """Per class the mean, the inverse Cholesky factor and the constant of its log density."""

    middle: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of class 1 from the difference of the log densities."""
        x = (matrix(texts) - self.middle) / self.scale
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            far = (x - mean) @ factor.T
            logs.append(constant - 0.5 * (far**2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _fitted(x: np.ndarray, y: np.ndarray, how: Discriminant) -> QualityModel:
    size = len(STATISTICS)
    middle = x.mean(axis=0) if len(x) else np.zeros(size)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(size)
    x = (x - middle) / scale
    rows = [x[y == c] for c in (0, 1)]
    means = np.array([r.mean(axis=0) if len(r) else np.zeros(size) for r in rows])
    spread = [(r - m).T @ (r - m) for r, m in zip(rows, means, strict=True)]
    common = sum(spread) / max(1, len(x))
    factors, constants = [], []
    for own, part in zip(spread, rows, strict=True):
        cov = (1 - how.to_common) * own / max(1, len(part)) + how.to_common * common
        cov = (1 - how.to_diagonal) * cov + how.to_diagonal * np.diag(np.diag(cov)) + how.floor * np.eye(size)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        prior = (len(part) + 1) / (len(x) + 2)
        constants.append(np.log(prior) - np.log(np.diag(lower)).sum())
    return QualityModel(middle, scale, means, np.array(factors), np.array(constants))


def fit(documents: DataFrame, labels: DataFrame, how: Discriminant = Discriminant()) -> QualityModel:
    """Learn from documents (doc_id, text) and labels (doc_id, quality of 0 or 1).

    Null labels and ids are left out; a null text counts as empty. Without rows of a class
    the scores follow from the priors alone.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    chosen = materialized(smallest_hashes(marked, how.sample, "doc_id", "quality"), "quality-sample")

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts.tolist())))

    # ``chosen`` has ``sample`` rows at most.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("quality", measured("text").alias("x"), F.xxhash64("doc_id", "text").alias("h"))
    sample = rows.orderBy("h", "quality").limit(how.sample).toPandas()
    x = np.array(sample["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    return _fitted(x, sample["quality"].to_numpy(), how)


def score(model: QualityModel, text: str = "text") -> Column:
    """The probability of class 1 for a text column, 0 to 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def judged(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return judged(F.col(text))
