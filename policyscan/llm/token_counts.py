"""Token counts of a unigram vocabulary by a Viterbi search that keeps only counts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character that stands for a blank.
BLANK = "▁"
#: What an unknown character scores below the worst piece.
UNKNOWN_BELOW = 10.0
#: Words that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores in the order of their ids, and the id of the unknown piece."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    """How many pieces the best segmentation of a text has.

    Blanks become ``BLANK``, one is put before a text that does not begin with it, and the
    text is cut before each; every part is segmented on its own. An Aho-Corasick automaton
    gives all pieces that end at a place, longest first. The best path to a place changes only
    for a strictly better score, so ties go to the longest last piece, as where segmentations
    are searched from left to right. A character that is no piece scores ``UNKNOWN_BELOW``
    less than the worst piece; it counts one per UTF-8 byte if the vocabulary has pieces for
    all bytes, else a run of such characters counts one.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        import ahocorasick

        self._pieces = dict(pieces)
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_BELOW
        self._bytes = all(f"<0x{b:02X}>" in self._pieces for b in range(256))
        self._automaton = ahocorasick.Automaton()
        for piece, score in self._pieces.items():
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._empty = not len(self._automaton)
        if not self._empty:
            self._automaton.make_automaton()
        self._known: dict[str, int] = {}

    def part(self, text: str) -> int:
        """The count for one part."""
        size = len(text)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        unknown = [False] * (size + 1)
        found = iter(()) if self._empty else self._automaton.iter(text)
        match = next(found, None)
        for end in range(1, size + 1):
            best, pieces, missing = None, 0, False
            while match is not None and match[0] == end - 1:
                length, own = match[1]
                total = own + score[end - length]
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
                match = next(found, None)
            if text[end - 1] not in self._pieces:
                total = self._unknown + score[end - 1]
                if best is None or total > best:
                    best, missing = total, True
                    if self._bytes:
                        pieces = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[end - 1] + (not unknown[end - 1])
            score[end], count[end], unknown[end] = best, pieces, missing
        return count[size]

    def _word(self, word: str) -> int:
        found = self._known.get(word)
        if found is None:
            found = self.part(BLANK + word)
            if len(self._known) < REMEMBERED and len(word) <= LONGEST:
                self._known[word] = found
        return found

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.replace(BLANK, " ").split(" ")
        total = sum(map(self._word, rest))
        # A text that begins with a blank has no part before it.
        return total + self._word(first) if first else total


def token_count(path: str, text: str = "text") -> Column:
    """The number of pieces of a text column; 0 for an empty or null text."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = _counter(path)
        return pd.Series([counter(t or "") for t in texts], dtype="int64")

    return counted(F.col(text))


_counters: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    """One counter per task process, so that it remembers words from batch to batch."""
    if path not in _counters:
        _counters[path] = UnigramCounter(vocabulary(path)[0])
    return _counters[path]
