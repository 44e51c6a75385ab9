"""Text surfaces and whole-word tests.

Word characters are the ASCII ones (letters, digits, underscore) throughout, so
an accented letter ends a word. The JVM's own word-edge escape follows Unicode
instead, which is why it is not used here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_START = r"(?<![0-9A-Za-z_])"
WORD_END = r"(?![0-9A-Za-z_])"
BLANKS = r"[\t\n\f\r ]+"
#: A pattern that holds nowhere, for lists without words.
NOTHING = r"(?!)"


def padded_words(text: Column) -> Column:
    """Lower-case words separated by one blank, with a blank at both ends."""
    words = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\W+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def term_array(values: Iterable[str]) -> str:
    """SQL for a constant array of terms."""
    listed = ", ".join(values).replace("'", "\\'")
    return f"split('{listed}', ', ')"


def terms_in(surface: Column, vocabulary: Iterable[str], open_spellings: dict[str, str]) -> Column:
    """The vocabulary entries that a padded surface holds, as an array.

    The text is cut into its runs of one to N words, and those are intersected
    with the vocabulary, so the cost follows the length of the text and not the
    number of rules. Entries of ``open_spellings`` are matched by their pattern.
    """
    vocabulary = list(dict.fromkeys(vocabulary))
    listed = [v for v in vocabulary if v not in open_spellings]
    words = F.split(F.trim(surface), " ")
    runs = [words]
    for length in range(2, max((len(v.split()) for v in listed), default=1) + 1):
        following = F.slice(words, F.lit(length), F.size(words))
        runs.append(F.zip_with(runs[-1], following, lambda a, b: F.concat_ws(" ", a, b)))
    found = F.array_intersect(F.expr(term_array(listed)), F.concat(*runs))
    if not listed:
        found = F.array().cast("array<string>")
    for entry in vocabulary:
        if entry in open_spellings:
            hit = F.when(surface.rlike(open_spellings[entry]), F.array(F.lit(entry)))
            found = F.concat(found, hit.otherwise(F.array().cast("array<string>")))
    return found


def computed_once(df: DataFrame, keep: Iterable[str | Column], **columns: Column) -> DataFrame:
    """Add columns so that later filters read their values.

    Catalyst would otherwise copy the expressions of projected columns into
    every later filter that mentions them; it does not do so across a generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def has_word(text: Column, words: Iterable[str]) -> Column:
    """Whole-word test on raw text; NULL when the text is NULL."""
    words = tuple(words) or (NOTHING,)
    return F.lower(text).rlike(f"{WORD_START}(?:{'|'.join(words)}){WORD_END}")


def has_phrase(text: Column, firsts: Iterable[str], last: str) -> Column:
    """True when raw text holds ``<one of firsts> <last>`` with only blanks between."""
    firsts = tuple(firsts) or (NOTHING,)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    # The substring test is cheap and settles most long texts.
    return lowered.contains(last) & lowered.rlike(
        f"{WORD_START}(?:{'|'.join(firsts)}){BLANKS}{last}{WORD_END}"
    )


def title_words(title: Column) -> Column:
    """Words of a title, cut at every single blank; punctuation becomes a blank."""
    return F.split(F.lower(F.regexp_replace(title, r"[^\w\t\n\f\r ]", " ")), " ")
