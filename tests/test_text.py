"""Whole-word tests against Python's ASCII regular expressions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from policyscan.functions.text import has_phrase, has_word, padded_words, terms_in, title_words
from policyscan.rules import bank

PIECES = (
    ["fur", "Real", "fox", "FOXES", "mink", "nerzmantel", "nerz", "skin", "on", "racccoons"]
    + ["finn", "coon", "furs", "fur_", "pelz", "pelzé", "é", "–", "faux", "9fur", "full", "body"]
    + ["mount", "persian", "lamb", "let", "out", "saga", "artificial"]
)
GAPS = [" ", " ", "  ", "-", ", ", "\t", "\n", "", "'", " – "]


def random_texts(count: int = 400) -> list[str | None]:
    rng = random.Random(7)
    texts = [
        "".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randrange(1, 9)))
        for _ in range(count)
    ]
    return [*texts, "", None]


def test_terms_in_finds_exactly_the_whole_phrases(spark):
    vocabulary = [
        *bank.all_terms(bank.FUR_TERMS),
        *bank.all_terms(bank.AMBIGUOUS_ANIMALS),
        *bank.all_terms(bank.SURE_ANIMALS),
    ]
    patterns = {
        term: r"rac+oons?" if term == "rac+oon" else term.replace("*", r"\w*").replace(" ", r"\s+")
        for term in vocabulary
    }
    df = spark.createDataFrame([(t,) for t in random_texts()], "text string")
    found = terms_in(padded_words(F.col("text")), vocabulary, bank.OPEN_SPELLINGS)
    for text, terms in df.select("text", found).collect():
        plain = re.sub(r"[^\w\s]", " ", text or "", flags=re.ASCII).lower()
        expected = {
            term
            for term, pattern in patterns.items()
            if re.search(rf"\b(?:{pattern})\b", plain, re.ASCII)
        }
        assert set(terms) == expected, text


def test_word_and_phrase_tests_on_raw_text(spark):
    df = spark.createDataFrame([(t,) for t in random_texts()], "text string")
    words, firsts = ("fur", "fox", "pelz"), ("faux", "artificial", "real")
    rows = df.select("text", has_word(F.col("text"), words), has_phrase(F.col("text"), firsts, "fur"))
    for text, word, phrase in rows.collect():
        if text is None:
            assert word is None and phrase is False
            continue
        assert word == bool(re.search(r"\b(fur|fox|pelz)\b", text.lower(), re.ASCII))
        expected = re.search(r"\b(faux|artificial|real)[\t\n\f\r ]+fur\b", text.lower(), re.ASCII)
        assert phrase == bool(expected), text


def test_accented_letter_ends_a_word(spark):
    df = spark.createDataFrame([("pelzé",), ("pelze",)], "text string")
    assert [r[0] for r in df.select(has_word(F.col("text"), ("pelz",))).collect()] == [True, False]


def test_title_words_split_at_every_blank(spark):
    df = spark.createDataFrame([("Real Fox,  Fox\tTail",)], "text string")
    assert df.select(title_words(F.col("text"))).first()[0] == ["real", "fox", "", "", "fox\ttail"]
