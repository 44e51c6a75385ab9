"""Removal of repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from policyscan.llm import repeated_phrases
from policyscan.llm.repeated_phrases import RepeatedPhrases, with_kept_text, without_repeats

from .tables import documents, rows


def brute(texts, size=35):
    """Per text the number of words, of removed ones, and the kept words."""
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if counts[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def prose(n, seed, vocabulary=300):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def corpus():
    passage, long = prose(60, 1), prose(400, 2).split()
    texts = [f"{prose(20 + 7 * i, 10 + i)} {passage} {prose(15 * i, 40 + i)}" for i in range(12)]
    texts += [" ".join(long[a:b]) for a, b in [(0, 400), (30, 64), (30, 65), (100, 135), (101, 200), (150, 260), (380, 400)]]
    # Near copies that differ in a word each, exact copies, a passage twice in one text.
    texts += [" ".join(long[: 40 * i] + ["changed"] + long[40 * i + 1 :]) for i in range(1, 9)]
    texts += [prose(50, 3)] * 5 + [prose(36, 4) + " x " + prose(36, 4), prose(35, 5) + " " + prose(35, 5)]
    # One word many times, a short cycle, other white space, words beyond ASCII and in capitals.
    texts += ["echo " * 90, "a b c " * 40, prose(40, 6), prose(40, 6).replace(" ", "\t\n"), prose(40, 7), prose(40, 7).replace("w", "W")]
    texts += [prose(40, 8).replace("w", "ü "), prose(40, 8).replace("w", "ü "), None, "", " \n", "one", prose(34, 3), prose(20000, 9)]
    return texts


def check(found, texts):
    wanted = [(i, n, gone, hashlib.sha256(kept).hexdigest()) for i, (n, gone, kept) in enumerate(brute(texts))]
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(wanted, key=repr)


@pytest.mark.parametrize(
    "how",
    [RepeatedPhrases(), RepeatedPhrases(segments=20, broadcast=0), RepeatedPhrases(anchor=3, segments=2), RepeatedPhrases(anchor=35)],
    ids=["whole", "shuffled", "split", "anchor-is-window"],
)
def test_removal_equals_brute_force(spark, how):
    texts = corpus()
    check(without_repeats(documents(spark, texts).repartition(5), how), texts)


def test_a_very_common_phrase_in_unlike_contexts(spark):
    texts = [f"{prose(40, i)} common words of a line that all share {prose(40, 100 + i)}" for i in range(60)]
    texts += [texts[7], texts[9] + " more", prose(10, 500) + texts[11]]
    for segments in (10, 20_000):
        check(without_repeats(documents(spark, texts), RepeatedPhrases(segments=segments)), texts)


def test_kept_text_and_clashing_columns(spark):
    texts = corpus()
    df = documents(spark, texts).withColumns({"key": F.lit(1), "kept_text": F.lit("x"), "_kept": F.lit(2), "anchors": F.lit(3)})
    found = with_kept_text(df)
    assert found.columns == [*df.columns, "_kept_text"]
    for (_, gone, kept), r in zip(brute(texts), found.orderBy("doc_id").collect(), strict=True):
        assert r["_kept_text"] == (kept.decode() if gone else texts[r.doc_id])
    check(without_repeats(df), texts)


def test_odd_tables(spark):
    assert without_repeats(documents(spark, [])).count() == 0
    found = without_repeats(documents(spark, [prose(40, 1)] * 3 + [None], ids=[None, 1, 1, None]))
    assert rows(found, "doc_id", "n_removed") == sorted([(None, 40), (1, 40), (1, 40), (None, 0)], key=repr)


def test_shards_find_the_phrases_of_a_plain_search():
    phrases = [(1, 2, 3), (2, 3), (3, 4, 5, 6)]
    found = repeated_phrases.automaton(iter(phrases))
    assert repeated_phrases._occurrences(found, (9, 1, 2, 3, 9, 2, 3, 4, 5, 6, 9)) == [(1, 4), (5, 10)]
