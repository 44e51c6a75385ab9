"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyscan.llm import spelling
from policyscan.llm.spelling import Letters, Spelling, Trie, spelling_variants

from .tables import documents, rows

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, ids=None):
    counts = Counter()
    for i, text in zip(range(len(texts)) if ids is None else ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, sizes = {}, {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        sizes[w] = len(found)
        forms[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, sizes[w], words.get(forms[w])))
    return sorted(out, key=repr)


def corpus(seed=1, stems=40):
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzàéßÉ×"
    words = []
    for _ in range(stems):
        stem = "".join(draw.choices(letters, k=draw.randrange(4, 10)))
        words += [stem] * draw.randrange(20, 80)
        for _ in range(12):
            at = draw.randrange(len(stem))
            changed = [stem[:at] + stem[at + 1 :], stem[:at] + draw.choice(letters) + stem[at:], stem[:at] + draw.choice(letters) + stem[at + 1 :]]
            words += [draw.choice(changed)] * draw.randrange(1, 30)
    draw.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    # Chains, anagrams, capitals, very long words, and words with 300 equal letters.
    texts += ["chains " * 40 + "chain " * 16 + "chai1n chaim " * 6 + "haim haims chaims " * 4, "listen silent enlist tinsel " * 5]
    texts += [("ab" * 4000 + " " + "ab" * 3999 + "a ") * 3, ("z" * 300 + " " + "z" * 301 + " " + "z" * 303 + " ") * 4, "ÀBCDEF àbcdef Àbcdef " * 3]
    return texts + ["straße strasse straßes, l’étéété " * 4, None, "", "12 3 !", "foo\nbarbarłbarbar " * 3]


@pytest.mark.parametrize("how", [Spelling(), Spelling(cell=30, leaf=2, queries=7), Spelling(cell=1, leaf=1)], ids=["one-cell", "cells", "blocks"])
def test_variants_equal_brute_force(spark, how):
    texts = corpus(stems=40 if how.cell > 1 else 4)
    found = spelling_variants(documents(spark, texts).repartition(3), how)
    assert rows(found, "word", "form", "root", "n", "n_near", "form_n") == brute(texts)


def test_anagrams_beyond_a_cell_meet_in_blocks(spark):
    draw = random.Random(3)
    made = sorted({"".join(draw.sample("abcde", 5)) for _ in range(90)})
    texts = [" ".join(made)] * 3 + [" ".join(w + "x" for w in made[:50])] * 4 + [" ".join(w[1:] + "ab" for w in made)] * 6
    found = spelling_variants(documents(spark, texts), Spelling(cell=8, leaf=2, queries=5))
    assert rows(found, "word", "form", "root", "n", "n_near", "form_n") == brute(texts)


def test_a_trie_reaches_all_words_at_one_edit():
    words = sorted({w for t in corpus(2, 25) for w in re.findall("[a-zà-ÿ]{5,40}", t or "")})
    coded = [w.encode("latin-1") for w in words]
    how = Spelling(leaf=3)
    trie = Trie(coded, np.ones(len(coded), np.int64), how)
    pairs = set()
    for frame in trie.near(Letters(coded), np.ones(len(coded), np.int64), spelling.letter_counts(coded).astype(np.int16), None):
        pairs |= set(zip(frame["word"], frame["near"], strict=True))
    wanted = {(a, b) for a in words for b in words if near(a, b)}
    assert {p for p in pairs if p[0] != p[1]} == wanted


def test_odd_tables(spark):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    assert rows(spelling_variants(documents(spark, [])), *columns) == []
    texts, ids = ["alpha alphas alpha", "alpha", "Alphas ALPHA", "alphas"], [None, None, 7, 7]
    df = documents(spark, texts, ids=ids).withColumns({"id": F.lit(1), "run": F.lit("x"), "word": F.lit("y"), "n": F.lit(2)})
    assert rows(spelling_variants(df), *columns) == brute(texts, ids) == [
        ("alpha", None, "alpha", 4, 1, None), ("alphas", None, "alphas", 3, 1, None),
    ]
