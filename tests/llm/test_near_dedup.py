from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyscan.llm import shingles
from policyscan.llm.components import components
from policyscan.llm.near_dedup import NearDuplicates, deduplicated, near_duplicates

from .tables import documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(texts, words, percent):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, words) for i, t in texts}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = {}
    for i, s in sets.items():
        for shingle in s:
            holders.setdefault(shingle, []).append(i)
    pairs = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), root(i)) for i in sets), key=repr)


def family(rng, size, length, edits):
    """Texts made from one by replacing some words."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    shared = " ".join(f"p{i}" for i in range(40))
    out = [t for n in (2, 3, 5, 30, 60) for t in family(rng, n, 150, 6)]
    out += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) + " " + shared for _ in range(60)]
    out += ["a b", "A  B", "a b c", "", " \t\n", None, "É b", "é b"] + out[:5] + [out[9].upper()]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(
    "how",
    [NearDuplicates(words=4), NearDuplicates(words=4, small=6, block=16), NearDuplicates(words=5, small=3, block=5, depth=1)],
)
def test_components_equal_brute_force(spark, texts, how):
    df = documents(spark, [t for _, t in texts])
    found = near_duplicates(df, how)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(texts, how.words, how.percent)
    assert found.where("kept <> (doc_id = component_id)").isEmpty()


def test_the_given_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    found = near_duplicates(df, NearDuplicates(words=4))
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(texts, 4, 80)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = documents(spark, [text, text + " end", "other words only here", "other words only here", text, "zz"], ids=[5, 9, 7, 7, None, None])
    df = df.withColumn("cell", F.lit("x")).withColumn("signature", F.lit(1)).withColumn("kept", F.lit(0))
    found = near_duplicates(df)
    assert rows(found, "doc_id", "component_id", "kept") == sorted(
        [(5, 5, True), (9, 5, False), (7, 7, True), (7, 7, True), (None, None, True), (None, None, True)], key=repr
    )
    for how in (NearDuplicates(), NearDuplicates(broadcast=0)):
        kept = deduplicated(df, how)
        assert kept.columns == df.columns
        # One of the three alike, whatever their ids, one of the two others, and the last.
        assert sorted(r.text[:2] for r in kept.collect()) == ["ot", "w0", "zz"]


def test_different_texts_with_one_id_all_stay(spark):
    df = documents(spark, ["one text of words", "quite another text here", "a third"], ids=[1, 1, 2])
    assert deduplicated(df).count() == 3
    df = documents(spark, ["same text of words"] * 3 + ["", None, ""], ids=[None, None, 4, 4, None, None])
    assert sorted((r.text or "") for r in deduplicated(df).collect()) == ["", "", "", "same text of words"]


def test_near_copies_are_finished_where_they_first_meet(spark, monkeypatch):
    from policyscan.llm import near_dedup

    rng = random.Random(11)
    texts = family(rng, 120, 90, 2) + [t for _ in range(150) for t in family(rng, 1, 60, 0)]
    rng.shuffle(texts)
    branched = []
    monkeypatch.setattr(near_dedup, "_branched", lambda rows, how: branched.append(rows) or pytest.fail("branched"))
    how = NearDuplicates(words=4, small=15)
    found = near_duplicates(documents(spark, texts), how)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), 4, 80)
    assert not branched


@pytest.mark.parametrize("block", [50, 2048])
def test_copies_that_are_like_only_some_others_are_finished_too(spark, monkeypatch, block):
    from policyscan.llm import near_dedup

    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(250):  # four words changed: 80 % and more alike with the base, less with each other
        words = list(base)
        for at in rng.sample(range(150), 4):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    monkeypatch.setattr(near_dedup, "_branched", lambda rows, how: pytest.fail("branched"))
    how = NearDuplicates(words=4, small=25, block=block)
    found = near_duplicates(documents(spark, texts), how)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), 4, 80)


def test_blocks_are_bounded_by_bytes(spark):
    rng = random.Random(12)
    texts = [t for n in (9, 14) for t in family(rng, n, 400, 30)]
    how = NearDuplicates(words=4, small=3, block=1000, block_bytes=9000)
    found = near_duplicates(documents(spark, texts), how)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), 4, 80)


def test_an_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert deduplicated(documents(spark, ["", None])).count() == 2


def test_shingle_sets_follow_the_words():
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "É", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1f", " ", "日"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(400)] + [None]
    sets = list(shingles.shingle_sets(texts, 2))
    wanted = [shingle_set(t, 2) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in wanted]
    names = {}
    for found, true in zip(sets, wanted, strict=True):
        names.setdefault(frozenset(true), set()).add(found.tobytes())
    assert all(len(n) == 1 for n in names.values())
    assert len({n for x in names.values() for n in x}) == len(names)


def test_a_very_long_text_and_word():
    long = " ".join(f"w{i}" for i in range(300_000)) + " " + "x" * 2_000_000
    first, second = shingles.shingle_sets([long, long + " y"], 5)
    assert (len(first), len(second)) == (299_997, 299_998)
    assert len(np.intersect1d(first, second)) == 299_997


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    hashes = shingles.mixed(rng.integers(0, 2**63, 3000).astype(np.uint64))
    sign = shingles.Signatures(1024)
    same = (sign(hashes[:2500]) == sign(hashes[500:])).mean()
    assert abs(same - 2 / 3) < 0.06


def test_components_of_paths_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, i) for i in range(1001, 1400)]
    df = spark.createDataFrame([*path, *hub, (7, 7), (2000, 1399)], "a long, b long")
    found = dict(map(tuple, components(df).collect()))
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in [*range(1000, 1400), 2000]} == {1000}
    assert 7 not in found
    assert components(df.limit(0)).count() == 0
