from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from policyscan.llm.token_counts import BLANK, UnigramCounter, token_count, vocabulary

from .tables import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, unknown, byte_fallback):
    tokenizer = Tokenizer(models.Unigram(pieces, unknown, byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=BLANK, prepend_scheme="always")
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def whole():
    pieces, unknown = vocabulary(PATH)
    return UnigramCounter(pieces), library(pieces, unknown, True)


def test_counts_equal_the_library_on_the_given_documents(spark, folder, whole):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for r in df.select("text", token_count(PATH).alias("n")).collect():
        assert r.n == whole[1](r.text)


def test_counts_equal_the_library_on_random_texts(whole):
    rng = random.Random(6)
    alphabet = [*"abcehinorst .,\n\t 09", "th", "ing", " the", BLANK, "é", "日", "\U0001f600", "<s>", "  ", "<0x41>", "̀"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(30)))
        assert whole[0](text) == whole[1](text), repr(text)


@pytest.mark.parametrize("seed", range(30))
def test_ties_follow_the_library(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("ab" + BLANK, k=rng.randrange(1, 5))) for _ in range(12)} - {"a" if seed % 2 else ""}
    pieces = [("<unk>", 0.0)] + [(w, float(-rng.randrange(1, 4))) for w in sorted(words) if w]
    ours, theirs = UnigramCounter(pieces), library(pieces, 0, False)
    for _ in range(200):
        text = "".join(rng.choices("abc ", k=rng.randrange(12)))
        assert ours(text) == theirs(text), (pieces, text)


def test_odd_texts(spark):
    df = documents(spark, [None, "", " ", "word " * 100_000, "x" * 20_000])
    found = [r.n for r in df.orderBy("doc_id").select(token_count(PATH).alias("n")).collect()]
    assert found[:3] == [0, 0, 1] and found[3] > 100_000
    assert documents(spark, []).select(token_count(PATH).alias("n")).count() == 0
