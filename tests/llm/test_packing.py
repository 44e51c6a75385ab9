from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from policyscan.llm.byte_bpe import ByteBpe
from policyscan.llm.packing import pack_documents, sum_of_squares
from policyscan.llm.queries import QUERIES

from .tables import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check(found, texts, library, window):
    """Pieces cover each document's ids once, and sequences are gapless and not too long."""
    pieces = {}
    sequences = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = library(texts[i] or "") + [0]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length >= 1
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_round_trip_of_the_given_documents(spark, folder, library):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    found = pack_documents(df, PATH).collect()
    sequences = check(found, texts, library, 1024)
    tokens = sum(r.length for r in found)
    assert sequences * 1024 < 1.12 * tokens


def test_odd_texts(spark, library):
    texts = [None, "", " ", "<|endoftext|> x", "a  b\n\n c\t", "long " * 30_000, "é日\U0001f600 'S it's", "ab" * 50_000]
    found = pack_documents(documents(spark, texts), PATH, 64).collect()
    check(found, dict(enumerate(texts)), library, 64)


def test_repeated_rows_each_get_their_pieces(spark):
    df = documents(spark, ["one two three"] * 40 + ["x"], ids=[7] * 40 + [None])
    found = pack_documents(df, PATH, 8).collect()
    assert len(found) == 41 and len({(r.sequence_id, r.offset) for r in found}) == 41
    assert pack_documents(documents(spark, []), PATH).count() == 0


def test_ids_equal_the_library_on_random_texts(library):
    rng = random.Random(1)
    alphabet = [*" \n\t ab'sé1!　日", "<|endoftext|>", "'re", "\r\n", "\U0001f600", "　", "\x85"]
    encode = ByteBpe(PATH).encode
    for _ in range(2000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert encode(text) == np.array(library(text), "<u4").tobytes()


def test_added_tokens_get_the_ids_of_the_library_left_alone(spark):
    plain = Tokenizer.from_file(PATH)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = random.Random(4)
    alphabet = [*" \n\t ab'sé1!", "<|endoftext|>", "<|endo", "'re", "\U0001f600"]
    encode = ByteBpe(PATH, special=True).encode
    for _ in range(2000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_the_query_and_the_stage_take_the_ids_of_the_library_left_alone(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "no such token"]
    df = documents(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    own = lambda text: plain.encode(text, add_special_tokens=False).ids
    check(QUERIES["op5_sum_of_squares_packing"](spark, str(tmp_path)).collect(), dict(enumerate(texts)), own, 1024)
    check(corpus_pipeline.pack(spark, df, str(tmp_path)).collect(), dict(enumerate(texts)), own, 1024)


def naive(lengths, window):
    counts, bins, out = [0] * (window + 1), [], []
    for size in lengths:
        best = None
        for level in range(window - size, -1, -1):
            if level and not counts[level]:
                continue
            after = list(counts)
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            total = sum(n * n for n in after[1:window])
            if best is None or total < best[0]:
                best = (total, level, after)
        _, level, counts = best
        if level:
            chosen = max(i for i, fill in enumerate(bins) if fill[0] == level and fill[1] == max(f[1] for f in bins if f[0] == level))
        else:
            bins.append([0, 0])
            chosen = len(bins) - 1
        bins[chosen] = [level + size, len(out) + 1]
        out.append((chosen, level))
    return out


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(2)
    for window in (7, 16, 50):
        lengths = rng.integers(1, window + 1, 200)
        bins, offsets = sum_of_squares(lengths, window)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == naive(lengths.tolist(), window)
