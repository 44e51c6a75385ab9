"""Packing token pieces into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyscan.llm.byte_bpe import ByteBpe
from policyscan.llm.tables import materialized

#: Pieces that one packer places, on average.
PIECES_PER_PACKER = 1 << 15

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, special: bool = False) -> DataFrame:
    """Each document's tokens and a final ``end_id``, cut into windows and a rest.

    One row per piece: where it starts, its length, the CRC-32 of its ids and the tokens of
    the document. A null text counts as empty and gives the end alone. Equal rows of the
    input give equal rows here. ``special`` tells whether the strings of added tokens in a
    text get their own ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ByteBpe(tokenizer, special).encode
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"]):
                data = encode(text or "") + end
                tokens = len(data) // 4
                for start in range(0, tokens, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append((at, start, len(part) // 4, zlib.crc32(part), tokens))
            frame = pd.DataFrame(rows, columns=["at", "start", "length", "ids_crc32", "doc_tokens"])
            frame.insert(0, "doc_id", batch["doc_id"].iloc[frame["at"]].array)
            yield frame.drop(columns="at")

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece, placed in the given order.

    ``open_at[h]`` counts the windows that are filled up to level ``h``. A piece goes to the
    level, or to a new window, that leaves the least sum of the squares of these counts;
    full windows do not count. Ties go to the fullest level.
    """
    open_at = np.zeros(window + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        best = 0
        room = window - size
        if room:
            # Change of the sum: a level loses one window, level + size gains one.
            change = 2 * open_at[size : window + 1] + 1
            change[room] = 0
            change[1:] += np.where(open_at[1 : room + 1] > 0, 1 - 2 * open_at[1 : room + 1], np.iinfo(np.int32).max)
            best = room - int(np.argmin(change[::-1]))
        if best:
            chosen = waiting[best].pop()
            open_at[best] -= 1
        else:
            chosen = made
            made += 1
        bins[i], offsets[i] = chosen, best
        if best + size < window:
            open_at[best + size] += 1
            waiting[best + size].append(chosen)
    return bins, offsets


def packed(cut: DataFrame, window: int = 1024, pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; no sequence is longer than ``window``.

    Pieces are dealt by a hash to packers, of which there are as many as the pieces need, so
    that each places a bounded number and leaves few windows partly filled. Equal pieces of
    repeated documents are counted, numbered and then dealt apart, so that a document that is
    repeated often does not meet in one packer. A packer places its pieces in the order of
    their hash. ``sequence_id`` holds the packer above 2^32.
    """
    stored = materialized(cut, "pieces")
    packers = max(1, -(-stored.count() // pieces_per_packer))
    columns = stored.columns
    copies = stored.groupBy(*columns).agg(F.count("*").alias("_n"))
    single = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.xxhash64(*columns, "_copy")
    dealt = single.withColumn("_order", order).withColumn("_packer", F.pmod(F.xxhash64("_order"), F.lit(packers)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "doc_id", "start", "_copy"], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), window)
        out = pdf[columns].copy()
        out["sequence_id"] = pdf["_packer"].to_numpy(np.int64) * (1 << 32) + bins
        out["offset"] = offsets
        return out

    return dealt.drop("_n").groupBy("_packer").applyInPandas(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, special: bool = False) -> DataFrame:
    """``documents`` cut into pieces and packed; one row per piece."""
    return packed(pieces(documents, tokenizer, window, end_id, special), window)

