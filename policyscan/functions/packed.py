"""Long texts in few bytes, for the shuffles and sorts that carry them."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lengths of the two texts in bytes (-1: null), and whether they are compressed.
_HEAD = struct.Struct("<qq?")
#: Texts that shrink more stay as they are, which bounds what a batch unpacks to.
_MOST = 8


def _pair(before: bytes | None, after: bytes | None, codec: pa.Codec) -> bytes:
    both = (before or b"") + (after or b"")
    short = codec.compress(both, asbytes=True)
    small = len(both) // _MOST <= len(short) < len(both)
    lengths = (-1 if text is None else len(text) for text in (before, after))
    return _HEAD.pack(*lengths, small) + (short if small else both)


def _texts(data: bytes, codec: pa.Codec) -> tuple[bytes | None, bytes | None]:
    first, second, small = _HEAD.unpack_from(data)
    end = max(first, 0)
    both = data[_HEAD.size :]
    if small:
        both = codec.decompress(both, end + max(second, 0), asbytes=True)
    return None if first < 0 else both[:end], None if second < 0 else both[end:]


def _pack(before: pd.Series, after: pd.Series) -> pd.Series:
    codec = pa.Codec("zstd")
    return pd.Series([_pair(b, a, codec) for b, a in zip(before, after, strict=True)], dtype=object)


def _unpack(pairs: pd.Series) -> pd.DataFrame:
    codec = pa.Codec("zstd")
    return pd.DataFrame([_texts(p, codec) for p in pairs], columns=["before", "after"], dtype=object)


def packed(before: Column, after: Column) -> Column:
    """Two texts, of which the second often repeats much of the first, as one binary."""
    pack = F.pandas_udf(_pack, "binary")
    return pack(before.cast("binary"), after.cast("binary"))


def unpacked(pair: Column) -> Column:
    """A struct of the two texts, ``before`` and ``after``."""
    unpack = F.pandas_udf(_unpack, "before binary, after binary")
    return unpack(pair).cast("struct<before: string, after: string>")
