"""Small tables for the tests of this folder."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
VECTOR = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)
PAGE = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def documents(spark, texts, lang="en", source="s", ids=None):
    """One document per text; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCUMENT)


def vectors(spark, rows):
    """Rows of (vec_id, components)."""
    return spark.createDataFrame([(i, v, None) for i, v in rows], VECTOR)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
