"""Whitening against plain integers and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyscan.llm import whitening
from policyscan.llm.queries import op11_bit_sliced_whitening

from .tables import rows, vectors

NAN, INF = float("nan"), float("inf")


def plain(data, components=32):
    """Exact deviations and the covariance by Python integers, and its eigenvalues."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in data]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    away = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    deviation = [sum(a * a for a in r) for r in away]
    covariance = np.array([[sum(a[i] * a[j] for a in away) / n**3 for j in range(dims)] for i in range(dims)])
    return np.array(away, float) / n, deviation, covariance


def check(found, data, model):
    away, deviation, covariance = plain(data)
    got = {r.vec_id: r for r in found.collect()}
    assert len(got) == len(data)
    assert [int(got[i].deviation) for i, _ in data] == deviation
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1][: len(model.variances)]
    np.testing.assert_allclose(model.variances, values, rtol=1e-7)
    np.testing.assert_allclose(model.explained, model.variances / np.trace(covariance), rtol=1e-9)
    z = np.array([got[i].whitened for i, _ in data])
    np.testing.assert_allclose(z, away @ model.axes / np.sqrt(model.variances), atol=1e-7)
    np.testing.assert_allclose(z.T @ z / len(z), np.eye(z.shape[1]), atol=1e-7)
    assert model.identity_error <= 1e-7


@pytest.mark.parametrize("bits_at_once", [1 << 22, 64])
def test_whitening_equals_plain_integers(spark, bits_at_once):
    rng = np.random.default_rng(5)
    data = [(i, v.tolist()) for i, v in enumerate(np.float32(rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))))]
    df = vectors(spark, data).repartition(3)
    model = whitening.fit(df, whitening.Whitening(bits_at_once=bits_at_once))
    assert model.rows == 300 and len(model.variances) == 7
    check(whitening.whiten(df, model), data, model)


def test_variances_of_many_orders_of_magnitude(spark):
    rng = np.random.default_rng(6)
    spread = np.array([1e9, 1e5, 10.0, 1.0, 0.1])
    data = [(i, v.tolist()) for i, v in enumerate(np.float32(rng.normal(size=(200, 5)) * spread))]
    df = vectors(spark, data)
    model = whitening.fit(df)
    assert len(model.variances) == 5 and model.identity_error < 1e-6
    assert [int(r.deviation) for r in whitening.whiten(df, model).orderBy("vec_id").collect()] == plain(data)[1]


def test_the_scatter_of_bits_is_exact():
    rng = np.random.default_rng(7)
    values = rng.integers(0, [2**40, 2**3, 1, 2**17, 2], (1000, 5))
    values[:, 4] = 1
    found = whitening.Scatter(np.array([40, 3, 0, 17, 1]))
    for part in np.array_split(values, 3):
        found.add(part)
    total = np.zeros((5, 5), object)
    for r in found.rows().itertuples():
        total[r.i, r.j] += int(r.value) << 16 * int(r.limb)
    exact = values.astype(object).T @ values.astype(object)
    assert (np.triu(total) == np.triu(exact)).all()


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 2))
    data = [(i, [float(np.float32(a)), 3.0, float(np.float32(b)), float(np.float32(a))]) for i, (a, b) in enumerate(base)]
    df = vectors(spark, data)
    model = whitening.fit(df)
    assert len(model.variances) == 2 and model.identity_error < 1e-9
    few = whitening.fit(df, whitening.Whitening(components=1))
    assert len(few.variances) == 1
    equal = vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])
    model = whitening.fit(equal)
    assert model.rows == 4 and len(model.variances) == 0
    assert [tuple(r) for r in whitening.whiten(equal, model).select("deviation", "whitened").distinct().collect()] == [(0, [])]


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [(i % 5 if i else None, np.float32(v).tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))]
    short = [(50, [0.5, -0.25]), (51, []), (52, [0.0, 0.0, 0.0])]
    bad = [(60, None), (61, [NAN, 1.0, 1.0]), (62, [INF, 1.0, 1.0]), (63, [None, 1.0, 1.0])]
    df = vectors(spark, good + short + bad).withColumns({"whitened": F.lit("x"), "deviation": F.lit(1), "i": F.lit(2)})
    model = whitening.fit(df)
    found = whitening.whiten(df, model)
    assert model.rows == 43 and found.count() == 43 and found.where("vec_id >= 60").isEmpty()
    full = [(n, (v + [0.0] * 3)[:3]) for n, (_, v) in enumerate(good + short)]
    assert sorted(int(r.deviation) for r in found.collect()) == sorted(plain(full)[1])
    none = vectors(spark, bad)
    assert whitening.fit(none) is None and whitening.whiten(none, None).isEmpty()


def test_the_query(spark, folder, tmp_path):
    found = op11_bit_sliced_whitening(spark, folder)
    assert found.dtypes[:6] == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"),
    ]
    got = found.collect()
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    _, deviation, covariance = plain(data)
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1][:32]
    assert len(got) == 32 * len(data) and {r.n for r in got} == {len(data)}
    assert dict(zip((i for i, _ in data), deviation, strict=True)) == {r.vec_id: r.deviation for r in got}
    np.testing.assert_allclose([r.explained for r in sorted(got, key=lambda r: r.component)][:: len(data)], values / np.trace(covariance), rtol=1e-9)
    assert {r.identity_error <= 1e-9 for r in got} == {True}
    vectors(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = op11_bit_sliced_whitening(spark, str(tmp_path))
    assert empty.dtypes == found.dtypes and rows(empty, "vec_id") == []
