"""Vector near-duplicates and exact search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from policyscan.llm.tables import materialized
from policyscan.llm.vector_dedup import Index, VectorDuplicates, vector_duplicates
from policyscan.llm.vector_search import top_k

from .tables import rows, vectors

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, []), (902, [0.0] * 12), (903, [NAN] + [1.0] * 11), (904, [INF] + [1.0] * 11), (905, [None] + [1.0] * 11)]


def clustered(seed=3, families=12, size=9, singles=200, dims=12, noise=0.03):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(families):
        base = rng.normal(size=dims)
        out += [base + noise * np.linalg.norm(base) * rng.normal(size=dims) for _ in range(size)]
    out += list(rng.normal(size=(singles, dims)))
    x = np.float32(out)
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]


def linked(data, least):
    ids = [i for i, _ in data]
    x = np.array([v for _, v in data], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    label = np.array(ids)
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            break
        label = low
    return sorted((i, int(n) - 1, int(c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True))


@pytest.mark.parametrize("how", [VectorDuplicates(), VectorDuplicates(entries=16, queries=16, lists=5, codes=8)])
def test_links_equal_brute_force(spark, how):
    data = clustered()
    data += [(2000 + i, data[5][1]) for i in range(30)]  # copies
    found = vector_duplicates(vectors(spark, data), how)
    assert rows(found, "vec_id", "n_links", "component_id") == sorted(linked(data, how.least), key=repr)
    assert found.where("kept <> (vec_id = component_id)").isEmpty()


def test_recall_on_the_given_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    least = 0.3  # so that this small table has links
    wanted = linked(data, least)
    found = rows(vector_duplicates(df, VectorDuplicates(least=least)), "vec_id", "n_links")
    assert sum(n for _, n in found) >= 0.9 * sum(n for _, n, _ in wanted) > 0


@pytest.mark.parametrize("dims", [768, 300])
def test_wide_groups_that_differ_in_few_directions(spark, dims):
    rng = np.random.default_rng(dims)
    plane = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
    angles = rng.uniform(0, 2 * np.pi, 300)
    x = np.float32(np.stack([np.cos(angles), np.sin(angles)], 1) @ plane)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    # Short vectors beside wide ones, alike in few directions too.
    short = [(1000 + i, v[:40].tolist()) for i, v in enumerate(np.float32(rng.normal(size=(60, 2)) @ rng.normal(size=(2, 40))))]
    found = vector_duplicates(vectors(spark, data + short))
    wanted = linked(data, 0.95) + linked(short, 0.95)
    assert rows(found, "vec_id", "n_links", "component_id") == sorted(wanted, key=repr)


def test_vectors_that_link_with_nothing(spark):
    data = [*ODD, (1, [1.0] * 12), (2, [2.0] * 12), (3, [1.0] * 11), (None, [1.0] * 12)]
    found = {r.vec_id: r for r in vector_duplicates(vectors(spark, data)).collect()}
    assert len(found) == len(data)
    assert (found[1].n_links, found[2].n_links, found[2].component_id) == (1, 1, 1)
    for i in (900, 901, 902, 903, 904, 905, 3, None):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert vector_duplicates(vectors(spark, [])).count() == 0


def test_encoding_error_bounds_the_table_distance():
    x = np.random.default_rng(1).normal(size=(300, 16))
    index = Index.fit(x, 300, VectorDuplicates(codes=16))
    home, _ = index.probes(x, 0.1)
    codes, off = index.encode(x - index.coarse[home])
    table = np.sqrt(np.maximum(index.distances(x[:20] - index.coarse[home[0]], codes[home == home[0]]), 0))
    true = np.linalg.norm(x[:20, None] - x[home == home[0]][None], axis=2)
    assert (np.abs(table - true) <= off[home == home[0]] + 1e-3).all()


def searched(data, k):
    ids = np.array([i for i, _ in data])
    x = np.floor(256 * np.array([v for _, v in data], float)).astype(np.int64)
    out = []
    for i in np.flatnonzero(ids % 50 == 0):
        others = np.flatnonzero(ids != ids[i])
        score = x[others] @ x[i]
        best = np.lexsort((ids[others], -score))[:k]
        out += [(int(ids[i]), r + 1, int(ids[others[b]]), int(score[b])) for r, b in enumerate(best)]
    return sorted(out, key=repr)


def test_search_equals_brute_force_with_ties(spark, monkeypatch):
    import policyscan.llm.vector_search as search

    monkeypatch.setattr(search, "FILE_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    data = clustered(seed=8)
    data += [(3000 + i, data[0][1]) for i in range(60)]
    df = vectors(spark, data)
    found = top_k(df, df.where("vec_id % 50 = 0"), 5)
    assert rows(found, "query_id", "rank", "vec_id", "score") == searched(data, 5)


def test_search_leaves_out_bad_vectors_and_returns_fewer(spark):
    data = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5, 1.0]), (50, None), (100, [NAN, 1.0]), (None, [1.0, 1.0]), (3, [2.0**40, 0.0])]
    df = vectors(spark, data)
    found = rows(top_k(df, df.where("vec_id % 50 = 0"), 5), "query_id", "rank", "vec_id", "score")
    assert found == [(0, 1, 3, 256 * 2**48), (0, 2, 1, 0)]
    empty = vectors(spark, [])
    assert top_k(empty, empty, 5).count() == 0


def test_scores_of_large_components_are_exact(spark):
    near = [2.0**46 - 2.0**23, 2.0**24, -(2.0**45), 300_000.0, 400_000.0, -400_000.0, -300_000.0, 1e-3, -0.5]
    for asked in ([0.125, 0.0], [1.0, -0.75], [-0.125, 2.0**30]):
        data = [(0, asked)] + [(1 + n, [x, y]) for n, (x, y) in enumerate((a, b) for a in near for b in (0.0, 1.0, -3.5))]
        data = [(i, np.float32(v).tolist()) for i, v in data]
        x = [(i, [math.floor(256 * c) for c in v]) for i, v in data]
        wanted = sorted((-sum(a * b for a, b in zip(x[0][1], v, strict=True)), i) for i, v in x[1:])[:6]
        assert all(abs(s) < 2**63 for s, _ in wanted)
        df = vectors(spark, data)
        found = rows(top_k(df, df.where("vec_id = 0"), 6), "rank", "vec_id", "score")
        assert found == [(r, i, -s) for r, (s, i) in enumerate(wanted, 1)]
    data = [(0, [1.0]), (1, [300_000.0]), (2, [400_000.0])]
    df = vectors(spark, data)
    assert rows(top_k(df, df.where("vec_id = 0"), 2), "rank", "vec_id", "score") == [(1, 2, 26_214_400_000), (2, 1, 19_660_800_000)]
    df = vectors(spark, [(0, [2.0**30]), (1, [2.0**30])])
    with pytest.raises(Exception, match="a score leaves 64 bits"):
        top_k(df, df, 1).collect()


def test_repeated_rows_are_candidates_each(spark):
    df = vectors(spark, [(0, [1.0]), (7, [2.0]), (7, [2.0]), (8, [2.0])])
    found = rows(top_k(df, df.where("vec_id = 0"), 3), "rank", "vec_id")
    assert found == [(1, 7), (2, 7), (3, 8)]


@pytest.mark.parametrize("held", [0, 20, 10_000])
def test_parts_of_the_file_that_queries_meet_block_by_block(spark, monkeypatch, held):
    import policyscan.llm.vector_search as search

    for name, most in (("FILE_BLOCK", 40), ("QUERY_BLOCK", 3), ("FILE_PARTS", 3), ("QUERIES_AT_ONCE", 2), ("BOUNDS_AT_ONCE", 2), ("HELD", held)):
        monkeypatch.setattr(search, name, most)
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialized(df, name)

    monkeypatch.setattr(search, "materialized", kept)
    data = clustered(seed=9) + [(4000 + i, clustered(seed=9)[0][1]) for i in range(30)]
    short = [(5000 + 10 * i, [v[0], 500.0 * v[1], 1e6 * v[2]]) for i, (_, v) in enumerate(clustered(seed=10)[:60])]
    none = [(6000 + 25 * i, []) for i in range(4)]
    df = vectors(spark, data + short + none)
    found = top_k(df, df.where("vec_id % 50 = 0"), 5)
    wanted = searched(data, 5) + searched([(i, np.float32(v).tolist()) for i, v in short], 5)
    wanted += [(i, r, other, 0) for i in (6000, 6050) for r, other in enumerate((j for j, _ in none if j != i), 1)]
    assert rows(found, "query_id", "rank", "vec_id", "score") == sorted(wanted, key=repr)
    # A join may be done by a broadcast, which takes the copies of all blocks to the driver.
    assert "edges" in plans["bounds"] and "Join" not in plans["bounds"] and "Broadcast" not in plans["bounds"]


def test_candidates_do_not_grow_with_the_blocks_of_a_part(spark, monkeypatch):
    import policyscan.llm.vector_search as search

    counted = {}

    def kept(df, name):
        out = materialized(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(search, "materialized", kept)
    monkeypatch.setattr(search, "FILE_PARTS", 2)
    df = vectors(spark, clustered(seed=11, singles=1500))
    found = []
    for size in (20, 400):
        monkeypatch.setattr(search, "FILE_BLOCK", size)
        top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
        found.append(counted["bounds"])
    assert found[0] < 2 * found[1]


def test_numbers_are_stored_in_the_shortest_type_that_holds_them():
    from policyscan.llm.vector_search import _narrow

    for values, kind in (([-128, 127], "int8"), ([-129], "int16"), ([2**15], "int32"), ([2.0**31], "float64"), ([-1e300], "float64"), ([], "int8")):
        found, data = _narrow(np.array([values], float))
        assert found == kind and np.frombuffer(data, found).astype(float).tolist() == values
