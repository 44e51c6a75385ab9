"""The registered queries: their SQL, their rows, and the pipeline's stages."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from checks.compare import connect, differences, type_differences
from policyscan.llm import language, mixing, quality
from policyscan.llm.queries import QUERIES
from policyscan.llm.tables import materialized
from policyscan.llm.twins import TWINS

from .tables import documents
from .test_near_dedup import brute

SCALE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_agrees_with_its_sql(spark, name):
    duck = connect(SCALE)
    df = materialized(QUERIES[name](spark, SCALE), "result")
    assert type_differences(df, duck, TWINS[name]) == []
    assert differences(df, duck, TWINS[name]) == []


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage got and returned."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialized(stage(spark, docs, folder), "stage")
        found.append((name, docs, out))
        docs = out
    return found


def test_stages_return_the_columns_of_documents(stages):
    assert 4 <= len(stages) <= 5
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_filtering_stages_follow_their_operators(spark, folder, stages):
    (_, docs, spoken), (_, _, good), (_, _, single), (_, _, mixed), (_, _, packed) = stages
    rows = docs.collect()
    verdicts = language.fit(docs).judge([r.text for r in rows])
    wanted = {r.doc_id for r, v in zip(rows, verdicts, strict=True) if v[2]}
    assert {r.doc_id for r in spoken.collect()} == wanted
    rows = spoken.collect()
    scores = quality.fit(spoken, spark.read.parquet(f"{folder}/labels.parquet")).scores([r.text for r in rows])
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= 0.3}
    kept = {i for i, _, root in brute([(r.doc_id, r.text) for r in good.collect()], 5, 80) if i == root}
    assert {r.doc_id for r in single.collect()} == kept and single.count() == len(kept)
    how = mixing.Mixture(repetition=corpus_pipeline.REPETITION)
    uses = mixing.placed(single, how, mixing.plan(single, how, mixing.words()), mixing.words())
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in uses.collect())
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(r.doc_id for r in mixed.collect())


def test_run_equals_the_stages_on_a_small_table(spark, folder, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ours = corpus_pipeline.run(spark, folder).select(*columns).collect()
    assert Counter(map(tuple, ours)) == Counter(map(tuple, stages[-1][2].select(*columns).collect()))


def test_stages_on_odd_rows(spark, folder):
    for texts in ([None, "", " ", "x", "the and of " * 40, "the and of " * 40], []):
        docs = documents(spark, texts, lang=None, source=None)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialized(stage(spark, docs, folder), "odd")
        assert docs.count() >= 0
