"""Language and quality on held-out documents, and odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyscan.llm import language, quality
from policyscan.llm.queries import op6_nearest_centroid_language, op7_discriminant_quality

from .tables import documents

SCALE = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    found = op6_nearest_centroid_language(spark, SCALE)
    rows = found.join(spark.read.parquet(f"{SCALE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([r.accepted for r in rows]) > 0.99


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{SCALE}/documents.parquet"))


def test_odd_texts_have_a_defined_language(spark, model):
    texts = [None, "", " \n", "12 345 !?", "日本語の文章です。これは別の言語で書かれています。" * 10, "İ" * 700, "ß the and of", "the " * 200_000]
    df = documents(spark, texts).withColumn("found", F.lit(1))
    rows = df.select("doc_id", language.language(model).alias("r")).orderBy("doc_id").collect()
    assert [(r.r.lang_pred, r.r.score, r.r.accepted) for r in rows[:4]] == [("und", 0.0, False)] * 4
    assert not rows[4].r.accepted and rows[4].r.lang_pred in model.languages
    assert rows[7].r.lang_pred == "en"
    assert all(0 <= r.r.score <= 1 for r in rows)


def test_language_without_training_rows(spark):
    empty = language.fit(documents(spark, []))
    assert empty.languages == []
    rows = documents(spark, ["some text"]).select(language.language(empty).alias("r")).collect()
    assert tuple(rows[0].r) == ("und", 0.0, False)


def test_the_prediction_uses_only_the_text(spark, model):
    df = documents(spark, ["Onan, thhare of erhe ndouly of, heen shti"] * 2, lang="de")
    found = {tuple(r.r) for r in df.select(language.language(model).alias("r")).collect()}
    assert len(found) == 1


def test_blocks_do_not_change_counts():
    how = language.NearestCentroids()
    texts = ["Ab c", "", "é1é  x", "long " * 400] * 90
    whole = np.concatenate(list(language.counts(texts, how)))
    single = np.concatenate([b for t in texts for b in language.counts([t], how)])
    assert np.array_equal(whole, single)


def plain_vector(text, how, idf):
    """TF-IDF of hashed n-grams by a loop over characters."""
    mask, counts = (1 << 64) - 1, {}

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    letters = f" {letters} " if letters else " "
    for n in range(1, how.longest + 1):
        for at in range(len(letters) - n + 1):
            gram = letters[at : at + n]
            if gram == " ":
                continue
            value = 0
            for c in gram:
                value = (value * 0x110000 + ord(c)) & mask
            slot = mix((value + (n << 60)) & mask) % how.slots
            counts[slot] = counts.get(slot, 0) + 1
    vector = {slot: np.log1p(count) * idf[slot] for slot, count in counts.items()}
    size = np.sqrt(sum(v * v for v in vector.values())) or 1.0
    return {slot: v / size for slot, v in vector.items()}


def test_predictions_equal_a_plain_version(spark, model):
    rows = spark.read.parquet(f"{SCALE}/documents.parquet").where("length(text) < 3000").limit(60).collect()
    texts = [r.text for r in rows] + ["Straße, l'été!", "a", "x  y\t- 9 z", "ǅ İi", "?"]
    for text, (found, score, _) in zip(texts, model.judge(texts), strict=True):
        vector = plain_vector(text, model.how, model.idf)
        near = [sum(v * centroid[slot] for slot, v in vector.items()) for centroid in model.centroids]
        if not any(c.isalpha() for c in text):
            assert (found, score) == ("und", 0.0)
            continue
        assert score == pytest.approx(min(1.0, max(0.0, max(near))), abs=1e-5)
        owners = {model.languages[o] for o, n in zip(model.owner, near, strict=True) if n >= max(near) - 1e-5}
        assert found in owners


def test_idf_and_centroids_equal_a_plain_version(spark):
    df = spark.read.parquet(f"{SCALE}/documents.parquet").where("length(text) < 1500")
    how = language.NearestCentroids(sample=10_000, rounds=0, centroids=2)
    model = language.fit(df, how)
    rows = [(r.lang, r.text) for r in df.collect()]
    held = np.zeros(how.slots)
    for _, text in rows:
        held[list(plain_vector(text, how, np.ones(how.slots)))] += 1
    np.testing.assert_allclose(model.idf, np.log((1 + len(rows)) / (1 + held)) + 1, rtol=1e-5)
    # Without rounds the centroids are the first and last texts in order.
    for at, lang in enumerate(model.languages):
        texts = sorted(t for name, t in rows if name == lang)
        for centroid, text in zip(model.centroids[model.owner == at], (texts[0], texts[-1]), strict=True):
            wanted = np.zeros(how.slots)
            for slot, v in plain_vector(text, how, model.idf).items():
                wanted[slot] = v
            np.testing.assert_allclose(centroid, wanted, atol=1e-5)


def test_languages_of_most_texts_are_learned(spark):
    texts = [("aa", "alpha beta"), ("aa", "alpha gamma"), ("bb", "delta eta"), ("bb", "eta zeta"), ("cc", "omega")]
    df = spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(texts)], "doc_id long, text string, lang string")
    assert language.fit(df, language.NearestCentroids(languages=2)).languages == ["aa", "bb"]


def test_quality_of_held_out_documents(spark):
    rows = op7_discriminant_quality(spark, SCALE).join(spark.read.parquet(f"{SCALE}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_log_densities_equal_the_plain_formula(spark):
    df = spark.read.parquet(f"{SCALE}/documents.parquet")
    labels = spark.read.parquet(f"{SCALE}/labels.parquet")
    how = quality.Discriminant()
    fitted = quality.fit(df, labels, how)
    rows = df.join(labels, "doc_id").select("text", "quality").collect()
    x, y = quality.matrix([r.text for r in rows]), np.array([r.quality for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    common = sum(c * (y == k).sum() for k, c in enumerate(covs)) / len(y)
    logs = []
    for c in (0, 1):
        cov = 0.9 * covs[c] + 0.1 * common
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + how.floor * np.eye(len(cov))
        away = x - x[y == c].mean(axis=0)
        far = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        logs.append(np.log(((y == c).sum() + 1) / (len(y) + 2)) - np.linalg.slogdet(cov)[1] / 2 - far / 2)
    wanted = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(fitted.scores([r.text for r in rows]), wanted, atol=1e-6)


def test_odd_texts_and_labels_have_a_score(spark):
    texts = [None, "", " \n", "x", "word " * 100_000, "|" * 1000, "日本"]
    df = documents(spark, texts)
    marked = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 1), (5, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (marked, marked.limit(0)):
        fitted = quality.fit(df, labels)
        scores = [r.s for r in df.select(quality.score(fitted).alias("s")).collect()]
        assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores)
    assert documents(spark, []).select(quality.score(fitted).alias("s")).count() == 0
