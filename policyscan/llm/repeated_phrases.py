"""Removal of passages that occur more than once, by automata of repeated phrases.

Every window of words has an anchor, the run of a few words in it with the least hash; it
depends on the window's words alone, so equal windows have equal anchors. Anchors are counted
over all documents, and those seen twice lead to segments, the stretches of text whose windows
share the anchor. Segments with one anchor go to one shard. There windows that start twice are
confirmed, runs of them are the phrases of the shard's Aho-Corasick automaton over words, and
all segments of the shard stream through it, which finds every occurrence. Texts without
a repeated anchor hold no repeated window and go nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.llm import shingles
from policyscan.llm.tables import materialized, unused_name

LOCATED = "anchor long, digest long, begins array<int>, ends array<int>"


@dataclass(frozen=True)
class RepeatedPhrases:
    """Windows of ``words`` consecutive words; anchors have ``anchor`` words.

    A shard has about ``segments`` different segments; one that holds more, as its anchor is
    very common, is split, and its windows are counted before. Up to ``broadcast`` numbers of
    texts, 8 bytes each, go to all executors; more are joined by a shuffle.
    """

    words: int = 35
    anchor: int = 8
    segments: int = 20_000
    broadcast: int = 2_000_000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _key() -> Column:
    """128 bits that stand for a text; all rows with one text have one."""
    return F.unhex(F.md5(_text().cast("binary")))


def _anchors(words: np.ndarray, how: RepeatedPhrases) -> tuple[np.ndarray, np.ndarray]:
    """For each window, by its start, where its anchor begins; and the hashes at all places."""
    windows = len(words) - how.words + 1
    if windows < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(len(words) - how.anchor + 1, np.uint64)
    for j, factor in enumerate(shingles.odd(how.anchor, 401)):
        grams += words[j : j + len(grams)] * factor
    grams = shingles.mixed(grams)
    inside = np.lib.stride_tricks.sliding_window_view(grams, how.words - how.anchor + 1)
    return np.arange(windows) + inside.argmin(axis=1), grams


def _hashed(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, in order."""
    for low, high in shingles.spans([len(t) + 1 for t in texts], shingles.BYTES_AT_ONCE):
        hashes, counts = shingles.word_hashes(texts[low:high], shingles.AS_WRITTEN)
        yield from np.split(hashes, np.cumsum(counts)[:-1])


def _digest(words: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def fingerprints(documents: DataFrame, how: RepeatedPhrases) -> DataFrame:
    """Per row the text's key, its number of words, their SHA-256, and the anchors of its windows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text").tolist()
            found = []
            for hashes in _hashed(texts):
                at, grams = _anchors(hashes, how)
                found.append(grams[np.unique(at)].astype(np.int64))
            split = [t.split() for t in texts]
            batch["n_words"] = [len(w) for w in split]
            batch["words_sha256"] = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
            batch["anchors"] = found
            yield batch

    rows = documents.select("doc_id", _key().alias("key"), _text().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(scan, f"doc_id {kind}, key binary, n_words long, words_sha256 string, anchors array<long>")


def _number(key: str = "key") -> Column:
    """64 bits of a key: enough to find texts, which their keys then tell apart."""
    return F.xxhash64(key)


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """``number`` of each text (key, copies, anchors) and its anchors that occur twice or more."""
    each = texts.select(_number().alias("number"), "copies", F.explode("anchors").alias("anchor"))
    twice = each.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
    held = each.select("number", "anchor").join(twice, "anchor")
    return held.groupBy("number").agg(F.collect_set("anchor").alias("repeated"))


def segments_of(candidates: DataFrame, how: RepeatedPhrases, texts: bool) -> DataFrame:
    """Segments around repeated anchors of ``candidates`` (key, copies, text, repeated).

    Each has its anchor, its digest and its number of copies, and either its text or else the
    text's key and the number of its first word there.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["text"].tolist()
            columns = {"anchor": [], "digest": [], "copies": []} | ({"text": []} if texts else {"key": [], "start": []})
            for row, hashes in enumerate(_hashed(whole)):
                at, grams = _anchors(hashes, how)
                values = grams[at].astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
                chosen = np.flatnonzero(np.isin(values[cuts[:-1]], np.asarray(batch["repeated"].iloc[row], np.int64)))
                words = whole[row].split() if len(chosen) else []
                for low, high in zip(cuts[chosen].tolist(), cuts[chosen + 1].tolist(), strict=True):
                    segment = b" ".join(words[low : high - 1 + how.words])
                    columns["anchor"].append(int(values[low]))
                    columns["digest"].append(_digest(segment))
                    columns["copies"].append(int(batch["copies"].iloc[row]))
                    if texts:
                        columns["text"].append(segment)
                    else:
                        columns["key"].append(batch["key"].iloc[row])
                        columns["start"].append(low)
            if columns["anchor"]:
                yield pd.DataFrame(columns)

    kind = "text binary" if texts else "key binary, start long"
    return candidates.mapInPandas(scan, f"anchor long, digest long, copies long, {kind}")


def _windows(segments: pd.DataFrame, how: RepeatedPhrases) -> pd.DataFrame:
    """All windows of the segments: the segment's row, the start there, copies, and 128 bits of its words."""
    hashes, counts = shingles.word_hashes(segments["text"].tolist(), shingles.AS_WRITTEN)
    inside = counts - how.words + 1
    rows = np.repeat(np.arange(len(segments)), inside)
    start = np.arange(len(rows)) - np.repeat(np.cumsum(inside) - inside, inside)
    at = start + np.repeat(np.cumsum(counts) - counts, inside)
    both = []
    for seed in (811, 977):
        total = np.zeros(max(0, len(hashes) - how.words + 1), np.uint64)
        for j, factor in enumerate(shingles.odd(how.words, seed)):
            total += hashes[j : j + len(total)] * factor
        both.append(shingles.mixed(total)[at].astype(np.int64))
    copies = segments["copies"].to_numpy()[rows]
    return pd.DataFrame({"row": rows, "start": start, "copies": copies, "one": both[0], "two": both[1]})


def automaton(phrases: Iterator[tuple[int, ...]]) -> ahocorasick.Automaton:
    """An automaton over word numbers that gives the length of each phrase it finds."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    return found


def _occurrences(phrases: ahocorasick.Automaton, words: tuple[int, ...]) -> list[tuple[int, int]]:
    """The stretches of ``words`` that occurrences of phrases cover."""
    covered: list[tuple[int, int]] = []
    for last, length in phrases.iter(words):
        begin, end = last + 1 - length, last + 1
        while covered and covered[-1][1] >= begin:
            begin = min(begin, covered.pop()[0])
        covered.append((begin, end))
    return covered


def _shard(segments: pd.DataFrame, known: pd.DataFrame | None, how: RepeatedPhrases) -> pd.DataFrame:
    """The covered stretches of a shard's segments; ``known`` has its repeated windows, or
    they are counted here if the shard is whole."""
    if not len(segments):
        return pd.DataFrame(columns=["anchor", "digest", "begins", "ends"])
    windows = _windows(segments, how)
    if known is None:
        again = windows.groupby(["one", "two"])["copies"].transform("sum").to_numpy() > 1
    else:
        marked = windows[["one", "two"]].merge(known[["one", "two"]].assign(again=True), how="left", on=["one", "two"])
        again = marked["again"].notna().to_numpy()
    rows, starts = windows["row"].to_numpy()[again], windows["start"].to_numpy()[again]
    if not len(rows):
        return pd.DataFrame(columns=["anchor", "digest", "begins", "ends"])
    numbers: dict[bytes, int] = {}
    words = [tuple(numbers.setdefault(w, len(numbers)) for w in t.split(b" ")) for t in segments["text"]]
    cuts = np.flatnonzero((rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(rows) - 1]])
    runs = zip(rows[firsts].tolist(), starts[firsts].tolist(), starts[lasts].tolist(), strict=True)
    phrases = automaton(words[row][low : high + how.words] for row, low, high in runs)
    covered = [_occurrences(phrases, w) for w in words]
    return pd.DataFrame(
        {
            "anchor": segments["anchor"].to_numpy(),
            "digest": segments["digest"].to_numpy(),
            "begins": [[b for b, _ in c] for c in covered],
            "ends": [[e for _, e in c] for c in covered],
        }
    )[[bool(c) for c in covered]]


def located(segments: DataFrame, how: RepeatedPhrases) -> DataFrame:
    """The stretches of each different segment (anchor, digest, copies, text) that repeated
    phrases cover, as numbers of words in it."""
    shards = -(-max(1, segments.count()) * 2 // how.segments)
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sizes = materialized(dealt.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
    large = sizes.where(F.col("n") > how.segments)
    if large.isEmpty():
        return dealt.groupBy("shard").applyInPandas(lambda s: _shard(s, None, how), LOCATED)
    whole = dealt.join(large, "shard", "left_anti").groupBy("shard").applyInPandas(lambda s: _shard(s, None, how), LOCATED)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), how.segments):
                part = batch.iloc[low : low + how.segments]
                windows = _windows(part, how)
                windows["shard"] = part["shard"].to_numpy()[windows["row"]]
                yield windows.groupby(["shard", "one", "two"], as_index=False)["copies"].sum()

    split = dealt.join(large, "shard")
    windows = split.select("shard", "copies", "text").mapInPandas(count, "shard long, one long, two long, copies long")
    known = windows.groupBy("shard", "one", "two").agg(F.sum("copies").alias("copies")).where("copies > 1")
    known = materialized(known.select("shard", "one", "two"), "repeated-windows")
    # Segments are dealt to blocks, known windows to parts, and every block meets every part.
    parts = known.groupBy("shard").agg(F.ceil(F.count("*") / (how.segments * 8)).alias("parts"))
    grid = large.join(parts, "shard").select("shard", "parts", F.ceil(F.col("n") / how.segments).alias("blocks"))
    grid = materialized(grid, "split-shards")
    left = split.drop("n").join(grid, "shard").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks"))
    left = left.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts", "blocks")
    right = known.join(grid, "shard").withColumn("part", F.pmod(F.xxhash64("one"), "parts"))
    right = right.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("parts", "blocks")
    cell = ["shard", "block", "part"]
    pairs = left.groupBy(*cell).cogroup(right.groupBy(*cell))
    return whole.unionByName(pairs.applyInPandas(lambda s, k: _shard(s, k, how), LOCATED))


def repeated_spans(documents: DataFrame, texts: DataFrame, how: RepeatedPhrases) -> DataFrame:
    """Per different text with repeated passages: key, copies, text (binary), and ``spans``,
    pairs of first word and end of the stretches that repeated windows cover; these may overlap.

    ``texts`` has key, copies and anchors of each different text of ``documents``.
    """
    hits = materialized(repeated_anchors(texts), "repeated-anchors")
    rows = documents.select(_key().alias("key"), _text().cast("binary").alias("text"))
    if hits.count() <= how.broadcast:
        rows = rows.join(F.broadcast(hits.select("number")), _number() == F.col("number"), "left_semi")
    # Equal texts meet in their task first, so that one with very many copies is moved a few times only.
    once = rows.groupBy("key").agg(F.first("text").alias("text"))
    found = once.join(texts.select("key", "copies"), "key").withColumn("number", _number()).join(hits, "number")
    candidates = materialized(found.drop("number"), "candidates")
    members = materialized(segments_of(candidates, how, texts=False).drop("copies"), "members")
    different = segments_of(candidates, how, texts=True).groupBy("anchor", "digest")
    different = materialized(different.agg(F.sum("copies").alias("copies"), F.first("text").alias("text")), "segments")
    covered = materialized(located(different, how), "located")
    spans = members.join(covered, ["anchor", "digest"]).select(
        "key", F.explode(F.arrays_zip(F.col("begins").alias("low"), F.col("ends").alias("high"))).alias("s"), "start"
    )
    spans = spans.groupBy("key").agg(F.collect_list(F.array(F.col("start") + F.col("s.low"), F.col("start") + F.col("s.high"))).alias("spans"))
    return candidates.drop("repeated").join(spans, "key")


def kept_words(text: bytes, spans: list) -> list[bytes]:
    """The words of a text outside the spans."""
    words = text.split()
    kept = np.ones(len(words), bool)
    for low, high in spans:
        kept[low:high] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def without_repeats(documents: DataFrame, how: RepeatedPhrases = RepeatedPhrases()) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the
    words that stay, joined by blanks.

    A word goes if it is in a window whose words start anywhere else too, in this row or
    another. A null text has no words. Rows with one doc_id, or none, stay rows of their own,
    and two rows with one text are copies of each other. Other columns are ignored.
    """
    signed = materialized(fingerprints(documents, how), "words")
    texts = signed.where("size(anchors) > 0").groupBy("key").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    texts = materialized(texts, "texts")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [kept_words(t, p) for t, p in zip(batch["text"], batch["spans"], strict=True)]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "n_kept": [len(k) for k in kept],
                    "kept": [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept],
                }
            )

    spans = repeated_spans(documents, texts, how).select("key", "text", "spans")
    judged = materialized(spans.mapInPandas(judge, "key binary, n_kept long, kept string"), "kept")
    return (
        signed.drop("anchors")
        .join(judged, "key", "left")
        .select(
            "doc_id",
            "n_words",
            (F.col("n_words") - F.coalesce("n_kept", "n_words")).alias("n_removed"),
            F.coalesce("kept", "words_sha256").alias("kept_sha256"),
        )
    )


def with_kept_text(documents: DataFrame, how: RepeatedPhrases = RepeatedPhrases()) -> DataFrame:
    """``documents`` with a column ``kept_text``, its words outside repeated passages joined by
    blanks; a text without such passages stays as it is, and a null one null."""
    signed = fingerprints(documents, how).where("size(anchors) > 0")
    texts = materialized(signed.groupBy("key").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors")), "texts")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [kept_words(t, p) for t, p in zip(batch["text"], batch["spans"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "kept": [b" ".join(k).decode("utf-8", "replace") for k in kept]})

    found = repeated_spans(documents, texts, how).select("key", "text", "spans").mapInPandas(keep, "key binary, kept string")
    key, kept, out = (unused_name(documents, n) for n in ("_key", "_kept", "kept_text"))
    found = materialized(found.withColumnsRenamed({"key": key, "kept": kept}), "kept-texts")
    rows = documents.withColumn(key, _key()).join(found, key, "left")
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns], F.coalesce(kept, "text").alias(out))
