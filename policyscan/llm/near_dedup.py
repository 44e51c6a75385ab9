"""MinHash near-duplicates by a chosen-path set similarity join.

Documents descend independent trees. A node picks a few places of the minwise signature, and
each of its documents goes to one child for each picked place, named by the node, the place
and the value there. Similar documents so stay together in some branch with a known
probability, and unrelated ones part at once. Nodes with few documents are compared
exhaustively by their signatures; that gives candidate links, whose components are then
checked on the full shingle sets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyscan.llm import shingles
from policyscan.llm.components import components
from policyscan.llm.groups import Forest, bounds, whole_groups
from policyscan.llm.tables import materialized, unused_name

LINKS = "a long, b long"


@dataclass(frozen=True)
class NearDuplicates:
    """``words`` per shingle; sets are linked when 100 * intersection >= ``percent`` * union.

    ``recall`` is the chance that a pair just at the threshold meets in a small node of some
    tree. ``small`` documents are compared exhaustively in one task; ``block`` is the number
    of rows on either side of a comparison of a larger group, which ``block_bytes`` bounds
    too, and ``depth`` how often a larger node branches before that; one whose comparison is
    no more than that of two blocks does not branch.
    """

    words: int = 5
    percent: int = 80
    places: int = 128
    branches: int = 2
    recall: float = 0.9999
    small: int = 100
    block: int = 2048
    block_bytes: int = 64 << 20
    depth: int = 3
    #: Documents of a large node that all its rows are compared with.
    firsts: int = 8
    #: Dropped ids, 8 bytes each, that go to all executors; more are joined by a shuffle.
    broadcast: int = 2_000_000

    @property
    def trees(self) -> int:
        """Enough independent trees for the recall, at full depth."""
        parted = 0.0
        for _ in range(self.depth):
            stays = self.percent / 100 * (1 - parted)
            parted = (1 - stays) ** self.branches
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(parted)))

    @property
    def agreeing(self) -> int:
        """Places that a pair at the threshold shares but for about one time in 10,000."""
        p = self.percent / 100
        return math.floor(self.places * p - 3.7 * math.sqrt(self.places * p * (1 - p)))


def fingerprints(documents: DataFrame, how: NearDuplicates) -> DataFrame:
    """Per document the size, a 128-bit key and the signature of its shingle set, and the
    nodes below the roots that it goes to.

    These are named by all 32 bits of the smallest hashes, so that unrelated documents part
    there however many there are; within a node the narrow signature will do.
    """
    roots = shingles.mixed(np.arange(1, how.trees + 1, dtype=np.uint64))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signature = shingles.Signatures(how.places)
        for batch in batches:
            sizes, ones, twos, least = [], [], [], []
            for found in shingles.shingle_sets(batch["text"].tolist(), how.words):
                one, two = shingles.set_key(found)
                sizes.append(len(found))
                ones.append(one)
                twos.append(two)
                least.append(signature(found))
            values = np.array(least, np.uint32).reshape(-1, how.places)
            nodes = [_children(np.full(len(values), r, np.uint64), values, how.branches) for r in roots]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].array,
                    "n_shingles": sizes,
                    "key_1": ones,
                    "key_2": twos,
                    "signature": [s.tobytes() for s in shingles.narrowed(values)],
                    "nodes": list(np.concatenate(nodes, axis=1).astype(np.int64)),
                }
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        sign, "doc_id long, n_shingles long, key_1 long, key_2 long, signature binary, nodes array<long>"
    )


def _children(nodes: np.ndarray, signs: np.ndarray, branches: int) -> np.ndarray:
    """For each row the ids of its children; the places depend on the node alone."""
    rows, places = signs.shape
    start = shingles.mixed(nodes)
    step = shingles.mixed(start) | np.uint64(1)  # odd, so no place is picked twice
    out = np.empty((rows, branches), np.uint64)
    for j in range(branches):
        place = ((start + np.uint64(j) * step) % np.uint64(places)).astype(np.int64)
        value = signs[np.arange(rows), place].astype(np.uint64)
        out[:, j] = shingles.mixed(nodes + shingles.mixed((place.astype(np.uint64) << np.uint64(32)) + value + np.uint64(1)))
    return out


def _signs(column: pd.Series, places: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, places)


def _branched(rows: DataFrame, how: NearDuplicates) -> DataFrame:
    """Rows (node, doc_id, signature) in the children of their nodes."""

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            signs = _signs(batch["signature"], how.places)
            for child in _children(batch["node"].to_numpy().astype(np.uint64), signs, how.branches).T:
                yield pd.DataFrame({"node": child.astype(np.int64), "doc_id": batch["doc_id"].array})

    return rows.select("doc_id", "signature", "node").mapInPandas(descend, "node long, doc_id long")


def _forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest linked position of each of ``size`` positions."""
    label = np.arange(size)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _alike(signs: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Which of the pairs agree in ``least`` places or more."""
    out = np.empty(len(left), bool)
    for at in range(0, len(left), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[part] = (signs[left[part]] == signs[right[part]]).sum(axis=1) >= least
    return out


def _node_links(rows: DataFrame, how: NearDuplicates) -> DataFrame:
    """Candidate links within small nodes: each linked document to the first of its tree."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, "node"):
            ids = groups["doc_id"].to_numpy()
            signs = _signs(groups["signature"], how.places)
            cuts = bounds(groups["node"].to_numpy())
            sizes = np.diff(cuts)
            links = []
            for size in np.unique(sizes[sizes > 1]):
                i, j = np.triu_indices(size, 1)
                firsts = cuts[:-1][sizes == size]
                for part in np.array_split(firsts, max(1, len(firsts) * len(i) >> 18)):
                    left, right = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    near = _alike(signs, left, right, how.agreeing)
                    links.append((left[near], right[near]))
            if links:
                left, right = (np.concatenate(x) for x in zip(*links, strict=True))
                label = _forest(left, right, len(ids))
                linked = np.flatnonzero(label != np.arange(len(ids)))
                yield pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    return rows.select("node", "doc_id", "signature").repartition("node").sortWithinPartitions("node", "doc_id").mapInPandas(compare, LINKS)


def _against(rows: DataFrame, key: str, first: DataFrame, payload: str) -> DataFrame:
    """``rows`` of large groups with the payload of the first document of their group."""
    return rows.join(first.select(F.col(key), F.col("doc_id").alias("first_id"), F.col(payload).alias("first_payload")), key)


def _block_counts(rows: DataFrame, key: str, block: int, payload: str, most: int) -> DataFrame:
    """Per group how many blocks of about ``block`` rows and ``most`` bytes of ``payload`` all
    its rows make, and its open ones."""
    size = F.length(payload)
    return rows.groupBy(key).agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(size) / most)).cast("int").alias("all_blocks"),
        F.greatest(F.ceil(F.count_if("open") / block), F.ceil(F.sum(F.when(F.col("open"), size)) / most)).cast("int").alias("open_blocks"),
    )


def _blocks(dealt: DataFrame, key: str) -> DataFrame:
    """Rows of large groups dealt to the block pairs in which they meet all open rows.

    ``dealt`` has ``open``, false for a row that is already linked to the others of its group
    that are not open, and the group's ``all_blocks`` and ``open_blocks``. Open rows fall into
    blocks by a hash, and so do all rows; each pair (open block, block) is a task. So two rows
    that are not yet linked always meet.
    """
    share = F.xxhash64("doc_id")
    dealt = dealt.withColumn("_at", F.pmod(share, "all_blocks").cast("int")).withColumn("_other", F.pmod(share, "open_blocks").cast("int"))
    as_any = "transform(sequence(0, open_blocks - 1), x -> struct(0 as side, _at as at, x as other))"
    as_open = "transform(slice(sequence(0, all_blocks - 1), 1, if(open, all_blocks, 0)), x -> struct(1 as side, x as at, _other as other))"
    placed = dealt.select("*", F.inline(F.expr(f"concat({as_any}, {as_open})")))
    return placed.withColumn("pair", F.xxhash64(key, "at", "other")).drop("_at", "_other", "all_blocks", "open_blocks")


def _beside_firsts(rows: DataFrame, how: NearDuplicates) -> DataFrame:
    """Rows of large nodes with the ids of a few ``firsts`` of their node, which of these they
    are ``like`` (bits), and the id of the first of them, or their own."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(how.firsts)).alias("share")
    firsts = rows.groupBy("node", share).agg(F.min("doc_id").alias("doc_id")).join(rows, ["node", "doc_id"])
    few = F.slice(F.sort_array(F.collect_list(F.struct("doc_id", "signature"))), 1, how.firsts)
    firsts = firsts.groupBy("node").agg(few.alias("few")).select(
        "node",
        F.col("few.doc_id").alias("firsts"),
        F.expr("aggregate(few.signature, cast('' as binary), (all, one) -> concat(all, one))").alias("first_signs"),
    )

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            signs = _signs(batch["signature"], how.places)
            like, first = np.zeros(len(batch), np.int64), batch["doc_id"].to_numpy().copy()
            for at in batch.groupby("node", sort=False).indices.values():
                others = _signs(batch["first_signs"].iloc[at[:1]], how.places)
                for j in reversed(range(len(others))):
                    near = at[(signs[at] == others[j]).sum(axis=1) >= how.agreeing]
                    like[near] |= 1 << j
                    first[near] = batch["firsts"].iloc[at[0]][j]
            yield batch[["node", "doc_id", "signature", "firsts"]].assign(like=like, first_id=first)

    return rows.join(firsts, "node").mapInPandas(
        beside, "node long, doc_id long, signature binary, firsts array<long>, like long, first_id long"
    )


def _hubs(judged: DataFrame, how: NearDuplicates) -> DataFrame:
    """Per large node its ``hub``: the firsts, as bits, that rows link and most rows are like.

    Rows that are like none of these are open. ``n`` and ``n_open`` count rows; ``a`` and ``b``
    are links between firsts.
    """
    kinds = judged.groupBy("node", "like").agg(F.count("*").alias("n"), F.min("firsts").alias("firsts"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, "node"):
            cuts = bounds(groups["node"].to_numpy())
            found = []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = groups.iloc[low:high]
                ids, total = part["firsts"].iloc[0], int(part["n"].sum())
                forest, rows = Forest(len(ids)), Counter()
                likes = [[j for j in range(len(ids)) if like >> j & 1] for like in part["like"].tolist()]
                for bits in likes:
                    for j in bits[1:]:
                        forest.link(bits[0], j)
                for bits, n in zip(likes, part["n"].tolist(), strict=True):
                    if bits:
                        rows[forest.root(bits[0])] += n
                root, most = rows.most_common(1)[0]
                hub = sum(1 << j for j in range(len(ids)) if forest.root(j) == root)
                ends = [ids[forest.root(j)] for j in range(len(ids))]
                found.append((part["node"].iloc[0], hub, total, total - most, ids, ends))
            yield pd.DataFrame(found, columns=["node", "hub", "n", "n_open", "a", "b"])

    return kinds.repartition("node").sortWithinPartitions("node").mapInPandas(
        gather, "node long, hub long, n long, n_open long, a array<long>, b array<long>"
    )


def _open_links(judged: DataFrame, hubs: DataFrame, how: NearDuplicates) -> DataFrame:
    """Candidate links of the open rows of large nodes to all others, in blocks."""
    block = max(1, min(how.block, how.block_bytes // (2 * how.places)))
    counted = hubs.where("n_open > 0").select(
        "node",
        "hub",
        F.ceil(F.col("n") / block).cast("int").alias("all_blocks"),
        F.ceil(F.col("n_open") / block).cast("int").alias("open_blocks"),
    )
    dealt = judged.drop("firsts", "first_id").join(counted, "node").withColumn("open", F.expr("like & hub = 0")).drop("like", "hub")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, signs = pdf["doc_id"].to_numpy(), _signs(pdf["signature"], how.places)
        left, right = np.flatnonzero(pdf["side"] == 0), np.flatnonzero(pdf["side"] == 1)
        found = []
        for r in right:
            near = left[(signs[left] == signs[r]).sum(axis=1) >= how.agreeing]
            found.append((near, np.full(len(near), r)))
        if not found:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        label = _forest(a, b, len(ids))
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    return _blocks(dealt, "node").groupBy("pair").applyInPandas(compare, LINKS)


def _signed(entries: DataFrame, nodes: DataFrame, signed: DataFrame) -> DataFrame:
    """The entries of some nodes with their signatures."""
    return entries.join(nodes, "node", "left_semi").join(signed.select("doc_id", "signature"), "doc_id")


def candidate_links(signed: DataFrame, how: NearDuplicates) -> DataFrame:
    """Links (a, b) whose components hold every pair that met in a tree and looks similar.

    The rows of a large node are compared with a few of its documents. Those like them are
    linked to them, and where rows so link these documents, all their rows are done with each
    other; if few rows are not among them, or if that takes no more than the comparison of two
    blocks, these are compared with all others, and the node is finished. So near copies, which
    never part, do not go down further, also where each is like only a part of the others.
    Only nodes with many open rows branch, with all their rows.
    """
    dear = (F.col("n_open") > how.small) & (F.col("n_open") * F.col("n") > how.block**2)
    entries = signed.select(F.explode("nodes").alias("node"), "doc_id")
    links = None
    for level in range(how.depth):
        sizes = materialized(entries.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes")
        # Each entry is looked up once: as one of a small node, or as one of a large node.
        small, large = (sizes.where(test).select("node") for test in (F.col("n") <= how.small, F.col("n") > how.small))
        found = materialized(_node_links(_signed(entries, small, signed), how), "candidates")
        links = found if links is None else links.unionAll(found)
        if large.isEmpty():
            break
        rows = materialized(_signed(entries, large, signed), "large")
        judged = materialized(_beside_firsts(rows, how), "large-nodes")
        hubs = materialized(_hubs(judged, how), "hubs")
        links = links.unionAll(judged.where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")))
        links = links.unionAll(hubs.select(F.inline(F.arrays_zip("a", "b"))))
        parting = hubs.where(dear).select("node")
        if level == how.depth - 1 or parting.isEmpty():
            links = links.unionAll(materialized(_open_links(judged, hubs, how), "open-links"))
            break
        links = links.unionAll(materialized(_open_links(judged, hubs.where(~dear), how), "open-links"))
        entries = materialized(_branched(rows.join(parting, "node", "left_semi"), how), "nodes")
    return links


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(one) + len(two) - len(np.union1d(one, two))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _sized(one: int, two: int, percent: int) -> bool:
    return 100 * min(one, two) >= percent * max(one, two)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _linked(pairs: Iterator[tuple[int, int]], sets: list[np.ndarray], forest: Forest, percent: int) -> None:
    """Link the pairs that the full sets confirm, leaving out those already linked."""
    for i, j in pairs:
        if forest.root(i) != forest.root(j) and _sized(len(sets[i]), len(sets[j]), percent) and _similar(sets[i], sets[j], percent):
            forest.link(i, j)


def verified_links(sets: DataFrame, cells: DataFrame, how: NearDuplicates) -> DataFrame:
    """Links confirmed on full sets, as trees, among the documents of each ``cell``.

    ``sets`` has cell, doc_id, elements and signature, ``cells`` its cell and doc_id. A small cell is compared by one task
    that leaves out pairs already linked. In a larger one each document is compared with the
    first; those not linked to it meet all others in blocks.
    """
    sizes = materialized(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
    with_size = sets.join(sizes, "cell")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, "cell"):
            ids = groups["doc_id"].to_numpy()
            found = [_set(e) for e in groups["elements"]]
            cuts, forest = bounds(groups["cell"].to_numpy()), Forest(len(groups))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                _linked(((i, j) for i in range(low, high) for j in range(i + 1, high)), found, forest, how.percent)
            label = np.array([forest.root(i) for i in range(len(ids))], np.int64)
            linked = np.flatnonzero(label != np.arange(len(ids)))
            yield pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    small = with_size.where(F.col("n") <= how.small).select("cell", "doc_id", "elements")
    links = small.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInPandas(within, LINKS)
    large_sizes = sizes.where(F.col("n") > how.small)
    if large_sizes.isEmpty():
        return links
    large = with_size.where(F.col("n") > how.small).drop("n")
    firsts = large.where(F.col("cell") == F.col("doc_id")).dropDuplicates(["cell"])

    def to_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["open"] = [
                not _similar(_set(e), _set(f), how.percent) for e, f in zip(batch["elements"], batch["first_payload"], strict=True)
            ]
            yield batch[["cell", "doc_id", "elements", "signature", "first_id", "open"]]

    kinds = "cell long, doc_id long, elements binary, signature binary, first_id long, open boolean"
    judged = materialized(_against(large, "cell", firsts, "elements").mapInPandas(to_first, kinds), "large-cells")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "doc_id"], kind="stable")
        ids, signs = pdf["doc_id"].to_numpy(), _signs(pdf["signature"], how.places)
        found = [_set(e) for e in pdf["elements"]]
        opened = pdf["open"].to_numpy()
        side = pdf["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        forest = Forest(len(ids))
        hub = np.flatnonzero(~opened)
        for x in hub[1:].tolist():
            forest.link(int(hub[0]), x)  # all of these are linked to the first
        agree = np.array([(signs[left] == signs[r]).sum(axis=1) for r in right])
        near = np.argwhere(agree >= how.agreeing)
        order = np.argsort(-agree[near[:, 0], near[:, 1]], kind="stable")
        pairs = ((int(left[near[o, 1]]), int(right[near[o, 0]])) for o in order)
        _linked(pairs, found, forest, how.percent)
        label = np.array([forest.root(i) for i in range(len(ids))], np.int64)
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    counted = _block_counts(judged, "cell", how.block, "elements", how.block_bytes).where("open_blocks > 0")
    blocks = _blocks(judged.join(counted, "cell"), "cell")
    return links.unionAll(judged.where("not open").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))).unionAll(
        blocks.groupBy("pair").applyInPandas(across, LINKS)
    )


def near_duplicates(documents: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id and kept.

    ``component_id`` is the smallest doc_id that links reach; ``kept`` marks the row that is
    it. Equal sets are linked through their key and enter the join once. Documents without
    words, or a null text, have no shingles and stay alone, as do rows without a doc_id
    (their component is null). Rows with one doc_id count as one document.
    """
    signed = materialized(fingerprints(documents, how), "fingerprints")
    keyed = signed.where("doc_id is not null and n_shingles > 0")
    distinct = materialized(
        keyed.groupBy("key_1", "key_2").agg(F.min("doc_id").alias("first_id")), "distinct-sets"
    )
    members = keyed.select("doc_id", "key_1", "key_2").join(distinct, ["key_1", "key_2"])
    copies = members.where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    keys = ["key_1", "key_2", "doc_id"]
    alone = keyed.select(*keys, "signature", "nodes").join(distinct.withColumnRenamed("first_id", "doc_id"), keys, "left_semi")
    alone = materialized(alone.dropDuplicates(keys).select("doc_id", "signature", "nodes"), "signatures")
    cells = components(candidate_links(alone, how)).select(F.col("node").alias("doc_id"), F.col("component").alias("cell"))
    cells = materialized(cells, "cells")

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signature = shingles.Signatures(how.places)
        for batch in batches:
            sets = list(shingles.shingle_sets(batch["text"].tolist(), how.words))
            batch["elements"] = [s.tobytes() for s in sets]
            batch["signature"] = [shingles.narrowed(signature(s)).tobytes() for s in sets]
            yield batch[["cell", "doc_id", "elements", "signature"]]

    texts = documents.select(F.col("doc_id").cast("long"), "text").join(cells.hint("shuffle_hash"), "doc_id")
    sets = texts.mapInPandas(elements, "cell long, doc_id long, elements binary, signature binary")
    links = verified_links(materialized(sets, "sets"), cells, how).unionAll(copies)
    found = components(links)
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(documents: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, one for each component.

    Rows are judged by their texts alone: where ids are missing or repeated, rows are numbered
    first, so that different texts with one id both stay and copies without one go. Rows
    without words all stay.
    """
    number = unused_name(documents, "_number")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        rows = documents.withColumn(number, F.col("doc_id").cast("long"))
    else:
        rows = materialized(documents.withColumn(number, F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), how)
    dropped = materialized(judged.where("not kept").select(F.col("doc_id").alias(number)), "dropped")
    if dropped.count() <= how.broadcast:
        dropped = F.broadcast(dropped)  # else the texts are shuffled
    return rows.join(dropped, number, "left_anti").select(*[f"`{c}`" for c in documents.columns])
