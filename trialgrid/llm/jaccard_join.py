"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is the set of its word shingles. Each tree of the forest labels a set
with a path of min-hashes; in the order of the labels, sets that share a prefix
stand together. A match begins at full depth and is shortened until, at the
threshold, sharing it in one tree reaches the target recall. A prefix with few
members is shortened by one step more, and its pairs need to share as many trees
at that depth as still reach the target: fewer of them are false. One with many
members stays at the longer prefix, so a crowd is never compared as a whole.
Candidates are verified by exact intersection. Sets found equal count once,
however many copies they have.

Pairs are never rows: the members of a prefix are dealt into blocks, a task
verifies one pair of blocks by matrix products and returns counts by set and
star edges for the classes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .components import connected_components
from .groups import whole_groups
from .store import forget, keep

TREES, DEPTH = 32, 8
#: Members up to which a prefix is shortened by one step more; beyond, they are dealt into blocks of so many.
BLOCK = 512
#: A label is 40 bits of the shorter prefix and 24 of the step by which the longer one goes on.
_STEP = np.uint64(24)
_D1, _D2 = np.uint64(0xA5A5), np.uint64(0x5A5A5A)


def expected_recall(depth: int, similarity: float, trees: int = TREES, shared: int = 1) -> float:
    """Chance that a pair of this similarity shares ``shared`` of the trees down to ``depth``."""
    p = similarity**depth
    return 1 - sum(comb(trees, k) * p**k * (1 - p) ** (trees - k) for k in range(shared))


def prefix_depths(similarity: float, recall: float, trees: int = TREES, deepest: int = DEPTH) -> tuple[int, int]:
    """The longest prefix that reaches the target recall at the threshold by one tree, and the trees to share one step above it."""
    depth = deepest
    while depth > 2 and expected_recall(depth, similarity, trees) < recall:
        depth -= 1
    shared = 1
    while shared < trees and expected_recall(depth - 1, similarity, trees, shared + 1) >= recall:
        shared += 1
    return depth, shared


def _minhash(values: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Tree labels, a row per nonempty set: digests of all of ``depth`` min-hashes but the last, and of the last."""
    at = bounds[:-1][np.diff(bounds) > 0]
    draws = np.random.default_rng(9).integers(1, 1 << 63, (trees * depth, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(at), trees), np.uint64)
    for t in range(trees):
        label = np.zeros(len(at), np.uint64)
        for d in range(depth):
            a, b = draws[t * depth + d]
            least = np.minimum.reduceat((values ^ b) * a, at)
            if d < depth - 1:
                label = label * np.uint64(0x2545F4914F6CDD1D) + least
        out[:, t] = (bt.mix(label + np.uint64(t)) >> _STEP << _STEP) | (bt.mix(least) >> np.uint64(40))
    return out


def _signing(words: int, trees: int, depth: int):
    def run(batches):
        for batch in batches:
            for first, data, bounds in bt.slices(batch.column(1), 1 << 19):
                values, at = bt.shingles(data, bounds, words)
                sizes = np.diff(at)
                some = sizes > 0
                n = len(sizes)
                d1, d2, labels = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, None, object)
                if some.any():
                    d1[some] = np.add.reduceat(bt.mix(values ^ _D1), at[:-1][some])
                    d2[some] = np.add.reduceat(bt.mix(values ^ _D2), at[:-1][some])
                    keys = _minhash(values, at, trees, depth)
                    labels[some] = [row.tobytes() for row in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array(labels, pa.binary()),
                        batch.column(2).slice(first, n),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "labels", "hash"],
                )

    return run


def _unpack(labels: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(labels.to_pylist()), np.uint64).reshape(-1, trees)


#: Marks the cells of the longer prefixes; a cell's last six bits are its tree.
_LONG = 1 << 62


def _explode_labels(trees: int):
    def run(batches):
        for batch in batches:
            labels = batch.column(1)
            if len(labels):
                keys, tree = _unpack(labels, trees), np.arange(trees)
                short = (keys >> _STEP).astype(np.int64) * 64 + tree
                long = (bt.mix(keys) >> np.uint64(8)).astype(np.int64) // 64 * 64 + tree + _LONG
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), trees)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(short.ravel()), pa.array(long.ravel())], names=["sid", "short", "long"])

    return run


def _owned(keys: np.ndarray, crowded: np.ndarray, side: np.ndarray, within: bool, cell: int, shared: int) -> np.ndarray:
    """Pairs of a block pair that this cell owns: in the first tree in which they are a match.

    They match by the shorter prefix where it is not crowded, if they share it in
    ``shared`` trees at least, and by the longer one where it is. ``crowded`` has
    a bit for each tree in which a set's shorter prefix has many members.
    """
    n, tree = len(keys), int(cell & 63)
    few, many, count = np.zeros((n, n), bool), np.zeros((n, n), bool), np.zeros((n, n), np.uint8)
    short, here = keys >> _STEP, None
    for t in range(keys.shape[1]):
        same = short[:, t][:, None] == short[:, t][None, :]
        full = (crowded >> t & 1).astype(bool)[:, None]
        count += same
        long = same & full
        if long.any():
            long &= keys[:, t][:, None] == keys[:, t][None, :]
        if t < tree:
            few |= same & ~full
            many |= long
        elif t == tree:
            here = long if cell & _LONG else same & ~full
    enough = count >= shared
    pairs = np.triu(here & ~(many | (few & enough)), 1)
    pairs = pairs if cell & _LONG else pairs & enough
    return pairs if within else pairs & (side[:, None] != side[None, :])


def _groups(table: pa.Table) -> list[np.ndarray]:
    """Rows of each (cell, lo, hi)."""
    cols = [table[c].to_numpy() for c in ("cell", "lo", "hi")]
    order = np.lexsort(cols[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for c in cols:
        change[1:] |= np.diff(c[order]) != 0
    return np.split(order, np.flatnonzero(change)[1:])


_PAIR = ["cell", "lo", "hi"]


def _choosing(trees: int, shared: int):
    """Of the members of each block pair, those with a candidate that the tree owns."""

    def choose(table: pa.Table) -> pa.Table:
        keys, wanted = _unpack(table["labels"].combine_chunks(), trees), []
        cell, lo, hi = (table[c].to_numpy() for c in ("cell", "lo", "hi"))
        side, crowded = table["side"].to_numpy(), table["crowded"].to_numpy()
        for rows in _groups(table):
            if len(rows) > 1:
                pairs = _owned(keys[rows], crowded[rows], side[rows], lo[rows[0]] == hi[rows[0]], int(cell[rows[0]]), shared)
                wanted.append(rows[pairs.any(0) | pairs.any(1)])
        wanted = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
        return table.take(pa.array(np.sort(wanted)))

    def run(batches):
        for table in whole_groups(batches, _PAIR):
            yield from choose(table).to_batches()

    return run


def _intersections(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of a block's sets."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    distinct, code, times = np.unique(values, return_inverse=True, return_counts=True)
    common = times > 1
    rank = np.cumsum(common) - 1
    keep_ = common[code]
    owner, code, m = owner[keep_], rank[code[keep_]], int(common.sum())
    out = np.zeros((n, n), np.float32)
    for k in range(0, m, 4096):
        part = (code >= k) & (code < k + 4096) if m > 4096 else slice(None)
        dense = np.zeros((n, min(4096, m - k)), np.float32)
        dense[owner[part], code[part] - k] = 1
        out += dense @ dense.T
    return out


def _roots(pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each member reaches over the block's links."""
    label = ids.copy()
    a, b = np.nonzero(pairs)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == label).all():
            return label
        label = new


def _verifying(words: int, trees: int, shared: int, similarity: float):
    def verify(table: pa.Table) -> pa.Table:
        keys = _unpack(table["labels"].combine_chunks(), trees)
        cell, lo, hi = (table[c].to_numpy() for c in _PAIR)
        side, sid, copies, crowded = (table[c].to_numpy() for c in ("side", "sid", "copies", "crowded"))
        text = table["text"].combine_chunks()
        out = []
        for rows in _groups(table):
            if len(rows) < 2:
                continue
            pairs = _owned(keys[rows], crowded[rows], side[rows], lo[rows[0]] == hi[rows[0]], int(cell[rows[0]]), shared)
            parts = [bt.shingles(d, b, words) for _, d, b in bt.slices(text.take(pa.array(rows)))]
            values = np.concatenate([v for v, _ in parts])
            sizes = np.concatenate([np.diff(a) for _, a in parts])
            both = _intersections(values, np.concatenate([[0], np.cumsum(sizes)]))
            either = sizes[:, None] + sizes[None, :] - both
            pairs &= both >= similarity * either - 1e-6 * either
            if pairs.any():
                linked = pairs | pairs.T
                some = linked.any(1)
                root = _roots(pairs, sid[rows])
                out.append((sid[rows][some], linked.sum(1)[some], (linked @ copies[rows])[some], root[some]))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("sid", "texts", "docs", "root"), columns, strict=True)})

    def run(batches):
        for table in whole_groups(batches, _PAIR, 1):
            yield from verify(table).to_batches()

    return run


def jaccard_join(
    docs: DataFrame,
    similarity: float = 0.8,
    words: int = 5,
    recall: float = 0.9999999,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Links between documents whose word shingles have this Jaccard similarity.

    Returns one row per input row: doc_id; class_id, the least doc_id that can be
    reached over links; copy_of, the least doc_id with the same shingles;
    n_shingles; n_texts, the number of different shingle sets linked to this one;
    n_links, the number of other documents linked, copies included. Words are
    lower-cased runs of ASCII letters and digits and of anything beyond ASCII.

    ``recall`` is the expected share of pairs found at exactly the threshold,
    more above it, by either prefix (see :func:`prefix_depths`); verification is exact on 64-bit shingle hashes. Both parts of
    a pair of blocks are at most about 2 x 512 sets, whatever the group's size.

    A text of one to four words has one shingle of all its words. A text
    without words, or null, has no links, and its class is its own id. Rows that
    repeat an id count as documents of their own but share class and copy ids; a
    row without an id has no links. No rows give no rows; other columns play no
    part.
    """
    depth, shared = prefix_depths(similarity, recall)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    shape = "doc_id long, n_shingles int, d1 long, d2 long, labels binary, hash long"
    signed = keep(plain.mapInArrow(_signing(words, TREES, depth), shape), "jaccard-sets")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # a set's text is known by id and hash, as an id may have many texts
    sets = some.groupBy(F.col("d1").alias("sid"), "d2").agg(
        F.min(F.struct("doc_id", "hash")).alias("first"), F.count("*").alias("copies"), F.max("labels").alias("labels")
    )
    sets = keep(sets.select("sid", "d2", F.col("first.doc_id").alias("rep"), F.col("first.hash").alias("hash"), "copies", "labels"), "jaccard-distinct")
    cells = sets.select("sid", "labels").mapInArrow(_explode_labels(TREES), "sid long, short long, long long")
    busy = cells.groupBy("short").agg(F.count("*").alias("members")).where("members > 1")
    shared_cells = keep(cells.join(busy, "short"), "jaccard-cells")
    crowds = shared_cells.where(F.col("members") > BLOCK)
    within = crowds.groupBy("long").agg(F.count("*").alias("members")).where("members > 1")
    tree = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("long") % 64).cast("int"))
    crowded = crowds.groupBy("sid").agg(F.bit_or(tree).alias("crowded"))
    few = shared_cells.where(F.col("members") <= BLOCK).select("sid", F.col("short").alias("cell"), "members")
    blocks = F.ceil(F.col("members") / BLOCK)
    side = F.pmod(F.xxhash64("sid"), blocks)
    placed = few.unionByName(crowds.drop("members").join(within, "long").select("sid", F.col("long").alias("cell"), "members"))
    placed = placed.select("sid", "cell", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    placed = placed.select("sid", "cell", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    # a block pair is a group of rows that come one after another; a task holds one at a time
    shape = "sid long, cell long, side long, lo long, hi long, rep long, hash long, copies long, labels binary, crowded long"
    columns = ["sid", "cell", "side", "lo", "hi", "rep", "hash", "copies", "labels", "crowded"]
    told = sets.join(crowded, "sid", "left").withColumn("crowded", F.coalesce("crowded", F.lit(0).cast("long")))
    placed = placed.join(told, "sid").select(*columns).repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    chosen = keep(placed.mapInArrow(_choosing(TREES, shared), shape), "jaccard-candidates")
    wanted = chosen.select("sid", F.col("rep").alias("doc_id"), "hash").distinct()
    texts = plain.join(wanted, ["doc_id", "hash"]).groupBy("sid").agg(F.min("text").alias("text"))  # rows that repeat id and text are one
    to_check = chosen.drop("rep", "hash").join(texts, "sid").repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    checked = to_check.mapInArrow(_verifying(words, TREES, shared, similarity), "sid long, texts long, docs long, root long")
    checked = keep(checked, "jaccard-links")
    forget(shared_cells)
    forget(chosen)
    degree = checked.groupBy("sid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("others"))
    label = connected_components(checked.where("sid != root").select(F.col("sid").alias("u"), F.col("root").alias("v")))
    classes = sets.join(degree, "sid", "left").join(label.select(F.col("node").alias("sid"), "component"), "sid", "left")
    classes = classes.withColumn("component", F.coalesce("component", "sid"))
    least = classes.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = classes.join(least, "component").select("sid", "d2", "rep", "copies", "texts", "others", "class_id")
    out = signed.join(classes, (signed["d1"] == classes["sid"]) & (signed["d2"] == classes["d2"]) & (signed["n_shingles"] > 0) & signed["doc_id"].isNotNull(), "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("copy_of"),
        "n_shingles",
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        (F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of :func:`jaccard_join`, the one of least id; all columns kept.

    Rows are told apart by a key of their own, whatever their ids: rows that
    repeat an id, or have none, are compared by their texts like all others. Null
    ids come after all ids. Texts without words stay; those that repeat an id
    with the same text count once. No rows give no rows; any names of columns may
    occur.
    """
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "near-copies-rows")
    own = rows.select("row", F.col("doc")[doc_id].alias("id"), F.col("doc")[text].alias("text"))
    classes = jaccard_join(own, similarity, words, doc_id="row", text="text")
    members = classes.where("n_links > 0 or n_shingles = 0").select(F.col("doc_id").alias("row"), "class_id", (F.col("n_links") > 0).alias("linked"))
    members = members.join(own, "row")
    keys = [F.when(F.col("linked") | F.col("id").isNull(), F.col("class_id")), *[F.when(~F.col("linked"), F.col(c)) for c in ("id", "text")]]
    members = keep(members.select("row", "id", *[k.alias(f"k{n}") for n, k in enumerate(keys)]), "near-copies-members")
    least = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))["row"]
    first = members.groupBy("k0", "k1", "k2").agg(least.alias("row")).select("row")
    losers = keep(members.select("row").join(first, "row", "left_anti"), "near-copies-losers")
    forget(members)
    return rows.join(losers, "row", "left_anti").select("doc.*")
