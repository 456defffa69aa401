"""Language-model scoring with a hierarchical Pitman-Yor model.

Words are dishes. Each context, the previous word, has a restaurant in which a
word's occurrences sit at tables; the tables of all contexts are the customers of
one parent restaurant, whose base is uniform over the known words and one more.
Seats are sampled by Gibbs sweeps: a sweep takes all customers of a word in a
context away and seats them anew by their exact conditional law, given all other
seats (:mod:`.tables`). The probabilities that the sampled seatings predict are
averaged. Buckets work side by side: what others seat meanwhile is held at the
last sweep's values; inside a bucket the words' contexts take turns in two halves.

All that belongs to a word lies in one bucket: its counts by context, its tables
and its parent's customers. A bucket needs of the rest only the totals of the
contexts it holds; these are summed in parts by context, to which the buckets send
their own shares, and come back as rows. Documents are dealt into blocks; a block
asks the buckets for the (word, context) pairs it holds, each once, and gets their
log-probabilities back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import forget, keep, shuffle_partitions
from .tables import Weights, draw_tables, lattice, prime

#: Contexts are told apart by all 64 bits; a bucket numbers those it holds, and so many numbers fit the low half of one.
CONTEXTS = 1 << 16
BLOCK_BYTES = 8 << 20
#: Text bytes for each bucket of words.
BUCKET_BYTES = 8 << 20
#: Times the mean number of rows from which on a block is dealt out.
CROWD = 4
FLUSH_TOKENS = 900_000
_END, _START = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, first all lowest bytes, then all second ones: planes of equal bytes compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(body: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_counts(values: np.ndarray) -> bytes:
    """:func:`pack` in 32 bits where all values fit."""
    return pack(values.astype(np.int32 if not len(values) or values.max() < 1 << 31 else np.int64))


def unpack_counts(body: bytes, n: int) -> np.ndarray:
    return unpack(body, np.int64 if n and len(body) == 8 * n else np.int32)


def _stream(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids with an end after each document, and bounds by document."""
    low = bt.LOWER[data]
    starts, ends, at = bt.tokens(low, bounds, bt.SOLID)
    word = bt.span_hash(bt.prefix_sums(low), starts, ends)
    docs = len(bounds) - 1
    full = np.insert(word, at[1:], _END)
    del word, starts, ends
    return full, at + np.arange(docs + 1)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each value among them: ``np.unique`` in two thirds of its memory."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ordered = ordered[new]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered, place


def _counted(code: np.ndarray, words: int, at: np.ndarray, keys: int, train: np.ndarray | None):
    """The number of contexts of each word, and by pair its context, its training count, and by row its pair."""
    n = max(1, keys)
    pair, back = _numbered(code * np.int64(n) + at)
    counts = None if train is None else np.bincount(back, weights=train, minlength=len(pair)).astype(np.int64)
    return np.bincount(pair // n, minlength=words), (pair % n).astype(np.int32), counts, back


def _followed(word: np.ndarray, first: np.ndarray, train: np.ndarray | None):
    """Distinct words in order, the number of contexts of each, distinct contexts in order, their places and training counts by pair, and each word's number and pair.

    ``first`` words follow a start and all others the word before them, so contexts are numbered as words are.
    """
    words, code = _numbered(word)
    start = int(np.searchsorted(words, _START))
    keys = words if start < len(words) and words[start] == _START else np.insert(words, start, _START)
    if len(keys) == len(words):
        at = np.concatenate([[0], code[:-1]]).astype(np.int32)
    else:
        at = np.concatenate([[0], code[:-1] + (code[:-1] >= start)]).astype(np.int32)
    at[first] = start
    used = np.zeros(len(keys), bool)
    used[at] = True
    at = (np.cumsum(used, dtype=np.int32) - np.int32(1))[at]
    keys = keys[used]
    sizes, places, counts, back = _counted(code, len(words), at, len(keys), train)
    return words, sizes, keys, places, counts, code, back


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of word ids."""
    return ((words >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


_ASK = "bucket long, block long, words binary, sizes binary, keys binary, contexts binary, counts binary"
_ASK_NAMES = ["bucket", "block", "words", "sizes", "keys", "contexts", "counts"]


def _asking(buckets: int):
    """Per block, the (word, context) pairs it holds and how often its training texts have them."""

    def settle(held: dict[int, list]) -> pa.RecordBatch:
        rows = []
        for block in list(held):
            word, first, train = (np.concatenate(x) for x in zip(*held.pop(block), strict=True))
            words, sizes, keys, contexts, counts, _, _ = _followed(word, first, train)
            del word, first, train
            cut = np.concatenate([[0], np.cumsum(sizes)])
            home = _bucket(words, buckets)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(home)) + 1, [len(home)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                s, e = cut[a], cut[b]
                own, place = np.unique(contexts[s:e], return_inverse=True)
                rows.append((int(home[a]), block, words[a:b].tobytes(), pack(sizes[a:b].astype(np.int32)), keys[own].tobytes(), pack(place.astype(np.int32)), pack_counts(counts[s:e])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=_ASK_NAMES)

    def run(batches):
        held: dict[int, list] = {}
        count = 0
        for batch in batches:
            block = batch.column(2).to_numpy(zero_copy_only=False)
            train = batch.column(3).to_numpy(zero_copy_only=False)
            for row, data, bounds in bt.slices(batch.column(1)):
                full, at = _stream(data, bounds)
                size = np.diff(at)
                first = np.zeros(len(full), bool)
                first[at[:-1]] = True
                own = block[row : row + len(size)]
                weight = np.repeat(train[row : row + len(size)], size)
                of = np.repeat(own, size)
                for b in np.unique(own).tolist():
                    mine = slice(None) if (own == b).all() else of == b
                    held.setdefault(b, []).append((full[mine], first[mine], weight[mine]))
                count += len(full)
                if count >= FLUSH_TOKENS:
                    yield settle(held)
                    held, count = {}, 0
        if held:
            yield settle(held)

    return run


_MERGED = "bucket long, sizes binary, contexts binary, high binary, counts binary, parts binary, keys binary, blocks binary, places binary, place_sizes binary, word_places binary, word_sizes binary"
_MERGED_NAMES = [p.split()[0] for p in _MERGED.split(", ")]
_STATE = "bucket long, sizes binary, contexts binary, high binary, counts binary, parts binary, seats array<binary>, parents array<binary>"
_STATE_NAMES = [p.split()[0] for p in _STATE.split(", ")]
_STATE_TYPES = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.binary()), pa.list_(pa.binary())]


def _merging(parts: int):
    """A bucket's pairs with their counts over all blocks, and which of them each block asked for."""

    def run(table: pa.Table) -> pa.Table:
        return _merged(table, parts)

    return run


def _of_blocks(rows: dict[str, list]):
    """Distinct words and contexts of all blocks' pairs, and by pair the numbers of both and the count; and each block's pairs."""
    cut = lambda x: np.cumsum([len(v) for v in x])[:-1]
    word = [np.frombuffer(x, np.uint64) for x in rows["words"]]
    words, place = _numbered(np.concatenate(word))
    code = [np.repeat(p, unpack(s, np.int32)) for p, s in zip(np.split(place, cut(word)), rows["sizes"], strict=True)]
    key = [np.frombuffer(x, np.uint64) for x in rows["keys"]]
    keys, place = _numbered(np.concatenate(key))
    at = [p[unpack(x, np.int32)] for p, x in zip(np.split(place, cut(key)), rows["contexts"], strict=True)]
    length = [len(c) for c in at]
    count = [unpack_counts(x, n) for x, n in zip(rows["counts"], length, strict=True)]
    return words, keys, np.concatenate(code), np.concatenate(at), np.concatenate(count), length


def _merged(table: pa.Table, parts: int) -> pa.Table:
    rows = {n: table[n].to_pylist() for n in _ASK_NAMES}
    # words and contexts are numbered by the lists that blocks send, each far shorter than its pairs
    words, keys, code, at, count, length = _of_blocks(rows)
    sizes, contexts, counts, back = _counted(code, len(words), at, len(keys), count)
    del code, at, count
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ask: dict[int, list] = {}
    at = 0
    for block, n in zip(rows["block"], length, strict=True):
        ask.setdefault(block, []).append(back[at : at + n])
        at += n
    blocks = sorted(ask)
    places = [np.unique(np.concatenate(ask[b])) for b in blocks]
    word_places = [np.unique(owner[p]) for p in places]

    def steps(parts):
        return pack(np.concatenate([np.diff(p, prepend=0) for p in parts]).astype(np.int32))

    def lengths(parts):
        return np.array([len(p) for p in parts], np.int64).tobytes()

    row = [
        table["bucket"][0].as_py(), pack(sizes.astype(np.int32)), (contexts % CONTEXTS).astype(np.uint16).tobytes(), pack((contexts // CONTEXTS).astype(np.uint16)), pack_counts(counts),
        pack(np.bincount(_bucket(keys, parts), minlength=parts).astype(np.int32)), keys.tobytes(), np.array(blocks, np.int64).tobytes(), steps(places), lengths(places), steps(word_places), lengths(word_places),
    ]
    return pa.table([pa.array([v], pa.binary() if k else pa.int64()) for k, v in enumerate(row)], names=_MERGED_NAMES)


def _rows(batches):
    """The rows of all batches, unpacked one at a time: each holds a whole bucket."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class Totals:
    """What a bucket needs to know of all others: customers and tables of the contexts it holds, and scalars."""

    def __init__(self, customers, vocabulary, tokens, discounts, strength, parent_customers=0, parent_tables=0):
        self.customers, self.vocabulary, self.tokens = customers, vocabulary, tokens
        self.context_discount, self.parent_discount = discounts
        self.strength = strength
        self.tables = np.minimum(customers, 1)
        self.parent_customers, self.parent_tables = parent_customers, parent_tables


class Bucket:
    """One bucket's contexts and counts, unpacked. Tables are kept for pairs that occur more than once."""

    def __init__(self, row: dict):
        self.row = row
        self.sizes = unpack(row["sizes"], np.int32)
        self.contexts = np.frombuffer(row["contexts"], np.uint16).astype(np.int32)
        if row.get("high"):
            self.contexts += unpack(row["high"], np.uint16).astype(np.int32) * CONTEXTS
        self.counts = unpack_counts(row["counts"], len(self.contexts))
        self.words = len(self.sizes)
        self.owner = np.repeat(np.arange(self.words, dtype=np.int32), self.sizes)
        self.word_counts = np.bincount(self.owner, self.counts, self.words).astype(np.int64)
        self.several = np.flatnonzero(self.counts > 1)

    def state(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables by pair and by word after sweep ``k``."""
        seats = np.minimum(self.counts, 1)
        seats[self.several] = unpack_counts(self.row["seats"][k], len(self.several))
        return seats, unpack_counts(self.row["parents"][k], self.words)

    def parent(self, seats: np.ndarray, parents: np.ndarray, totals: Totals) -> np.ndarray:
        """Predictive probability of each word in the parent restaurant."""
        customers = np.bincount(self.owner, seats, self.words)
        d, th = totals.parent_discount, totals.strength
        base = 1.0 / (totals.vocabulary + 1)
        return (np.maximum(customers - d * parents, 0) + (th + d * totals.parent_tables) * base) / (th + totals.parent_customers)

    def shares(self, values: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Sums over this bucket's pairs by context, cut by the part that a context belongs to."""
        parts = unpack(self.row["parts"], np.int32)
        sums = np.bincount(self.contexts, values, int(parts.sum())).astype(np.int64)
        return [(k, self.row["bucket"], pack(x)) for k, x in enumerate(np.split(sums, np.cumsum(parts)[:-1])) if len(x)]

    def sweep(self, totals: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Seat every word of every context again, then every word in the parent, given the tables of the last sweep elsewhere."""
        if self.row["seats"]:
            seats, parents = self.state(-1)
        else:
            seats, parents = np.minimum(self.counts, 1), np.minimum(self.word_counts, 1)
        seats = seats.astype(np.int64)
        d, up, strength = totals.context_discount, totals.parent_discount, totals.strength
        base = 1.0 / (totals.vocabulary + 1)
        fresh = (strength + up * totals.parent_tables) * base
        customers = np.bincount(self.owner, seats, self.words).astype(np.int64)
        for half in (0, 1):
            rows = self.several[half::2]
            own, word = seats[rows], self.owner[rows]
            others = customers[word] - own
            elsewhere = np.maximum(totals.tables[self.contexts[rows]] - own, 0)
            # a further table's share in the parent: what others have there and this dish's tables so far
            top = others - up * np.minimum(parents[word], np.maximum(others, 1)) + fresh
            bottom = np.maximum(strength + totals.parent_customers - own, strength)
            start = np.where(others > 0, top, fresh) / bottom
            seats[rows] = draw_tables(self.counts[rows], Weights(strength + d * elsewhere, d, top, bottom, start), d, rng)
            customers += np.bincount(word, seats[rows] - own, self.words).astype(np.int64)
        tables = np.maximum(totals.parent_tables - parents, 0)
        return seats, draw_tables(customers, Weights.constant(strength + up * tables, up, base, self.words), up, rng)

    def log10(self, states: list[Totals], first: int) -> np.ndarray:
        """Mean predictive probability of each pair over the kept sweeps, as a logarithm."""
        mean = np.zeros(len(self.counts))
        for k, totals in enumerate(states):
            seats, parents = self.state(first + k)
            d = totals.context_discount
            given, tables = totals.customers[self.contexts], totals.tables[self.contexts]
            p = self.parent(seats, parents, totals)[self.owner]
            mean += (np.maximum(self.counts - d * seats, 0) + (totals.strength + d * tables) * p) / (totals.strength + given)
        return np.log10(mean / len(states))


_SHARE = "part long, bucket long, values binary"
_SHARE_NAMES = ["part", "bucket", "values"]


def _blobs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.binary() if n in ("keys", "codes", "values", "counts") else pa.int64() for n in names]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _knowing(batches):
    """A bucket's contexts, cut by the part they belong to."""
    for row in _rows(batches):
        keys, cut = np.frombuffer(row["keys"], np.uint64), np.cumsum(unpack(row["parts"], np.int32))[:-1]
        yield _blobs([(k, row["bucket"], x.tobytes()) for k, x in enumerate(np.split(keys, cut)) if len(x)], ["part", "bucket", "keys"])


def _coding(table: pa.Table) -> pa.Table:
    """The contexts of a part numbered, as each bucket has them."""
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    code = np.unique(np.concatenate(keys), return_inverse=True)[1].astype(np.int32)
    codes = [pack(c) for c in np.split(code, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"part": table["part"], "bucket": table["bucket"], "codes": pa.array(codes, pa.binary())})


def _summing(shares: pa.Table, directory: pa.Table) -> pa.Table:
    """Sums by context over all buckets, given back to each in its own order."""
    if not shares.num_rows:
        return pa.Table.from_batches([_blobs([], _SHARE_NAMES)])
    codes = {b: unpack(c, np.int32) for b, c in zip(directory["bucket"].to_pylist(), directory["codes"].to_pylist(), strict=True)}
    sums = np.zeros(1 + max(int(c.max()) for c in codes.values()), np.int64)
    for bucket, values in zip(shares["bucket"].to_pylist(), shares["values"].to_pylist(), strict=True):
        sums[codes[bucket]] += unpack(values, np.int64)
    part = shares["part"][0].as_py()
    return pa.Table.from_batches([_blobs([(part, b, pack(sums[c])) for b, c in codes.items()], _SHARE_NAMES)])


def _exchange(shares: DataFrame, directory: DataFrame, label: str) -> DataFrame:
    return keep(shares.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(_summing, _SHARE), label)


def _aligned(table: pa.Table) -> np.ndarray:
    """The totals of a bucket's contexts, in the bucket's order."""
    order = np.argsort(table["part"].to_numpy())
    values = table["values"].to_pylist()
    return np.concatenate([unpack(values[k], np.int64) for k in order]) if len(order) else np.zeros(0, np.int64)


def _own_shares(kind: str):
    """What a bucket's pairs add to each context: training counts or, after a sweep, tables."""

    def run(batches):
        for row in _rows(batches):
            b = Bucket(row)
            yield _blobs(b.shares(b.counts if kind == "customers" else b.state(-1)[0]), _SHARE_NAMES)

    return run


def _counting(batches):
    """What the discounts and the base need, by name."""
    for row in _rows(batches):
        b = Bucket(row)
        kinds = np.bincount(b.owner, b.counts > 0, b.words)
        extra = [(b.word_counts > 0).sum(), b.word_counts.sum(), (b.counts == 1).sum(), (b.counts == 2).sum(), (kinds == 1).sum(), (kinds == 2).sum(), (b.counts > 0).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(extra))), pa.array(np.array(extra, np.int64))], names=["key", "n"])


def _given(shares: pa.Table, sweep: int, scalars: tuple) -> Totals:
    """A bucket's totals as they were after ``sweep``; before any, each context has one table."""
    kinds = shares["sweep"].to_numpy()
    totals = Totals(_aligned(shares.filter(pa.array(kinds == -1))), *scalars)
    if sweep >= 0:
        totals.tables = _aligned(shares.filter(pa.array(kinds == sweep)))
    return totals


def _sweeping(scalars: tuple, number: int, seed: int, lattices: dict[float, np.ndarray]):
    def run(states: pa.Table, shares: pa.Table) -> pa.Table:
        prime(lattices)
        out, totals = [], _given(shares, number - 1, scalars)
        for row in _rows(states.to_batches()):
            b = Bucket(row)
            seats, parents = b.sweep(totals, np.random.default_rng([seed, number, row["bucket"]]))
            row["seats"] = [*row["seats"], pack_counts(seats[b.several])]
            row["parents"] = [*row["parents"], pack_counts(parents)]
            out.append(row)
        return pa.table([pa.array([r[n] for r in out], t) for n, t in zip(_STATE_NAMES, _STATE_TYPES, strict=True)], names=_STATE_NAMES)

    return run


def _parents(batches):
    """After the last sweep, under 0 the parent's customers, under 1 its tables."""
    for row in _rows(batches):
        seats, parents = Bucket(row).state(-1)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([int(seats.sum()), int(parents.sum())])], names=["key", "n"])


_ANSWER_NAMES = ["block", "bucket", "values", "counts"]


def _answering(kept: list[tuple], first: int):
    """For each block the log-probabilities of its pairs and the counts of its words, in its own order."""

    def run(rows: pa.Table, shares: pa.Table) -> pa.Table:
        out = []
        states = [_given(shares, first + k, scalars) for k, scalars in enumerate(kept)]
        for row in _rows(rows.to_batches()):
            b = Bucket(row)
            value = b.log10(states, first).astype(np.float32)
            at = word_at = 0
            blocks = np.frombuffer(row["blocks"], np.int64).tolist()
            steps, word_steps = unpack(row["places"], np.int32), unpack(row["word_places"], np.int32)
            for block, n, m in zip(blocks, np.frombuffer(row["place_sizes"], np.int64).tolist(), np.frombuffer(row["word_sizes"], np.int64).tolist(), strict=True):
                places, words = np.cumsum(steps[at : at + n]), np.cumsum(word_steps[word_at : word_at + m])
                out.append((block, row["bucket"], pack(value[places]), pack(b.word_counts[words])))
                at, word_at = at + n, word_at + m
        return pa.Table.from_batches([_blobs(out, _ANSWER_NAMES)])

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scoring(tokens: int, vocabulary: int):
    unit = math.log10(tokens + 1 * (vocabulary + 1))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        n = texts.num_rows
        if not n:
            return pa.table({p.split()[0]: pa.array([], pa.float64() if "double" in p else pa.bool_() if "bool" in p else pa.int64()) for p in _SCORE.split(", ")})
        order = np.argsort(answers["bucket"].to_numpy())
        values, counts = answers["values"].to_pylist(), answers["counts"].to_pylist()
        value = np.concatenate([unpack(values[k], np.float32) for k in order])
        count = np.concatenate([unpack(counts[k], np.int64) for k in order])
        parts = [_stream(data, bounds) for _, data, bounds in bt.slices(texts["text"].combine_chunks())]
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        word, first = np.concatenate([p[0] for p in parts]), np.zeros(at[-1], bool)
        first[at[:-1]] = True
        del parts
        words, _, _, contexts, _, code, back = _followed(word, first, None)
        del word, first
        if len(words) != len(count) or len(contexts) != len(value):
            raise RuntimeError("a block's answers do not fit its documents")
        seen = count[code]
        score = np.add.reduceat(value[back].astype(np.float64), at[:-1])
        base = np.add.reduceat(np.log10(seen + 1) - unit, at[:-1])
        known = np.add.reduceat((seen > 0).astype(np.int64), at[:-1])
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array(np.diff(at)),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, tokens)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    return run


def _collected(rows: DataFrame) -> dict[int, int]:
    return {r.key: r.n for r in rows.groupBy("key").agg(F.sum("n").alias("n")).collect()}


def score_documents(
    docs: DataFrame,
    sweeps: int = 2,
    burn_in: int = 1,
    strength: float = 1.0,
    folds: int = 7,
    held_fold: int = 2,
    seed: int = 1,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Log10 probability of every text under a model of the training texts.

    Training texts are those for which crc32(id as text) mod ``folds`` is not
    ``held_fold``. Returns (doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score); tokens are blank-separated words, ASCII lower-cased, and
    an end. ``base_score`` is that of add-one smoothed word counts. Perplexity is
    ``10 ** (-score / n_tokens)``.

    Null and empty texts have the end as their only token. A null id counts as
    the empty text for the fold. Rows that repeat an id are documents of their
    own. If no row is for training, all words are new. No rows give no rows;
    other columns play no part.
    """
    spark = docs.sparkSession
    remainder = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (remainder == held_fold).alias("held_out"))
    size = plain.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("b")).first()
    blocks = max(1, math.ceil((size.b or 0) / BLOCK_BYTES))
    # ids that follow each other share words, so a block is a range of ids; one that takes in far more
    # rows than others, as its ids are null, repeat or go in steps, is dealt out by hash
    rows = max(1, math.ceil(size.n / blocks))
    block = F.coalesce(F.pmod(F.floor(F.col("doc_id") / rows), F.lit(blocks)), F.lit(0)).cast("long")
    crowded = [r.block for r in plain.groupBy(block.alias("block")).count().where(F.col("count") > CROWD * rows).collect()]
    plain = plain.withColumn("block", F.when(block.isin(crowded), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).otherwise(block))
    buckets, parts = max(4 * shuffle_partitions(spark), math.ceil((size.b or 0) / BUCKET_BYTES)), math.ceil(blocks / 4)
    asked = plain.select("doc_id", "text", "block", (~F.col("held_out")).alias("train")).mapInArrow(_asking(buckets), _ASK)
    merged = keep(asked.groupBy("bucket").applyInArrow(_merging(parts), _MERGED), "pitman-yor-counts")
    known = merged.select("bucket", "parts", "keys").mapInArrow(_knowing, "part long, bucket long, keys binary")
    directory = keep(known.groupBy("part").applyInArrow(_coding, "part long, bucket long, codes binary"), "pitman-yor-contexts")
    empty = F.array().cast("array<binary>")
    state = merged.select(*_STATE_NAMES[:6], empty.alias("seats"), empty.alias("parents"))
    extra = _collected(state.mapInArrow(_counting, "key long, n long"))
    vocabulary, tokens, n1, n2, m1, m2, pairs = (extra.get(k, 0) for k in range(7))
    discounts = tuple(min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in ((n1, n2), (m1, m2)))
    model = (vocabulary, tokens, discounts, strength)
    lattices = {d: lattice(d) for d in discounts}
    customers = _exchange(state.mapInArrow(_own_shares("customers"), _SHARE), directory, "pitman-yor-customers").withColumn("sweep", F.lit(-1))
    # before any sweep each pair has one table, and each word one in the parent
    scalars, shares, kept, every = (*model, pairs, vocabulary), customers, [], customers
    for k in range(burn_in + sweeps):
        swept = state.groupBy("bucket").cogroup(shares.groupBy("bucket")).applyInArrow(_sweeping(scalars, k, seed, lattices), _STATE)
        before, state = state, keep(swept, "pitman-yor-seats")
        if k:
            forget(before)  # its seats are in the new table too
        else:  # the state holds the counts from now on
            places = keep(merged.select("bucket", *_MERGED_NAMES[7:]), "pitman-yor-places")
            forget(merged)
        parent = _collected(state.mapInArrow(_parents, "key long, n long"))
        scalars = (*model, parent.get(0, 0), parent.get(1, 0))
        tables = _exchange(state.mapInArrow(_own_shares("tables"), _SHARE), directory, "pitman-yor-tables").withColumn("sweep", F.lit(k))
        shares = customers.unionByName(tables)
        if k >= burn_in:
            every = every.unionByName(tables)
            kept.append(scalars)
    # a stated number keeps few buckets, each of some MB, in a task
    final = state.repartition(buckets, "bucket").join(places.repartition(buckets, "bucket"), "bucket")
    answers = final.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(_answering(kept, burn_in), "block long, bucket long, values binary, counts binary")
    return plain.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scoring(tokens, vocabulary), _SCORE)
