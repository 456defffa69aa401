"""Removal of repeated byte strings by suffix sorting with bucket pointers.

Any two equal strings of ``length`` bytes hold the same q-gram of least hash at
the same place. So only those q-grams are gathered: each run of string starts
that share one is a record of its bucket (the q-gram) and of the bytes that the
run covers. Records that agree in both are equal all along, so all but the first
are repeats: a task drops those among its own rows, and only the first of each
kind is shuffled. A bucket with one kind of record is settled by that.

The buckets left hold suffixes that agree for q bytes and may differ later. For
these the bytes of each kind are fetched once and sorted: buckets of 8-grams are
refined by the bucket identifiers of later offsets, and each round's buckets are
the next round's identifiers, until they stand for ``length`` bytes.

A document is a pair of its id and a hash of its text, and comes in this order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import forget, keep, shuffle_partitions

Q = 32
FLUSH = 1_200_000
#: Text bytes for each part that records are dealt into.
PART_BYTES = 4 << 20
#: A sample of one document in so many tells which q-grams are so frequent that one would take up
#: a part: those with a share of 1 in so many parts of all runs, at least so many of them. Shares
#: add up to 1, so there are no more of these than parts. They are dealt out by whole strings.
SAMPLE, HOT_SHARE, HOT_RUNS = 64, 4, 256


def _least_positions(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` values the place of the least, the leftmost of equals.

    Values are compared by their upper 40 bits, whatever the length of ``h``.
    """
    size = 1 << 22
    if len(h) > 2 * size:
        return np.concatenate([k + _least_positions(h[k : k + size + span - 1], span) for k in range(0, len(h) - span + 1, size)])
    best = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    return (best & np.uint64((1 << 24) - 1)).astype(np.int64)


def _q(length: int) -> int:
    return min(Q, (length + 1) // 2)


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one least q-gram: (document, start, starts more, bucket, kind), and prefix sums."""
    sums = bt.prefix_sums(data)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums
    q = _q(length)
    at = np.arange(len(data) - q + 1)
    anchor = _least_positions(bt.span_hash(sums, at, at + q), length - q + 1)
    valid = np.zeros(n + 1, np.int32)
    sizes = np.diff(bounds)
    for lo, hi in zip(bounds[:-1][sizes >= length].tolist(), bounds[1:][sizes >= length].tolist(), strict=True):
        valid[lo] += 1
        valid[hi - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] & ~valid[:-1])
    edge = bounds[1:-1]
    fresh[edge[edge < n]] = True
    stop = np.ones(n, bool)
    stop[:-1] = fresh[1:] | ~valid[1:]
    first, last = np.flatnonzero(fresh & valid), np.flatnonzero(stop & valid)
    doc = np.searchsorted(bounds, first, "right") - 1
    bucket = bt.span_hash(sums, anchor[first], anchor[first] + q, 1)
    kind = bt.mix(bt.span_hash(sums, first, last + length, 2) + (anchor[first] - first).astype(np.uint64))
    return doc, first, last - first, bucket, kind, sums


def _strings(sums: np.ndarray, doc: np.ndarray, first: np.ndarray, more: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs taken apart into single strings; the bucket is the string's own hash and the kind is the q-gram's."""
    times = more + 1
    at = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return np.repeat(doc, times), at, np.zeros(len(at), np.int64), bt.span_hash(sums, at, at + length, 3), np.repeat(bt.mix(bucket), times)


def _firsts(bucket, kind, ids, tie, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, kind, document, start) without what is listed twice, and which rows are the first of their kind."""
    order = np.lexsort((start, tie, ids, kind, bucket))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(bucket[order]) != 0) | (np.diff(kind[order]) != 0)
    new = fresh.copy()
    for column in (ids, tie, start):
        new[1:] |= np.diff(column[order]) != 0
    return order[new], fresh[new]


_FIELDS = (("ids", np.int64), ("tie", np.int64), ("start", np.int32), ("more", np.uint16), ("bucket", np.uint64), ("kind", np.uint64))
_PACKED = pa.schema([("part", pa.int32()), ("sure", pa.bool_()), *((n, pa.binary()) for n, _ in _FIELDS)])
_PACKED_SQL = "part int, sure boolean, ids binary, tie binary, start binary, more binary, bucket binary, kind binary"
_FOUND_SQL = "ids long, tie long, start int, more int, bucket long"


def _pack(part: int, sure: bool, arrays: dict[str, np.ndarray]) -> tuple:
    return part, sure, *(arrays[n].astype(t, copy=False).tobytes() for n, t in _FIELDS)


def _collecting(length: int, parts: int, hot: np.ndarray):
    """Records of a task's documents: repeats found on the spot, and the first of each kind by bucket."""

    def settle(held: list[dict]) -> pa.RecordBatch:
        every = {n: np.concatenate([h[n] for h in held]) for n, _ in _FIELDS}
        order, first = _firsts(every["bucket"], every["kind"], every["ids"], every["tie"], every["start"])
        every = {n: v[order] for n, v in every.items()}
        rows = []
        part = (every["bucket"] % np.uint64(parts)).astype(np.int64)
        for sure, mask in ((True, ~first), (False, first)):
            chosen = np.flatnonzero(mask)
            chosen = chosen[np.argsort(part[chosen], kind="stable")]
            for piece in np.split(chosen, np.flatnonzero(np.diff(part[chosen])) + 1) if len(chosen) else ():
                rows.append(_pack(int(part[piece[0]]), sure, {n: v[piece] for n, v in every.items()}))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, data, bounds in bt.slices(batch.column(2)):
                doc, first, more, bucket, kind, sums = _runs(data, bounds, length)
                if len(hot) and len(doc):
                    split = np.isin(bucket, hot)
                    if split.any():
                        single = _strings(sums, doc[split], first[split], more[split], bucket[split], length)
                        whole = (doc[~split], first[~split], more[~split], bucket[~split], kind[~split])
                        doc, first, more, bucket, kind = (np.concatenate(x) for x in zip(whole, single, strict=True))
                if len(doc):
                    held.append({"ids": ids[row + doc], "tie": tie[row + doc], "start": (first - bounds[doc]).astype(np.int32), "more": more.astype(np.uint16), "bucket": bucket, "kind": kind})
                    count += len(doc)
                if count >= FLUSH:
                    yield settle(held)
                    held, count = [], 0
        if held:
            yield settle(held)

    return run


def _sampling(length: int):
    """Counts of different records by bucket."""

    def run(batches):
        for batch in batches:
            for _, data, bounds in bt.slices(batch.column(2)):
                _, _, _, bucket, kind, _ = _runs(data, bounds, length)
                both = np.unique(np.stack([bucket, kind], 1), axis=0)[:, 0]
                value, times = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["bucket", "runs"])

    return run


def _merging(table: pa.Table) -> pa.Table:
    """Repeats of a part's buckets, and the kinds of the buckets that have several."""
    sure = table["sure"].to_numpy(zero_copy_only=False)
    every = {}
    for n, t in _FIELDS:
        every[n] = [np.frombuffer(x, t) for x in table[n].to_pylist()]
    known = {n: np.concatenate([v for v, s in zip(every[n], sure, strict=True) if s] or [np.zeros(0, t)]) for n, t in _FIELDS}
    open_ = {n: np.concatenate([v for v, s in zip(every[n], sure, strict=True) if not s] or [np.zeros(0, t)]) for n, t in _FIELDS}
    order, first = _firsts(open_["bucket"], open_["kind"], open_["ids"], open_["tie"], open_["start"])
    open_ = {n: v[order] for n, v in open_.items()}
    kinds = np.flatnonzero(first)
    bucket = open_["bucket"][kinds]
    _, code, times = np.unique(bucket, return_inverse=True, return_counts=True)
    unsettled = kinds[times[code] > 1]
    repeats = np.flatnonzero(~first)

    def rows(field: str) -> np.ndarray:
        return np.concatenate([known[field], open_[field][repeats], open_[field][unsettled]])

    shown = np.concatenate([np.zeros(len(known["ids"]) + len(repeats), np.int64), open_["bucket"][unsettled].view(np.int64) | 1])
    return pa.table(
        {
            "ids": pa.array(rows("ids")),
            "tie": pa.array(rows("tie")),
            "start": pa.array(rows("start")),
            "more": pa.array(rows("more").astype(np.int32)),
            "bucket": pa.array(shown),
        }
    )


def bucket_pointers(data: np.ndarray, at: np.ndarray, depth: int, first: int = 8) -> np.ndarray:
    """Bucket numbers of the suffixes at ``at`` by their leading ``depth`` bytes.

    Initial buckets are those of ``first``-grams. A bucket is refined by the
    bucket identifiers found ``covered`` bytes later, which stand for as many
    bytes again; the last step overlaps to end at ``depth`` exactly. Suffixes
    that are alone in their bucket need no further step and keep their number.
    """
    first = min(first, depth)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    code = np.zeros(len(data), np.uint64)
    for j in range(first):
        code |= padded[j : j + len(data)].astype(np.uint64) << np.uint64(8 * (first - 1 - j))
    ids = np.unique(code, return_inverse=True)[1].astype(np.uint64)
    covered = first
    while covered < depth:
        step = min(covered, depth - covered)
        where = at if covered + step >= depth else np.arange(len(data))
        crowded = np.bincount(ids.astype(np.int64))[ids[where].astype(np.int64)] > 1
        work = where[crowded]
        later = np.zeros(len(work), np.uint64)
        fits = work + step < len(data)
        later[fits] = ids[work[fits] + step]
        fresh = ids.copy()
        top = np.uint64(int(ids.max()) + 1 if len(ids) else 1)
        fresh[work] = top + np.unique((ids[work] << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint64)
        ids = np.unique(fresh, return_inverse=True)[1].astype(np.uint64)
        covered += step
    return ids[at].astype(np.int64)


def _refining(length: int, most: int = 1 << 22):
    """Repeated strings among the kinds of a part's buckets, by bucket-pointer refinement."""

    def refine(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        body = table["body"].take(pa.array(rows))
        ids, tie, start, more = (table[c].to_numpy()[rows] for c in ("ids", "tie", "start", "more"))
        blob = [np.frombuffer(b, np.uint8) for b in body.to_pylist()]
        data = np.concatenate(blob)
        base = np.concatenate([[0], np.cumsum([len(b) for b in blob])[:-1]])
        times = more + 1
        shift = np.arange(times.sum()) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        at = np.repeat(base, times) + shift
        ids, tie, place = np.repeat(ids, times), np.repeat(tie, times), np.repeat(start, times) + shift
        order, first = _firsts(bucket_pointers(data, at, length), np.zeros(len(at), np.int64), ids, tie, place)
        again = order[~first]
        return ids[again], tie[again], place[again]

    def run(table: pa.Table) -> pa.Table:
        bucket, size = table["bucket"].to_numpy(), table["more"].to_numpy() + length
        order = np.argsort(bucket, kind="stable")
        ends = np.concatenate([np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        total = np.cumsum(size[order])
        out, lo = [], 0
        while lo < len(order):  # whole buckets, about ``most`` bytes at a time
            want = total[lo - 1] + most if lo else most
            hi = int(ends[min(np.searchsorted(total[ends - 1], want), len(ends) - 1)])
            hi = int(ends[np.searchsorted(ends, lo, "right")]) if hi <= lo else hi
            out.append(refine(table, order[lo:hi]))
            lo = hi
        ids, tie, places = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((places, tie, ids))
        ids, tie, places = ids[order], tie[order], places[order].astype(np.int64)
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (np.diff(ids) != 0) | (np.diff(tie) != 0) | (np.diff(places) != 1)
        first = np.flatnonzero(fresh)
        more = np.diff(np.concatenate([first, [len(ids)]])) - 1
        columns = {"ids": ids[first], "tie": tie[first], "start": places[first].astype(np.int32), "more": more.astype(np.int32), "bucket": np.zeros(len(first), np.int64)}
        return pa.table({n: pa.array(c) for n, c in columns.items()})

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with ``ids``, in which null comes after all, and ``tie``, the hash of their text."""
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return out.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ids"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tie"), "text", "doc_id")


def _hot(plain: DataFrame, length: int, parts: int) -> np.ndarray:
    """Q-grams of which one would take up a part, judged by a sample of documents."""
    sample = plain.where(F.pmod(F.xxhash64("ids", "tie"), F.lit(SAMPLE)) == 0)
    runs = keep(sample.mapInArrow(_sampling(length), "bucket long, runs long").groupBy("bucket").agg(F.sum("runs").alias("runs")), "suffix-sample")
    every = runs.agg(F.sum("runs")).first()[0] or 0
    often = runs.where((F.col("runs") >= HOT_RUNS) & (F.col("runs") * HOT_SHARE * parts >= every)).select("bucket").toArrow()
    forget(runs)
    return often["bucket"].to_numpy().view(np.uint64)


def repeated_spans(docs: DataFrame, length: int = 100, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the byte ranges covered by strings of ``length`` bytes that also start earlier.

    Returns (ids, tie, doc_id, text, copies, spans): one row for each different
    pair of id and text, and how many rows have it. Earlier is a smaller id, then
    a smaller hash of the text, then a smaller place in the same text. Ranges are
    in order of their starts; there are none (null) if nothing repeats.
    """
    if not 2 <= length < 1 << 16:
        raise ValueError("strings have 2 to 65535 bytes")
    plain = _keyed(docs, doc_id, text)
    size = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(4 * shuffle_partitions(docs.sparkSession), int(size // PART_BYTES))
    packed = plain.select("ids", "tie", "text").mapInArrow(_collecting(length, parts, _hot(plain, length, parts)), _PACKED_SQL)
    found = keep(packed.groupBy("part").applyInArrow(_merging, _FOUND_SQL), "suffix-found")
    whole = plain.groupBy("ids", "tie").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    bodies = found.where("bucket != 0").join(whole.where("copies > 0"), ["ids", "tie"]).select(
        "ids", "tie", "start", "more", "bucket", F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("more") + length).alias("body")
    )
    refined = bodies.groupBy(F.pmod("bucket", F.lit(parts)).alias("part")).applyInArrow(
        lambda table: _refining(length)(table), _FOUND_SQL
    )
    every = found.where("bucket = 0").unionByName(refined)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("more") + length).alias("end"))))
    return whole.join(every.groupBy("ids", "tie").agg(spans.alias("spans")), ["ids", "tie"], "left")


def _cutting(batches):
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            body = (batch.column(1)[row].as_py() or "").encode()
            spans = batch.column(2)[row].as_py() or ()
            kept, upto, removed, runs = [], 0, 0, 0
            last = -1
            for span in spans:
                s, e = max(span["start"], upto), span["end"]
                if span["start"] > last:
                    runs += 1
                last = max(last, e)
                if e <= upto:
                    continue
                kept.append(body[upto:s])
                removed += e - s
                upto = e
            kept.append(body[upto:])
            rest = b"".join(kept)
            out.append((batch.column(0)[row].as_py(), len(body), removed, runs, hashlib.sha256(rest).hexdigest(), rest, batch.column(3)[row].as_py()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "copies"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def suffix_dedup(docs: DataFrame, length: int = 100, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text without the bytes of strings that occurred before.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per
    input row; ``kept`` is the rest of the UTF-8 bytes, which may be cut inside a
    character. Strings are judged on the input, overlaps count, and none crosses
    documents.

    Null and empty texts have no bytes; texts shorter than ``length`` stay whole.
    Of equal texts the least id keeps its bytes. Rows that repeat an id with
    other texts are documents of their own, in the order of a hash of the text;
    of rows that repeat id and text one keeps its bytes and the others count as
    later. Rows without an id come after all others. No rows give no rows; other
    columns play no part.
    """
    found = repeated_spans(docs, length, doc_id=doc_id, text=text).select("doc_id", "text", "spans", "copies").mapInArrow(
        _cutting, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, copies long"
    )
    # one row for each copy; all but one are repeats throughout if they are long enough
    step = 1 << 16
    some = found.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / step))))
    each = some.withColumn("copy", F.explode(F.sequence(F.col("lot") * step, F.least(F.col("copies"), (F.col("lot") + 1) * step) - 1)))
    gone = (F.col("copy") > 0) & (F.col("n_bytes") >= length)
    return each.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
