"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items make one automaton over words. Training texts stream
through it word by word; the automaton tracks the longest match that ends at
each word, and words inside a match of the window length are hit. A cheap test
comes first: a window can only lie in a run of words whose every neighbouring
pair occurs in some item, so only such runs are streamed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import forget, fresh, keep

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<start:int,end:int>>, contaminated boolean"
_PAIR = np.uint64(0x9FB21C651E98DF25)


class Automaton:
    """Generalised suffix automaton of word sequences.

    A state stands for the word strings that end at the same places of the
    items; ``length`` is that of its longest, ``link`` leads to its suffixes.
    """

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
        self._mark(items)

    def _state(self, length: int, link: int, arcs: dict[bytes, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state of the longest string of ``state`` followed by ``word``, cut loose if it shares one."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, word: bytes) -> int:
        if word in self.next[state]:
            return self._split(state, word)
        new = self._state(self.length[state] + 1, 0, {})
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _mark(self, items: Sequence[tuple[str, list[bytes]]]) -> None:
        """``cut``: the suffix state of window length; ``inside``: items with that window; ``whole``: short items."""
        w, n = self.window, len(self.length)
        self.cut, self.short_up = [0] * n, [-1] * n
        self.inside: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        order = sorted(range(n), key=self.length.__getitem__)
        for s in order[1:]:
            self.cut[s] = self.cut[self.link[s]] if self.length[self.link[s]] >= w else s
        for name, words in items:
            state = 0
            for k, word in enumerate(words):
                state = self.next[state][word]
                if k + 1 >= w:
                    self.inside.setdefault(self.cut[state], set()).add(name)
            if len(words) < w:
                self.whole.setdefault(state, []).append((len(words), name))
        for s in order[1:]:
            up = self.link[s]
            self.short_up[s] = up if up in self.whole else self.short_up[up]

    def stream(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows, and the items that have them."""
        nxt, link, length, w = self.next, self.link, self.length, self.window
        state, matched, spans, found = 0, 0, [], set()
        for k, word in enumerate(words, 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= w:
                spans.append((k - w, k))
                found |= self.inside[self.cut[state]]
            at = state if state in self.whole else self.short_up[state]
            while at > 0:
                for size, name in self.whole[at]:
                    if size <= matched:
                        spans.append((k - size, k))
                        found.add(name)
                at = self.short_up[at]
        return spans, found


class Matcher:
    """An automaton with the pair filter in front of it; matches runs of documents."""

    def __init__(self, items: Sequence[tuple[str, str]], window: int):
        parsed = []
        pairs, single = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for name, text in items:
            data = bt.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = bt.tokens(data, np.array([0, len(data)]), bt.ALNUM)
            raw = data.tobytes()
            parsed.append((name, [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]))
            word = bt.span_hash(bt.prefix_sums(data), starts, ends)
            single.append(word)
            pairs.append(word[:-1] * _PAIR + word[1:])
        sizes = [len(words) for _, words in parsed if words]
        self.least = min([window, *sizes])
        self.known = np.unique(np.concatenate(single if self.least == 1 else pairs))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.automaton = Automaton(parsed, window)

    def _runs(self, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ranges in which every pair (word, if items of one word exist) is known."""
        if self.least == 1:
            linked, joint = word, np.ones(max(0, len(word)), bool)
        else:
            linked = word[:-1] * _PAIR + word[1:]
            joint = np.ones(len(linked), bool)
            cuts = at[1:-1]
            joint[cuts[(cuts > 0) & (cuts <= len(linked))] - 1] = False
        near = np.flatnonzero(self.bitmap[(linked >> np.uint64(44)).astype(np.int64)] & joint)
        known = self.known[np.minimum(np.searchsorted(self.known, linked[near]), len(self.known) - 1)] == linked[near]
        hit = np.zeros(len(linked) + 2, np.int8)
        hit[near[known] + 1] = 1
        step = np.diff(hit)
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if self.least > 1:
            hi = hi + 1
            return lo[hi - lo >= self.least], hi[hi - lo >= self.least]
        cuts = at[1:-1]  # runs of single words may cross documents
        lo = np.union1d(lo, cuts[(hit[cuts + 1] == 1)]) if len(cuts) else lo
        hi = np.union1d(hi, cuts[(hit[cuts] == 1) & (cuts > 0)]) if len(cuts) else hi
        return lo, hi

    def match(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
        """For every document its words, hit words, byte spans hit and items."""
        low = bt.LOWER[data]
        starts, ends, at = bt.tokens(low, bounds, bt.ALNUM)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if len(self.known) and len(starts):
            lo, hi = self._runs(bt.span_hash(bt.prefix_sums(low), starts, ends), at)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                words = [low[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                spans, names = self.automaton.stream(words)
                if spans:
                    doc = int(np.searchsorted(at, a, "right")) - 1
                    kept = found.setdefault(doc, ([], set()))
                    kept[0].extend((a + s, a + e) for s, e in spans)
                    kept[1].update(names)
        sizes = np.diff(at).tolist()
        for doc, size in enumerate(sizes):
            spans, names = found.get(doc, ((), set()))
            merged: list[list[int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            base = int(bounds[doc])
            in_bytes = [(int(starts[s]) - base, int(ends[e - 1]) - base) for s, e in merged]
            yield size, sum(e - s for s, e in merged), in_bytes, names


def _shards(items: DataFrame, item_id: str, text: str, most_words: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in lists of about ``most_words`` words, and whether a list is the last.

    They are streamed from Spark partition by partition; no more than two lists
    are held. Without items there is one empty list.
    """
    shard: list[tuple[str, str]] = []
    ready, held = None, 0
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text))
    for name, body in rows.toLocalIterator():
        shard.append((name if name is not None else "", body))
        held += len(body) // 4 + 1
        if held >= most_words:
            if ready is not None:
                yield ready, False
            ready, shard, held = shard, [], 0
    if shard and ready is not None:
        yield ready, False
        ready = None
    yield (shard if ready is None else ready), True


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = 200_000,
) -> DataFrame:
    """Benchmark windows in every document.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one; words are lower-cased runs of ASCII letters and digits and of
    anything beyond ASCII. Returns (doc_id, n_words, n_hit, n_items, items,
    items_sha256, spans, contaminated), one row per input row; ``spans`` are
    code points of the text that windows cover, end exclusive.

    Items are cut into shards of ``shard_words`` words, whatever their number.
    One automaton at a time is broadcast, and every shard passes over the
    documents once; what it finds travels on with them.

    Null and empty texts have no words and no hits; null items are left out;
    items without words have no window; no items leave every document clean;
    equal items under two ids are both listed; rows that repeat an id are
    judged one by one; other columns of either table play no part.
    """
    none = [F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(_SPANS).alias("spans")]
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *none)
    context, before = docs.sparkSession.sparkContext, None
    for shard, last in _shards(items, item_id, item_text, shard_words):
        tag = uuid.uuid4().hex
        if last:
            return marked.mapInArrow(_reporting(context.broadcast(shard), tag, window), REPORT)
        marked = keep(marked.mapInArrow(_marking(context.broadcast(shard), tag, window, 1), marked.schema), "benchmark-marked")
        before = _replace(before, marked)
    raise AssertionError("there is always a last shard")


def _replace(before: DataFrame | None, now: DataFrame) -> DataFrame:
    if before is not None:
        forget(before)
    return now


def _row(name, size: int, hit: int, spans: list[tuple[int, int]], names) -> tuple:
    listed = sorted(names)
    digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
    return name, size, hit, len(listed), listed, digest, [{"start": s, "end": e} for s, e in spans], hit > 0


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("items_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("contaminated", pa.bool_()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _count_words(body: str) -> int:
    data = bt.LOWER[np.frombuffer(body.encode(), np.uint8)]
    return len(bt.tokens(data, np.array([0, len(data)]), bt.ALNUM)[0])


def _covered(spans: list[dict], body: str) -> tuple[list[list[int]], int]:
    """Spans in order of their starts joined where they meet, and the words in them."""
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    return merged, sum(_count_words(body[s:e]) for s, e in merged)


_last: dict[str, Matcher] = {}


def _matcher(shared, tag: str, window: int) -> Matcher:
    """The automaton of a broadcast shard; a worker builds it once."""
    if tag not in _last:
        _last.clear()
        _last[tag] = Matcher(shared.value, window)
    return _last[tag]


def _found(matcher: Matcher, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
    """For every text its words, hit words, spans hit in code points, and items."""
    for _, data, bounds in bt.slices(column):
        for k, (size, hit, spans, names) in enumerate(matcher.match(data, bounds)):
            if spans:
                lead = np.concatenate([[0], np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)])
                spans = [(int(lead[s]), int(lead[e])) for s, e in spans]
            yield size, hit, spans, names


def _reporting(shared, tag: str, window: int):
    """The report, from the last shard and what earlier ones have found."""

    def run(batches):
        matcher = _matcher(shared, tag, window)
        for batch in batches:
            rows = []
            for k, (size, hit, spans, names) in enumerate(_found(matcher, batch.column(1))):
                earlier = batch.column(3)[k].as_py()
                if earlier:
                    every = sorted([*earlier, *({"start": s, "end": e} for s, e in spans)], key=lambda s: (s["start"], s["end"]))
                    merged, hit = _covered(every, batch.column(1)[k].as_py())
                    spans, names = [tuple(s) for s in merged], names | set(batch.column(2)[k].as_py())
                rows.append(_row(batch.column(0)[k].as_py(), size, hit, spans, names))
            yield _batch(rows)

    return run


_SPANS = "array<struct<start:int,end:int>>"


def _dropping(shared, tag: str, window: int, at: int):
    def run(batches):
        matcher = _matcher(shared, tag, window)
        for batch in batches:
            yield batch.filter(pa.array([not hit for _, hit, _, _ in _found(matcher, batch.column(at))], pa.bool_()))

    return run


def _marking(shared, tag: str, window: int, at: int):
    """Adds this shard's items and what its windows cover, in code points, to the last two columns."""

    def run(batches):
        matcher = _matcher(shared, tag, window)
        for batch in batches:
            items, spans = (c.to_pylist() for c in batch.columns[-2:])
            for k, (_, _, more, names) in enumerate(_found(matcher, batch.column(at))):
                if more:
                    spans[k] = [*(spans[k] or ()), *({"start": s, "end": e} for s, e in more)]
                    items[k] = sorted({*(items[k] or ()), *names})
            last = [pa.array(v, c.type) for v, c in zip((items, spans), batch.columns[-2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *last], schema=batch.schema)

    return run


def _cutting(at: int, max_coverage: float):
    def run(batches):
        for batch in batches:
            texts, keep_ = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for k, spans in enumerate(batch.columns[-1].to_pylist()):
                if not spans:
                    continue
                merged, hit = _covered(sorted(spans, key=lambda s: (s["start"], s["end"])), texts[k])
                keep_[k] = hit / _count_words(texts[k]) <= max_coverage
                edges = [0, *[e for span in merged for e in span], len(texts[k])]
                texts[k] = "".join(texts[k][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : -2]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2]).filter(pa.array(keep_, pa.bool_()))

    return run


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    max_coverage: float = 0.0,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = 200_000,
) -> DataFrame:
    """Documents without what :func:`benchmark_hits` finds, all columns kept.

    A document of which windows cover more than ``max_coverage`` of its words is
    dropped; from the others the covered text is cut out. With the default 0
    every contaminated document goes. Rows are judged one by one by their texts;
    ids, null or repeated, play no part, and any names of columns may occur. Null
    and empty texts stay; no items leave all documents; no rows give no rows.
    """
    at, schema, context = docs.columns.index(text), docs.schema, docs.sparkSession.sparkContext
    whole, before = max_coverage <= 0, None
    if not whole:
        docs = docs.select("*", F.lit(None).cast("array<string>").alias(fresh("items", docs.columns)), F.lit(None).cast(_SPANS).alias(fresh("spans", docs.columns)))
    work = _dropping if whole else _marking
    for shard, last in _shards(items, item_id, item_text, shard_words):
        docs = docs.mapInArrow(work(context.broadcast(shard), uuid.uuid4().hex, window, at), docs.schema)
        if not last:
            docs = keep(docs, "decontaminate")
            before = _replace(before, docs)
    return docs if whole else docs.mapInArrow(_cutting(at, max_coverage), schema)
