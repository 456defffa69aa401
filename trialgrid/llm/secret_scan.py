"""Secret scans: rules first, then a character convolutional network.

The rules find assignments, access keys and hexadecimal keys. Every other token
of eight characters or more that is not made of plain words is a candidate. A
small network reads all of it, in windows, with the characters around. It is
trained on all of the rules' findings and other candidates and, so that it knows more
than the rules, on planted keys and harmless tokens of many formats set into the
same surroundings. Parts of these are learnt from side by side, each from the
weights that all parts together had reached before. Its scores are calibrated on
tokens it has not seen, and the threshold is that of best precision among those
that keep the recall asked for.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import keep

KINDS = ("assign", "access", "hex", "cnn")
_KEYWORD = b"(?:" + b"|".join(
    b"".join(b"[%c%c]" % (c, c - 32) if 97 <= c <= 122 else bytes([c]) for c in word) for word in (b"password", b"passwd", b"secret", b"token")
) + b"|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = re.compile(_KEYWORD + rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_SIGNS = rb"[A-Za-z0-9+/_.=-]"
#: Tokens with a digit, a plus sign or a capital after a small letter; all else is words.
_CANDIDATE = re.compile(rb"(?<!" + _SIGNS + rb")(?=[A-Za-z/_.=-]*?(?:[0-9+]|[a-z][A-Z]))" + _SIGNS + rb"{8,}")

#: Characters the network sees at a time: a window of the candidate, and what stands around it.
WINDOW, STEP, AROUND = 56, 48, 20
VIEW = AROUND + WINDOW + AROUND
#: What a token is: unknown, found by a rule, or left of one that a rule has found in part.
OTHER, FOUND, REST = range(3)
_CLASSES = np.zeros(256, np.uint8)
for _k, _c in enumerate(b"0123456789abcdefghijklmnopqrstuvwxyz+/_.=-\"':,;@() \n", 2):
    _CLASSES[_c] = _k
_CLASSES[65:91] = 54
_CLASSES[128:] = 55
_UNSEEN = (_CLASSES == 0) & (np.arange(256) > 0)
_CLASSES[_UNSEEN] = 1
CLASSES = 56


def base_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of what the rules find."""
    found = []
    if b"=" in body or b":" in body:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(body) if len(m[1]) >= 6]
    if b"AKIA" in body:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(body) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(body)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(body: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, OTHER, FOUND or REST) of tokens; what a rule has found is cut out of a token, and the rest is one more."""
    out = []
    for m in _CANDIDATE.finditer(body):
        start, end = m.span()
        over = [(s, e) for s, e, _ in base if s < end and start < e]
        if not over:
            out.append((start, end, OTHER))
            continue
        out.append((start, end, FOUND))
        at = start
        for s, e in [*over, (end, end)]:
            out += [(at + r.start(), at + r.end(), REST) for r in _CANDIDATE.finditer(body[at : max(at, s)])]
            at = max(at, e)
    return out


def picture(before: bytes, token: bytes, after: bytes) -> bytes:
    """One view of fixed size; 0 where there is nothing."""
    return before[-AROUND:].rjust(AROUND, b"\0") + token[:WINDOW].ljust(WINDOW, b"\0") + after[:AROUND].ljust(AROUND, b"\0")


def views(body: bytes, start: int, end: int) -> list[bytes]:
    """Pictures that together show all of a token; neighbours overlap by more than the filters' width."""
    at = [*range(start, max(start + 1, end - WINDOW), STEP), end - WINDOW] if end - start > WINDOW else [start]
    return [picture(body[max(0, k - AROUND) : k], body[k : min(end, k + WINDOW)], body[min(end, k + WINDOW) : min(end, k + WINDOW) + AROUND]) for k in at]


_HEXES, _LETTERS = b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz"
_BASE62 = _LETTERS + _LETTERS.upper() + b"0123456789"


def planted(rng: np.random.Generator) -> tuple[bytes, bool]:
    """A made-up token, and whether it is a key; both come in several formats."""

    def draw(signs: bytes, least: int, most: int) -> bytes:
        return bytes(rng.choice(np.frombuffer(signs, np.uint8), int(rng.integers(least, most + 1))).tobytes())

    def word() -> bytes:
        return b"".join(draw(b"bcdfghlmnprstvw", 1, 2) + draw(b"aeiou", 1, 1) for _ in range(int(rng.integers(1, 4))))

    digits = lambda a, b: draw(b"0123456789", a, b)
    keys = (
        lambda: b"-".join(draw(_HEXES, 8, 8) for _ in range(int(rng.integers(3, 7)))),
        lambda: draw(_BASE62, 24, 48),
        lambda: draw(_BASE62 + b"+/", 32, 64) + b"=" * int(rng.integers(0, 3)),
        lambda: draw(_LETTERS, 2, 4) + draw(b"_-", 1, 1) + draw(_BASE62, 20, 40),
        lambda: draw(_HEXES.upper(), 32, 40),
        lambda: b".".join(draw(_BASE62 + b"_-", 20, 60) for _ in range(3)),
    )
    harmless = (
        lambda: digits(8, 20),
        lambda: b"-".join(digits(2, 4) for _ in range(int(rng.integers(3, 5)))),
        lambda: b".".join(digits(1, 3) for _ in range(4)),
        lambda: b".".join(digits(1, 3) for _ in range(4)) + b":" + digits(2, 5),
        lambda: digits(4, 4) + b"".join(sign + digits(4, 4) for sign in [draw(b"-.", 1, 1)] for _ in range(int(rng.integers(1, 4)))),
        lambda: b"+" + digits(1, 2) + b"-" + digits(2, 3) + b"-" + digits(6, 8),
        lambda: digits(1, 1) + b"-" + digits(3, 5) + b"-" + digits(3, 5) + b"-" + draw(b"0123456789X", 1, 1),
        lambda: digits(4, 4) + b"-" + digits(2, 2) + b"-" + digits(2, 2) + b"T" + digits(2, 2),
        lambda: word() + digits(1, 2) + b"." + word() + b".example." + draw(b"comnetrg", 2, 3),
        lambda: b"/".join([word() for _ in range(int(rng.integers(2, 6)))] + [word() + digits(1, 3) + b".html"]),
        lambda: word() + b"".join(word().capitalize() for _ in range(int(rng.integers(1, 4)))),
        lambda: b"_".join([word() for _ in range(int(rng.integers(2, 5)))] + [digits(1, 4)]),
        lambda: word() + b"-" + digits(1, 2) + b"." + digits(1, 2) + b"." + digits(1, 3) + b"-" + word(),
        lambda: word() + b"." + digits(2, 6),
    )
    kind = bool(rng.integers(0, 2))
    formats = keys if kind else harmless
    return formats[int(rng.integers(0, len(formats)))](), kind


class CharCNN:
    """Embedding, one convolution of width 5, max and mean pooling over places, one linear output."""

    WIDTH, EMBED, FILTERS = 5, 8, 16

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = (rng.normal(size=(CLASSES, self.EMBED)) * 0.3).astype(np.float32)
        self.w = (rng.normal(size=(self.WIDTH * self.EMBED, self.FILTERS)) * 0.2).astype(np.float32)
        self.b = np.zeros(self.FILTERS, np.float32)
        self.v = (rng.normal(size=2 * self.FILTERS) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.1
        self.moments, self.steps = [np.zeros_like(p) for p in 2 * self.params()], 0

    def params(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.v, self.c]

    def state(self) -> np.ndarray:
        """Weights, their moments and the number of steps as one row of numbers."""
        return np.concatenate([x.ravel() for x in (*self.params(), *self.moments)] + [[self.steps]]).astype(np.float64)

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for x in (*self.params(), *self.moments):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size
        self.steps = round(float(state[at]))

    def _forward(self, codes: np.ndarray):
        embedded = self.e[codes]
        windows = np.lib.stride_tricks.sliding_window_view(embedded, self.WIDTH, axis=1).transpose(0, 1, 3, 2)
        windows = windows.reshape(len(codes), -1, self.WIDTH * self.EMBED)
        hidden = np.maximum(windows @ self.w + self.b, 0)
        pooled = np.concatenate([hidden.max(1), hidden.mean(1)], 1)
        return windows, hidden, pooled, pooled @ self.v + self.c

    def logits(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, np.float32)
        return np.concatenate([self._forward(codes[k : k + 512])[3] for k in range(0, len(codes), 512)])

    def learn(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float = 0.01) -> None:
        """One pass of Adam over these rows on the weighted logistic loss."""
        params, half = self.params(), len(self.moments) // 2
        first, second = self.moments[:half], self.moments[half:]
        order = rng.permutation(len(codes))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x = codes[rows]
            windows, hidden, pooled, logit = self._forward(x)
            delta = ((1 / (1 + np.exp(-logit)) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dpool = delta[:, None] * self.v
            dhidden = np.repeat(dpool[:, None, self.FILTERS :] / hidden.shape[1], hidden.shape[1], 1)
            top = hidden.argmax(1)
            np.add.at(dhidden, (np.arange(len(rows))[:, None], top, np.arange(self.FILTERS)[None, :]), dpool[:, : self.FILTERS])
            dhidden *= hidden > 0
            flat = dhidden.reshape(-1, self.FILTERS)
            dwindows = (flat @ self.w.T).reshape(*windows.shape[:2], self.WIDTH, self.EMBED)
            de = np.zeros_like(self.e)
            for j in range(self.WIDTH):
                np.add.at(de, x[:, j : j + windows.shape[1]].ravel(), dwindows[:, :, j].reshape(-1, self.EMBED))
            grads = [de, windows.reshape(-1, windows.shape[2]).T @ flat, flat.sum(0), pooled.T @ delta, delta.sum(keepdims=True)]
            self.steps += 1
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)

    def calibrate(self, logit: np.ndarray, labels: np.ndarray, times: np.ndarray, recall: float) -> None:
        """Platt scaling, then the threshold of best precision that keeps ``recall`` of the findings; row k stands for ``times[k]`` equal ones."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -60, 60)))
            d, q = times * (p - labels), times * p * (1 - p)
            g = np.array([(d * logit).sum() + 1e-3 * (a - 1), d.sum() + 1e-3 * b])
            h = np.array([[(q * logit * logit).sum() + 1e-3, (q * logit).sum()], [(q * logit).sum(), q.sum() + 1e-3]])
            change = np.linalg.solve(h, g)
            a, b = a - np.clip(change[0], -1, 1), b - np.clip(change[1], -5, 5)
        self.slope, self.shift = float(a), float(b)
        order = np.argsort(logit)
        kept = order[labels[order] > 0]
        if not len(kept):
            return
        so_far = np.cumsum(times[kept])
        limit = logit[kept[np.searchsorted(so_far, np.floor((1 - recall) * so_far[-1]), "right")]]  # any lower threshold keeps the recall as well
        below = logit[(labels == 0) & (logit < limit)]
        # no candidate lies between: the middle costs no precision; probabilities under a half are never findings
        middle = (limit + below.max()) / 2 if len(below) else limit
        score = lambda x: float(1 / (1 + np.exp(-np.clip(a * x + b, -60, 60))))
        self.threshold = min(score(limit), max(0.5, score(middle)))

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes).astype(np.float64) + self.shift, -60, 60)))


_FOUND = "doc_id long, base array<struct<start:int,end:int,kind:int>>, candidates array<struct<start:int,end:int,kind:int,views:array<binary>>>"
_FOUND_ARROW = [
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("views", pa.list_(pa.binary()))])),
]


def _finding(batches):
    for batch in batches:
        ids, out = batch.column(0), []
        for row, data, bounds in bt.slices(batch.column(1)):
            for k in range(len(bounds) - 1):
                body = data[bounds[k] : bounds[k + 1]].tobytes()
                base = base_spans(body)
                tokens = candidates(body, base)
                if base or tokens:
                    lead = None if body.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
                    point = int if lead is None else lead.__getitem__
                    listed = [{"start": int(point(s)), "end": int(point(e)), "kind": kind, "views": views(body, s, e)} for s, e, kind in tokens]
                    base = [{"start": int(point(s)), "end": int(point(e)), "kind": kind} for s, e, kind in base]
                else:
                    listed = []
                out.append((ids[row + k].as_py(), base, listed))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_ARROW, strict=True)], names=["doc_id", "base", "candidates"])


def _codes(views: list[bytes]) -> np.ndarray:
    return _CLASSES[np.frombuffer(b"".join(views), np.uint8).reshape(-1, VIEW)] if views else np.zeros((0, VIEW), np.uint8)


def _bare(codes: np.ndarray) -> np.ndarray:
    """The same candidates with nothing around them."""
    out = codes.copy()
    out[:, :AROUND] = out[:, -AROUND:] = 0
    return out


#: Tokens planted among those that teach, and among those that calibrate, at least.
PLANTED = 2000
#: Rows that a part learns from in a round, passes over all rows, and steps of a logit that are told apart.
PART, MOST_PARTS, ROUNDS, STEPS = 8192, 512, 6, 1024


def _signs(rng: np.random.Generator) -> bytes:
    """What may stand at a token's side: nothing, a mark, or some of one mark and a blank."""
    mark = b"#$%&*!?.,:;|()\""[int(rng.integers(0, 15)) :][:1]
    return (b"", mark, mark * int(rng.integers(2, 5)) + b" ")[int(rng.integers(0, 3))]


def _set_in(pictures: list[bytes], seed: int | list[int], each: int | None = None) -> tuple[list[bytes], list[float]]:
    """Planted tokens in the surroundings of these views, ``each`` or else two for each and ``PLANTED`` at least."""
    rng = np.random.default_rng(seed)
    made, labels = [], []
    for view in pictures:
        for _ in range(each or max(2, -(-PLANTED // len(pictures)))):
            token, kind = planted(rng)
            before, after = view[:AROUND], view[-AROUND:]
            # loud and punctuated surroundings hold keys no more often than others
            if rng.integers(0, 3) == 0:
                before, after = before.upper(), after.upper()
            before, after = (before + _signs(rng))[-AROUND:], (_signs(rng)[::-1] + after)[:AROUND]
            own = views(before + token + after, AROUND, AROUND + len(token))
            made += own
            labels += [float(kind)] * len(own)
    return made, labels


_EXAMPLES = "view binary, label boolean, held boolean"


def _planting(each: dict[bool, int]):
    """Views, and for each as many planted tokens as its side is given, by a seed of its own bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for view, label, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out.append((view, label, held))
                made, kinds = _set_in([view], [7 + held, *np.frombuffer(hashlib.sha256(view).digest(), np.uint32).tolist()], each[held])
                out += [(v, kind > 0, held) for v, kind in zip(made, kinds, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.bool_(), pa.bool_()), strict=True)], names=["view", "label", "held"])

    return run


def _shown(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Views with and without what surrounds them, and their labels."""
    codes = _codes(batch.column("view").to_pylist())
    return np.concatenate([codes, _bare(codes)]), np.tile(batch.column("label").to_numpy(zero_copy_only=False).astype(float), 2)


def _learning(state: np.ndarray, share: float, turn: int):
    """A part's weights after it has learnt from its rows, from ``state`` on; both kinds weigh the same where ``share`` of all rows are findings."""

    def run(batches):
        model, n, first = CharCNN(), 0, None
        model.restore(state)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = first or hashlib.sha256(batch.column("view")[0].as_py()).digest()
            codes, labels = _shown(batch)
            weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
            model.learn(codes, labels, weight, np.random.default_rng([6, turn, n]))
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n]), pa.array([model.state().tobytes()])], names=["first", "n", "state"])

    return run


def _marking(state: np.ndarray):
    """Logits in steps, rounded down, with their labels."""

    def run(batches):
        model = CharCNN()
        model.restore(state)
        for batch in batches:
            codes, labels = _shown(batch)
            at = np.floor(np.clip(model.logits(codes).astype(np.float64), -64, 64) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(labels > 0)], names=["at", "label"])

    return run


def train(found: DataFrame, recall: float = 0.98) -> CharCNN | None:
    """A network fitted on all labelled views, and on planted tokens around each of them.

    A quarter of the tokens, by hash, calibrates, with planted tokens of its own.
    Every view is shown with and without what surrounds it, as the rules' own
    keywords would otherwise be all there is to learn. Rows are dealt into parts by
    hash; in a round each part takes its rows in turn, in tasks, from the same
    weights on, and the parts' weights are averaged. The driver holds as many
    networks as there are parts, ``MOST_PARTS`` at most, and counts of logits in steps of
    1 / ``STEPS``. Without tokens of both kinds, found or planted, on both sides
    there is no network.
    """
    each = found.select(F.explode("candidates").alias("c")).where(F.col("c.kind") != REST)
    token = F.xxhash64(F.element_at("c.views", 1))
    each = each.select(F.explode("c.views").alias("view"), (F.col("c.kind") == FOUND).alias("label"), token.alias("token")).groupBy("view", "label").agg(F.min("token").alias("token"))
    told = keep(each.select("view", "label", (F.col("token") % 4 == 0).alias("held")), "secret-views")
    sides = {r.held: r.n for r in told.groupBy("held").agg(F.count("*").alias("n")).collect()}
    planted_for = {held: max(2, -(-PLANTED // n)) for held, n in sides.items()}
    rows = keep(told.mapInArrow(_planting(planted_for), _EXAMPLES), "secret-examples")
    counts = {(r.held, r.label): r.n for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        return None
    n = counts[False, True] + counts[False, False]
    parts = min(MOST_PARTS, -(-n // PART))
    model = CharCNN()
    state = model.state()
    for turn in range(ROUNDS):
        order = F.xxhash64("view", F.lit(turn))
        dealt = rows.where("not held").withColumn("h", order).repartition(parts, "h").sortWithinPartitions("h", "view", "label")
        learnt = dealt.mapInArrow(_learning(state, counts[False, True] / n, turn), "first binary, n long, state binary").collect()
        learnt.sort(key=lambda r: bytes(r.first))
        state = np.average([np.frombuffer(r.state) for r in learnt], axis=0, weights=[r.n for r in learnt])
    model.restore(state)
    seen = rows.where("held").mapInArrow(_marking(state), "at long, label boolean").groupBy("at", "label").agg(F.count("*").alias("n")).orderBy("at", "label").collect()
    model.calibrate(np.array([r["at"] for r in seen]) / STEPS, np.array([float(r.label) for r in seen]), np.array([float(r.n) for r in seen]), recall)
    return model


def _found_by(model: CharCNN, listed: list[list[bytes]]) -> np.ndarray:
    """Whether some view of each token reaches the threshold."""
    if not listed:
        return np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum([len(v) for v in listed])[:-1]])
    return np.maximum.reduceat(model.probabilities(_codes([v for some in listed for v in some])), at) >= model.threshold


_SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, places array<struct<start:int,end:int>>"


def _listing(model: CharCNN | None):
    def listed(spans) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            asked = [[c for c in r["candidates"] if c["kind"] != FOUND] if model else [] for r in rows]
            score = iter(_found_by(model, [c["views"] for some in asked for c in some]) if model else ())
            out = []
            for r, some in zip(rows, asked, strict=True):
                base = sorted((s["start"], s["kind"], s["end"]) for s in r["base"])
                more = [(c["start"], 3, c["end"]) for c in some if next(score)]
                kinds = [k for _, k, _ in base]
                every = sorted(base + more)
                places = [{"start": s, "end": e} for s, _, e in every]
                out.append((r["doc_id"], kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(more), places))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            names = [p.split()[0] for p in _SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return keep(plain.mapInArrow(_finding, _FOUND), "secret-candidates")


def scan_secrets(
    docs: DataFrame, recall: float = 0.98, learn_from: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Secrets in every text.

    The network learns from ``learn_from``, or else from ``docs``: what the rules
    find there are findings, all other candidates are not, and planted tokens are
    set in among both; all of them are learnt from. Candidates are read whole, whatever their length. Returns (doc_id,
    n_assign, n_access, n_hex, base_sha256, spans, n_cnn, places), one row per
    input row; spans are ``kind:start:end`` in code points, end exclusive, by
    start and then kind. ``base_sha256`` is the digest of the rules' spans alone.

    Null and empty texts have none; overlapping spans of different kinds are all
    listed; if there are too few labelled candidates the rules stand alone;
    repeated candidates train once; rows that repeat an id are scanned one by
    one; no rows give no rows; other columns play no part.
    """
    found = _found(docs, doc_id, text)
    known = found if learn_from is None else _found(learn_from, doc_id, text)
    return found.mapInArrow(_listing(train(known, recall)), _SPANS)


def _redacting(model: CharCNN | None, mark: bytes, text: str, n_chars: str | None):
    def cleaned(bodies: list[bytes]) -> list[str | None]:
        """New texts, or None where nothing is to be replaced."""
        base = [base_spans(b) for b in bodies]
        tokens = [[(s, e) for s, e, kind in candidates(b, own) if kind != FOUND] if model else [] for b, own in zip(bodies, base, strict=True)]
        score = iter(_found_by(model, [views(body, *token) for body, listed in zip(bodies, tokens, strict=True) for token in listed]) if model else ())
        out: list[str | None] = []
        for body, spans, listed in zip(bodies, base, tokens, strict=True):
            places = sorted([(s, e) for s, e, _ in spans] + [token for token in listed if next(score)])
            pieces, at = [], 0
            for start, end in places:
                if start >= at:
                    pieces += [body[at:start], mark]
                at = max(at, end)
            out.append((b"".join(pieces) + body[at:]).decode() if places else None)
        return out

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            new: list[str | None] = []
            for _, data, bounds in bt.slices(column):
                new += cleaned([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            changed = pa.array([t is not None for t in new], pa.bool_())
            arrays = list(batch.columns)
            for k, name in enumerate(batch.schema.names):
                if name == text:
                    arrays[k] = pc.if_else(changed, pa.array(new, column.type), column)
                elif name == n_chars:
                    counts = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(arrays[k].type)
                    arrays[k] = pc.if_else(changed, counts, arrays[k])
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def redact(docs: DataFrame, mark: str = "[SECRET]", *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with every span of :func:`scan_secrets` replaced by ``mark``; all columns kept.

    The network is trained first; then each text is scanned and rewritten where
    it lies, so rows are neither shuffled nor joined, and null or repeated ids
    make no difference. Overlapping spans are replaced once. ``n_chars``, where
    there is one, follows the text. Null and empty texts stay as they are.
    """
    model = train(_found(docs, doc_id, text))
    n_chars = "n_chars" if "n_chars" in docs.columns else None
    return docs.mapInArrow(_redacting(model, mark.encode(), text, n_chars), docs.schema)
