"""How many tables a dish has in a Chinese restaurant, drawn from its exact conditional law.

Given everything else, ``c`` customers of one dish take ``t`` tables with a
probability in proportion to ``S(c, t) * w(0) * ... * w(t - 1)``: ``S`` counts the
seatings by the generalised Stirling numbers of the discount, and ``w(k)`` is the
weight of a new table when there are ``k``. To draw from it is to take all
customers of the dish away and seat them anew: one Gibbs step for the block.

``S`` comes from its recursion for up to 512 customers. Beyond, it is the integral
of its generating function ``(1 - (1 - x)**d)**t`` over a contour through the
saddle point, worked out on a lattice once for a discount and interpolated there.
The law is the same for all sizes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Up to so many customers the numbers S come from a table.
SMALL = 512
#: Table numbers looked at for a dish with many customers.
GRID = 64
_ROWS = 1 << 12
#: Numbers worked on at a time.
_CELLS = 1 << 20


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series four steps up."""
    x = np.asarray(x, float)
    up, steps = x + 4, np.log(x * (x + 1) * (x + 2) * (x + 3))
    square = up * up
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / up
    return (up - 0.5) * np.log(up) - up + 0.9189385332046727 + series - steps


@lru_cache(maxsize=8)
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to ``SMALL``; minus infinity where t is greater than c."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(SMALL + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(SMALL):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


def _contour(c: np.ndarray, t: np.ndarray, d: float, nodes: int = 96) -> np.ndarray:
    """log S(c, t) by the coefficient of ``x**c`` in the generating function, with ``x = exp(-u)``.

    ``u`` runs over a parabola about the cut on the negative axis, through the
    saddle point or, where that lies too near to 0, through 3 / c; there the
    function less 1, which adds nothing to the integral, keeps the digits.
    """
    low, high = np.full(c.shape, -200.0), np.full(c.shape, 6.0)
    with np.errstate(all="ignore"):
        for _ in range(80):
            mid = (low + high) / 2
            u = np.exp(mid)
            v = -np.expm1(-u)
            before = c < t * d * v ** (d - 1) * np.exp(-u) / -np.expm1(d * np.log(v))
            low, high = np.where(before, mid, low), np.where(before, high, mid)
        mu = np.maximum(np.exp((low + high) / 2), 3 / c)
        v = -np.expm1(-mu)
        height = t * np.log(-np.expm1(d * np.log(v)))
        less = t * v**d < 1
        most = np.minimum(np.sqrt(45 / (c * mu * min(1, 2 * (1 - d)))), np.pi / (2 * mu))
        z = 1 + 1j * ((np.arange(nodes) + 0.5) * (most / nodes)[:, None])
        u = mu[:, None] * z * z
        log_f = t[:, None] * np.log1p(-((-np.expm1(-u)) ** d))
        e = np.exp(c[:, None] * (u - mu[:, None]))
        f = np.where(less[:, None], np.expm1(log_f) * e, np.exp(log_f - height[:, None]) * e)
        area = 2 * mu / np.pi * most / nodes * (f * z).real.sum(1)
        out = np.log(np.abs(area)) + c * mu + np.where(less, 0, height)
    return out + lgamma(c + 1) - lgamma(t + 1) - t * np.log(d)


def _main_part(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """What log S(c, t) comes to for few tables and many customers."""
    return lgamma(c - d) - lgamma(np.asarray(1 - d)) - lgamma(t) - (t - 1) * np.log(d)


#: The lattice: customers from 32 in steps of half an octave, and log t / log c from 0 to 1.
_FROM, _PER_OCTAVE, _ACROSS = 5, 2, 160


@lru_cache(maxsize=8)
def lattice(discount: float) -> np.ndarray:
    """log S less its main part, by (customers, tables)."""
    c = 2.0 ** (_FROM + np.arange(44 * _PER_OCTAVE) / _PER_OCTAVE)
    share = np.arange(_ACROSS + 1) / _ACROSS
    rows = []
    for one in c:
        t = np.minimum(one**share, one * (1 - 1e-9))
        every = np.full(len(t), one)
        rows.append(_contour(every, t, discount) - _main_part(every, t, discount))
    return np.array(rows)


def _cubic(x: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first of four lattice places about ``x``, and their Lagrange weights."""
    at = np.clip(np.floor(x).astype(np.int64) - 1, 0, size - 4)
    u = x - at
    return at, [-(u - 1) * (u - 2) * (u - 3) / 6, u * (u - 2) * (u - 3) / 2, -u * (u - 1) * (u - 3) / 2, u * (u - 1) * (u - 2) / 6]


def prime(lattices: dict[float, np.ndarray]) -> None:
    """Hand lattices worked out elsewhere to this process."""
    _known.update(lattices)


_known: dict[float, np.ndarray] = {}


class LogStirling:
    """log S(c, t) for rows of ``c`` above ``SMALL`` customers."""

    def __init__(self, c: np.ndarray, discount: float):
        self.c, self.d = np.asarray(c, float)[:, None], discount
        every = _known.get(discount)
        every = lattice(discount) if every is None else every
        at, weights = _cubic((np.log2(self.c[:, 0]) - _FROM) * _PER_OCTAVE, len(every))
        self.rest = sum(w[:, None] * every[at + i] for i, w in enumerate(weights))
        self.nodes = np.clip(self.c ** (np.arange(0, _ACROSS + 1, 4) / _ACROSS), 1, self.c)

    def at_nodes(self) -> np.ndarray:
        return self.rest[:, ::4] + _main_part(self.c, self.nodes, self.d)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        """At t (rows, places) from 1 to c."""
        at, weights = _cubic(np.log(t) / np.log(self.c) * _ACROSS, _ACROSS + 1)
        rest = sum(w * np.take_along_axis(self.rest, at + j, 1) for j, w in enumerate(weights))
        return rest + _main_part(self.c, t, self.d)


def _pick(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One place of each row, by the exponentials of its values."""
    p = np.exp(logs - logs.max(1, keepdims=True))
    p = np.cumsum(p, 1)
    return (p < (rng.random(len(p)) * p[:, -1])[:, None]).sum(1)


class Weights:
    """Weights of new tables: ``(first + k * step) * (top + k) / (bottom + k)`` when there are k; the fraction for k = 0 is ``start``."""

    def __init__(self, first, step, top, bottom, start):
        self.first, self.top, self.bottom, self.start = (np.asarray(x, float) for x in (first, top, bottom, start))
        self.step = step

    @classmethod
    def constant(cls, first, step, share, n: int) -> Weights:
        """A dish's share of new tables that stays as it is."""
        huge = 1e18
        return cls(np.broadcast_to(first, n), step, np.full(n, share * huge), np.full(n, huge), np.full(n, share))

    def at(self, rows: np.ndarray) -> Weights:
        return Weights(self.first[rows], self.step, self.top[rows], self.bottom[rows], self.start[rows])

    def up_to(self, most: int) -> np.ndarray:
        """log w(0) + ... + log w(t - 1) for t from 1 to ``most``."""
        k = np.arange(most)
        out = np.log(np.maximum((self.first[:, None] + k * self.step) * (self.top[:, None] + k), 1e-300) / (self.bottom[:, None] + k))
        out[:, 0] = np.log(self.first) + np.log(self.start)
        return np.cumsum(out, 1)

    def total(self, t: np.ndarray) -> np.ndarray:
        """The same for numbers of tables ``t`` (rows, places) of any size."""

        def rise(a: np.ndarray, n: np.ndarray) -> np.ndarray:  # log a (a + 1) ... (a + n - 1)
            a = a[:, None]
            near = np.minimum(a, 1e9)
            return np.where(a > 1e9, n * np.log(a) + n * (n - 1) / (2 * a), lgamma(near + n) - lgamma(near))

        shares = rise(self.top + 1, t - 1) - rise(self.bottom + 1, t - 1) + np.log(self.start)[:, None]
        return t * np.log(self.step) + rise(self.first / self.step, t) + shares


def _draw_many(c: np.ndarray, w: Weights, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers: the law on ever finer grids about its mode."""
    stirling, top, rows = LogStirling(c, discount), c.astype(float)[:, None], np.arange(len(c))
    logs, places, width = stirling.at_nodes() + w.total(stirling.nodes), stirling.nodes, None
    for _ in range(3):
        # from the place before the first that counts to the one after the last
        counts = logs > logs.max(1, keepdims=True) - 40
        first = np.maximum(counts.argmax(1) - 1, 0)
        last = np.minimum(places.shape[1] - counts[:, ::-1].argmax(1), places.shape[1] - 1)
        start = np.floor(places[rows, first])
        end = np.minimum(np.ceil(places[rows, last]) + (0 if width is None else width - 1), c)
        width = np.maximum(1.0, np.ceil((end - start + 1) / GRID))
        places = start[:, None] + np.arange(GRID) * width[:, None]
        middle = np.minimum(places + (width[:, None] - 1) / 2, top)
        logs = np.where(places <= top, stirling(middle) + w.total(middle), -np.inf)
        if (width == 1).all():
            break
    got = places[rows, _pick(logs, rng)] + np.floor(rng.random(len(c)) * width)
    return np.clip(got, 1, c).astype(np.int64)


def draw_tables(counts: np.ndarray, weights: Weights, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish, by its exact conditional law."""
    counts = np.asarray(counts, np.int64)
    out = np.minimum(counts, 1)
    stirling = log_stirling(discount)
    low = 1
    for most in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, SMALL):
        rows = np.flatnonzero((counts > low) & (counts <= most))
        step = _CELLS // most
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            logs = stirling[counts[some], 1 : most + 1] + weights.at(some).up_to(most)
            out[some] = 1 + _pick(logs, rng)
        low = most
    rows = np.flatnonzero(counts > SMALL)
    for at in range(0, len(rows), _ROWS):
        some = rows[at : at + _ROWS]
        out[some] = _draw_many(counts[some], weights.at(some), discount, rng)
    return out
