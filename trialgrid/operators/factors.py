"""Principal axes of many wide rows, by block Krylov iteration: passes over the rows that send sums of products alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows this wide or narrower are settled in one pass: their start block is the whole space.
WHOLE = 512
#: Vectors of a start block beyond that width, and numbers that one pass brings to the driver, at most.
BLOCK, NUMBERS = 32, 1 << 24
PASSES, PRECISION = 60, 1e-10


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Groups of a batch (__g, __w, ...) with their row numbers and their rows as a matrix; null rows are left out."""
    good = np.flatnonzero(batch.column("__w").is_valid().to_numpy(zero_copy_only=False))
    rows = batch.take(pa.array(good))
    names = np.array(rows.column("__g").to_pylist() + [None], object)[:-1]
    values = rows.column("__w")
    matrix = np.asarray(values.flatten().to_numpy(zero_copy_only=False), float).reshape(len(good), -1) if len(good) else np.zeros((0, 0))
    for g in dict.fromkeys(names):
        at = np.array([n == g for n in names])
        yield g, good[at], matrix[at]


def _products(blocks):
    """Sums over a task's rows x of ``x (x Q)``, of x, and their number, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for g, _, x in _by_group(batch):
                if g in blocks.value:
                    q = blocks.value[g]
                    if g not in held:
                        held[g] = np.zeros((q.shape[0] + 1, q.shape[1] + 1))
                    held[g][:-1, :-1] += x.T @ (x @ q)
                    held[g][:-1, -1] += x.sum(0)
                    held[g][-1, -1] += len(x)
        for g, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(total), pa.string()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["g", "i", "v"])

    return run


class _Group:
    """What is known of one group: an orthonormal basis, and what the matrix of products makes of it."""

    def __init__(self, width: int, k: int, centred: bool):
        self.k, self.centred = min(k, width), centred
        own = width if width <= WHOLE else max(BLOCK, 2 * k)
        start = np.eye(width) if own == width else np.linalg.qr(np.random.default_rng(0).normal(size=(width, own)))[0]
        self.block, self.basis, self.image = start, np.zeros((width, 0)), np.zeros((width, 0))
        self.values = self.vectors = self.mean = None

    def told(self, total: np.ndarray) -> None:
        n, sums = total[-1, -1], total[:-1, -1]
        self.mean = sums / n
        image = total[:-1, :-1] - (np.outer(sums, self.mean @ self.block) if self.centred else 0)
        self.basis, self.image = np.hstack([self.basis, self.block]), np.hstack([self.image, image])
        small = self.basis.T @ self.image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[: self.k]
        self.values, self.vectors = np.maximum(values[best], 0), self.basis @ turns[:, best]
        apart = np.linalg.norm(self.image @ turns[:, best] - self.vectors * self.values, axis=0).max()
        rest = image - self.basis @ (self.basis.T @ image)
        new, sizes, _ = np.linalg.svd(rest, full_matrices=False)
        new = new[:, sizes > 1e-11 * max(np.abs(self.values).max(initial=0), 1e-300)]
        for _ in range(2):  # what is small against the image is not at right angles to the basis yet
            new = np.linalg.qr(new - self.basis @ (self.basis.T @ new))[0]
        done = apart <= PRECISION * self.values.max(initial=0) or not new.size or self.basis.shape[1] >= len(self.basis)
        self.block = None if done else new

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows to multiply a waveform by, and what to take off."""
        if self.centred:
            return self.vectors, self.mean @ self.vectors
        scale = np.sqrt(self.values)
        return np.divide(self.vectors, scale, out=np.zeros_like(self.vectors), where=scale > 0), np.zeros(self.k)


def principal_axes(rows: DataFrame, groups: Sequence[str | None], width: int, k: int, centred: bool) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Axes and offsets of groups of ``rows`` (__g, __w), as many as fit a pass at once.

    The matrix of products is never made: a pass multiplies a block of vectors by
    it, and the basis that the blocks span grows until the first ``k`` axes in it
    solve the problem to ``PRECISION``. The driver holds the basis alone.
    """
    found: dict = {}
    each = max(1, NUMBERS // (width * (width if width <= WHOLE else max(BLOCK, 2 * k))))
    for start in range(0, len(groups), each):
        open_ = {g: _Group(width, k, centred) for g in groups[start : start + each]}
        found |= open_
        for _ in range(PASSES):
            shared = rows.sparkSession.sparkContext.broadcast({g: s.block for g, s in open_.items()})
            size = max(s.block.shape[1] for s in open_.values()) + 1
            parts = rows.mapInArrow(_products(shared), "g string, i int, v array<double>")
            sums = parts.groupBy("g", "i").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(size)]).alias("v")).collect()
            totals = {g: np.zeros((width + 1, s.block.shape[1] + 1)) for g, s in open_.items()}
            for g, i, v in sums:
                totals[g][i] = v[: totals[g].shape[1]]
            shared.unpersist()
            for g, s in open_.items():
                s.told(totals[g])
            open_ = {g: s for g, s in open_.items() if s.block is not None}
            if not open_:
                break
        else:
            raise RuntimeError("the axes did not settle")
    return {g: s.axes() for g, s in found.items()}


def project(df: DataFrame, key: str, column: str, k: int, centred: bool, by: str | None) -> DataFrame:
    """(key, features[, by]): rows projected on the axes of their group, which tasks get by broadcast; nothing is joined or shuffled."""
    group = F.col(by).cast("string") if by else F.lit("all")
    own = df.select(group.alias("__g"), F.col(key), *([F.col(by)] if by else []), F.col(column).cast("array<double>").alias("__w"))
    told = own.where("__w is not null").groupBy("__g").agg(F.max(F.size("__w")).alias("d"))
    sizes = {r["__g"]: r.d for r in told.collect()}  # a number for each group
    axes: dict = {}
    for width in set(sizes.values()):
        axes |= principal_axes(own.select("__g", "__w"), [g for g, d in sizes.items() if d == width], width, k, centred)
    shared = df.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, at, x in _by_group(batch):
                along, off = shared.value[g]
                rows = batch.take(pa.array(at))
                features = pa.array(list(x @ along - off), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column(key), features, *([rows.column(by)] if by else [])], names=[key, "features", *([by] if by else [])])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return own.mapInArrow(run, f"`{key}` {kind(key)}, features array<double>" + (f", `{by}` {kind(by)}" if by else ""))
