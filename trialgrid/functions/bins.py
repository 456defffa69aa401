"""Bin edges and bin numbers. Bin k of an edge array lies between edges k and k+1, counted from 1."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Edges = Column | Sequence[float]


def edge_array(edges: Edges) -> Column:
    return edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])


def soft_range(start: float, stop: float, step: float) -> list[float]:
    """Evenly spaced edges that hit both ends, with the step shrunk to fit."""
    n = max(1, math.ceil((stop - start) / step))
    return [start + k * (stop - start) / n for k in range(n + 1)]


def soft_range_column(start: Column, stop: Column, step: Column) -> Column:
    """:func:`soft_range` for limits that are columns."""
    n = F.greatest(F.lit(1), F.ceil((stop - start) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: start + k * (stop - start) / n)


def uniform_edges(start: float, stop: float, count: int) -> list[float]:
    """``count`` edges from start to stop."""
    return [start + k * (stop - start) / (count - 1) for k in range(count)]


def mean_step(edges: Column) -> Column:
    """Mean edge spacing of an edge array."""
    return (F.element_at(edges, -1) - F.element_at(edges, 1)) / (F.size(edges) - 1)


def bin_left_closed(x: Column, edges: Edges) -> Column:
    """Number of edges at or below x: 0 below the first edge, the edge count from the last one on."""
    return F.when(x.isNotNull(), F.size(F.filter(edge_array(edges), lambda e: e <= x)))


def bin_right_closed(x: Column, edges: Edges) -> Column:
    """Number of edges below x, as a bin is open on the left and closed on the right."""
    return F.when(x.isNotNull(), F.size(F.filter(edge_array(edges), lambda e: e < x)))


def uniform_bin(x: Column, start: float, step: float) -> Column:
    """Left-closed bin number for evenly spaced edges, without an array."""
    return (F.floor((x - F.lit(start)) / F.lit(step)) + 1).cast("int")


def in_bins(number: Column, count: Column | int) -> Column:
    """Whether a bin number is one of ``count`` bins."""
    return number.between(F.lit(1), count if isinstance(count, Column) else F.lit(count))
