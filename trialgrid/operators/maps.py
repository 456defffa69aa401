"""Occupancy, rate maps and what they say: 2-D bins, sparse and in long form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import Edges, bin_left_closed, bin_right_closed, in_bins
from .asof import asof_join
from .ordered import neighbour
from .signals import band_signal
from .trials import Stream, cut_streams


def bin_xy(df: DataFrame, xedges: Sequence[float], yedges: Sequence[float], x: str = "x", y: str = "y", *, right_closed: bool = False) -> DataFrame:
    """Rows inside the grid with bin numbers ix, iy; rows outside are dropped."""
    number = bin_right_closed if right_closed else bin_left_closed
    out = df.withColumns({"ix": number(F.col(x), xedges), "iy": number(F.col(y), yedges)})
    return out.where(in_bins(F.col("ix"), len(xedges) - 1) & in_bins(F.col("iy"), len(yedges) - 1))


def occupancy(samples: DataFrame, keys: Sequence[str], xedges: Sequence[float], yedges: Sequence[float], time: str = "t", by: Sequence[str] = (), *, bucket: float | None = None) -> DataFrame:
    """Time spent by bin (by..., ix, iy, occ): a sample holds until the next of its key; ``bucket`` deals out long keys."""
    held = neighbour(samples, keys, time, "__next", later=True, bucket=bucket)
    held = held.withColumn("__dt", F.col("__next") - F.col(time)).where("__dt is not null")
    return bin_xy(held, xedges, yedges).groupBy(*by, "ix", "iy").agg(F.sum("__dt").alias("occ"))


def event_map(events: DataFrame, xedges: Sequence[float], yedges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Events by bin (by..., ix, iy, weight)."""
    return bin_xy(events, xedges, yedges).groupBy(*by, "ix", "iy").agg(F.count("*").alias("weight"))


def rate_map(events: DataFrame, occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, occupancy and their ratio by bin; null where nothing was occupied."""
    joined = events.join(occ, [*by, "ix", "iy"], "full")
    joined = joined.withColumns({"weight": F.coalesce("weight", F.lit(0)), "occ": F.coalesce("occ", F.lit(0))})
    return joined.withColumn("rate", F.try_divide(F.col("weight"), F.col("occ")))


def spatial_information(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bits per event: sum of p (x/r) log2(x/r), with p the share of time and r the mean rate."""
    by = list(by)
    finite = rates.where("rate is not null")
    totals = finite.groupBy(*by).agg(F.sum("occ").alias("__occ"), F.sum("weight").alias("__w"))
    joined = finite.join(totals, by) if by else finite.crossJoin(F.broadcast(totals))
    p = F.col("occ") / F.col("__occ")
    ratio = F.try_divide(F.col("rate"), F.try_divide(F.col("__w"), F.col("__occ")))
    term = F.when(ratio > 0, p * ratio * F.log2(ratio))
    return joined.groupBy(*by).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("sic"))


def entropy(df: DataFrame, weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """-sum p log2 p of a weight column; zero weights are skipped."""
    held = df.where(F.col(weight) > 0)
    # log2(sum) - sum(w log2 w) / sum: one pass, and nothing to join back
    total = F.sum(weight)
    return held.groupBy(*by).agg((F.log2(total) - F.sum(F.col(weight) * F.log2(weight)) / total).alias("entropy"))


def fraction_map(df: DataFrame, xedges: Sequence[float], yedges: Sequence[float], weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows, or of a weight, by right-closed bin."""
    by = list(by)
    amount = F.sum(weight) if weight is not None else F.count("*")
    counts = bin_xy(df, xedges, yedges, right_closed=True).groupBy(*by, "ix", "iy").agg(amount.alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    joined = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))
    return joined.withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def preference_map(shares: DataFrame, occupancy_shares: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Event share over time share by bin."""
    base = occupancy_shares.select(*by, "ix", "iy", F.col("share").alias("occ_share"))
    return shares.join(base, [*by, "ix", "iy"]).withColumn("preference", F.try_divide("share", "occ_share"))


def plane_histogram(df: DataFrame, xedges: Sequence[float], yedges: Sequence[float], z0: float, dz: float) -> DataFrame:
    """Points within ``dz`` of a plane by bin; those past the last edge count in the last bin."""
    near = df.where(F.abs(F.col("z") - z0) <= dz)
    ix = F.least(bin_left_closed(F.col("x"), xedges), F.lit(len(xedges) - 1))
    iy = F.least(bin_left_closed(F.col("y"), yedges), F.lit(len(yedges) - 1))
    return near.select(ix.alias("ix"), iy.alias("iy")).where("ix >= 1 and iy >= 1").groupBy("ix", "iy").agg(F.count("*").alias("n"))


def volume_histogram(df: DataFrame, xedges: Edges, yedges: Edges, zedges: Edges, by: Sequence[str] = ()) -> DataFrame:
    """Points by 3-D bin."""
    out = df.withColumns({f"i{c}": bin_left_closed(F.col(c), e) for c, e in zip("xyz", (xedges, yedges, zedges), strict=True)})
    for c, e in zip("xyz", (xedges, yedges, zedges), strict=True):
        out = out.where(in_bins(F.col(f"i{c}"), F.size(e) - 1 if isinstance(e, Column) else len(e) - 1))
    return out.groupBy(*by, "ix", "iy", "iz").agg(F.count("*").alias("n"))


def data_limits(df: DataFrame) -> DataFrame:
    """One row with the least and greatest x and y."""
    return df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def disk_kernel(radius: float) -> list[tuple[int, int, float]]:
    """Offsets (dx, dy, w) within ``radius``; weights are equal and sum to 1."""
    r = int(radius)
    held = [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius]
    return [(dx, dy, 1.0 / len(held)) for dx, dy in held]


def smooth_map(df: DataFrame, nx: int, ny: int, kernel: Sequence[tuple[int, int, float]], value: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """Weighted sum over a neighbourhood of bins; bins past the border repeat the border's.

    ``df`` is sparse; absent bins count as 0. Each bin sends its value to those
    bins in whose neighbourhood it is, as often as the clamped border repeats it.
    """
    shape = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel])
    reach = max(abs(v) for dx, dy, _ in kernel for v in (dx, dy))
    span = F.sequence(F.lit(-reach), F.lit(reach))
    sent = df.select(*by, "ix", "iy", F.col(value).alias("__v"), F.explode(span).alias("__a")).select("*", F.explode(span).alias("__b"))
    sent = sent.withColumns({"tx": F.col("ix") + F.col("__a"), "ty": F.col("iy") + F.col("__b")}).where(F.col("tx").between(1, nx) & F.col("ty").between(1, ny))
    reads = lambda at, d, n: F.greatest(F.lit(1), F.least(F.lit(n), at + d))
    w = F.aggregate(
        F.filter(shape, lambda k: (reads(F.col("tx"), k["dx"], nx) == F.col("ix")) & (reads(F.col("ty"), k["dy"], ny) == F.col("iy"))),
        F.lit(0.0),
        lambda s, k: s + k["w"],
    )
    return sent.withColumn("__w", w).where("__w > 0").groupBy(*by, F.col("tx").alias("ix"), F.col("ty").alias("iy")).agg(F.sum(F.col("__v") * F.col("__w")).alias("smooth"))


def signal_map(signal: DataFrame, positions: DataFrame, keys: Sequence[str], xedges: Sequence[float], yedges: Sequence[float], value: str = "v", *, bucket: float | None = None) -> DataFrame:
    """Share of a signal's absolute values by the place where they fell, over the share of samples there.

    A sample falls where the first position at or after it is; ``value`` may be
    the signal or one band of its spectrum. Returns (ix, iy, n, share,
    occ_share, preference).
    """
    placed = asof_join(signal.select(*keys, "t", F.col(value).alias("__v")), positions, keys, bucket=bucket)
    shares = fraction_map(placed, xedges, yedges, F.abs(F.col("__v")))
    return preference_map(shares, fraction_map(placed, xedges, yedges))


def band_map(positions: Stream, signal: Stream, keys: Sequence[str], fs: float, frequency: float | None, xedges: Sequence[float], yedges: Sequence[float], value: str = "v", *, block: int = 4096) -> DataFrame:
    """Where a band of a signal is strong: (ix, iy, n, share, occ_share, preference) over all trials.

    Both streams are cut by trial, each on its own clock. The band is that of
    each trial's piece of signal by itself; without a ``frequency`` the signal
    stands for it. A sample falls where the trial's first position at or after
    it is, and weighs by its absolute value; ``occ_share`` is the share of the
    trials' positions.
    """
    keys = [*keys, "trial"]
    cut = cut_streams(keys[:-1], {"positions": positions, "signal": signal})
    told = cut["signal"].withColumnRenamed(value, "v")
    if frequency is not None:
        told = band_signal(told, keys, fs, frequency, signal.index, "v", [signal.time], block=block)
    placed = asof_join(told.select(*keys, F.col(signal.time).alias("t"), F.col("v").alias("__v")), cut["positions"].withColumnRenamed(positions.time, "t"), keys, bucket=math.inf)
    shares = fraction_map(placed, xedges, yedges, F.abs(F.col("__v")))
    return preference_map(shares, fraction_map(cut["positions"], xedges, yedges))
