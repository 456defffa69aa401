"""Interval joins and band joins over bucketed time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_buckets, packed, unpacked


def interval_mask(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str = "t", *, strict: bool = False, name: str = "fixated", bucket: float | None = None) -> DataFrame:
    """Flag samples that lie in an interval of the same keys.

    Sample k is flagged if an interval [t_start, t_end] begins at or before it
    and ends after the sample before it; a key's first sample needs no such end,
    unless ``strict``. Of the intervals that begin at or before a sample only the
    latest end matters, so one window over both streams holds two running maxima,
    and no sample is paired with an interval. ``bucket``, a width in units of
    time, deals long keys into buckets.

    Samples at the same time are flagged alike, by the sample before all of
    them. A null time is never flagged; an interval with a null bound, or that
    ends before it begins, flags nothing.
    """
    keys = list(keys)
    rows = packed(samples, keys, time).withColumn("__at", F.col(time))
    starts = intervals.where("t_end >= t_start").select(*keys, F.col("t_start").alias(time), F.col("t_end").alias("__end"))
    both, parts = in_buckets(rows.unionByName(starts, allowMissingColumns=True), keys, time, bucket, ["__at", "__end"]), [*keys, "__bucket"]
    w = Window.partitionBy(*parts).orderBy(time, F.col("__row").isNotNull())
    both = both.withColumns({"__before": F.max("__at").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__latest": F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    tied = Window.partitionBy(*parts, time)
    first = F.count("__before").over(tied) < F.count("*").over(tied)
    both = both.where("__row is not null").withColumn("__before", F.when(~first, F.min("__before").over(tied)))
    flag = F.when(F.col("__before").isNull(), F.lit(False) if strict else F.col("__latest").isNotNull()).otherwise(F.col("__latest") > F.col("__before"))
    return unpacked(both.withColumn(name, F.coalesce(flag & F.col(time).isNotNull(), F.lit(False))), samples, keys, time, name)


def band_self_join(points: DataFrame, keys: Sequence[str], width: float, time: str = "t") -> DataFrame:
    """Ordered pairs of points of one key with 0 < later - earlier <= width: (keys, t, t_later, lag).

    Points are dealt into buckets as wide as the band, so that a point meets its
    own bucket and the next one only.
    """
    keys = list(keys)
    bucket = F.floor(F.col(time) / width)
    early = points.select(*keys, time, F.explode(F.array(bucket, bucket + 1)).alias("__bucket"))
    late = points.select(*keys, F.col(time).alias(f"{time}_later"), bucket.alias("__bucket"))
    lag = F.col(f"{time}_later") - F.col(time)
    return early.join(late, [*keys, "__bucket"]).withColumn("lag", lag).where((F.col("lag") > 0) & (F.col("lag") <= width)).drop("__bucket")


def lag_counts(points: DataFrame, keys: Sequence[str], edges: Sequence[float], time: str = "t", *, bucket: float | None = None) -> DataFrame:
    """Numbers of ordered pairs of points of one key by the bin of their lag (keys, bin, n), bins closed on the right.

    No pair is made. Of the points that follow one at t, those within a lag e
    are the points up to t + e less those up to t. So every point asks, at
    t + e for each edge e, how many points there are up to then; points and
    questions go through one window of running counts, with buckets of time, and
    a bin's number is the difference of two edges' sums. Rows: points x edges.
    """
    keys = list(keys)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(max(float(e), 0.0)).alias("e")) for k, e in enumerate(edges)]))
    known = points.where(F.col(time).isNotNull())
    asked = known.select(*keys, F.col(time).cast("double").alias("__t"), at.alias("__a")).select(*keys, (F.col("__t") + F.col("__a.e")).alias("__t"), F.col("__a.k").alias("__k"))
    both = known.select(*keys, F.col(time).cast("double").alias("__t"), F.lit(1).cast("long").alias("__one")).unionByName(asked, allowMissingColumns=True)
    dealt = in_buckets(both, keys, "__t", bucket, ["__one"], pick=F.sum)
    # points up to and with the question's time: they stand before it
    w = Window.partitionBy(*keys, "__bucket").orderBy("__t", F.col("__k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__upto", F.coalesce(F.sum("__one").over(w), F.lit(0))).where("__k is not null")
    sums = found.groupBy(*keys).agg(*[F.sum(F.when(F.col("__k") == k, F.col("__upto")).cast("decimal(38,0)")).alias(f"__s{k}") for k in range(len(edges))])
    bins = F.array(*[F.struct(F.lit(k).alias("bin"), (F.col(f"__s{k}") - F.col(f"__s{k - 1}")).cast("long").alias("n")) for k in range(1, len(edges))])
    return sums.select(*keys, F.explode(bins).alias("__b")).select(*keys, "__b.bin", "__b.n").where("n > 0")


def autocorrelogram(spikes: DataFrame, keys: Sequence[str], edges: Sequence[float], time: str = "t", *, normalize: bool = False, bucket: float | None = None) -> DataFrame:
    """Counts of lags between a unit's spikes by right-closed bin (keys, bin, n[, share]); see :func:`lag_counts`."""
    keys = list(keys)
    counts = lag_counts(spikes, keys, edges, time, bucket=bucket)
    if normalize:
        counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return counts


def firing_rate(spikes: DataFrame, keys: Sequence[str], start: int, width: int, windows: int, time: str = "t", *, cumulative: bool = False) -> DataFrame:
    """Greatest and mean count per unit of time over left-closed windows, empty ones included.

    Windows are ``[start + k * width, start + (k + 1) * width)``. With
    ``cumulative`` each count is divided by the time since the first window began.
    """
    keys = list(keys)
    number = F.floor((F.col(time) - start) / width)
    counts = spikes.withColumn("k", number).where(F.col("k").between(0, windows - 1)).groupBy(*keys, "k").agg(F.count("*").alias("n"))
    span = (F.col("k") + 1) * width if cumulative else F.lit(width)
    rates = counts.withColumn("rate", F.col("n") / span)
    every = spikes.select(*keys).distinct()
    out = rates.groupBy(*keys).agg(F.max("rate").alias("max_rate"), (F.sum("rate") / windows).alias("mean_rate"))
    return every.join(out, keys, "left").fillna(0.0, ["max_rate", "mean_rate"])
