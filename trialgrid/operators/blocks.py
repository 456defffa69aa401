"""Sampled series as arrays: one row for each block of samples, with margins, out of which windows are cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a series that a block holds, besides its margins.
BLOCK = 4096


def halo_blocks(samples: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], before: Column | int, after: Column | int, *, within: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Series in blocks (keys, within, __block, __samples): all samples that a window about a sample of the block reaches.

    Block b holds the numbers from ``b * block - before`` up to ``(b + 1) * block
    - 1 + after`` as an array of (index, values) in order. Samples are dealt by
    keys and block alone, so that windows of the same keys meet all series
    ``within`` a key (its channels, say) without a further shuffle; this is the
    only one. A sample within a margin's reach of a border is in both blocks.
    """
    at = lambda c: F.floor(c / block)
    known = samples.where(F.col(index).isNotNull())
    dealt = known.select(*keys, *within, F.struct(index, *values).alias("__s"), F.explode(F.sequence(at(F.col(index) - after), at(F.col(index) + before))).alias("__block"))
    dealt = dealt.repartition(*[F.col(k) for k in keys], F.col("__block"))
    return dealt.groupBy(*keys, *within, "__block").agg(F.array_sort(F.collect_list("__s")).alias("__samples"))


def samples_between(samples: Column, index: str, low: Column, high: Column) -> Column:
    """The part of a block's array whose numbers lie in [low, high]: a slice, or where numbers are missing or repeated a filter."""
    first, last = F.element_at(samples, 1)[index], F.element_at(samples, -1)[index]
    whole = last - first + 1 == F.size(samples)
    start, stop = F.greatest(low, first), F.least(high, last)
    cut = F.slice(samples, (start - first + 1).cast("int"), F.greatest(stop - start + 1, F.lit(0)).cast("int"))
    return F.when(~whole, F.filter(samples, lambda s: s[index].between(low, high))).when(start > last, F.slice(samples, F.lit(1), F.lit(0))).otherwise(cut)


def cut_windows(events: DataFrame, samples: DataFrame, keys: Sequence[str], at: str, index: str, values: Sequence[str], before: Column | int, after: Column | int, low: Column, high: Column, *, within: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Events with ``__window``, the samples of their keys whose numbers lie in [low, high], once for each series ``within``.

    ``low`` and ``high`` are columns of the events and lie at most ``before`` and
    ``after`` from the number ``at``. Events without any series have no row.
    """
    held = halo_blocks(samples, keys, index, values, before, after, within=within, block=block)
    placed = events.where(F.col(at).isNotNull()).withColumn("__block", F.floor(F.col(at) / block))
    joined = placed.join(held, [*keys, "__block"])
    return joined.withColumn("__window", samples_between(F.col("__samples"), index, low, high)).drop("__samples", "__block")
