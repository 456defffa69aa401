"""Sorted units: templates, spikes, waveforms, features, thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, cut_windows
from .factors import project
from .ordered import ranked


def spike_counts(firings: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    return firings.groupBy(*keys).agg(F.count("*").alias("n"))


def _renumber(df: DataFrame, unit: str) -> DataFrame:
    """Units numbered densely from 1 in their order, by buckets of their numbers."""
    numbers = ranked(df.select(unit).distinct(), [], unit, "__new", bucket=1 << 16)
    return df.join(numbers, unit).withColumn(unit, F.col("__new").cast("int")).drop("__new")


def keep_units(df: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows of the listed units, renumbered."""
    return _renumber(df.join(units.select(unit).distinct(), unit, "left_semi"), unit)


def discard_units(df: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows of all other units, renumbered."""
    return _renumber(df.join(units.select(unit).distinct(), unit, "left_anti"), unit)


def merge_units(templates: DataFrame, firings: DataFrame, units: Sequence[int], unit: str = "unit") -> tuple[DataFrame, DataFrame]:
    """Units merged into the first of them: templates weighted by spike counts, spikes relabelled."""
    target = F.when(F.col(unit).isin(*units), F.lit(units[0])).otherwise(F.col(unit))
    weighed = templates.join(spike_counts(firings, [unit]), unit, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    merged = weighed.groupBy(target.cast(templates.schema[unit].dataType).alias(unit), "channel", "pt").agg(
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n")), F.avg("v")).alias("v")
    )
    return merged, firings.withColumn(unit, target.cast(firings.schema[unit].dataType))


def trigger_points(templates: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """The point of greatest amplitude of each template, the first of equals, and its length."""
    return templates.groupBy(*keys).agg(F.max_by("pt", F.struct(F.abs("v"), -F.col("pt"))).alias("trigger"), F.max("pt").alias("points"))


def cut_waveforms(firings: DataFrame, samples: DataFrame, triggers: DataFrame, on: Sequence[str] = ("session",), unit: str = "unit", *, block: int = BLOCK) -> DataFrame:
    """Waveforms (session, channel, unit, idx, wave): samples idx - trigger + 1 up to idx - trigger + points.

    Spikes whose window leaves the data are dropped. Samples are arrays in blocks
    with margins as wide as the widest template, and a waveform is a slice: each
    spike is one row throughout, and samples are shuffled once.
    """
    before = triggers.agg(F.coalesce(F.max("trigger") - 1, F.lit(0))).scalar()  # two numbers of a small table
    after = triggers.agg(F.coalesce(F.greatest(F.max(F.col("points") - F.col("trigger")), F.lit(0)), F.lit(0))).scalar()
    first = F.col("idx") - F.col("trigger") + 1
    shared = [c for c in (*on, unit) if c in triggers.columns]
    wanted = firings.select(*on, unit, "idx").join(triggers, shared).withColumns({"__low": first, "__high": first + F.col("points") - 1})
    told = samples.select(*on, "channel", F.col("idx").alias("__at"), "v")
    found = cut_windows(wanted, told, list(on), "idx", "__at", ["v"], before, after, F.col("__low"), F.col("__high"), within=["channel"], block=block)
    whole = found.where(F.size("__window") == F.col("points"))
    return whole.select(*on, "channel", unit, "idx", F.transform("__window", lambda s: s["v"]).alias("wave"))


def minmax_downsample(samples: DataFrame, keys: Sequence[str], window: int, index: str = "idx", value: str = "v") -> DataFrame:
    """Mean, and least and greatest value with their places in time order, of chunks that share a border sample.

    Chunk k holds samples k * (window - 1) up to k * (window - 1) + window - 1,
    counted from 0; a last chunk that is not full is dropped.
    """
    step = window - 1
    chunk = F.floor(F.col(index) / step)
    own = F.when((F.col(index) % step == 0) & (F.col(index) > 0), F.array(chunk - 1, chunk)).otherwise(F.array(chunk))
    dealt = samples.select(*keys, index, value, F.explode(own).alias("chunk"))
    low, high = F.min_by(F.struct(index, value), F.struct(F.col(value), F.col(index))), F.max_by(F.struct(index, value), F.struct(F.col(value), -F.col(index)))
    out = dealt.groupBy(*keys, "chunk").agg(F.avg(value).alias("mean"), low.alias("low"), high.alias("high"), F.count("*").alias("__n")).where(F.col("__n") == window)
    first, second = F.least("low", "high"), F.greatest("low", "high")
    return out.select(*keys, "chunk", "mean", first[index].alias("i1"), first[value].alias("v1"), second[index].alias("i2"), second[value].alias("v2"))


def channel_offsets(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value of each channel, and the offset that stacks the channels."""
    ranges = samples.groupBy(*keys, "channel").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    w = Window.partitionBy(*keys).orderBy("channel")  # one row per channel
    step = F.coalesce(F.lag("v_max").over(w) - F.col("v_min"), F.lit(0.0))
    return ranges.withColumn("__step", step).withColumn("offset", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def first_per_unit(df: DataFrame, keys: Sequence[str], most: int = 1000, order: str = "t", *, bucket: float | None = None) -> DataFrame:
    """At most ``most`` rows of each unit, in order; ``bucket`` is a width of the order column."""
    return ranked(df, keys, order, "__n", bucket=bucket).where(F.col("__n") <= most).drop("__n")


def even_thin(df: DataFrame, keys: Sequence[str], most: int = 16383, order: str = "t", *, bucket: float | None = None) -> DataFrame:
    """At most ``most`` rows of each key, evenly spread, the first and the last among them."""
    marked = ranked(df, keys, order, "__k", total="__n", bucket=bucket)
    # row k is taken if some j in 0..most-1 has round(1 + j (n - 1) / (most - 1)) = k
    place = lambda j: F.floor(1.5 + j * (F.col("__n") - 1) / (most - 1))
    guess = F.floor((F.col("__k") - 1) * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    near = [F.greatest(F.least(guess + s, F.lit(most - 1)), F.lit(0)) for s in (-1, 0, 1)]
    taken = (F.col("__n") <= most) | (place(near[0]) == F.col("__k")) | (place(near[1]) == F.col("__k")) | (place(near[2]) == F.col("__k"))
    return marked.where(taken).drop("__k", "__n")


def concatenate(parts: Sequence[tuple[DataFrame, DataFrame]], unit: str = "unit") -> tuple[DataFrame, DataFrame]:
    """Templates and spikes of several sorts as one: each sort's units are numbered on from those of the sorts before."""
    templates, firings, shift = None, None, F.lit(0)
    for own, spikes in parts:
        top = own.agg(F.coalesce(F.max(unit), F.lit(0)).alias("__top"))
        own, spikes = (df.withColumn(unit, (F.col(unit) + shift).cast("int")) for df in (own, spikes))
        templates = own if templates is None else templates.unionByName(own)
        firings = spikes if firings is None else firings.unionByName(spikes)
        shift = shift + F.lit(top.first()[0])  # one number for each sort
    return templates, firings


def pca_features(df: DataFrame, key: str, column: str = "wave", k: int = 3) -> DataFrame:
    """The first ``k`` principal components of centred waveforms: (key, features). Signs are free; null waveforms have none."""
    return project(df, key, column, k, True, None)


def svd_features(df: DataFrame, key: str, column: str = "wave", k: int = 3) -> DataFrame:
    """Left singular vectors of the uncentred waveform matrix, one row per waveform: (key, features). Signs are free."""
    return project(df, key, column, k, False, None)


def features_by_channel(df: DataFrame, key: str, column: str = "wave", k: int = 3, method: str = "pca") -> DataFrame:
    """Features of each channel's waveforms on their own: (key, features, channel). No rows give no rows."""
    return project(df, key, column, k, method == "pca", "channel")
