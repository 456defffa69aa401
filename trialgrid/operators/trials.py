"""Trials from markers, and slices of streams by trial."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import marker_class
from .asof import asof_join
from .blocks import BLOCK, cut_windows
from .ordered import between_join, in_buckets, neighbour, packed, ranked, unpacked


def cumulative_clock(df: DataFrame, keys: Sequence[str], dt: str = "dt", order: str = "seq", name: str = "t", *, bucket: float | None = None) -> DataFrame:
    """Running sum of time steps; ``bucket``, a width of the order column, deals out long keys."""
    rows = packed(df, keys, order).withColumn("__dt", F.col(f"__row.{dt}"))
    dealt = in_buckets(rows, keys, order, bucket, ["__dt"], pick=F.sum)
    w = Window.partitionBy(*keys, "__bucket").orderBy(order, F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return unpacked(dealt.withColumn(name, F.sum("__dt").over(w)), df, keys, order, name)


def _wide(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    pick = lambda c, k: F.max(F.when(F.col("part") == k, F.col(c)))
    return df.groupBy(*keys, "trial").agg(*[pick("marker", k).alias(f"trig{k}") for k in (1, 2, 3)], *[pick("t", k).alias(f"t{k}") for k in (1, 2, 3)])


def pair_markers(df: DataFrame, keys: Sequence[str], marker: str = "marker", time: str = "t", order: str = "seq", *, check: bool = True, bucket: float | None = None) -> DataFrame:
    """Trials (keys, trial, trig1..3, t1..3): the k-th start, cue and end markers form trial k.

    With ``check`` a key whose three counts differ raises an error. ``bucket``
    is a width of the order column (see :func:`~trialgrid.operators.ordered.ranked`).
    """
    marked = df.select(*keys, F.col(marker).cast("int").alias("marker"), F.col(time).alias("t"), F.col(order).alias("__order")).withColumn("part", marker_class(F.col("marker"))).where("part is not null")
    marked = ranked(marked, [*keys, "part"], "__order", "trial", bucket=bucket).withColumn("trial", F.col("trial").cast("int"))
    out = _wide(marked, keys)
    if check:
        whole = F.col("t1").isNotNull() & F.col("t2").isNotNull() & F.col("t3").isNotNull()
        out = out.withColumn("trial", F.when(whole, F.col("trial")).otherwise(F.raise_error(F.lit("Start, cue and end markers differ in number")).cast("int")))
    return out


def reshape_triggers(df: DataFrame, keys: Sequence[str], marker: str = "marker", time: str = "t", order: str = "seq", *, positive_only: bool = False, bucket: float | None = None) -> DataFrame:
    """Trials from markers in trios, after a leading 84 is dropped.

    The tens digits of a trio are 1, 2 and 3 or 4 and its unit digits are equal;
    otherwise the query fails with "Inconsistent main markers" or "Inconsistent
    cue markers". So it does with "Inconsistent number of markers" if a key's
    last trio is not whole.
    """
    rows = df.select(*keys, F.col(marker).cast("int").alias("marker"), F.col(time).alias("t"), F.col(order).alias("__order"))
    if positive_only:
        rows = rows.where("marker > 0")
    rows = ranked(rows, keys, "__order", bucket=bucket).where("not (n = 1 and marker = 84)")
    rows = ranked(rows, keys, "__order", bucket=bucket).withColumn("n", F.col("n") - 1)
    rows = rows.withColumn("trial", (F.floor(F.col("n") / 3) + 1).cast("int")).withColumn("part", F.col("n") % 3 + 1)
    out = _wide(rows, keys)
    tens = lambda c: F.floor(F.col(c) / 10)
    main = (tens("trig1") == 1) & tens("trig3").isin(3, 4)
    cue = (tens("trig2") == 2) & (F.col("trig1") % 10 == F.col("trig2") % 10) & (F.col("trig1") % 10 == F.col("trig3") % 10)
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")
    short = F.col("trig1").isNull() | F.col("trig2").isNull() | F.col("trig3").isNull()
    judged = F.when(short, fail("Inconsistent number of markers")).when(~F.coalesce(main, F.lit(False)), fail("Inconsistent main markers")).when(~F.coalesce(cue, F.lit(False)), fail("Inconsistent cue markers")).otherwise(F.col("trial"))
    return out.withColumn("trial", judged)


def trial_slice(samples: DataFrame, trials: DataFrame, keys: Sequence[str], time: str = "t", start: str = "t1", end: str = "t3", *, bucket: float | None = None) -> DataFrame:
    """Samples from the first at or after a trial's start up to and with the first at or after its end.

    Past the data the last sample ends the trial. Times stay as they are. Long
    keys are dealt into buckets (see :func:`~trialgrid.operators.ordered.in_buckets`),
    and a trial meets the samples of the buckets it touches alone.
    """
    marked = neighbour(samples, keys, time, "__before", bucket=bucket)
    bounds = trials.select(*keys, "trial", F.col(start).alias("__start"), F.col(end).alias("__end"))
    before_end = F.coalesce(F.col("__before") < F.col("__end"), F.col("__end").isNotNull())
    # the sample that ends a trial may lie in a later bucket
    last = asof_join(bounds.withColumnRenamed("__end", time), samples.select(*keys, time), keys, time, (), bucket=bucket, drop_unmatched=False)
    last = last.withColumnRenamed(time, "__end").withColumn("__stop", F.coalesce("t_match", "__end")).drop("t_match")
    return between_join(marked, last, keys, time, "__start", "__stop", before_end, bucket=bucket).drop("__before", "__start", "__end", "__stop")


def trial_window(samples: DataFrame, trials: DataFrame, keys: Sequence[str], time: str = "t", pre: float = 0, post: float = 0, start: str = "t1", end: str = "t3", *, bucket: float | None = None) -> DataFrame:
    """Samples in [start - pre, end + post], time relative to the trial's start; overlapping trials repeat rows."""
    bounds = trials.select(*keys, "trial", F.col(start).alias("__start"), (F.col(start) - pre).alias("__low"), (F.col(end) + post).alias("__high"))
    out = between_join(samples, bounds, keys, time, "__low", "__high", bucket=bucket)
    return out.withColumn(time, F.col(time) - F.col("__start")).drop("__start", "__low", "__high")


def index_window(samples: DataFrame, trials: DataFrame, keys: Sequence[str], index: str = "seq", time: str = "t", pre: float = 0, post: float = 0, *, bucket: float | None = None) -> DataFrame:
    """:func:`trial_window` for triggers that are row numbers, with the end rule of :func:`trial_slice`."""
    at = samples.select(*keys, F.col(index).alias("__i"), F.col(time).alias("__at"))
    found = trials
    for name in ("t1", "t3"):
        found = found.join(at.withColumnRenamed("__i", name).withColumnRenamed("__at", f"__{name}"), [*keys, name])
    found = found.select(*keys, "trial", (F.col("__t1") - pre).alias("t1"), (F.col("__t3") + post).alias("t3"), F.col("__t1").alias("__zero"))
    out = trial_slice(samples, found, keys, time, bucket=bucket)
    return out.join(found.select(*keys, "trial", "__zero"), [*keys, "trial"]).withColumn(time, F.col(time) - F.col("__zero")).drop("__zero")


def clamped_window(samples: DataFrame, trials: DataFrame, keys: Sequence[str], index: str = "idx", margin: int = 1000, start: str = "i1", end: str = "i3", *, bucket: float | None = None) -> DataFrame:
    """Rows whose number lies within ``margin`` of a trial's rows, cut at the ends of the data."""
    return _clamped(samples, trials, keys, index, margin, start, end, [], bucket)


def _clamped(samples: DataFrame, trials: DataFrame, keys: Sequence[str], index: str, margin: int, start: str, end: str, carried: Sequence[str], bucket: float | None) -> DataFrame:
    limits = samples.groupBy(*keys).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))
    bounds = trials.join(limits, list(keys)).select(*keys, "trial", *carried, F.greatest(F.col(start) - margin, "__lo").alias("__a"), F.least(F.col(end) + margin, "__hi").alias("__b"))
    return between_join(samples, bounds, keys, index, "__a", "__b", bucket=bucket).drop("__a", "__b")


@dataclass(frozen=True)
class Stream:
    """A stream of rows with its own numbering and clock, and the trials in its row numbers.

    ``samples`` is (keys, ``index``, ``time``, values) and ``trials`` (keys,
    trial, i1, i3): the rows at which a trial begins and ends in this stream.
    ``margin`` rows more are taken on either side, as far as there are any.
    """

    samples: DataFrame
    trials: DataFrame
    index: str = "idx"
    time: str = "t"
    margin: int = 0
    bucket: float | None = None


def cut_streams(keys: Sequence[str], streams: Mapping[str, Stream]) -> dict[str, DataFrame]:
    """Every stream cut by trial: (keys, trial, index, time, values), time zeroed at the row with which the trial begins.

    Each stream is cut on its own numbering (see :func:`clamped_window`), so
    streams of different rates meet on (keys, trial) and time in the trial.
    Trials that begin at a row which is not there are left out.
    """
    keys, out = list(keys), {}
    for name, s in streams.items():
        starts = s.samples.select(*keys, F.col(s.index).alias("i1"), F.col(s.time).alias("__zero"))
        bounds = s.trials.select(*keys, "trial", "i1", "i3").join(starts, [*keys, "i1"])
        cut = _clamped(s.samples, bounds, keys, s.index, s.margin, "i1", "i3", ["__zero"], s.bucket)
        out[name] = cut.withColumn(s.time, F.col(s.time) - F.col("__zero")).drop("__zero")
    return out


def shift_clock(samples: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Samples with time zeroed at their first, to fit trials whose clock starts at the first trial."""
    zero = samples.groupBy(*keys).agg(F.min(time).alias("__zero"))
    return samples.join(zero, list(keys)).withColumn(time, F.col(time) - F.col("__zero")).drop("__zero")


def event_windows(samples: DataFrame, trials: DataFrame, keys: Sequence[str], before: int = 500, after: int = 500, index: str = "idx", onset: str = "i3", rewarded: Column | None = None, *, block: int = BLOCK) -> DataFrame:
    """Samples around rewarded ends: index in [onset - before, onset + after), as ``offset``."""
    values = [c for c in samples.columns if c not in (*keys, index)]
    found = _onset_windows(samples, trials, keys, before, after, index, onset, rewarded, values, block)
    rows = found.select(*keys, "trial", "__onset", F.explode("__window").alias("__s"))
    return rows.select(*keys, F.col(f"__s.{index}").alias(index), "trial", (F.col(f"__s.{index}") - F.col("__onset")).cast("int").alias("offset"), *[F.col(f"__s.`{c}`").alias(c) for c in values])


def _onset_windows(samples, trials, keys, before, after, index, onset, rewarded, values, block) -> DataFrame:
    rewarded = rewarded if rewarded is not None else (F.col("trig3") > 30) & (F.col("trig3") < 40)
    wanted = trials.where(rewarded).select(*keys, "trial", F.col(onset).alias("__onset"))
    around = F.col("__onset") - before, F.col("__onset") + (after - 1)
    return cut_windows(wanted, samples, list(keys), "__onset", index, values, before, max(after - 1, 0), *around, block=block)


def event_waves(samples: DataFrame, trials: DataFrame, keys: Sequence[str], before: int = 500, after: int = 500, index: str = "idx", onset: str = "i3", value: str = "v", rewarded: Column | None = None, *, block: int = BLOCK) -> DataFrame:
    """:func:`event_windows` of one value as arrays (keys, trial, wave), one row an event; windows that leave the data are dropped."""
    found = _onset_windows(samples, trials, keys, before, after, index, onset, rewarded, [value], block)
    wave = F.transform("__window", lambda s: s[value].cast("double")).alias("wave")
    return found.where(F.size("__window") == before + after).select(*keys, "trial", wave)


def count_trials(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count_distinct("trial").alias("n_trials"))


def compare_clocks(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials on which two clocks disagree: missing on one side, or other triggers."""
    cols = ["trig1", "trig2", "trig3"]
    left = a.select(*keys, "trial", F.struct(*cols).alias("a"))
    right = b.select(*keys, "trial", F.struct(*cols).alias("b"))
    return left.join(right, [*keys, "trial"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def rows_between(samples: DataFrame, low: float, high: float, index: str = "idx") -> DataFrame:
    """A time slice: rows whose number or time lies in [low, high]."""
    return samples.where(F.col(index).between(low, high))


def trial_of(df: DataFrame, trial: int) -> DataFrame:
    return df.where(F.col("trial") == trial)


def zip_trials(keys: Sequence[str], **streams: DataFrame) -> DataFrame:
    """Streams of a trial side by side: (keys, trial, <name> array of structs in time order), for trials that all have.

    Meant for streams of a few rows a trial, such as spikes and markers.
    """
    out = None
    for name, df in streams.items():
        rest = [c for c in df.columns if c not in (*keys, "trial")]
        own = df.groupBy(*keys, "trial").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = own if out is None else out.join(own, [*keys, "trial"])
    return out
