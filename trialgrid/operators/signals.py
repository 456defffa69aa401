"""Spectra of sampled signals, aligned to events, and phases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_right_closed, in_bins
from ..functions.columns import phase, phase_difference
from .blocks import BLOCK, halo_blocks
from .ordered import ranked


def _frequencies(n: int, fs: float, per_octave: int, low: float) -> np.ndarray:
    octaves = int(np.floor(np.log2(max(1.0, fs / 2 / low)) * per_octave))
    return low * 2.0 ** (np.arange(octaves + 1) / per_octave)


def morlet(values: np.ndarray, fs: float, beta: float = 1.5, low: float = 1.0, per_octave: int = 4, within: tuple[float, float] = (0.0, np.inf)) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies ``within`` two bounds, and complex coefficients (time, frequency) of a Morlet transform.

    A wavelet at frequency f has the spectrum ``2 exp(-(w/f - 1)**2 (2 pi beta)**2 / 2)``
    over positive w: a cosine of amplitude A at f has coefficients of modulus A.
    """
    n = len(values)
    spectrum, w = np.fft.fft(values), np.fft.fftfreq(n, 1 / fs)
    freqs = _frequencies(n, fs, per_octave, low)
    freqs = freqs[(freqs >= within[0]) & (freqs <= within[1])]
    bank = np.where(w[None, :] > 0, 2 * np.exp(-0.5 * ((w[None, :] / freqs[:, None] - 1) * 2 * np.pi * beta) ** 2), 0)
    return freqs, np.fft.ifft(spectrum[None, :] * bank, axis=1).T


#: Coefficients that a task gives on at a time.
FLUSH = 1 << 18

#: Wavelet widths (standard deviations in time) beyond which a sample has no weight.
REACH = 6.0


def _margin(fs: float, beta: float, low: float) -> int:
    """Samples on either side that a coefficient depends on; the lowest frequency reaches furthest."""
    return int(np.ceil(REACH * beta / low * fs))


def spectrum(samples: DataFrame, keys: Sequence[str], fs: float, time: str = "t", value: str = "v", beta: float = 1.5, low: float = 1.0, *, block: int | None = None, within: tuple[float, float] = (0.0, np.inf)) -> DataFrame:
    """Wavelet coefficients of each key's series (keys, t, freq, re, im) at the frequencies ``within`` two bounds.

    The series goes on with zeros at both ends. It is dealt into blocks of
    ``block`` samples, each with as many more on both sides as a coefficient
    reaches over; a task transforms the blocks it holds one by one, and short
    series cost no more than their samples. Frequencies near half the
    sampling rate, whose wavelets are cut off there, come out slightly different
    at the borders. With a ``block`` the time column is a sample number without
    gaps; without one the samples are numbered by their time first.
    """
    keys, reach = list(keys), _margin(fs, beta, low)
    numbered = block is not None
    block, number = block or BLOCK, time if numbered else "__n"
    rows = samples.select(*keys, time, value) if numbered else ranked(samples.select(*keys, time, value), keys, time, "__n")
    held = halo_blocks(rows, keys, number, [value] if numbered else [time, value], reach, reach, block=block)
    own = lambda s: F.floor(s[number] / block) == F.col("__block")
    held = held.where(F.exists("__samples", own))  # a margin alone has no coefficients to give
    cells = held.select(*keys, F.transform("__samples", own).alias("__own"), F.col(f"__samples.{time}").alias("__t"), F.transform("__samples", lambda s: s[value].cast("double")).alias("__v"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ready = [], 0
            for k, (mine, values) in enumerate(zip(batch.column("__own"), batch.column("__v"), strict=True)):
                mine = np.flatnonzero(mine.values.to_numpy(zero_copy_only=False))
                padded = np.pad(values.values.to_numpy(zero_copy_only=False).astype(float), reach)
                freqs, c = morlet(padded, fs, beta, low, within=within)
                c = c[reach + mine]
                out.append((k, mine, freqs, c))
                ready += c.size
                if ready >= FLUSH:
                    yield packed(batch, out)
                    out, ready = [], 0
            if out:
                yield packed(batch, out)

    def packed(batch: pa.RecordBatch, out: list) -> pa.RecordBatch:
        row = np.repeat([k for k, *_ in out], [c.size for *_, c in out])
        starts = batch.column("__t").offsets.to_numpy()
        at = np.concatenate([np.repeat(starts[k] + mine, len(freqs)) for k, mine, freqs, _ in out])
        c = np.concatenate([c.ravel() for *_, c in out])
        freq = np.concatenate([np.tile(freqs, len(mine)) for _, mine, freqs, _ in out])
        columns = [batch.column(k).take(pa.array(row)) for k in keys] + [batch.column("__t").values.take(pa.array(at))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(freq), pa.array(c.real), pa.array(c.imag)], names=[*keys, time, "freq", "re", "im"])

    fields = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in [*keys, time])
    return cells.mapInArrow(transform, f"{fields}, freq double, re double, im double")


def band(spec: DataFrame, frequency: float, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Real part at the first frequency at or above ``frequency``."""
    return spec.where(F.col("freq") >= frequency).groupBy(*keys, time).agg(F.min_by("re", "freq").alias("v"))


def band_signal(samples: DataFrame, keys: Sequence[str], fs: float, frequency: float, index: str = "idx", value: str = "v", carried: Sequence[str] = (), beta: float = 1.5, low: float = 1.0, per_octave: int = 4, *, block: int = BLOCK) -> DataFrame:
    """One band of each key's series: (keys, index, carried, v), the real part at the first frequency of the grid at or above ``frequency``.

    It is :func:`band` of :func:`spectrum`, but no other frequency is computed:
    the series are arrays in blocks with margins as wide as the wavelet, and a
    task folds each block with the wavelet. Numbers go up by one and start
    anywhere; zeros follow at both ends of a series, and stand in its gaps.
    """
    freq = low * 2.0 ** (int(np.ceil(np.log2(frequency / low) * per_octave - 1e-9)) / per_octave)
    reach = int(np.ceil((REACH + 2) * beta / freq * fs))
    at = np.arange(-reach, reach + 1) / fs
    # the wavelet in time: a Gaussian of width beta / freq under a carrier
    kernel = 2 * freq / (beta * np.sqrt(2 * np.pi)) * np.exp(-0.5 * (at * freq / beta) ** 2) * np.cos(2 * np.pi * freq * at) / fs
    keys, carried = list(keys), list(carried)
    held = halo_blocks(samples, keys, index, [value, *carried], reach, reach, block=block)
    cells = held.select(*keys, "__block", F.col(f"__samples.{index}").alias("__i"), F.transform("__samples", lambda s: s[value].cast("double")).alias("__v"), "__samples")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for numbers, values in zip(batch.column("__i"), batch.column("__v"), strict=True):
                i, v = numbers.values.to_numpy(), np.nan_to_num(values.values.to_numpy(zero_copy_only=False).astype(float))
                series = np.zeros(i[-1] - i[0] + 1)
                np.add.at(series, i - i[0], v)
                out.append(np.convolve(series, kernel)[reach : reach + len(series)][i - i[0]])
            yield batch.drop_columns(["__i", "__v"]).append_column("__b", pa.array(out, pa.list_(pa.float64())))

    shape = cells.drop("__i", "__v").withColumn("__b", F.lit(None).cast("array<double>")).schema
    rows = cells.mapInArrow(folded, shape).select(*keys, "__block", F.explode(F.arrays_zip("__samples", "__b")).alias("__z"))
    own = rows.where(F.floor(F.col(f"__z.__samples.{index}") / block) == F.col("__block"))
    return own.select(*keys, F.col(f"__z.__samples.{index}").alias(index), *[F.col(f"__z.__samples.{c}").alias(c) for c in carried], F.col("__z.__b").alias("v"))


def up_to(spec: DataFrame, frequency: float) -> DataFrame:
    return spec.where(F.col("freq") <= frequency)


def phase_histogram(spec: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    number = bin_right_closed(phase(F.col("re"), F.col("im")), edges)
    return spec.withColumn("bin", number).where(in_bins(F.col("bin"), len(edges) - 1)).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def phase_differences(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    left = a.select(*on, phase(F.col("re"), F.col("im")).alias("__a"))
    right = b.select(*on, phase(F.col("re"), F.col("im")).alias("__b"))
    return left.join(right, list(on)).select(*on, phase_difference(F.col("__a"), F.col("__b")).alias("difference"))


def wavelet_kernels(size: int, fs: float, beta: float = 1.5, low: float = 1.0, per_octave: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and what a sample adds to the coefficients of a series of ``size`` samples: (frequency, 2 * size - 1).

    Entry ``size - 1 + m`` of a row is the weight of a sample for the coefficient
    ``m`` samples later. With zeros at both ends of a series, as many as a
    wavelet reaches over, its coefficients are sums of samples by these weights.
    """
    reach = _margin(fs, beta, low)
    impulse = np.zeros(size + 2 * reach)
    impulse[0] = 1.0
    freqs, answer = morlet(impulse, fs, beta, low, per_octave)
    return freqs, answer[np.arange(1 - size, size)].T


def _moments(size: int, fs: float):
    """Numbers, means and summed squares about them of log amplitudes, by offset and frequency, of all windows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs, kernels = wavelet_kernels(size, fs)
        n, mean, m2 = (np.zeros((len(freqs), size)) for _ in range(3))
        lag = np.arange(size)[None, :] - np.arange(size)[:, None] + size - 1  # row: sample, column: offset
        for batch in batches:
            column = batch.column(0).drop_null()
            waves = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)
            for k in range(len(freqs) if len(waves) else 0):
                matrix = kernels[k][lag]
                with np.errstate(divide="ignore"):
                    level = 0.5 * np.log((waves @ matrix.real) ** 2 + (waves @ matrix.imag) ** 2)
                good = np.isfinite(level)
                count = good.sum(0)
                level = np.where(good, level, 0.0)
                own = level.sum(0) / np.maximum(count, 1)
                spread = (np.where(good, level - own, 0.0) ** 2).sum(0)
                both, apart = np.maximum(n[k] + count, 1), own - mean[k]
                m2[k] += spread + apart**2 * n[k] * count / both
                mean[k] += apart * count / both
                n[k] += count
        at = np.argwhere(n > 0)
        k, o = at[:, 0], at[:, 1]
        yield pa.RecordBatch.from_arrays([pa.array(o.astype(np.int32)), pa.array(freqs[k]), pa.array(n[k, o].astype(np.int64)), pa.array(mean[k, o]), pa.array(m2[k, o])], names=["at", "freq", "n", "mean", "m2"])

    return run


def aligned_spectrum_of(waves: DataFrame, keys: Sequence[str], fs: float, size: int, first: int = 0, seed: int | None = None, wave: str = "wave") -> DataFrame:
    """:func:`aligned_spectrum` of windows that are arrays of ``size`` values in one row each; ``first`` is the first offset.

    A task multiplies its windows, the rows of a matrix, by the matrix of each
    frequency's wavelet at all offsets, and sends three numbers for each offset
    and frequency. There is no group of an event, and nothing else is shuffled.
    """
    held = waves.where(F.size(wave) == size)
    row = F.col(wave).cast("array<double>")
    if seed is not None:
        turn = F.conv(F.substring(F.md5(F.concat_ws("|", *keys, F.lit(seed))), 1, 8), 16, 10).cast("long") % size
        row = F.concat(F.slice(row, (size - turn + 1).cast("int"), turn.cast("int")), F.slice(row, F.lit(1), (size - turn).cast("int")))
    parts = held.select(row.alias("w")).mapInArrow(_moments(size, fs), "at int, freq double, n long, mean double, m2 double")
    sums = parts.groupBy("at", "freq").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.greatest(F.col("m2") + F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / F.col("n")
    return sums.select((F.col("at") + first).alias("offset"), "freq", mean.alias("mean"), F.sqrt(spread).alias("deviation"))


def aligned_spectrum(windows: DataFrame, keys: Sequence[str], fs: float, seed: int | None = None) -> DataFrame:
    """Mean and population deviation of log amplitudes by (offset, freq) over events.

    ``windows`` is (keys, offset, v); all windows are as long as the longest, and
    shorter ones, or ones with gaps, are left out. With ``seed`` every event's
    window is first turned round by a number drawn from it: a control with no
    alignment. Values of amplitude 0 have no logarithm and do not count.
    """
    packed = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("offset", "v"))).alias("__s"))
    size = packed.agg(F.max(F.size("__s")), F.min(F.element_at("__s", 1)["offset"])).first()  # two numbers
    if size[0] is None:
        return windows.sparkSession.createDataFrame([], "offset int, freq double, mean double, deviation double")
    waves = packed.select(*keys, F.transform("__s", lambda s: s["v"]).alias("wave"))
    return aligned_spectrum_of(waves, keys, fs, size[0], size[1], seed)
