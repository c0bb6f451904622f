"""Signals as array columns: level, normalisation, framing, spectral tilt."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import log_ratio


def _sum_squares(wav: Column) -> Column:
    return F.aggregate(wav, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def rms_dbfs(wav: Column) -> Column:
    """Level of the root mean square below full scale; null for silence."""
    ms = F.try_divide(_sum_squares(wav), F.size(wav))
    return F.when(ms > 0, 10 * F.log10(ms))


def peak_dbfs(wav: Column) -> Column:
    peak = F.array_max(F.transform(wav, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > 0, 20 * F.log10(peak))


def duration_s(wav: Column, sample_rate: Column) -> Column:
    return F.try_divide(F.size(wav), sample_rate)


def rms_normalize(wav: Column, dbfs: float) -> Column:
    """Scaled to a level; silence stays silence. No limiter."""
    gain = F.coalesce(F.pow(F.lit(10.0), (F.lit(float(dbfs)) - rms_dbfs(wav)) / 20), F.lit(1.0))
    return F.transform(wav, lambda x: x.cast("double") * gain)


def mono_mix(channels: Column) -> Column:
    """Mean of the channels of an array of arrays."""
    n = F.size(channels)
    first = F.transform(F.get(channels, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(channels, 2, F.greatest(n - 1, F.lit(0))), first, lambda a, c: F.zip_with(a, c, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def select_channel(channels: Column, channel: Column) -> Column:
    """One channel, counted from 0; below 0, null: the mean of all."""
    return F.when(channel.isNull() | (channel < 0), mono_mix(channels)).otherwise(F.transform(F.get(channels, channel.cast("int")), lambda x: x.cast("double")))


def n_frames(n_samples: Column, hop: int) -> Column:
    return F.floor(n_samples / hop).cast("int")


def frame_signal(wav: Column, hop: int, window: int, causal: bool = False) -> Column:
    """Windows at every hop: padded by half a window on both sides, or causally behind the first sample's place."""
    left = 0 if causal else window // 2
    right = window - 1 if causal else window // 2
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    padded = F.concat(zeros(left), F.transform(wav, lambda x: x.cast("double")), zeros(right))
    n = n_frames(F.size(wav), hop)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(padded, i * hop + 1, window))).otherwise(F.array().cast("array<array<double>>"))


def hamming(window: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (window - 1)) for i in range(window)] if window > 1 else [1.0]


def next_pow2(n: int) -> int:
    return 1 << (n - 1).bit_length()


def band_bins(n_fft: int, sample_rate: int, low: float, high: float, closed: bool = False) -> list[int]:
    """Bins of a band, with its upper end where it is closed."""
    f = [k * sample_rate / n_fft for k in range(n_fft // 2 + 1)]
    return [k for k, x in enumerate(f) if low <= x < high or closed and x == high]


def power_spectrum_native(frame: Column, n_fft: int) -> Column:
    """Power of the discrete Fourier transform of one windowed frame by its definition; for short windows."""
    out = []
    window = n_fft
    w = hamming(window)
    for k in range(n_fft // 2 + 1):
        re = F.lit(0.0)
        im = F.lit(0.0)
        for t in range(window):
            x = F.get(frame, F.lit(t)) * w[t]
            re = re + x * math.cos(2 * math.pi * k * t / n_fft)
            im = im + x * math.sin(2 * math.pi * k * t / n_fft)
        out.append(re * re + im * im)
    return F.array(*out)


def power_spectrum(window: int, n_fft: int):
    """Arrow function: frames of one signal to power spectra."""
    w = np.array(hamming(window))

    @F.pandas_udf("array<array<double>>")
    def run(frames: pd.Series) -> pd.Series:
        def one(fs):
            if fs is None or len(fs) == 0:
                return []
            x = np.stack([np.asarray(f, dtype=np.float64) for f in fs]) * w
            return list(np.abs(np.fft.rfft(x, n_fft)) ** 2)

        return frames.map(one)

    return run


def tilt_from_power(power: Column, n_fft: int, sample_rate: int, alpha=((0.0, 1000.0), (1000.0, 5000.0)), hammarberg=((0.0, 2000.0), (2000.0, 5000.0))) -> Column:
    """struct(alpha_ratio_db, hammarberg_db) of one power spectrum, averaged or not."""

    def pick(band, closed):
        bins = band_bins(n_fft, sample_rate, *band, closed=closed)
        if not bins:
            raise ValueError(f"no bin of {n_fft} points at {sample_rate} Hz lies in {band}")
        return F.slice(power, bins[0] + 1, len(bins))

    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        log_ratio(total(pick(alpha[1], True)), total(pick(alpha[0], False))).alias("alpha_ratio_db"),
        log_ratio(F.array_max(pick(hammarberg[0], False)), F.array_max(pick(hammarberg[1], True))).alias("hammarberg_db"),
    )
