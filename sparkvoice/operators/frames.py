"""Frames as rows: framing, spectral tilt, statistics over frame sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..functions.scalars import hz_to_semitones, semitones_to_hz


@dataclass(frozen=True)
class FrameGrid:
    hop_size: int
    sample_rate: int
    causal: bool = False

    def n_frames(self, n_samples: int) -> int:
        return n_samples // self.hop_size


@dataclass(frozen=True)
class SpectralTilt:
    """The frame feature spectral_tilt: alpha ratio and Hammarberg index of each frame."""

    sample_rate: int = 16_000
    window_length: int = 400
    n_fft: int = 512
    alpha: tuple = ((0.0, 1000.0), (1000.0, 5000.0))
    hammarberg: tuple = ((0.0, 2000.0), (2000.0, 5000.0))

    columns = ("alpha_ratio_db", "hammarberg_db")

    def __post_init__(self):
        if self.n_fft < self.window_length:
            raise ValueError(f"n_fft {self.n_fft} is shorter than the window of {self.window_length}")
        for low, high in (*self.alpha, *self.hammarberg):
            if not 0 <= low < high <= self.sample_rate / 2:
                raise ValueError(f"band {low} to {high} Hz does not lie within 0 to {self.sample_rate / 2} Hz")

    def params(self) -> dict:
        return {"sample_rate": self.sample_rate, "window_length": self.window_length, "n_fft": self.n_fft, "alpha": self.alpha, "hammarberg": self.hammarberg}

    def compute(self, waves: DataFrame, grid: FrameGrid, wav: str = "wav", key: str = "utt_id") -> DataFrame:
        """key, frame and the two columns, a row for each frame. The native form serves windows that fill the FFT."""
        if grid.sample_rate != self.sample_rate:
            raise ValueError(f"the grid is at {grid.sample_rate} Hz, the feature at {self.sample_rate} Hz")
        frames = waves.select(key, signal.frame_signal(F.col(wav), grid.hop_size, self.window_length, grid.causal).alias("__frames"))
        if self.n_fft == self.window_length and self.n_fft <= 32:
            rows = frames.select(key, F.posexplode("__frames").alias("frame", "__f")).withColumn("__p", signal.power_spectrum_native(F.col("__f"), self.n_fft))
        else:
            spectra = frames.select(key, signal.power_spectrum(self.window_length, self.n_fft)(F.col("__frames")).alias("__spectra"))
            rows = spectra.select(key, F.posexplode("__spectra").alias("frame", "__p"))
        tilt = signal.tilt_from_power(F.col("__p"), self.n_fft, self.sample_rate, self.alpha, self.hammarberg)
        return rows.select(key, "frame", tilt.alias("__t")).select(key, "frame", "__t.*")


FRAME_FEATURES: dict[str, type] = {}


def register_frame_feature(kind: str, made: type) -> None:
    if kind in FRAME_FEATURES:
        raise ValueError(f"frame feature {kind!r} is registered already")
    FRAME_FEATURES[kind] = made


def available_frame_features() -> list[str]:
    return sorted(FRAME_FEATURES)


def build_frame_feature(spec: dict):
    spec = dict(spec)
    kind = spec.pop("type", None)
    if kind is None:
        raise KeyError("a frame feature needs a type")
    if kind not in FRAME_FEATURES:
        raise KeyError(f"unknown frame feature {kind!r}; known: {available_frame_features()}")
    return FRAME_FEATURES[kind](**spec)


def build_frame_features(specs: list[dict]) -> list:
    return [build_frame_feature(s) for s in specs]


register_frame_feature("spectral_tilt", SpectralTilt)

STATISTICS = ("mean", "std", "median", "min", "max")


def frame_set_stats(frames: DataFrame, key: str = "utt_id", statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """frames (key, frame, descriptor, value, voiced): statistics over voiced, unvoiced and all frames.

    A descriptor whose name holds ``_sma3nz`` is undefined outside voiced frames, so only voiced statistics are given."""
    sets = F.when(F.col("descriptor").contains("_sma3nz"), F.array(F.when(F.col("voiced"), "voiced"))).otherwise(F.array(F.when(F.col("voiced"), "voiced").when(~F.col("voiced"), "unvoiced"), F.lit("all")))
    rows = frames.select(key, "descriptor", F.when(~F.isnan("value"), F.col("value")).alias("value"), F.explode(F.array_compact(sets)).alias("frame_set"))
    made = {"mean": F.avg("value"), "std": F.stddev_samp("value"), "median": F.median("value"), "min": F.min("value"), "max": F.max("value")}
    return rows.groupBy(key, "descriptor", "frame_set").agg(*[made[s].alias(s) for s in statistics], F.count("value").alias("n"))


def pitch_summary(frames: DataFrame, key: str = "utt_id") -> DataFrame:
    """frames (key, frame, f0_hz: null or NaN where unvoiced): median in Hz, mean and spread in semitones, voicing."""
    f = F.when(~F.isnan("f0_hz") & (F.col("f0_hz") > 0), F.col("f0_hz"))
    st = hz_to_semitones(f)
    out = frames.groupBy(key).agg(F.median(f).alias("median_hz"), F.avg(st).alias("mean_semitones"), F.stddev_samp(st).alias("sd_semitones"), F.count(F.lit(1)).alias("n_frames"), F.count(f).alias("n_voiced_frames"))
    return out.withColumn("voiced_fraction", F.try_divide("n_voiced_frames", "n_frames")).withColumn("mean_hz_of_semitones", semitones_to_hz(F.col("mean_semitones")))


def formant_summary(frames: DataFrame, key: str = "utt_id") -> DataFrame:
    """frames (key, frame, formant, hz, bandwidth, voiced): per formant, over voiced frames."""
    hz = F.when(F.col("voiced") & ~F.isnan("hz"), F.col("hz"))
    return frames.groupBy(key, "formant").agg(F.median(hz).alias("median_hz"), F.stddev_samp(hz).alias("sd_hz"), F.median(F.when(hz.isNotNull() & ~F.isnan("bandwidth"), F.col("bandwidth"))).alias("bandwidth_hz"), F.count(hz).alias("n_frames"))


def track_times(frames: DataFrame, t0_s: float, time_step_s: float) -> DataFrame:
    return frames.withColumn("time_s", F.lit(t0_s) + F.col("frame") * F.lit(time_step_s))
