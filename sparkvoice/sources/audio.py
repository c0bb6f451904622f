"""Audio regions. WAV files are decoded from the bytes that Spark reads, so any file system of Spark serves."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = "sample_rate int, channels array<array<float>>"


def decode_wav(content: bytes, start_s: float | None = None, end_s: float | None = None) -> tuple[int, np.ndarray]:
    """Sample rate and (channels, samples) of a PCM file; only the region's frames are unpacked."""
    with wave.open(io.BytesIO(content)) as w:
        rate, n, width, chans = w.getframerate(), w.getnframes(), w.getsampwidth(), w.getnchannels()
        first = 0 if start_s is None or start_s != start_s else min(n, round(start_s * rate))
        last = n if end_s is None or end_s != end_s else min(n, round(end_s * rate))
        w.setpos(first)
        raw = w.readframes(max(0, last - first))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return rate, x.reshape(-1, chans).T


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling by the Fourier transform."""
    if rate == target or not len(x):
        return x
    n = round(len(x) * target / rate)
    spectrum = np.fft.rfft(x)
    keep = min(len(spectrum), n // 2 + 1)
    out = np.zeros(n // 2 + 1, dtype=complex)
    out[:keep] = spectrum[:keep]
    return np.fft.irfft(out, n) * (n / len(x))


def read_audio(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with sample_rate and channels of each row's region (start_s to end_s where given)."""
    for c, kind in (("start_s", "double"), ("end_s", "double")):
        if c not in manifest.columns:
            manifest = manifest.withColumn(c, F.lit(None).cast(kind))
    paths = manifest.select("signal_path").distinct()
    folders = [r[0] for r in paths.select(F.regexp_replace("signal_path", "/[^/]*$", "").alias("d")).distinct().collect()]
    files = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", "^file:/*", "/").alias("__path"), "content")

    @F.pandas_udf(AUDIO)
    def decode(content: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = [decode_wav(c, s, e) for c, s, e in zip(content, start, end, strict=True)]
        return pd.DataFrame({"sample_rate": [r[0] for r in rows], "channels": [list(r[1]) for r in rows]})

    met = manifest.join(files, F.regexp_replace("signal_path", "^file:/*", "/") == F.col("__path"))
    return met.withColumn("__audio", decode("content", "start_s", "end_s")).drop("content", "__path").select("*", "__audio.*").drop("__audio")


def in_memory(spark: SparkSession, utterances: list[dict]) -> DataFrame:
    """utt_id, wav, sample_rate, text, meta from plain rows."""
    schema = "utt_id string, wav array<float>, sample_rate int, text string, meta map<string,string>"
    return spark.createDataFrame([(u["utt_id"], u["wav"], u["sample_rate"], u.get("text"), u.get("meta") or {}) for u in utterances], schema)
