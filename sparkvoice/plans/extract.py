"""Planning of extraction: metrics say what audio they need, rows are prepared once for each distinct need.

Back-ends that are not installed plug in as functions; their guards, status flags and summaries are here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, signal
from ..operators.select import already_done, carried, name, with_transcript
from ..sources.audio import resample
from ..sources.results import assemble, split_features


@dataclass(frozen=True)
class Requirements:
    sample_rate: int | None = 16_000
    mono: bool = True
    level_norm_dbfs: float | None = None
    needs_text: bool = False
    needs_intervals: bool = False
    meta_columns: tuple[str, ...] = ()


def _resampled(wav: Column, rate: Column, target: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(wavs: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([resample(np.asarray(w, dtype=np.float64), int(r), target) if w is not None else None for w, r in zip(wavs, rates, strict=True)])

    return run(wav, rate)


def prepare(df: DataFrame, need: Requirements) -> DataFrame:
    """wav and sample_rate as a requirement asks: resampled, then mixed to one channel, then set to a level.

    Rows hold ``wav`` (one channel) or ``channels`` with an optional ``channel``."""
    if "channels" in df.columns:
        channel = F.col("channel") if "channel" in df.columns else F.lit(None).cast("int")
        df = df.withColumn("wav", signal.select_channel(F.col("channels"), channel)).drop("channels")
    wav = F.transform("wav", lambda x: x.cast("double"))
    if need.sample_rate is not None:
        wav = F.when(F.col("sample_rate") == need.sample_rate, wav).otherwise(_resampled(F.col("wav").cast("array<double>"), F.col("sample_rate"), need.sample_rate))
        df = df.withColumn("wav", wav).withColumn("sample_rate", F.lit(need.sample_rate))
    else:
        df = df.withColumn("wav", wav)
    if need.level_norm_dbfs is not None:
        df = df.withColumn("wav", signal.rms_normalize(F.col("wav"), need.level_norm_dbfs))
    return df


class Metric:
    """compute: prepared rows (utt_id, wav, sample_rate, text and meta columns) -> utt_id and features, a row each."""

    kind = ""
    requirements = Requirements()

    def __init__(self, name: str | None = None):
        self.name = name or self.kind

    def compute(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


METRICS: dict[str, type[Metric]] = {}


def register_metric(kind: str) -> Callable[[type[Metric]], type[Metric]]:
    def add(made: type[Metric]) -> type[Metric]:
        if kind in METRICS:
            raise ValueError(f"metric {kind!r} is registered already")
        made.kind = kind
        METRICS[kind] = made
        return made

    return add


def available_metrics() -> list[str]:
    return sorted(METRICS)


def build_metric(spec: dict) -> Metric:
    spec = dict(spec)
    kind = spec.pop("type", None)
    if kind is None:
        raise KeyError("a metric needs a type")
    if not METRICS:
        raise KeyError("no metric is registered; import the module that defines them")
    if kind not in METRICS:
        raise KeyError(f"unknown metric {kind!r}; known: {available_metrics()}")
    return METRICS[kind](**spec)


def build_metrics(specs: Iterable[dict]) -> list[Metric]:
    made = [build_metric(s) for s in specs]
    names = [m.name for m in made]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"metric names are used twice: {twice}")
    return made


def group_by_requirements(metrics: Iterable[Metric]) -> dict[Requirements, list[Metric]]:
    """Metrics by the audio they need; the metadata they read does not part them."""
    out: dict[Requirements, list[Metric]] = {}
    for m in metrics:
        out.setdefault(replace(m.requirements, meta_columns=()), []).append(m)
    return out


def meta_columns(metrics: Iterable[Metric], carry: Iterable[str] = ()) -> list[str]:
    return list(dict.fromkeys([*carry, *[c for m in metrics for c in m.requirements.meta_columns]]))


def run_metrics(manifest: DataFrame, audio: DataFrame, metrics: list[Metric], carry: Iterable[str] = (), previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The results table and the artifacts of all metrics.

    audio: utt_id with wav or channels and sample_rate. Rows done before (``previous``) are not computed again: they
    are taken out before audio is prepared, and their values are kept."""
    results, artifacts = manifest.select("utt_id"), None
    for need, group in group_by_requirements(metrics).items():
        if need.needs_intervals:
            raise NotImplementedError("interval requirements are not supported")
        rows = with_transcript(manifest, need.needs_text)
        meta = [c for c in meta_columns(group) if c in manifest.columns]
        done = [already_done(previous, m.name) if previous is not None else None for m in group]
        if previous is not None:
            # A row is prepared if any metric of the group still lacks it.
            every = done[0]
            for d in done[1:]:
                every = every.join(d, "utt_id", "left_semi")
            rows = rows.join(every, "utt_id", "left_anti")
        keep = ["utt_id", *carried(manifest, [*(["text"] if "text" in manifest.columns else []), *(["channel"] if "channel" in manifest.columns else []), *meta], ("utt_id",))]
        prepared = prepare(rows.select(*[name(c) for c in keep]).join(audio, "utt_id"), need).persist()
        for m, d in zip(group, done, strict=True):
            todo = prepared if d is None else prepared.join(d, "utt_id", "left_anti")
            table, arrays = split_features(m.compute(todo), m.name)
            if previous is not None:
                old = [c for c in previous.columns if c in table.columns and c != "utt_id"]
                if old:
                    before = previous.join(d, "utt_id", "left_semi").select("utt_id", *[name(c) for c in old])
                    table = table.unionByName(before, allowMissingColumns=True)
            results = results.join(table, "utt_id", "left")
            artifacts = arrays if artifacts is None else artifacts.unionByName(arrays)
    if previous is not None:
        gone = [c for c in previous.columns if "." in c and c not in results.columns]
        if gone:
            results = results.join(previous.select("utt_id", *[name(c) for c in gone]), "utt_id", "left")
    return assemble(manifest, results, carry), artifacts


@register_metric("level")
class Level(Metric):
    requirements = Requirements(sample_rate=None)

    def compute(self, df: DataFrame) -> DataFrame:
        w = F.col("wav")
        df = df.select("utt_id", "sample_rate", signal.duration_s(w, F.col("sample_rate")).alias("duration_s"), signal.rms_dbfs(w).alias("rms_dbfs"), signal.peak_dbfs(w).alias("peak_dbfs"))
        return df.withColumn("crest_factor_db", F.col("peak_dbfs") - F.col("rms_dbfs"))


Track = Callable[[np.ndarray, int, float, float], tuple[np.ndarray, float, float]]


@dataclass
class _Missing:
    """Stands for a back-end that is not installed."""

    what: str

    def __call__(self, *_):
        raise ImportError(f"{self.what} is not installed; pass a function as backend")


def _rows(df: DataFrame, schema: str, each: Callable[[dict], dict]) -> DataFrame:
    """A Python function of each row, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([each(r) for r in pdf.to_dict("records")], columns=[p.strip().split(" ")[0].strip("`") for p in _split(schema)])

    return df.mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    return [p for p in schema.split(", ") if p]


class Pitch(Metric):
    """backend(wav, sample_rate, fmin, fmax) -> (f0 in Hz with NaN where unvoiced, t0_s, time_step_s)."""

    requirements = Requirements(level_norm_dbfs=-27.0, meta_columns=("sex",))
    fixed: tuple[float, float] | None = None

    def __init__(self, name: str | None = None, backend: Track | None = None, fmin_hz: float | None = None, fmax_hz: float | None = None):
        super().__init__(name)
        self.backend, self.chosen = backend or _Missing(self.kind), (fmin_hz, fmax_hz)

    def bounds(self, df: DataFrame) -> tuple[Column, Column, Column]:
        if self.fixed:
            return F.lit(self.fixed[0]), F.lit(self.fixed[1]), F.lit("backend_fixed")
        if None not in self.chosen:
            return F.lit(float(self.chosen[0])), F.lit(float(self.chosen[1])), F.lit("config")
        sex = F.col("sex") if "sex" in df.columns else F.lit(None).cast("string")
        lo, hi = ({k: v[i] for k, v in scalars.PITCH_RANGES.items()} for i in (0, 1))
        return scalars.by_sex(sex, lo), scalars.by_sex(sex, hi), scalars.range_source(sex)

    def compute(self, df: DataFrame) -> DataFrame:
        lo, hi, source = self.bounds(df)
        df = df.select("utt_id", "wav", "sample_rate", lo.alias("fmin_hz"), hi.alias("fmax_hz"), source.alias("range_source"))
        track = self.backend

        def each(r: dict) -> dict:
            f0, t0, step = track(np.asarray(r["wav"], dtype=np.float64), int(r["sample_rate"]), r["fmin_hz"], r["fmax_hz"])
            f0 = np.asarray(f0, dtype=np.float64)
            return {k: r[k] for k in ("utt_id", "fmin_hz", "fmax_hz", "range_source")} | {"t0_s": float(t0), "time_step_s": float(step), "contour.f0_hz": list(f0)}

        out = _rows(df, "utt_id string, fmin_hz double, fmax_hz double, range_source string, t0_s double, time_step_s double, `contour.f0_hz` array<double>", each)
        f = F.filter(F.col("`contour.f0_hz`"), lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0))
        st = F.transform(f, scalars.hz_to_semitones)
        n = F.size(f)
        mean = F.aggregate(st, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
        spread = F.sqrt(F.aggregate(F.transform(st, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.nullif(n - 1, F.lit(0)))
        s = F.sort_array(f)
        median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
        total = F.size("`contour.f0_hz`")
        return out.select(
            "utt_id", F.when(n > 0, median).alias("median_hz"), F.when(n > 0, mean).alias("mean_semitones"), F.when(n > 1, spread).alias("sd_semitones"), total.cast("long").alias("n_frames"), n.cast("long").alias("n_voiced_frames"),
            F.try_divide(n, total).alias("voiced_fraction"), F.lit(self.kind).alias("tracker"), "fmin_hz", "fmax_hz", "range_source", "t0_s", "time_step_s", "`contour.f0_hz`",
            F.transform(F.col("`contour.f0_hz`"), lambda x: (x.isNotNull() & ~F.isnan(x)).cast("double")).alias("contour.voiced"),
        )


@register_metric("f0_praat")
class PraatPitch(Pitch):
    pass


@register_metric("f0_swiftf0")
class SwiftPitch(Pitch):
    pass


@register_metric("f0_opensmile")
class SmilePitch(Pitch):
    requirements = Requirements(level_norm_dbfs=-27.0)
    fixed = (55.0, 1000.0)


def autocorrelation_pitch(wav: np.ndarray, rate: int, fmin: float, fmax: float, step_s: float = 0.01, window_s: float = 0.04, least: float = 0.5) -> tuple[np.ndarray, float, float]:
    """A plain autocorrelation tracker. It is no substitute for the trackers above and registered under none of them."""
    hop, size = round(step_s * rate), round(window_s * rate)
    out = []
    for at in range(0, max(0, len(wav) - size + 1), hop):
        x = wav[at : at + size] - wav[at : at + size].mean()
        power = np.fft.rfft(x, 2 * size)
        ac = np.fft.irfft(np.abs(power) ** 2)[:size]
        lo, hi = int(rate / fmax), min(size - 1, int(rate / fmin))
        if ac[0] <= 0 or hi <= lo:
            out.append(np.nan)
            continue
        norm = ac[: hi + 1] / ac[0] * size / (size - np.arange(hi + 1))
        # The first peak nearly as high as the highest, so a multiple of the period does not win.
        inner = norm[lo : hi + 1]
        peaks = np.flatnonzero((inner[1:-1] >= inner[:-2]) & (inner[1:-1] >= inner[2:]) & (inner[1:-1] >= 0.9 * inner.max())) + 1
        k = lo + int(peaks[0] if len(peaks) else inner.argmax())
        if norm[k] < least:
            out.append(np.nan)
            continue
        shift = 0.0
        if 0 < k < hi:
            a, b, c = norm[k - 1], norm[k], norm[k + 1]
            shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
        out.append(rate / (k + shift))
    return np.array(out), window_s / 2, step_s


@register_metric("egemaps")
class Egemaps(Metric):
    """backend(wav, sample_rate) -> (descriptor names, (frames, descriptors) values, voiced mask or None)."""

    requirements = Requirements(level_norm_dbfs=-27.0)

    def __init__(self, name: str | None = None, backend=None, statistics: tuple[str, ...] = ("mean", "std", "median", "min", "max"), descriptors: tuple[str, ...] = ()):
        super().__init__(name)
        self.backend, self.statistics, self.descriptors = backend or _Missing("egemaps"), statistics, descriptors

    def compute(self, df: DataFrame) -> DataFrame:
        read, stats, names = self.backend, self.statistics, self.descriptors
        made = {"mean": np.mean, "std": lambda v: np.std(v, ddof=1) if len(v) > 1 else np.nan, "median": np.median, "min": np.min, "max": np.max}
        keys = [(d, s, st) for d in names for s in (("voiced",) if "_sma3nz" in d else ("voiced", "unvoiced", "all")) for st in stats]

        def each(r: dict) -> dict:
            wav = np.asarray(r["wav"], dtype=np.float64)
            have, values, voiced = read(wav, int(r["sample_rate"]))
            masks = {"all": np.ones(len(values), bool)} | ({"voiced": voiced, "unvoiced": ~voiced} if voiced is not None else {})
            peak = 20 * np.log10(np.abs(wav).max()) if len(wav) and np.abs(wav).max() > 0 else None
            out = {"utt_id": r["utt_id"], "n_frames": len(values), "n_voiced_frames": int(voiced.sum()) if voiced is not None else -1, "voiced_fraction": float(voiced.mean()) if voiced is not None and len(voiced) else None, "peak_dbfs": peak, "above_full_scale": peak is not None and peak > 0}
            for d, s, st in keys:
                v = values[masks[s], list(have).index(d)] if s in masks and d in have else np.zeros(0)
                v = v[~np.isnan(v)]
                x = float(made[st](v)) if len(v) else None
                out[f"{d}_{s}_{st}"] = x if x == x else None
            return out

        schema = "utt_id string, n_frames long, n_voiced_frames long, voiced_fraction double, peak_dbfs double, above_full_scale boolean" + "".join(f", `{d}_{s}_{st}` double" for d, s, st in keys)
        return _rows(df.select("utt_id", "wav", "sample_rate"), schema, each).withColumn("feature_set", F.lit("eGeMAPSv02"))


@register_metric("formants_praat")
class Formants(Metric):
    """backend(wav, sample_rate, ceiling) -> (times, (formants, frames) Hz, same for bandwidths, voiced mask)."""

    requirements = Requirements(level_norm_dbfs=-27.0, meta_columns=("sex",))

    def __init__(self, name: str | None = None, backend=None, ceiling_hz: float | None = None, n_formants: int = 5, tracked: bool = False, reported: int = 3):
        super().__init__(name)
        self.backend, self.ceiling, self.n, self.tracked, self.reported = backend or _Missing("formants_praat"), ceiling_hz, n_formants, tracked, reported

    def compute(self, df: DataFrame) -> DataFrame:
        sex = F.col("sex") if "sex" in df.columns else F.lit(None).cast("string")
        ceiling = F.lit(float(self.ceiling)) if self.ceiling else scalars.by_sex(sex, scalars.FORMANT_CEILINGS)
        df = df.select("utt_id", "wav", "sample_rate", ceiling.alias("ceiling_hz"), (F.lit("config") if self.ceiling else scalars.range_source(sex)).alias("ceiling_source"))
        read, reported = self.backend, self.reported

        def each(r: dict) -> dict:
            times, hz, width, voiced = read(np.asarray(r["wav"], dtype=np.float64), int(r["sample_rate"]), r["ceiling_hz"])
            out = {k: r[k] for k in ("utt_id", "ceiling_hz", "ceiling_source")}
            out |= {"n_frames": len(times), "n_voiced_frames": int(voiced.sum()), "voiced_fraction": float(voiced.mean()) if len(voiced) else None, "t0_s": float(times[0]) if len(times) else None, "time_step_s": float(times[1] - times[0]) if len(times) > 1 else None, "contour.voiced": [float(v) for v in voiced]}
            for k in range(reported):
                v = voiced & ~np.isnan(hz[k])
                out |= {f"f{k + 1}_median_hz": float(np.median(hz[k][v])) if v.any() else None, f"f{k + 1}_sd_hz": float(np.std(hz[k][v], ddof=1)) if v.sum() > 1 else None, f"f{k + 1}_bandwidth_hz": float(np.nanmedian(width[k][v])) if v.any() else None, f"f{k + 1}_n_frames": int(v.sum()), f"contour.f{k + 1}_hz": list(hz[k])}
            return out

        schema = "utt_id string, ceiling_hz double, ceiling_source string, n_frames long, n_voiced_frames long, voiced_fraction double, t0_s double, time_step_s double, `contour.voiced` array<double>"
        for k in range(1, reported + 1):
            schema += f", f{k}_median_hz double, f{k}_sd_hz double, f{k}_bandwidth_hz double, f{k}_n_frames long, `contour.f{k}_hz` array<double>"
        return _rows(df, schema, each).withColumns({"n_formants": F.lit(self.n), "tracked": F.lit(self.tracked)})


class Recogniser(Metric):
    """backend(list of wavs, sample_rate, language) -> list of (hypothesis, mean log probability)."""

    requirements = Requirements(level_norm_dbfs=-20.0, meta_columns=("language",))
    guard_s, decoder, fixed_language = 30.0, "greedy", None

    def __init__(self, name: str | None = None, backend=None, language: str | None = None, max_duration_s: float | None = -1.0, model_id: str = "", batch_size: int = 8):
        super().__init__(name)
        self.backend, self.language, self.model_id, self.batch_size = backend or _Missing(self.kind), language, model_id, batch_size
        self.guard = self.guard_s if max_duration_s is not None and max_duration_s < 0 else max_duration_s

    def compute(self, df: DataFrame) -> DataFrame:
        d = signal.duration_s(F.col("wav"), F.col("sample_rate"))
        own = F.col("language") if "language" in df.columns else F.lit(None).cast("string")
        if self.fixed_language:
            language, source = F.lit(self.fixed_language), F.lit("backend_fixed")
        elif self.language:
            language, source = F.lit(self.language), F.lit("config")
        else:
            language, source = own, F.when(own.isNotNull(), "metadata").otherwise("detected")
        status = F.when(F.size("wav") == 0, "empty_audio")
        if self.guard is not None:
            status = status.when(d > self.guard, "too_long")
        df = df.select("utt_id", "wav", "sample_rate", d.alias("duration_s"), language.alias("language"), source.alias("language_source"), status.otherwise("ok").alias("status"))
        run, size = self.backend, self.batch_size

        def batches(frames):
            for pdf in frames:
                pdf["hypothesis"], pdf["mean_logprob"] = None, np.nan
                ok = pdf[pdf["status"] == "ok"]
                for (lang, rate), part in ok.groupby(["language", "sample_rate"], dropna=False):
                    for lo in range(0, len(part), size):
                        piece = part.iloc[lo : lo + size]
                        got = run([np.asarray(w, dtype=np.float64) for w in piece["wav"]], int(rate), lang if isinstance(lang, str) else None)
                        if len(got) != len(piece):
                            raise ValueError(f"the backend gave {len(got)} results for {len(piece)} utterances")
                        pdf.loc[piece.index, "hypothesis"] = [g[0] for g in got]
                        pdf.loc[piece.index, "mean_logprob"] = [g[1] for g in got]
                yield pdf[["utt_id", "hypothesis", "mean_logprob", "status", "language", "language_source", "duration_s"]]

        out = df.mapInPandas(batches, "utt_id string, hypothesis string, mean_logprob double, status string, language string, language_source string, duration_s double")
        out = scalars.nan_to_null(out)
        return out.withColumns({"n_words": F.when(F.col("hypothesis").isNotNull(), scalars.word_count(F.col("hypothesis"))), "backend": F.lit(self.kind), "model_id": F.lit(self.model_id), "decoder": F.lit(self.decoder)})


@register_metric("asr_whisper")
class Whisper(Recogniser):
    pass


@register_metric("asr_wav2vec2")
class Wav2vec2(Recogniser):
    requirements = Requirements(level_norm_dbfs=-20.0)
    guard_s, decoder, fixed_language = 60.0, "ctc_greedy", "en"


class Embedder(Metric):
    """backend(list of wavs, sample_rate) -> list of vectors; they are set to length one."""

    requirements = Requirements(level_norm_dbfs=-20.0)
    short_s, frontend, dim = 2.0, "", 192

    def __init__(self, name: str | None = None, backend=None, min_duration_s: float | None = None, model_id: str = "", batch_size: int = 8, dim: int | None = None):
        super().__init__(name)
        self.backend, self.model_id, self.batch_size = backend or _Missing(self.kind), model_id, batch_size
        self.short, self.dim = self.short_s if min_duration_s is None else min_duration_s, dim or self.dim

    def compute(self, df: DataFrame) -> DataFrame:
        d = signal.duration_s(F.col("wav"), F.col("sample_rate"))
        status = F.when(F.size("wav") == 0, "empty_audio").when(d < self.short, "short").otherwise("ok")
        df = df.select("utt_id", "wav", "sample_rate", d.alias("duration_s"), status.alias("status"))
        run, size, dim = self.backend, self.batch_size, self.dim

        def batches(frames):
            for pdf in frames:
                vectors, norms = [np.full(dim, np.nan)] * len(pdf), [np.nan] * len(pdf)
                some = [i for i, s in enumerate(pdf["status"]) if s != "empty_audio"]
                for lo in range(0, len(some), size):
                    part = some[lo : lo + size]
                    got = run([np.asarray(pdf["wav"].iloc[i], dtype=np.float64) for i in part], int(pdf["sample_rate"].iloc[part[0]]))
                    for i, v in zip(part, got, strict=True):
                        v = np.asarray(v, dtype=np.float64)
                        norms[i] = float(np.linalg.norm(v))
                        vectors[i] = v / norms[i] if norms[i] else v
                yield pd.DataFrame({"utt_id": pdf["utt_id"], "embedding": vectors, "embedding_norm": norms, "status": pdf["status"], "duration_s": pdf["duration_s"]})

        out = df.mapInPandas(batches, "utt_id string, embedding array<double>, embedding_norm double, status string, duration_s double")
        return scalars.nan_to_null(out).withColumns({"dim": F.size("embedding"), "backend": F.lit(self.kind), "frontend": F.lit(self.frontend), "model_id": F.lit(self.model_id)})


@register_metric("speaker_ecapa")
class Ecapa(Embedder):
    frontend, dim = "fbank", 192


@register_metric("speaker_wavlm")
class Wavlm(Embedder):
    frontend, dim = "raw", 512


@register_metric("mos_utmos")
class Utmos(Metric):
    """backend(wav, sample_rate) -> score, one utterance at a time, never padded."""

    requirements = Requirements(level_norm_dbfs=-20.0)
    least_samples = 400

    def __init__(self, name: str | None = None, backend=None):
        super().__init__(name)
        self.backend = backend or _Missing("mos_utmos")

    def compute(self, df: DataFrame) -> DataFrame:
        run, least = self.backend, self.least_samples
        each = lambda r: {"utt_id": r["utt_id"], "score": float(run(np.asarray(r["wav"], dtype=np.float64), int(r["sample_rate"]))) if len(r["wav"]) >= least else None}
        return scalars.nan_to_null(_rows(df.select("utt_id", "wav", "sample_rate"), "utt_id string, score double", each))
