"""Audio, frames, planning and resuming."""

import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvoice.functions import signal
from sparkvoice.operators import frames, select
from sparkvoice.plans import extract
from sparkvoice.sources import audio, manifest, results
from sparkvoice.streaming.incremental import extract_stream

RATE = 16_000


def tone(f, seconds, amplitude, rate=RATE):
    return (amplitude * np.sin(2 * math.pi * f * np.arange(int(seconds * rate)) / rate)).astype(float)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("audio")
    rows = [("a_real", "a", "real", 1.0, 0.1, "hello"), ("a_conv", "a", "converted", 1.0, 0.4, ""), ("b_real", "b", "real", 0.5, 0.2, "world")]
    lines = ["utt_id,signal_path,group_id,condition,corpus,subject_id,text"]
    for u, g, c, s, amp, t in rows:
        with wave.open(str(d / f"{u}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
            w.writeframes(struct.pack(f"<{int(s * RATE)}h", *[int(round(32767 * x)) for x in tone(200, s, amp)]))
        lines.append(f"{u},{u}.wav,{g},{c},test,s1,{t}")
    (d / "manifest.csv").write_text("\n".join(lines) + "\n")
    return manifest.load_manifest(spark, f"file://{d}/manifest.csv", dataset_roots={"test": str(d)}), d


def test_manifest_errors(spark, corpus):
    df, d = corpus
    with pytest.raises(ValueError, match="condition"):
        manifest.check_manifest(df.drop("condition"))
    with pytest.raises(ValueError, match="a_real"):
        manifest.check_manifest(df.unionAll(df.limit(1)))
    with pytest.raises(ValueError):
        manifest.resolve_paths(df, {"test": "x"}, "y")
    assert {r[0] for r in select.with_transcript(df).collect()} == {"a_real", "b_real"}
    assert manifest.limited(df, 2).count() == 2


def test_level_of_files(spark, corpus):
    df, _ = corpus
    waves = audio.read_audio(spark, df).select("utt_id", "sample_rate", "channels")
    table, artifacts = extract.run_metrics(df, waves, extract.build_metrics([{"type": "level"}]), carry=["corpus"])
    got = {r["utt_id"]: r for r in table.collect()}
    assert got["a_real"]["level.duration_s"] == 1.0 and got["b_real"]["level.duration_s"] == 0.5
    assert got["a_conv"]["level.rms_dbfs"] - got["a_real"]["level.rms_dbfs"] == pytest.approx(20 * math.log10(4), abs=0.01)
    assert got["a_real"]["level.crest_factor_db"] == pytest.approx(3.01, abs=0.02) and got["a_real"]["corpus"] == "test"
    region = audio.read_audio(spark, df.filter("utt_id = 'a_real'").withColumns({"start_s": F.lit(0.25), "end_s": F.lit(0.5)}))
    assert region.select(F.size(F.col("channels")[0])).first()[0] == 4000


def test_preparation(spark):
    df = spark.createDataFrame([("u", [[0.1] * 8000, [0.3] * 8000], 8000), ("z", [[0.0] * 10, [0.0] * 10], 16000)], "utt_id string, channels array<array<double>>, sample_rate int")
    got = {r["utt_id"]: r for r in extract.prepare(df, extract.Requirements(level_norm_dbfs=-20.0)).collect()}
    assert len(got["u"]["wav"]) == 16000 and got["u"]["sample_rate"] == 16000
    assert 10 * math.log10(np.mean(np.square(got["u"]["wav"]))) == pytest.approx(-20, abs=0.01)
    assert set(got["z"]["wav"]) == {0.0}


def test_registry_and_grouping():
    ms = extract.build_metrics([{"type": "asr_whisper"}, {"type": "speaker_ecapa"}, {"type": "level"}, {"type": "f0_praat"}, {"type": "egemaps"}])
    assert [sorted(m.name for m in g) for g in extract.group_by_requirements(ms).values()] == [["asr_whisper", "speaker_ecapa"], ["level"], ["egemaps", "f0_praat"]]
    with pytest.raises(KeyError):
        extract.build_metric({"type": "no"})
    with pytest.raises(KeyError):
        extract.build_metric({})
    with pytest.raises(ValueError):
        extract.build_metrics([{"type": "level"}, {"type": "level"}])
    with pytest.raises(ValueError):
        extract.register_metric("level")(extract.Level)
    assert "mos_utmos" in extract.available_metrics()


def test_backends(spark):
    long, short, none = [0.1] * (RATE * 3), [0.1] * 300, []
    df = spark.createDataFrame([("long", long, RATE, "m"), ("short", short, RATE, None), ("none", none, RATE, None)], "utt_id string, wav array<double>, sample_rate int, sex string")
    asr = extract.Whisper(backend=lambda ws, r, lang: [(f"{len(w)} samples", -0.5) for w in ws], max_duration_s=2.0).compute(df)
    got = {r["utt_id"]: r for r in asr.collect()}
    assert (got["long"]["status"], got["short"]["status"], got["none"]["status"]) == ("too_long", "ok", "empty_audio")
    assert got["short"]["hypothesis"] == "300 samples" and got["short"]["n_words"] == 2 and got["long"]["hypothesis"] is None
    emb = {r["utt_id"]: r for r in extract.Ecapa(backend=lambda ws, r: [[3.0, 4.0] for _ in ws], dim=2).compute(df).collect()}
    assert emb["long"]["embedding"] == pytest.approx([0.6, 0.8]) and emb["long"]["status"] == "ok" and emb["short"]["status"] == "short" and emb["none"]["status"] == "empty_audio"
    mos = {r["utt_id"]: r["score"] for r in extract.Utmos(backend=lambda w, r: 3.5).compute(df).collect()}
    assert mos == {"long": 3.5, "short": None, "none": None}
    with pytest.raises(Exception, match="not installed"):
        extract.Utmos().compute(df).collect()


def test_pitch(spark):
    wav = np.concatenate([tone(120, 1.0, 0.3), np.zeros(RATE)])
    df = spark.createDataFrame([("u", wav.tolist(), RATE, " Male")], "utt_id string, wav array<double>, sample_rate int, sex string")
    r = extract.PraatPitch(backend=extract.autocorrelation_pitch).compute(df).first()
    assert r["median_hz"] == pytest.approx(120, abs=2) and (r["fmin_hz"], r["fmax_hz"], r["range_source"]) == (60.0, 400.0, "sex")
    assert r["voiced_fraction"] == pytest.approx(0.5, abs=0.05) and r["mean_semitones"] == pytest.approx(12 * math.log2(120 / 27.5), abs=0.3)
    assert extract.SmilePitch(backend=extract.autocorrelation_pitch).compute(df).first()["range_source"] == "backend_fixed"


def test_resume(spark, corpus):
    df, _ = corpus
    waves = spark.createDataFrame([(u, [0.1] * 100, RATE) for u in ("a_real", "a_conv", "b_real")], "utt_id string, wav array<double>, sample_rate int")
    before = spark.createDataFrame([("a_real", -1.0), ("a_conv", None)], "utt_id string, `level.rms_dbfs` double")
    assert {r[0] for r in select.pending(df, before, "level").select("utt_id").collect()} == {"a_conv", "b_real"}
    table, _ = extract.run_metrics(df, waves, extract.build_metrics([{"type": "level"}]), previous=before)
    got = {r["utt_id"]: r["level.rms_dbfs"] for r in table.collect()}
    assert got["a_real"] == -1.0 and got["b_real"] == pytest.approx(-20.0) == got["a_conv"]
    need = extract.Requirements(needs_intervals=True)
    m = extract.Level()
    m.requirements = need
    with pytest.raises(NotImplementedError):
        extract.run_metrics(df, waves, [m])


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("u", 1.0, [1.0, 2.0]), ("v", 2.0, None)], "utt_id string, s double, embedding array<double>")
    table, arrays = results.split_features(df, "m")
    assert table.columns == ["utt_id", "m.s"]
    results.write_artifacts(arrays, f"file://{tmp_path}/a")
    back = results.read_artifacts(spark, f"file://{tmp_path}/a")
    assert [(r["utt_id"], list(r["value"])) for r in results.array_features(back, "m.embedding").collect()] == [("u", [1.0, 2.0])]
    with pytest.raises(KeyError, match="m.embedding"):
        results.array_features(back, "m.other")
    assert results.read_artifacts(spark, f"file://{tmp_path}/none").count() == 0 and results.read_results(spark, f"file://{tmp_path}/none") is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("u1\nu2\n")
    run = lambda: extract_stream(spark.readStream.schema("utt_id string").csv(f"file://{tmp_path}/in"), lambda d: d.withColumn("m.x", F.lit(1.0)), "m", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    run()
    (tmp_path / "in" / "2.csv").write_text("u2\nu3\n")
    run()
    assert sorted(r[0] for r in spark.read.parquet(f"file://{tmp_path}/out").select("utt_id").collect()) == ["u1", "u2", "u3"]


def test_framing(spark):
    df = spark.createDataFrame([("u", [float(i) for i in range(40)]), ("e", [1.0] * 3)], "utt_id string, wav array<double>")
    got = {r[0]: r[1] for r in df.select("utt_id", signal.frame_signal(F.col("wav"), 8, 16)).collect()}
    padded = np.pad(np.arange(40.0), 8)
    assert [list(f) for f in got["u"]] == [padded[k * 8 : k * 8 + 16].tolist() for k in range(5)] and got["e"] == []
    causal = df.select("utt_id", signal.frame_signal(F.col("wav"), 8, 16, causal=True)).first()[1]
    assert list(causal[0]) == [float(i) for i in range(16)]
    assert frames.FrameGrid(320, RATE).n_frames(16319) == 50


def test_spectral_tilt(spark):
    t = np.arange(RATE) / RATE
    two = lambda a: (np.cos(2 * math.pi * 500 * t) + a * np.cos(2 * math.pi * 3000 * t)).tolist()
    df = spark.createDataFrame([("even", two(1.0)), ("low", two(0.1)), ("silent", [0.0] * RATE)], "utt_id string, wav array<double>")
    out = frames.SpectralTilt().compute(df, frames.FrameGrid(320, RATE))
    mid = {r["utt_id"]: r for r in out.filter("frame = 25").collect()}
    assert mid["even"]["alpha_ratio_db"] == pytest.approx(0, abs=0.1) and mid["low"]["alpha_ratio_db"] == pytest.approx(-20, abs=0.3)
    assert mid["low"]["hammarberg_db"] == pytest.approx(20, abs=1.2) and mid["silent"]["alpha_ratio_db"] is None
    assert out.filter("utt_id = 'even'").count() == 50
    with pytest.raises(ValueError):
        frames.SpectralTilt(n_fft=256)
    with pytest.raises(ValueError):
        frames.SpectralTilt().compute(df, frames.FrameGrid(320, 8000))
    assert frames.build_frame_feature({"type": "spectral_tilt"}).params()["n_fft"] == 512
    with pytest.raises(KeyError):
        frames.build_frame_feature({"type": "none"})


def test_frame_sets(spark):
    rows = [("u", i, d, float(i), i % 2 == 0) for i in range(6) for d in ("loud", "F1_sma3nz")]
    got = {(r["descriptor"], r["frame_set"]): (r["mean"], r["n"]) for r in frames.frame_set_stats(spark.createDataFrame(rows, "utt_id string, frame int, descriptor string, value double, voiced boolean")).collect()}
    assert got == {("loud", "all"): (2.5, 6), ("loud", "voiced"): (2.0, 3), ("loud", "unvoiced"): (3.0, 3), ("F1_sma3nz", "voiced"): (2.0, 3)}


def test_run_from_configuration(spark, corpus, tmp_path):
    from sparkvoice.run import last_run, run_config, runs

    _, d = corpus
    config = {"data": {"manifest": f"file://{d}/manifest.csv", "dataset_root": str(d), "carry_columns": ["subject_id"], "limit": 2}, "runner": {"resume": True}, "metrics": [{"type": "level"}, {"type": "speaker_ecapa", "dim": 2}]}
    out, seen = f"file://{tmp_path}/out", {"speaker_ecapa": lambda ws, r: [[3.0, 4.0]] * len(ws)}
    first = run_config(spark, config, out, seen)
    assert first.count() == 2 and "level.rms_dbfs" in first.columns and "subject_id" in first.columns
    config["data"].pop("limit")
    assert run_config(spark, config, out, seen).filter("`level.rms_dbfs` is not null and `speaker_ecapa.status` is not null").count() == 3
    assert runs(spark, out) == [1, 2] and last_run(spark, out)[1].count() == 3
    with pytest.raises(ValueError):
        run_config(spark, {"data": {}}, out)
