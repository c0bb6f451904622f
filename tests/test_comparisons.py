"""Known answers of the comparison layer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvoice.functions import scalars, text, vec
from sparkvoice.operators import contrasts, displacement, figures, select, speaker, wer


@pytest.fixture(scope="module")
def contrast(spark):
    rows = [("g1", "real_src", 100.0), ("g1", "converted", 130.0), ("g1", "real_tgt", 140.0), ("g2", "real_src", 200.0), ("g2", "converted", 200.0), ("g2", "real_tgt", 240.0)]
    return spark.createDataFrame(rows, "group_id string, condition string, f0 double")


def test_recovery(contrast):
    wide = contrasts.to_wide(contrast, ["f0"])
    got = {r[0]: r[1] for r in wide.select("group_id", scalars.recovery_rate(F.col("`real_src.f0`"), F.col("`converted.f0`"), F.col("`real_tgt.f0`"))).collect()}
    assert got == {"g1": 0.75, "g2": 0.0}
    small = wide.select(scalars.recovery_rate(F.col("`real_src.f0`"), F.col("`converted.f0`"), F.col("`real_src.f0`") + 0.2, 1.0).alias("r")).collect()
    assert all(r["r"] is None for r in small)


def test_wide_refuses_duplicates_and_missing_columns(contrast):
    with pytest.raises(ValueError, match="g1"):
        contrasts.to_wide(contrast.unionAll(contrast.limit(1)), ["f0"])
    with pytest.raises(KeyError):
        contrasts.to_wide(contrast, ["nothing"])


def test_slopes(spark):
    rows = [("s1", float(x), 1.0 * x + 5) for x in range(3)] + [("s2", float(x), 2.0 * x) for x in range(3)] + [("s3", 1.0, float(y)) for y in range(4)] + [("s4", 1.0, 2.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "subject_id string, x double, y double")
    got = {r["subject_id"]: (round(r["slope"], 9), round(r["r"], 9), r["n"]) for r in contrasts.slope_vs_target(df, "y", "x").collect()}
    assert got == {"s1": (1.0, 1.0, 3), "s2": (2.0, 1.0, 3)}
    flat = spark.createDataFrame([("a", float(x), 7.0) for x in range(4)], "subject_id string, x double, y double")
    assert contrasts.slope_vs_target(flat, "y", "x").first()["r"] is None
    assert contrasts.slope_vs_target(df, "y", "x", None).first()["__group"] == "all"


def test_bootstrap(spark):
    rows = [(f"c{k:02d}", float(10 * k)) for k in range(10) for _ in range(20)]
    df = spark.createDataFrame(rows, "cluster string, v double")
    r = contrasts.cluster_bootstrap_ci(df, "v", "cluster", n_boot=500).first()
    rng, means = np.random.default_rng(0), []
    for _ in range(500):
        means.append((10.0 * rng.integers(0, 10, size=10)).mean())
    assert (r["estimate"], r["n_clusters"], r["n"]) == (45.0, 10, 200)
    np.testing.assert_allclose([r["ci_low"], r["ci_high"]], np.quantile(means, [0.025, 0.975]))
    narrow = contrasts.cluster_bootstrap_ci(df.withColumn("cluster", F.monotonically_increasing_id().cast("string")), "v", "cluster", n_boot=500).first()
    assert r["ci_high"] - r["ci_low"] > 2 * (narrow["ci_high"] - narrow["ci_low"])
    holes = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", 4.0)], "cluster string, v double")
    assert contrasts.cluster_bootstrap_ci(holes, "v", "cluster", n_boot=10).first()["n"] == 3
    assert contrasts.cluster_bootstrap_ci(holes, "v", "cluster", statistic=np.median, n_boot=10).first()["estimate"] == 2.0
    with pytest.raises(ValueError):
        contrasts.cluster_bootstrap_ci(holes.filter("v is null"), "v", "cluster")


@pytest.fixture(scope="module")
def asr(spark):
    rows = [("u1", "g1", "real", "the quick fox", "the quick fox", "ok", "s1"), ("u2", "g1", "converted", "the quick fox", "the quiet fox", "ok", "s1"),
            ("u3", "g2", "real", "hello world", "hello world", "ok", "s2"), ("u4", "g2", "converted", "hello world", "hello word", "ok", "s2")]
    return spark.createDataFrame(rows, "utt_id string, group_id string, condition string, text string, `asr.hypothesis` string, `asr.status` string, subject_id string")


def test_transcription_errors(asr):
    for how in ({"reference_column": "text"}, {"reference_condition": "real"}):
        errors = wer.transcription_errors(asr, "asr.hypothesis", normalizer="basic", carry=["subject_id"], **how)
        pooled = {r["condition"]: (r["n_err"], r["n_ref"], r["wer"]) for r in wer.pooled_wer(errors, "condition").collect()}
        assert pooled == {"converted": (2, 5, 0.4), "real": (0, 5, 0.0)}
    flagged = asr.withColumn("asr.status", F.when(F.col("utt_id") == "u4", None).otherwise(F.col("`asr.status`")))
    assert wer.transcription_errors(flagged, "asr.hypothesis", "text", normalizer="basic").count() == 3
    with pytest.raises(ValueError):
        wer.transcription_errors(asr, "asr.hypothesis", normalizer="basic")
    with pytest.raises(ValueError, match="g1"):
        wer.transcription_errors(asr.unionAll(asr.limit(1)), "asr.hypothesis", reference_condition="real", normalizer="basic")
    assert wer.transcription_errors(asr.filter("utt_id <> 'u3'"), "asr.hypothesis", reference_condition="real", normalizer="basic").count() == 2


@pytest.mark.parametrize("ref,hyp,want", [
    ("the quick brown fox", "the quick brown fox", (0, 0, 0)), ("the quick brown fox", "the slow brown fox", (1, 0, 0)), ("the quick brown fox", "the brown fox", (0, 1, 0)),
    ("the quick brown fox", "the very quick brown fox", (0, 0, 1)), ("the quick brown fox", "", (0, 4, 0)), ("", "invented words here", (0, 0, 3)), ("", "", (0, 0, 0)),
])
def test_edit_split(ref, hyp, want):
    assert text.edit_split(ref.split(), hyp.split()) == want


def test_distance_agrees_with_split(spark):
    rng = np.random.default_rng(0)
    pairs = [(" ".join(rng.choice(list("abcd"), rng.integers(0, 12))), " ".join(rng.choice(list("abcd"), rng.integers(0, 12)))) for _ in range(80)]
    df = spark.createDataFrame(pairs, "r string, h string").withColumn("d", text.word_distance(F.col("r"), F.col("h")))
    assert all(x["d"] == sum(text.edit_split(x["r"].split(), x["h"].split())) for x in df.collect())


def test_pooled_is_not_the_mean(spark):
    e = spark.createDataFrame([(1, 0, 0, 1, 2, 0.5), (0, 0, 0, 0, 30, 0.0)], "n_sub long, n_del long, n_ins long, n_err long, n_ref long, wer double")
    assert wer.pooled_wer(e).first()["wer"] == 1 / 32


def test_normalisers(spark):
    df = spark.createDataFrame([("Hello, World!  It's  here.",), (None,)], "t string")
    assert [r[0] for r in df.select(text.basic_normalize(F.col("t"))).collect()] == ["hello world its here", None]
    assert df.select(text.build_normalizer(str.upper)(F.col("t"))).first()[0].startswith("HELLO")
    with pytest.raises(ValueError):
        text.build_normalizer("none")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([float("nan"), 1.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([2.0, 2.0], [5.0, 5.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vec.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1:4] == [None, None, None] and got[4] == pytest.approx(1.0)
    assert [r[0] for r in df.select(vec.unit(F.col("b"))).limit(2).collect()] == [[1.0, 0.0], [0.0, 0.0]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, art = np.random.default_rng(0), [], []
    for s in range(4):
        for g in range(3):
            for scale, c in enumerate(("real_normal", "real_loud", None, "converted")):
                if c:
                    v = np.eye(16)[s] + 0.05 * (1 + scale) * rng.standard_normal(16)
                    u = f"s{s}_g{g}_{c}"
                    rows.append((u, f"s{s}_g{g}", c, f"s{s}", "ok", 4.0))
                    art.append((u, "speaker_ecapa.embedding", [float(x) for x in v / np.linalg.norm(v)]))
    df = spark.createDataFrame(rows, "utt_id string, group_id string, condition string, subject_id string, `speaker_ecapa.status` string, `speaker_ecapa.duration_s` double")
    return df, spark.createDataFrame(art, "utt_id string, column string, value array<float>")


COL = "speaker_ecapa.embedding"


def test_pairs_and_trials(corpus):
    df, art = corpus
    assert speaker.paired_similarity(df, art, COL, "real_normal").count() == 24
    own = speaker.paired_similarity(df, art, COL, "real_normal", include_reference=True).filter("condition = 'real_normal'").collect()
    assert all(r["cosine"] == pytest.approx(1.0) for r in own)
    trials = speaker.verification_trials(df, art, COL)
    rows = trials.collect()
    assert all((r["speaker_a"] == r["speaker_b"]) == r["label"] for r in rows)
    assert not any(r["label"] and r["group_a"] == r["group_b"] for r in rows)
    assert sum(r["label"] for r in rows) == 4 * (36 - 9) and sum(not r["label"] for r in rows) == 6 * 81
    capped = speaker.verification_trials(df, art, COL, max_target=10, max_nontarget=10).collect()
    assert sum(r["label"] for r in capped) == 10 and sum(not r["label"] for r in capped) == 10
    assert capped == speaker.verification_trials(df, art, COL, max_target=10, max_nontarget=10).collect()
    assert speaker.calibrate(trials).first()["n_speakers"] == 4
    with pytest.raises(ValueError):
        speaker.verification_trials(df.limit(1), art, COL)


@pytest.mark.parametrize("scores,labels,eer", [([0.9, 0.8, 0.1, 0.2], [True, True, False, False], 0.0), ([0.5] * 4, [True, True, False, False], 0.5)])
def test_equal_error_rate(spark, scores, labels, eer):
    df = spark.createDataFrame(list(zip(scores, labels, strict=True)), "cosine double, label boolean")
    r = speaker.equal_error_rate(df).first()
    assert r["eer"] == eer and (eer or 0.2 < r["threshold"] <= 0.8)
    with pytest.raises(ValueError):
        speaker.equal_error_rate(df.filter("label"))


def test_equal_error_rate_random(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.normal(0, 1, 400), 2), rng.random(400) < 0.4
    s[y] += 0.8
    best = min(((abs((s[~y] >= t).mean() - (s[y] < t).mean()), t) for t in np.unique(s)))
    r = speaker.equal_error_rate(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y, strict=True)], "cosine double, label boolean"), bins=16).first()
    assert r["threshold"] == pytest.approx(best[1])


def test_calibration_and_accept(spark):
    df = spark.createDataFrame([(0.8,), (0.2,), (0.5,), (None,), (float("nan"),)], "c double")
    got = [r[0] for r in df.limit(3).select(F.round(speaker.calibrated_similarity(F.col("c"), {"mu_target": 0.8, "mu_nontarget": 0.2}), 9)).collect()]
    assert got == [1.0, 0.0, 0.5]
    with pytest.raises(ValueError):
        speaker.calibrated_similarity(F.col("c"), {"mu_target": 0.5, "mu_nontarget": 0.5})
    r = speaker.accept_rate(df, "c", 0.5).first()
    assert (r["accept_rate"], r["n"]) == (2 / 3, 3)


def test_centroids(corpus):
    df, art = corpus
    enrolled = speaker.speaker_centroids(df, art, COL, conditions=["real_normal"])
    assert {r["n"] for r in enrolled[0].collect()} == {3}
    left = {r["utt_id"]: r for r in speaker.similarity_to_centroid(df, art, COL, enrolled).collect()}
    whole = {r["utt_id"]: r for r in speaker.similarity_to_centroid(df, art, COL, enrolled, exclude_self=False).collect()}
    for u, r in left.items():
        assert r["n_enrolment"] == (2 if "real_normal" in u else 3)
        assert r["cosine"] <= whole[u]["cosine"] + 1e-9
    with pytest.raises(ValueError):
        speaker.speaker_centroids(df, art, COL, min_utterances=99)


@pytest.fixture(scope="module")
def moves(spark):
    rows = [("a_real", "a_real", None, "real", "S1", 10.0), ("b_real", "b_real", None, "real", "S1", 20.0), ("a_codec", "a_real", None, "codec", "S1", 11.0), ("b_codec", "b_real", None, "codec", "S1", 21.0),
            ("a_to_b", "a_real", "b_real", "converted", "S1", 19.0), ("b_to_a", "b_real", "a_real", "converted", "S1", 12.0)]
    return spark.createDataFrame(rows, "utt_id string, src string, ref string, condition string, spk string, x double")


HOW = {"source_col": "src", "target_col": "ref", "key_col": "utt_id", "condition_col": "condition"}


def test_displacement(moves):
    got = {r["utt_id"]: r for r in displacement.displacement_table(moves, ["x", "gone"], baseline_condition="codec", carry=["spk"], **HOW).collect()}
    assert (got["a_to_b"]["requested"], got["a_to_b"]["achieved"], got["a_to_b"]["error"]) == (10.0, 8.0, -2.0)
    plain = {r["utt_id"]: r for r in displacement.displacement_table(moves, ["x"], subject_conditions=["converted"], **HOW).collect()}
    assert plain["a_to_b"]["achieved"] == 9.0
    base = {r["utt_id"]: r for r in displacement.baseline_displacement_table(moves, ["x"], baseline_condition="codec", **HOW).collect()}
    assert base["a_to_b"]["achieved"] == 10.0
    assert displacement.displacement_table(moves, ["gone"], **HOW).count() == 0
    with pytest.raises(ValueError, match="unique"):
        displacement.displacement_table(moves.unionAll(moves.filter("utt_id = 'a_real'")), ["x"], **HOW)


@pytest.mark.parametrize("k", [1.0, 0.0, 0.6])
def test_slope_of_achieved_on_requested(spark, k):
    rows = [("x", f"s{s}", float(p), k * p, k * p - p) for s in range(4) for p in range(1, 7)]
    t = spark.createDataFrame(rows, "metric string, spk string, requested double, achieved double, error double")
    slopes = displacement.per_group_slopes(t, "spk")
    assert all(r["slope"] == pytest.approx(k) for r in slopes.collect())
    r = displacement.summarise(slopes, t, "spk", n_boot=200).first()
    assert (r["n_groups"], r["n_items"]) == (4, 24) and r["slope_lo"] == pytest.approx(k) == r["slope_hi"]
    assert displacement.cell_means(t, "spk", "requested").count() == 24
    assert figures.displacement_scatter(t)[1].first()["n"] == 24


def test_filters(spark):
    df = spark.createDataFrame([("1", "ok", 1.0), ("2", None, 5.0), ("3", "short", None), ("4", "ok", None)], "utt_id string, `m.status` string, `m.duration_s` double")
    assert select.status_column_for("m.value", df) == "m.status" and select.status_column_for("n.value", df) is None
    assert {r[0] for r in select.exclude_flagged_rows(df, "m.status").collect()} == {"1", "4"}
    assert {r[0]: r[1] for r in select.status_counts(df, "m.status").collect()} == {"nan": 1, "short": 1}
    assert {r[0] for r in select.duration_floor(df, "m.duration_s", 2.0).collect()} == {"2", "3", "4"}
    with pytest.raises(KeyError):
        select.exclude_flagged_rows(df, "x.status")


def test_whisper_normaliser_takes_its_spellings_from_the_tokenizer(spark, monkeypatch):
    """With a stand-in for the optional package."""
    import sys
    import types

    class Tokenizer:
        english_spelling_normalizer = {"colour": "color"}

        @classmethod
        def from_pretrained(cls, model_id):
            assert model_id == text.SPELLING_MODEL
            return cls()

    seen = []
    package, inner = types.ModuleType("transformers"), types.ModuleType("transformers.models.whisper.english_normalizer")
    package.WhisperTokenizer = Tokenizer
    inner.EnglishTextNormalizer = lambda m: seen.append(m) or (lambda t: t)
    for k, v in {"transformers": package, "transformers.models": types.ModuleType("m"), "transformers.models.whisper": types.ModuleType("w"), inner.__name__: inner}.items():
        monkeypatch.setitem(sys.modules, k, v)
    text.build_normalizer("whisper_en")
    assert seen == [{"colour": "color"}]
    Tokenizer.english_spelling_normalizer = None
    with pytest.raises(RuntimeError, match="spelling"):
        text.build_normalizer("whisper_en")


def test_edit_split_of_long_texts():
    import random

    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(20_000)]
    b = [x for x in a if rng.random() < 0.99]
    assert text.edit_split(a, b) == (0, 20_000 - len(b), 0)


def test_trials_of_one_large_speaker_are_drawn(spark):
    """A speaker with 20,000 rows has 2e8 pairs; they are not listed."""
    rows = spark.range(20_000).selectExpr("cast(id as string) utt_id", "cast(if(id < 19000, 0, id % 100) as int) subject_id", "id as group_id", "'c' as condition")
    art = spark.range(20_000).selectExpr("cast(id as string) utt_id", "'e' as column", "array(cast(id % 7 as float), 1f, cast(id % 3 as float)) as value")
    got = speaker.verification_trials(rows, art, "e", max_target=500, max_nontarget=500, status_col=None).collect()
    assert [sum(r["label"] == y for r in got) for y in (True, False)] == [500, 500]
    assert len({(r["utt_a"], r["utt_b"]) for r in got}) == 1000
    vec = lambda u: np.array([int(u) % 7, 1, int(u) % 3], dtype=float)
    for r in got:
        a, b = vec(r["utt_a"]), vec(r["utt_b"])
        assert r["utt_a"] < r["utt_b"] and (r["speaker_a"] == r["speaker_b"]) == r["label"]
        assert r["cosine"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
