"""Registered queries do their whole job: brute force over small tables."""

import itertools
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvoice import queries
from sparkvoice.operators import speaker
from sparkvoice.queries import QUERIES


def norm(t):
    return " ".join(t.lower().translate(str.maketrans("", "", string.punctuation)).split())


def distance(r, h):
    row = list(range(len(h) + 1))
    for i, w in enumerate(r, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(h, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != x))
    return row[-1]


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for c in range(1, 5):
        base = [rng.choice(["Alpha", "beta,", "gamma", "it's", "delta."]) for _ in range(120)]
        for t in range(4):
            ws = list(base)
            # Turns differ late in the text only.
            for _ in range(t):
                ws[rng.randrange(60, 120)] = "late%d" % rng.randrange(9)
            rows.append((c, t, "user", " ".join(ws)))
    rows += [(5, 0, "user", "short one"), (5, 1, "user", "short two"), (9, 0, "user", "flagged"), (10, 0, "user", " ")]
    d = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{d}/conversations.parquet")
    return f"file://{d}", rows


def test_transcripts_are_whole(spark, talks):
    d, rows = talks
    got = {r["utt_id"]: r["norm"] for r in QUERIES["basic_normalize"](spark, d).collect()}
    assert got == {f"{c}_{t}": norm(x) for c, t, _, x in rows}
    kept = {r["utt_id"]: r["text"] for r in QUERIES["transcript_filter"](spark, d).collect()}
    assert kept == {f"{c}_{t}": x for c, t, _, x in rows if t % 2 == 0 and x.strip()}


def test_word_errors_are_of_whole_texts(spark, talks):
    d, rows = talks
    said = {(c, t): x for c, t, _, x in rows if c % 9}
    heard = {k: re.sub(r"(\S+)$", r"\1 \1", x) if k[1] % 2 else x for k, x in said.items()}
    truth = {f"{c}_{t}": (norm(x), norm(heard[c, t])) for (c, t), x in said.items() if x.strip()}
    pseudo = {f"{c}_{t}": (norm(heard[c, t - t % 2]), norm(h)) for (c, t), h in heard.items()}
    for key, pairs in (("transcription_errors_truth", truth), ("transcription_errors_pseudo", pseudo)):
        got = {r["utt_id"]: (r["reference_norm"], r["hypothesis_norm"], r["n_err"], r["n_ref"]) for r in QUERIES[key](spark, d).collect()}
        assert got == {u: (r, h, distance(r.split(), h.split()), len(r.split())) for u, (r, h) in pairs.items()}
    errors = {u: distance(r.split(), h.split()) for u, (r, h) in pseudo.items()}
    assert {r["utt_id"]: r["n_err"] for r in QUERIES["word_errors"](spark, d).collect()} == errors
    assert max(errors.values()) > 1
    pooled = {r["condition"]: (r["n_err"], r["n_ref"]) for r in QUERIES["pooled_wer"](spark, d).collect()}
    for k, name in enumerate(("real", "converted")):
        own = [u for u in pseudo if int(u[-1]) % 2 == k]
        assert pooled[name] == (sum(errors[u] for u in own), sum(len(pseudo[u][0].split()) for u in own))


@pytest.fixture(scope="module")
def voices(spark, tmp_path_factory):
    rng = np.random.default_rng(10)
    axes = rng.normal(size=(4, 8))
    rows = [(i, [float(x) for x in (axes[i % 4] + 0.9 * rng.normal(size=8)).astype(np.float32)], i % 4) for i in range(48)]
    d = tmp_path_factory.mktemp("voices")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{d}/embeddings.parquet")
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    pairs = {}
    for i, j in itertools.combinations(range(48), 2):
        if i % 4 != j % 4 or i // 5 != j // 5:
            a, b = sorted((str(i), str(j)))
            pairs[a, b] = (i % 4 == j % 4, float(units[i] @ units[j]))
    return f"file://{d}", units, pairs


def test_trials_are_of_all_embeddings(spark, voices):
    d, units, pairs = voices
    got = {(r["utt_a"], r["utt_b"]): (r["label"], r["cosine"]) for r in QUERIES["verification_trials"](spark, d).collect()}
    assert set(got) == set(pairs)
    for k, (label, cosine) in pairs.items():
        assert got[k][0] == label and abs(got[k][1] - cosine) < 2e-6
    t, f = (np.array([c for y, c in pairs.values() if y == label]) for label in (True, False))
    gap, eer = min((abs((f >= s).mean() - (t < s).mean()), ((f >= s).mean() + (t < s).mean()) / 2) for s in sorted([*t, *f]))
    r = QUERIES["eer"](spark, d).first()
    assert (r["n_target"], r["n_nontarget"]) == (len(t), len(f)) and abs(abs(r["far"] - r["frr"]) - gap) < 3e-6
    c = QUERIES["calibrate"](spark, d).first()
    want = (t.mean(), t.std(), f.mean(), f.std(), (t.mean() - f.mean()) / np.sqrt((t.var() + f.var()) / 2))
    np.testing.assert_allclose([c[x] for x in ("mu_target", "sd_target", "mu_nontarget", "sd_nontarget", "d_prime")], want, atol=3e-6)
    assert c["n_speakers"] == 4 and abs(c["eer"] - eer) < 3e-6
    similar = QUERIES["calibrated_similarity"](spark, d).collect()
    assert similar
    for r in similar:
        i = int(r["utt_id"])
        assert abs(r["similarity"] - (units[i] @ units[i - i % 5] - f.mean()) / (t.mean() - f.mean())) < 2e-5


def test_enrolment_is_of_all_embeddings(spark, voices):
    d, units, _ = voices
    sums = {k: sum(u for i, u in units.items() if i % 4 == k) for k in range(4)}
    got = {(r["speaker"], r["pos"]): (r["n"], r["x"]) for r in QUERIES["speaker_centroids"](spark, d).collect()}
    assert len(got) == 32 and all(n == 12 and abs(x - sums[k][p] / np.linalg.norm(sums[k])) < 2e-6 for (k, p), (n, x) in got.items())
    scored = {int(r["utt_id"]): (r["n_enrolment"], r["cosine"]) for r in QUERIES["similarity_to_centroid"](spark, d).collect()}
    assert set(scored) == set(units)
    for i, (n, c) in scored.items():
        rest = sums[i % 4] - units[i]
        assert n == 11 and abs(c - units[i] @ rest / np.linalg.norm(rest)) < 2e-6


def shuffled(spark):
    """MB and rows written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return np.array([sum(x.shuffleWriteBytes() for x in stages) / 1e6, sum(x.shuffleWriteRecords() for x in stages)])


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    # Some vectors stand twice, some hold zeros only.
    vectors = rng.normal(size=(1200, 8))
    vectors[100:140] = vectors[200:240]
    vectors[300:303] = 0
    d = tmp_path_factory.mktemp("crowd")
    spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").write.parquet(f"file://{d}/embeddings.parquet")
    return f"file://{d}"


@pytest.mark.parametrize("query", ["calibrate", "eer", "calibrated_similarity"])
def test_trials_are_counted_without_a_row_for_each(spark, crowd, monkeypatch, query):
    """719,400 pairs took more than 15 MB of shuffle; their counts take less."""
    monkeypatch.setattr(speaker, "BLOCK_ROWS", 300)
    before = shuffled(spark)
    got = QUERIES[query](spark, crowd).collect()
    assert (shuffled(spark) - before)[0] < 8
    listed = queries._trials(spark, crowd).withColumn("cosine", F.round("cosine", 9))
    want = speaker.calibrate(listed).first().asDict()
    if query == "calibrated_similarity":
        paired = {r["utt_id"]: r["cosine"] for r in queries._paired(spark, crowd).collect() if r["cosine"] is not None}
        for r in got:
            if r["similarity"] is not None:
                assert r["similarity"] == pytest.approx((paired[r["utt_id"]] - want["mu_nontarget"]) / (want["mu_target"] - want["mu_nontarget"]), abs=2e-5)
        return
    for c, x in got[0].asDict().items():
        assert x == want[c] if c[:2] == "n_" else x == pytest.approx(want[c], abs=1.1e-6)


def test_trials_copy_a_row_for_few_blocks(spark, crowd, monkeypatch):
    """Blocks of 10 rows copied every row 121 times."""
    monkeypatch.setattr(speaker, "BLOCK_ROWS", 10)
    before = shuffled(spark)
    assert QUERIES["verification_trials"](spark, crowd).count() == 1200 * 1199 // 2 - sum(i % 3 == j % 3 for g in range(240) for i, j in itertools.combinations(range(5 * g, 5 * g + 5), 2))
    assert (shuffled(spark) - before)[1] < 40_000


def test_few_rows_are_not_copied_for_each_block(spark, crowd, monkeypatch):
    """Every row was shuffled once for each of 12 blocks; the result is the same by either way."""
    monkeypatch.setattr(speaker, "BLOCK_ROWS", 100)
    found, moved = [], []
    for most in (speaker.BROADCAST, 0):
        monkeypatch.setattr(speaker, "BROADCAST", most)
        before = shuffled(spark)
        found.append({(r["utt_a"], r["utt_b"]): tuple(r)[2:] for r in queries._trials(spark, crowd).collect() if int(r["utt_a"]) % 9 == 0})
        moved.append((shuffled(spark) - before)[1])
    assert found[0].keys() == found[1].keys() and len(found[0]) > 50_000
    assert all(x[:-2] == (y := found[1][k])[:-2] and x[-1] == y[-1] and (abs(x[-2] - y[-2]) < 1e-12 or x[-2] != x[-2] and y[-2] != y[-2]) for k, x in found[0].items())
    assert moved[0] < 8_000 < moved[1]
