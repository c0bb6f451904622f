"""Queries over the driver's tables, one or more for each operator, with the same result in SQL.

Adapters give the tables the shapes of the operators: events by user and type are scalar measurements by group and
condition, embeddings are speaker vectors or short waves, conversations are transcripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship
from .functions import scalars, signal, text, vec
from .operators import contrasts, displacement, figures, frames, select, speaker, wer
from .plans import extract
from .sources import manifest, results

CONDITIONS = ["click", "error", "purchase", "signup", "view"]
COLUMN = "speaker.embedding"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, places: int = 6):
    return F.round(c, places)


def v_scalar(spark, d):
    e = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    return e.select(F.col("user_id").alias("group_id"), F.col("event_type").alias("condition"), "value", (F.col("user_id") % 10).alias("subject_id"), F.concat_ws("_", F.col("user_id"), "event_type").alias("utt_id"))


S_SCALAR = """v_scalar AS (SELECT user_id AS group_id, event_type AS condition, avg(value) AS value, user_id % 10 AS subject_id,
 user_id || '_' || event_type AS utt_id FROM events GROUP BY user_id, event_type)"""


def v_disp(spark, d):
    # A user's target is the next one, the last one's the first.
    last = _t(spark, d, "events").agg(F.max("user_id").alias("m"), F.min("user_id").alias("l")).first()
    nxt = F.when(F.col("group_id") == last["m"], F.lit(last["l"])).otherwise(F.col("group_id") + 1)
    s = v_scalar(spark, d)
    own = lambda g: F.concat_ws("_", g, F.lit("view"))
    return s.select("*", own(F.col("group_id")).alias("src"), F.when(~F.col("condition").isin("view", "click"), own(nxt)).alias("tgt"))


S_DISP = S_SCALAR + """, lim AS (SELECT max(user_id) AS m, min(user_id) AS l FROM events),
v_disp AS (SELECT *, group_id || '_view' AS src, CASE WHEN condition NOT IN ('view', 'click') THEN (CASE WHEN group_id = m THEN l ELSE group_id + 1 END) || '_view' END AS tgt FROM v_scalar, lim)"""


def v_points(spark, d):
    return _t(spark, d, "events").select((F.col("event_id") % 7).cast("double").alias("x"), F.col("value").alias("y"), F.col("user_id").alias("subject_id"))


S_POINTS = "v_points AS (SELECT (event_id % 7)::DOUBLE AS x, value AS y, user_id AS subject_id FROM events)"


def v_speaker(spark, d):
    e = _t(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("utt_id"), F.col("label").alias("subject_id"), F.expr("vec_id div 5").alias("group_id"), (F.col("vec_id") % 5).cast("string").alias("condition"),
                    F.when(F.col("vec_id") % 11 == 0, "short").otherwise("ok").alias("speaker.status"))
    art = e.select(F.col("vec_id").cast("string").alias("utt_id"), F.lit(COLUMN).alias("column"), F.col("embedding").alias("value"))
    return rows, art


S_SPEAKER = """v_speaker AS (SELECT vec_id::VARCHAR AS utt_id, label AS subject_id, vec_id // 5 AS group_id, (vec_id % 5)::VARCHAR AS condition,
 list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 11 <> 0),
v_unit AS (SELECT * EXCLUDE (v), v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v_speaker)"""
# All embeddings, whatever their status.
S_EVERY = S_SPEAKER.replace(" WHERE vec_id % 11 <> 0", "")


def v_text(spark, d):
    # Whole texts; the converted hypothesis says the last word twice.
    c = _t(spark, d, "conversations")
    said = F.regexp_replace("text", r"[^\x20-\x7e]+", " ")
    heard = F.when(F.col("turn") % 2 == 0, said).otherwise(F.concat_ws(" ", said, F.substring_index(F.rtrim(said), " ", -1)))
    return c.select(
        F.concat_ws("_", "conv_id", "turn").alias("utt_id"), F.concat_ws("_", "conv_id", F.expr("turn div 2")).alias("group_id"),
        F.when(F.col("turn") % 2 == 0, "real").otherwise("converted").alias("condition"), F.col("role").alias("subject_id"), heard.alias("asr.hypothesis"),
        F.when(F.col("conv_id") % 9 == 0, "too_long").otherwise("ok").alias("asr.status"), said.alias("text"),
    )


_ASCII = "regexp_replace(text, '[^\\x20-\\x7e]+', ' ', 'g')"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"
S_TEXT = f"""v_said AS (SELECT *, {_ASCII} AS said FROM conversations),
v_raw AS (SELECT conv_id || '_' || turn AS utt_id, conv_id || '_' || (turn // 2) AS group_id, CASE WHEN turn % 2 = 0 THEN 'real' ELSE 'converted' END AS condition,
 role AS subject_id, CASE WHEN turn % 2 = 0 THEN said ELSE said || ' ' || regexp_extract(rtrim(said, ' '), '[^ ]*$') END AS hyp, CASE WHEN conv_id % 9 = 0 THEN 'too_long' ELSE 'ok' END AS status,
 said AS text FROM v_said),
v_text AS (SELECT * FROM v_raw WHERE status = 'ok')"""


def v_wave(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("utt_id"), F.col("embedding").alias("wav"), F.lit(16_000).alias("sample_rate"), F.when(F.col("label") % 3 == 0, "Female").when(F.col("label") % 3 == 1, " male").alias("sex"))


S_WAVE = "v_wave AS (SELECT vec_id::VARCHAR AS utt_id, list_transform(embedding, lambda x: x::DOUBLE) AS wav, CASE label % 3 WHEN 0 THEN 'Female' WHEN 1 THEN ' male' END AS sex FROM embeddings)"
S_LEVEL = """lv AS (SELECT utt_id, len(wav) / 16000.0 AS duration_s, 10 * log10(list_dot_product(wav, wav) / len(wav)) AS rms_dbfs,
 20 * log10(list_max(list_transform(wav, lambda x: abs(x)))) AS peak_dbfs FROM v_wave)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(key: str, run, sql: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[key] = query
    if sql:
        ORACLES[key] = sql


_add("to_wide", lambda s, d: contrasts.to_wide(v_scalar(s, d), ["value"], conditions=CONDITIONS).select("group_id", *[_r(select.name(f"{c}.value")).alias(f"{c}_value") for c in CONDITIONS]),
     f"WITH {S_SCALAR} SELECT group_id, " + ", ".join(f"round(max(value) FILTER (WHERE condition = '{c}'), 6) AS {c}_value" for c in CONDITIONS) + " FROM v_scalar GROUP BY group_id")


def _recovery(s, d):
    w = contrasts.to_wide(v_scalar(s, d), ["value"], conditions=CONDITIONS)
    return w.select("group_id", _r(scalars.recovery_rate(*[select.name(f"{c}.value") for c in ("view", "click", "purchase")], min_gap=1.0), 4).alias("recovery"))


_add("recovery_rate", _recovery, f"""WITH {S_SCALAR}, w AS (SELECT group_id, max(value) FILTER (WHERE condition = 'view') AS s, max(value) FILTER (WHERE condition = 'click') AS c,
 max(value) FILTER (WHERE condition = 'purchase') AS t FROM v_scalar GROUP BY group_id) SELECT group_id, CASE WHEN abs(t - s) >= 1.0 THEN round((c - s) / (t - s), 4) END AS recovery FROM w""")

_FIT = "round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(y, x), 6) AS r, count(*) AS n"
_fit = lambda df: df.withColumns({c: _r(F.col(c)) for c in ("slope", "intercept", "r")})
_add("slope_vs_target", lambda s, d: _fit(contrasts.slope_vs_target(v_points(s, d), "y", "x")), f"WITH {S_POINTS} SELECT subject_id, {_FIT} FROM v_points GROUP BY subject_id HAVING count(*) >= 3 AND max(x) > min(x)")
_add("slope_pooled", lambda s, d: _fit(contrasts.slope_vs_target(v_points(s, d), "y", "x", None)).withColumnRenamed("__group", "pool"), f"WITH {S_POINTS} SELECT 'all' AS pool, {_FIT} FROM v_points")
_add("status_filter", lambda s, d: select.exclude_flagged_rows(v_text(s, d), "asr.status").select("utt_id", "group_id", "condition"), f"WITH {S_TEXT} SELECT utt_id, group_id, condition FROM v_text")
_add("status_histogram", lambda s, d: select.status_counts(v_text(s, d), "asr.status"), f"WITH {S_TEXT} SELECT status, count(*) AS n FROM v_raw WHERE status <> 'ok' GROUP BY status")
_add("duration_floor", lambda s, d: select.duration_floor(_t(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("duration_s")), "duration_s", 50.0),
     "SELECT * FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS duration_s FROM events) WHERE NOT coalesce(duration_s < 50.0, false)")
_add("condition_membership", lambda s, d: select.in_conditions(v_speaker(s, d)[0], "condition", [1, 3]).select("utt_id", "condition"), "SELECT vec_id::VARCHAR AS utt_id, (vec_id % 5)::VARCHAR AS condition FROM embeddings WHERE vec_id % 5 IN (1, 3)")
_add("transcript_filter", lambda s, d: select.with_transcript(v_text(s, d).withColumn("text", F.when(F.col("condition") == "real", F.col("text")))).select("utt_id", "text"), f"WITH {S_TEXT} SELECT utt_id, text FROM v_raw WHERE condition = 'real' AND trim(text) <> ''")
_add("subject_selection", lambda s, d: select.subjects(v_scalar(s, d), "condition", "view", "click").select("utt_id"), f"WITH {S_SCALAR} SELECT utt_id FROM v_scalar WHERE condition NOT IN ('view', 'click')")
_add("pseudo_reference", lambda s, d: select.resolve_reference(v_scalar(s, d), "view", "value").select("utt_id", _r(F.col("value")).alias("value"), _r(F.col("__reference")).alias("reference")),
     f"WITH {S_SCALAR} SELECT a.utt_id, round(a.value, 6) AS value, round(b.value, 6) AS reference FROM v_scalar a JOIN v_scalar b ON a.group_id = b.group_id AND b.condition = 'view'")
_add("without_reference", lambda s, d: select.without_reference(v_text(s, d), "converted", "asr.hypothesis").select("utt_id"), f"WITH {S_TEXT} SELECT utt_id FROM v_raw a WHERE NOT EXISTS (SELECT 1 FROM v_raw b WHERE b.group_id = a.group_id AND b.condition = 'converted')")
_add("basic_normalize", lambda s, d: v_text(s, d).select("utt_id", text.basic_normalize(F.col("text")).alias("norm")), f"WITH {S_TEXT} SELECT utt_id, {_NORM.format('text')} AS norm FROM v_raw")
_add("word_count", lambda s, d: _t(s, d, "documents").select("doc_id", scalars.word_count(F.col("text")).cast("long").alias("n_words")),
     "SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x85]+', ' ', 'g'), ' '), lambda x: x <> ''))::BIGINT AS n_words FROM documents")

#: Least word edits by a table of prefixes: every pair is walked row by row in a recursive query.
S_EDIT = """, pr AS (SELECT *, list_filter(string_split(reference_norm, ' '), lambda x: x <> '') AS rw, list_filter(string_split(hypothesis_norm, ' '), lambda x: x <> '') AS hw FROM pairs),
dp(utt_id, i, row) AS (SELECT utt_id, 0, range(0, len(hw) + 1) FROM pr UNION ALL
 SELECT d.utt_id, d.i + 1, list_transform(range(1, len(hw) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: least(d.row[k] + 1,
   CASE WHEN k > 1 THEN d.row[k - 1] + CASE WHEN hw[k - 1] = rw[d.i + 1] THEN 0 ELSE 1 END ELSE d.row[k] + 1 END) + (j - k))))
 FROM dp d JOIN pr p ON p.utt_id = d.utt_id WHERE d.i < len(rw)),
er AS (SELECT p.utt_id, group_id, condition, reference_norm, hypothesis_norm, len(rw)::BIGINT AS n_ref, d.row[len(d.row)]::BIGINT AS n_err FROM pr p JOIN dp d ON d.utt_id = p.utt_id AND d.i = len(rw))"""
S_TRUTH = f"""WITH RECURSIVE {S_TEXT}, pairs AS (SELECT utt_id, group_id, condition, {_NORM.format('text')} AS reference_norm, {_NORM.format('hyp')} AS hypothesis_norm FROM v_text WHERE trim(text) <> ''){S_EDIT}"""
S_PSEUDO = f"""WITH RECURSIVE {S_TEXT}, pairs AS (SELECT a.utt_id, a.group_id, a.condition, {_NORM.format('b.hyp')} AS reference_norm, {_NORM.format('a.hyp')} AS hypothesis_norm
 FROM v_text a JOIN v_text b ON a.group_id = b.group_id AND b.condition = 'real'){S_EDIT}"""
_ERR = " SELECT utt_id, group_id, condition, reference_norm, hypothesis_norm, n_err, n_ref, CASE WHEN n_ref > 0 THEN round(n_err / n_ref, 6) END AS wer FROM er"


def _errors(s, d, **how):
    return wer.transcription_errors(v_text(s, d), "asr.hypothesis", normalizer="basic", **how)


def _short(e):
    return e.select("utt_id", "group_id", "condition", "reference_norm", "hypothesis_norm", "n_err", "n_ref", _r(F.col("wer")).alias("wer"))


_add("transcription_errors_truth", lambda s, d: _short(_errors(s, d, reference_column="text")), S_TRUTH + _ERR)
_add("transcription_errors_pseudo", lambda s, d: _short(_errors(s, d, reference_condition="real")), S_PSEUDO + _ERR)
_add("word_errors", lambda s, d: _errors(s, d, reference_condition="real").select("utt_id", text.word_distance(F.col("reference_norm"), F.col("hypothesis_norm")).alias("n_err")), S_PSEUDO + " SELECT utt_id, n_err FROM er")
_add("pooled_wer", lambda s, d: wer.pooled_wer(_errors(s, d, reference_condition="real"), "condition").select("condition", "n_err", "n_ref", "n_utterances", _r(F.col("wer")).alias("wer")),
     S_PSEUDO + " SELECT condition, sum(n_err)::BIGINT AS n_err, sum(n_ref)::BIGINT AS n_ref, count(*) AS n_utterances, round(sum(n_err) / sum(n_ref), 6) AS wer FROM er GROUP BY condition")

_add("cosine", lambda s, d: _t(s, d, "embeddings").select("vec_id", _r(vec.cosine(F.col("embedding"), F.reverse("embedding"))).alias("cosine")), "SELECT vec_id, round(list_dot_product(v, list_reverse(v)) / list_dot_product(v, v), 6) AS cosine FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
_add("unit_vector", lambda s, d: _t(s, d, "embeddings").select("vec_id", F.posexplode(vec.unit(F.col("embedding"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), _r(F.col("x")).alias("x")),
     "SELECT vec_id, unnest(range(0, len(v))) AS pos, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")


def _paired(s, d):
    rows, art = v_speaker(s, d)
    return speaker.paired_similarity(rows, art, COLUMN, "0", carry=["subject_id"])


S_PAIRED = f"""WITH {S_SPEAKER}, ps AS (SELECT a.utt_id, a.group_id, a.condition, a.subject_id, '0' AS reference_condition, b.utt_id AS reference_utt_id, list_dot_product(a.u, b.u) AS cosine
 FROM v_unit a JOIN v_unit b ON a.group_id = b.group_id AND b.condition = '0' WHERE a.condition <> '0')"""
_add("paired_similarity", lambda s, d: _paired(s, d).withColumn("cosine", _r(F.col("cosine"))), S_PAIRED + " SELECT * REPLACE (round(cosine, 6) AS cosine) FROM ps")
_add("similarity_by_condition", lambda s, d: _paired(s, d).groupBy("condition").agg(_r(F.avg("cosine")).alias("mean_cosine"), F.count(F.lit(1)).alias("n")), S_PAIRED + " SELECT condition, round(avg(cosine), 6) AS mean_cosine, count(*) AS n FROM ps GROUP BY condition")


def _trials(s, d, cap=None):
    # All embeddings, whatever their condition and status.
    rows, art = v_speaker(s, d)
    return speaker.verification_trials(rows, art, COLUMN, status_col=None, max_target=cap, max_nontarget=cap)


def _calibration(s, d):
    # The same trials, counted instead of listed.
    rows, art = v_speaker(s, d)
    return speaker.calibrate_all(rows, art, COLUMN, status_col=None)


S_TRIALS = f"""WITH {S_EVERY}, tr AS (SELECT a.utt_id AS utt_a, b.utt_id AS utt_b, a.subject_id AS speaker_a, b.subject_id AS speaker_b, a.subject_id = b.subject_id AS label, list_dot_product(a.u, b.u) AS raw, round(raw, 9) AS cosine
 FROM v_unit a JOIN v_unit b ON a.utt_id < b.utt_id AND (a.subject_id <> b.subject_id OR a.group_id <> b.group_id))"""
_add("verification_trials", lambda s, d: _trials(s, d).select("utt_a", "utt_b", "speaker_a", "speaker_b", "label", _r(F.col("cosine")).alias("cosine")), S_TRIALS + " SELECT utt_a, utt_b, speaker_a, speaker_b, label, round(raw, 6) AS cosine FROM tr")
S_EER = """, th AS (SELECT cosine AS s, count(*) FILTER (WHERE label) AS t, count(*) FILTER (WHERE NOT label) AS f FROM tr GROUP BY cosine),
cu AS (SELECT s, sum(t) OVER () AS nt, sum(f) OVER () AS nf, coalesce(sum(t) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pt,
 coalesce(sum(f) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pf FROM th),
ra AS (SELECT s AS threshold, (nf - pf) / nf AS far, pt / nt AS frr, nt, nf FROM cu),
eq AS (SELECT round((far + frr) / 2, 6) AS eer, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr, nt::BIGINT AS n_target, nf::BIGINT AS n_nontarget FROM ra ORDER BY abs(far - frr), ra.threshold LIMIT 1)"""
_add("eer", lambda s, d: _calibration(s, d).select(*[_r(F.col(c)).alias(c) for c in ("eer", "threshold", "far", "frr")], "n_target", "n_nontarget"), S_TRIALS + S_EER + " SELECT * FROM eq")
S_CAL = S_TRIALS + S_EER + """, mo AS (SELECT avg(cosine) FILTER (WHERE label) AS mt, stddev_pop(cosine) FILTER (WHERE label) AS st, avg(cosine) FILTER (WHERE NOT label) AS mn, stddev_pop(cosine) FILTER (WHERE NOT label) AS sn FROM tr),
sp AS (SELECT count(DISTINCT x) AS n_speakers FROM (SELECT speaker_a AS x FROM tr UNION ALL SELECT speaker_b FROM tr))"""
_add("calibrate", lambda s, d: _calibration(s, d).withColumns({c: _r(F.col(c)) for c in ("eer", "threshold", "far", "frr", "mu_target", "sd_target", "mu_nontarget", "sd_nontarget", "d_prime")}),
     S_CAL + " SELECT eq.*, round(mt, 6) AS mu_target, round(st, 6) AS sd_target, round(mn, 6) AS mu_nontarget, round(sn, 6) AS sd_nontarget, round((mt - mn) / sqrt((st * st + sn * sn) / 2), 6) AS d_prime, n_speakers FROM eq, mo, sp")


def _calibrated(s, d):
    c = _calibration(s, d).first().asDict()
    return _paired(s, d).select("utt_id", _r(speaker.calibrated_similarity(F.col("cosine"), c), 5).alias("similarity"))


_add("calibrated_similarity", _calibrated, S_CAL + """, ok AS (SELECT * FROM v_unit WHERE utt_id::BIGINT % 11 <> 0),
 ps AS (SELECT a.utt_id, list_dot_product(a.u, b.u) AS cosine FROM ok a JOIN ok b ON a.group_id = b.group_id AND b.condition = '0' WHERE a.condition <> '0')
 SELECT utt_id, round((cosine - mn) / (mt - mn), 5) AS similarity FROM ps, mo""")
_add("accept_rate", lambda s, d: speaker.accept_rate(_paired(s, d), "cosine", 0.1).withColumn("accept_rate", _r(F.col("accept_rate"))), S_PAIRED + " SELECT round(avg((cosine >= 0.1)::INT), 6) AS accept_rate, count(*) AS n, 0.1::DOUBLE AS threshold FROM ps")
S_ENROL = f"""WITH {S_EVERY}, mem AS (SELECT * FROM v_unit),
co AS (SELECT subject_id AS speaker, pos, sum(x) AS x FROM (SELECT subject_id, unnest(range(0, len(u))) AS pos, unnest(u) AS x FROM mem) GROUP BY ALL),
su AS (SELECT speaker, list(x ORDER BY pos) AS s FROM co GROUP BY speaker), nm AS (SELECT subject_id AS speaker, count(*) AS n FROM mem GROUP BY subject_id HAVING count(*) >= 2)"""


def _enrol(s, d):
    rows, art = v_speaker(s, d)
    return speaker.speaker_centroids(rows, art, COLUMN, status_col=None)


_add("speaker_centroids", lambda s, d: _enrol(s, d)[0].select("speaker", "n", F.posexplode("centroid").alias("pos", "x")).select("speaker", "n", F.col("pos").cast("long").alias("pos"), _r(F.col("x")).alias("x")),
     S_ENROL + " SELECT su.speaker, n, unnest(range(0, len(s))) AS pos, round(unnest(s) / sqrt(list_dot_product(s, s)), 6) AS x FROM su JOIN nm ON su.speaker = nm.speaker")


def _scored(s, d):
    rows, art = v_speaker(s, d)
    return speaker.similarity_to_centroid(rows, art, COLUMN, _enrol(s, d), status_col=None).select("utt_id", "subject_id", "n_enrolment", _r(F.col("cosine")).alias("cosine"))


_add("similarity_to_centroid", _scored, S_ENROL + """, sc AS (SELECT a.utt_id, a.subject_id, a.u, n - 1 AS k,
 list_transform(list_zip(s, a.u), lambda z: z[1] - z[2]) AS c FROM v_unit a JOIN su ON su.speaker = a.subject_id JOIN nm ON nm.speaker = a.subject_id)
 SELECT utt_id, subject_id, k AS n_enrolment, round(list_dot_product(u, c) / sqrt(list_dot_product(c, c)), 6) AS cosine FROM sc""")

DISP = {"source_col": "src", "target_col": "tgt", "key_col": "utt_id", "condition_col": "condition", "source_condition": "view", "baseline_condition": "click"}
_disp = lambda s, d: displacement.displacement_table(v_disp(s, d), ["value"], carry=["subject_id"], **DISP)
_base = lambda s, d: displacement.baseline_displacement_table(v_disp(s, d), ["value"], carry=["subject_id"], **DISP)
S_D = f"""WITH {S_DISP}, dt AS (SELECT v.utt_id, 'value' AS metric, t.value - s.value AS requested, v.value - b.value AS achieved, v.value, s.value AS value_source, t.value AS value_target, b.value AS value_baseline, v.subject_id
 FROM v_disp v LEFT JOIN v_disp s ON s.src = v.src AND s.condition = 'view' LEFT JOIN v_disp b ON b.src = v.src AND b.condition = 'click' LEFT JOIN v_disp t ON t.utt_id = v.tgt WHERE v.condition NOT IN ('view', 'click'))"""
S_B = f"""WITH {S_DISP}, dt AS (SELECT v.utt_id, 'value' AS metric, t.value - s.value AS requested, u.value - b.value AS achieved, u.value, s.value AS value_source, t.value AS value_target, b.value AS value_baseline, v.subject_id
 FROM v_disp v LEFT JOIN v_disp s ON s.src = v.src AND s.condition = 'view' LEFT JOIN v_disp b ON b.src = v.src AND b.condition = 'click' LEFT JOIN v_disp t ON t.src = v.tgt AND t.condition = 'view'
 LEFT JOIN v_disp u ON u.src = v.tgt AND u.condition = 'click' WHERE v.condition NOT IN ('view', 'click'))"""
_SEVEN = ("requested", "achieved", "value", "value_source", "value_target", "value_baseline", "error")
_d_out = lambda df: df.withColumns({c: _r(F.col(c)) for c in _SEVEN})
_D_SQL = " SELECT utt_id, metric, subject_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SEVEN[:-1]) + ", round(achieved - requested, 6) AS error FROM dt"
_add("displacement", lambda s, d: _d_out(_disp(s, d)), S_D + _D_SQL)
_add("baseline_displacement", lambda s, d: _d_out(_base(s, d)), S_B + _D_SQL)
_add("per_group_slopes", lambda s, d: _fit(displacement.per_group_slopes(_disp(s, d), "subject_id")), S_D + """ SELECT metric, subject_id, round(regr_slope(achieved, requested), 6) AS slope, round(regr_intercept(achieved, requested), 6) AS intercept,
 round(corr(achieved, requested), 6) AS r, count(*) AS n FROM dt WHERE achieved IS NOT NULL AND requested IS NOT NULL GROUP BY metric, subject_id HAVING count(*) >= 3""")


def _cells(s, d):
    t = _disp(s, d).withColumn("kind", F.substring_index("utt_id", "_", -1))
    return displacement.cell_means(t, "subject_id", "kind").withColumns({c: _r(F.col(c)) for c in ("mean", "std")})


S_CELLS = S_D + ", ce AS (SELECT metric, subject_id, split_part(utt_id, '_', 2) AS kind, round(avg(achieved - requested), 6) AS mean, round(stddev_samp(achieved - requested), 6) AS std, count(*) AS n FROM dt GROUP BY ALL)"
_add("cell_means", _cells, S_CELLS + " SELECT * FROM ce")
_add("figure_heatmap", lambda s, d: figures.cell_heatmap(_cells(s, d), "subject_id", "kind", levels=["error", "purchase", "signup"])[0], S_CELLS + " SELECT subject_id, " + ", ".join(f"max(mean) FILTER (WHERE kind = '{k}') AS {k}" for k in ("error", "purchase", "signup")) + " FROM ce GROUP BY subject_id")
_add("figure_scatter_limits", lambda s, d: figures.displacement_scatter(_disp(s, d))[1].select(*[_r(F.col(c)).alias(c) for c in ("low", "high", "slope", "intercept")], "n"),
     S_D + """, li AS (SELECT least(min(requested), min(achieved)) AS lo, greatest(max(requested), max(achieved)) AS hi, count(*) AS n, regr_slope(achieved, requested) AS s, regr_intercept(achieved, requested) AS i FROM dt WHERE requested IS NOT NULL AND achieved IS NOT NULL)
 SELECT round(lo - 0.05 * (hi - lo), 6) AS low, round(hi + 0.05 * (hi - lo), 6) AS high, round(s, 6) AS slope, round(i, 6) AS intercept, n FROM li""")
_add("figure_group_slopes", lambda s, d: figures.group_slopes(displacement.per_group_slopes(_disp(s, d), "subject_id"), "subject_id")[1].withColumn("slope_mean", _r(F.col("slope_mean"))),
     S_D + " SELECT metric, round(avg(slope), 6) AS slope_mean FROM (SELECT metric, regr_slope(achieved, requested) AS slope FROM dt WHERE achieved IS NOT NULL AND requested IS NOT NULL GROUP BY metric, subject_id HAVING count(*) >= 3) GROUP BY metric")
_add("figure_proportion_curve", lambda s, d: figures.proportion_curve(_t(s, d, "events").groupBy((F.col("event_id") % 7).alias("x")).agg(_r(F.avg("value")).alias("v"), _r(F.min("value")).alias("lo"), _r(F.max("value")).alias("hi"), F.count(F.lit(1)).alias("k")), "x", "v", "lo", "hi", "k"),
     "SELECT event_id % 7 AS x, round(avg(value), 6) AS value, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n FROM events GROUP BY event_id % 7")

_add("level", lambda s, d: extract.Level().compute(v_wave(s, d)).select("utt_id", *[_r(F.col(c)).alias(c) for c in ("duration_s", "rms_dbfs", "peak_dbfs", "crest_factor_db")]),
     f"WITH {S_WAVE}, {S_LEVEL} SELECT utt_id, round(duration_s, 6) AS duration_s, round(rms_dbfs, 6) AS rms_dbfs, round(peak_dbfs, 6) AS peak_dbfs, round(peak_dbfs - rms_dbfs, 6) AS crest_factor_db FROM lv")
_add("rms_normalize", lambda s, d: v_wave(s, d).select("utt_id", F.posexplode(signal.rms_normalize(F.col("wav"), -27.0)).alias("i", "x")).select("utt_id", F.col("i").cast("long").alias("i"), _r(F.col("x")).alias("x")),
     f"WITH {S_WAVE}, {S_LEVEL} SELECT w.utt_id, unnest(range(0, len(wav))) AS i, round(unnest(wav) * pow(10, (-27.0 - rms_dbfs) / 20), 6) AS x FROM v_wave w JOIN lv ON lv.utt_id = w.utt_id")
_add("mono_mix", lambda s, d: v_wave(s, d).select("utt_id", F.posexplode(signal.mono_mix(F.array("wav", F.reverse("wav")))).alias("i", "x")).select("utt_id", F.col("i").cast("long").alias("i"), _r(F.col("x")).alias("x")),
     f"WITH {S_WAVE} SELECT utt_id, unnest(range(0, len(wav))) AS i, round(unnest(list_transform(list_zip(wav, list_reverse(wav)), lambda z: (z[1] + z[2]) / 2)), 6) AS x FROM v_wave")
S_FRAMES = f"""WITH {S_WAVE}, pd AS (SELECT utt_id, list_concat(list_concat([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], wav), [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) AS p FROM v_wave),
fr AS (SELECT utt_id, f AS frame, p[f * 8 + 1 : f * 8 + 16] AS x FROM pd, range(0, 8) t(f))"""
_add("frame_signal", lambda s, d: v_wave(s, d).select("utt_id", F.posexplode(signal.frame_signal(F.col("wav"), 8, 16)).alias("frame", "x")).select("utt_id", F.col("frame").cast("long").alias("frame"), F.size("x").cast("long").alias("n"), _r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("energy")),
     S_FRAMES + " SELECT utt_id, frame, len(x)::BIGINT AS n, round(list_dot_product(x, x), 6) AS energy FROM fr")
TILT = frames.SpectralTilt(window_length=16, n_fft=16, alpha=((0.0, 2000.0), (2000.0, 5000.0)), hammarberg=((0.0, 2000.0), (2000.0, 5000.0)))
_tilt = lambda s, d: TILT.compute(v_wave(s, d), frames.FrameGrid(8, 16_000))
S_TILT = S_FRAMES + """, wx AS (SELECT utt_id, frame, list_transform(x, lambda v, i: v * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 15))) AS x FROM fr),
pw AS (SELECT utt_id, frame, list_transform(range(0, 9), lambda k: pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 16))), 2) + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 16))), 2)) AS p FROM wx),
ti AS (SELECT utt_id, frame, 10 * log10((p[3] + p[4] + p[5] + p[6]) / (p[1] + p[2])) AS alpha_ratio_db, 10 * log10(greatest(p[1], p[2]) / greatest(p[3], p[4], p[5], p[6])) AS hammarberg_db FROM pw)"""
_add("spectral_tilt", lambda s, d: _tilt(s, d).select("utt_id", F.col("frame").cast("long").alias("frame"), _r(F.col("alpha_ratio_db"), 5).alias("alpha_ratio_db"), _r(F.col("hammarberg_db"), 5).alias("hammarberg_db")),
     S_TILT + " SELECT utt_id, frame, round(alpha_ratio_db, 5) AS alpha_ratio_db, round(hammarberg_db, 5) AS hammarberg_db FROM ti")


def _sets(s, d):
    t = _tilt(s, d).select("utt_id", "frame", F.lit("alpha_ratio_db").alias("descriptor"), F.col("alpha_ratio_db").alias("value"), (F.col("frame") % 3 > 0).alias("voiced"))
    return frames.frame_set_stats(t).select("utt_id", "descriptor", "frame_set", *[_r(F.col(c), 5).alias(c) for c in frames.STATISTICS], "n")


_add("frame_set_stats", _sets, S_TILT + """ SELECT utt_id, 'alpha_ratio_db' AS descriptor, frame_set, round(avg(a), 5) AS mean, round(stddev_samp(a), 5) AS std, round(median(a), 5) AS median, round(min(a), 5) AS min, round(max(a), 5) AS max, count(a) AS n
 FROM (SELECT utt_id, alpha_ratio_db AS a, unnest([CASE WHEN frame % 3 > 0 THEN 'voiced' ELSE 'unvoiced' END, 'all']) AS frame_set FROM ti) GROUP BY utt_id, frame_set""")
_hz = lambda s, d: _t(s, d, "events").select(F.col("user_id").alias("utt_id"), F.col("event_id").alias("frame"), F.when(F.col("event_id") % 4 > 0, 80 + F.col("value")).alias("f0_hz"))
_add("pitch_summary", lambda s, d: frames.pitch_summary(_hz(s, d)).select("utt_id", *[_r(F.col(c)).alias(c) for c in ("median_hz", "mean_semitones", "sd_semitones", "voiced_fraction")], "n_frames", "n_voiced_frames"),
     """WITH f AS (SELECT user_id AS utt_id, CASE WHEN event_id % 4 > 0 THEN 80 + value END AS f FROM events) SELECT utt_id, round(median(f), 6) AS median_hz, round(avg(12 * log2(f / 27.5)), 6) AS mean_semitones,
 round(stddev_samp(12 * log2(f / 27.5)), 6) AS sd_semitones, round(count(f) / count(*), 6) AS voiced_fraction, count(*) AS n_frames, count(f) AS n_voiced_frames FROM f GROUP BY utt_id""")
_add("formant_summary", lambda s, d: frames.formant_summary(_hz(s, d).select("utt_id", "frame", (F.col("frame") % 3 + 1).alias("formant"), F.col("f0_hz").alias("hz"), (F.col("frame") % 50).cast("double").alias("bandwidth"), (F.col("frame") % 5 > 0).alias("voiced"))).select("utt_id", "formant", *[_r(F.col(c)).alias(c) for c in ("median_hz", "sd_hz", "bandwidth_hz")], "n_frames"),
     """WITH f AS (SELECT user_id AS utt_id, event_id % 3 + 1 AS formant, CASE WHEN event_id % 4 > 0 AND event_id % 5 > 0 THEN 80 + value END AS h, (event_id % 50)::DOUBLE AS b FROM events)
 SELECT utt_id, formant, round(median(h), 6) AS median_hz, round(stddev_samp(h), 6) AS sd_hz, round(median(b) FILTER (WHERE h IS NOT NULL), 6) AS bandwidth_hz, count(h) AS n_frames FROM f GROUP BY utt_id, formant""")
_add("semitones", lambda s, d: _t(s, d, "events").select("event_id", _r(scalars.hz_to_semitones(F.col("value"))).alias("semitones"), _r(scalars.semitones_to_hz(scalars.hz_to_semitones(F.col("value")))).alias("hz")),
     "SELECT event_id, CASE WHEN value > 0 THEN round(12 * log2(value / 27.5), 6) END AS semitones, CASE WHEN value > 0 THEN round(value, 6) END AS hz FROM events")
_add("sex_range", lambda s, d: v_wave(s, d).select("utt_id", scalars.by_sex(F.col("sex"), {k: v[0] for k, v in scalars.PITCH_RANGES.items()}).alias("fmin_hz"), scalars.by_sex(F.col("sex"), scalars.FORMANT_CEILINGS).alias("ceiling_hz"), scalars.range_source(F.col("sex")).alias("range_source")),
     f"WITH {S_WAVE} SELECT utt_id, CASE sex WHEN 'Female' THEN 90.0 ELSE 60.0 END::DOUBLE AS fmin_hz, CASE sex WHEN ' male' THEN 5000.0 ELSE 5500.0 END::DOUBLE AS ceiling_hz, CASE WHEN sex IS NULL THEN 'default' ELSE 'sex' END AS range_source FROM v_wave")
_add("log_ratio", lambda s, d: _t(s, d, "events").select("event_id", _r(scalars.log_ratio(F.col("value"), (F.col("event_id") % 7).cast("double"))).alias("db")), "SELECT event_id, CASE WHEN value > 0 AND event_id % 7 > 0 THEN round(10 * log10(value / (event_id % 7)), 6) END AS db FROM events")


def _manifest(s, d):
    return v_scalar(s, d).withColumns({"signal_path": F.concat("utt_id", F.lit(".wav")), "corpus": F.concat(F.lit("c"), F.col("subject_id") % 2)})


_add("manifest", lambda s, d: manifest.resolve_paths(manifest.check_manifest(_manifest(s, d)), {"c0": "/data/a", "c1": "/data/b/"}).select("utt_id", "signal_path"), f"WITH {S_SCALAR} SELECT utt_id, CASE subject_id % 2 WHEN 0 THEN '/data/a/' ELSE '/data/b/' END || utt_id || '.wav' AS signal_path FROM v_scalar")
_add("manifest_limit", lambda s, d: manifest.limited(v_scalar(s, d), 20).select("utt_id"), f"WITH {S_SCALAR} SELECT utt_id FROM v_scalar ORDER BY utt_id LIMIT 20")
_prev = lambda s, d: v_scalar(s, d).select("utt_id", F.when(F.col("subject_id") < 4, F.col("value")).alias("level.rms_dbfs"))
_add("resume_pending", lambda s, d: select.pending(v_scalar(s, d), _prev(s, d), "level").select("utt_id"), f"WITH {S_SCALAR} SELECT utt_id FROM v_scalar WHERE subject_id >= 4")
_add("results_table", lambda s, d: results.assemble(_manifest(s, d), _prev(s, d), ["corpus"]).select("utt_id", "group_id", "condition", "corpus", _r(select.name("level.rms_dbfs")).alias("rms_dbfs")),
     f"WITH {S_SCALAR} SELECT utt_id, group_id, condition, 'c' || (subject_id % 2) AS corpus, CASE WHEN subject_id < 4 THEN round(value, 6) END AS rms_dbfs FROM v_scalar")
_add("artifact_scan", lambda s, d: results.array_features(v_speaker(s, d)[1], COLUMN, v_speaker(s, d)[0].filter("condition = '2'")).select("utt_id", F.size("value").cast("long").alias("dim")), "SELECT vec_id::VARCHAR AS utt_id, len(embedding)::BIGINT AS dim FROM embeddings WHERE vec_id % 5 = 2")


def _run_metrics(s, d):
    w = v_wave(s, d)
    rows = w.select("utt_id", F.lit("p").alias("signal_path"), "utt_id", F.lit("real").alias("condition"), "sex").toDF("utt_id", "signal_path", "group_id", "condition", "sex")
    table, _ = extract.run_metrics(rows, w.select("utt_id", "wav", "sample_rate"), extract.build_metrics([{"type": "level"}]), ["sex"])
    return table.select("utt_id", "condition", "sex", _r(select.name("level.rms_dbfs")).alias("rms_dbfs"), _r(select.name("level.crest_factor_db")).alias("crest_factor_db"))


_add("run_metrics", _run_metrics, f"WITH {S_WAVE}, {S_LEVEL} SELECT w.utt_id, 'real' AS condition, sex, round(rms_dbfs, 6) AS rms_dbfs, round(peak_dbfs - rms_dbfs, 6) AS crest_factor_db FROM v_wave w JOIN lv ON lv.utt_id = w.utt_id")

# Random draws have no SQL; tests hold them against their definitions.
_add("cluster_bootstrap", lambda s, d: contrasts.cluster_bootstrap_ci(v_scalar(s, d), "value", "group_id", by=["condition"], n_boot=1000))
_add("summarise", lambda s, d: displacement.summarise(displacement.per_group_slopes(_disp(s, d), "subject_id"), _disp(s, d), "subject_id", n_boot=1000))
_add("trial_sampling", lambda s, d: _trials(s, d, cap=500))
