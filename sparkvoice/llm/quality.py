"""Quality rules with host verdicts.

Every document is measured and held against document rules. The failures of each rule are summed by host, each host's
rate is shrunk towards a beta prior estimated from all hosts, and a host whose shrunk rate of some rule is above a
limit loses all its documents. Only DataFrame functions are used.

Defined cases: a null or empty text has no words, so it fails; a null host is a host of its own; repeated rows are
judged one by one; an empty table gives an empty table; columns of the input beyond the text, id and host are ignored
by ``document_measures`` and kept by ``apply_rules``. Five-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, table, words

WINDOW = 5
#: Rules by name, over the measures; a document fails a rule where it is true.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def document_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The measures of every whole text beside the columns in ``keep``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    df = df.withColumn("__w", words(F.col("__t")))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    h = F.col("__h")
    window = F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
    )
    df = df.select(
        *[F.col(f"`{c}`") for c in keep],
        *MEASURES[:3],
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        window.alias("__v"),
    )
    # Only texts in which some window occurs twice are sorted.
    again = F.size(F.array_distinct("__v")) < F.size("__v")
    df = df.withColumn("__s", F.when(again, F.sort_array(F.transform("__v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.drop("__v")
    s = F.col("__s")
    same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
    at = F.filter(
        F.transform(s, lambda x, j: F.when(same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))), x["i"])),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("__p", F.sort_array(at)).drop("__s")
    p = F.col("__p")
    steps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def failed(rule: str) -> Column:
    return F.coalesce(F.expr(RULES[rule]), F.lit(False))


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """Per host: documents, failures by rule, shrunk rates and ``host_rejected``.

    For a rule with overall rate m, the variance of host rates beyond that of binomial counts is t; the prior's weight
    is m(1-m)/t - 1 documents. Without such variance every host has the overall rate.
    """
    hosts = measured.groupBy(F.col(host)).agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(failed(r).cast("long")).alias(f"failed_{r}") for r in RULES]
    )
    total = hosts.agg(
        F.sum("host_docs").alias("n"), F.count(F.lit(1)).alias("h"),
        *[F.sum(f"failed_{r}").alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("host_docs")).alias(f"s_{r}") for r in RULES],
    ).first()
    rejected = F.lit(False)
    for r in RULES:
        n, m, k = total["n"] or 1, 0.0, 0.0
        if total["n"]:
            m = total[f"f_{r}"] / n
            between = total[f"s_{r}"] / n - m * m - m * (1 - m) * total["h"] / n
            k = m * (1 - m) / between - 1 if between > 1e-12 else 1e12
        rate = (F.col(f"failed_{r}") + F.lit(k * m)) / (F.col("host_docs") + F.lit(k))
        hosts = hosts.withColumn(f"rate_{r}", rate)
        rejected = rejected | (F.col(f"rate_{r}") > F.lit(limit))
    return hosts.withColumn("host_rejected", rejected)


def judge(spark: SparkSession, measured: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """Measures with base_failed, the host's figures and kept. ``measured`` must be cheap to read twice."""
    hosts = host_verdicts(measured, host, limit).withColumnRenamed(host, "__host")
    base = F.lit(False)
    for r in RULES:
        base = base | failed(r)
    joined = measured.withColumn("base_failed", base).join(hosts, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def apply_rules(spark: SparkSession, docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    packed = packed.select("__doc", F.col(f"__doc.`{text}`").alias("text"), F.col(f"__doc.`{host}`").alias("source"))
    measured = Scratch(spark, "quality").table(document_measures(packed), "measures")
    return judge(spark, measured).filter("kept").select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: verdicts over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = Scratch(spark, "op4").table(document_measures(docs), "measures")
    return judge(spark, measured).select(
        "doc_id", *MEASURES, "base_failed", "kept", "source", "host_docs", "host_rejected"
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i:i+4] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS k FROM g) WHERE k > 1),
n AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS k FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM c) GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.k, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN n ON w.r = n.r),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (WHERE n_words < 10) AS a,
             count(*) FILTER (WHERE 100 * n_repeat_words > 20 * n_words) AS b FROM m GROUP BY source),
p AS (SELECT sum(host_docs) AS n, count(*) AS h, sum(a) / sum(host_docs) AS ma, sum(b) / sum(host_docs) AS mb,
             sum(a * a / host_docs) / sum(host_docs) AS sa, sum(b * b / host_docs) / sum(host_docs) AS sb FROM h),
q AS (SELECT *, sa - ma * ma - ma * (1 - ma) * h / n AS ta, sb - mb * mb - mb * (1 - mb) * h / n AS tb FROM p),
k AS (SELECT ma, mb, CASE WHEN ta > 1e-12 THEN ma * (1 - ma) / ta - 1 ELSE 1e12 END AS ka,
             CASE WHEN tb > 1e-12 THEN mb * (1 - mb) / tb - 1 ELSE 1e12 END AS kb FROM q),
v AS (SELECT source, host_docs, (a + ka * ma) / (host_docs + ka) > 0.5 OR (b + kb * mb) / (host_docs + kb) > 0.5 AS host_rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT host_rejected AS kept,
       m.source, host_docs, host_rejected
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""
