"""URL filtering by rules and by a ratio of character language models.

Rules decide first. For the other URLs two Markov models of host and path are compared, one of rejected URLs (those a
rule blocks) and one of accepted URLs (those a rule allows and those no rule speaks of). A model's probability of a
character after up to four others is its count there smoothed towards the next shorter context. A URL's score is the
difference of log10 likelihoods, accepted less rejected, over its length. URLs are halved by a hash; each half trains
models for the other, so no URL is judged by a model that has seen it. The threshold is the highest one that at most one
in a hundred accepted URLs falls below. Only DataFrame functions are used.

Defined cases: a null URL or one without ``://`` has empty host and path; equal URLs get equal verdicts; models of a
half without any rejected URL block nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, small, table

#: verdict, host, path
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ORDER = 4
#: Weight of the shorter context, in characters seen; characters that there may be.
PULL, ALPHABET = 2.0, 256.0
#: Windows of characters broadcast at most; all others are joined by shuffle.
HOT = 16_384
#: Bins of scores for each unit, and the largest bin.
BIN, LAST = 1000, 10_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return lower_ascii(raw), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def window_weights(windows: DataFrame) -> DataFrame:
    """windows: w (ORDER + 1 characters), a, r (counts in accepted and rejected training URLs).

    Gives w and delta, the log10 ratio of the models' probabilities of the last character after the others."""
    totals = windows.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first()
    base = windows.select("w", F.array_remove(F.split("w", ""), "").alias("c"), "a", "r")
    out = base
    gram = lambda k, n: F.concat_ws("", F.slice("c", ORDER + 1 - k, n))
    p = {"a": F.lit(1 / ALPHABET), "r": F.lit(1 / ALPHABET)}
    for k in range(ORDER + 1):
        whole = base.select(gram(k, k + 1).alias(f"g{k}"), "a", "r").groupBy(f"g{k}").agg(F.sum("a").alias(f"ga{k}"), F.sum("r").alias(f"gr{k}"))
        # Short ones are few, and one of them may stand in a large share of all windows.
        out = out.withColumn(f"g{k}", gram(k, k + 1)).join(small(whole, 64) if k < 2 else whole, f"g{k}")
        if k:
            past = base.select(gram(k, k).alias(f"x{k}"), "a", "r").groupBy(f"x{k}").agg(F.sum("a").alias(f"xa{k}"), F.sum("r").alias(f"xr{k}"))
            out = out.withColumn(f"x{k}", gram(k, k)).join(small(past, 64) if k < 3 else past, f"x{k}")
        for m in "ar":
            seen = F.col(f"x{m}{k}") if k else F.lit(totals[m])
            pull = PULL if k else ALPHABET
            p[m] = (F.col(f"g{m}{k}") + pull * p[m]) / (seen + pull)
    return out.select("w", "a", "r", (F.log10(p["a"]) - F.log10(p["r"])).alias("delta"))


def characters(host: Column, path: Column) -> Column:
    """The characters of host and path, with ORDER marks before and one after."""
    return F.array_remove(F.split(F.concat(F.lit("\x02" * ORDER), host, path, F.lit("\x03")), ""), "")


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", wrong: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    scratch = Scratch(spark, "urls")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("__u"))
    host, path = split_url(F.col("__u"))
    rows = rows.select("row", "page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = scratch.table(rows.select("row", "page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled")), "rows")
    blocked = F.coalesce(F.col("ruled") == "block", F.lit(False))
    # Equal URLs are scored once, with their number.
    texts = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.first("ruled").alias("ruled")).withColumn("blocked", blocked)
    texts = texts.withColumn("half", F.pmod(F.xxhash64("host", "path"), F.lit(2)).cast("int"))
    texts = scratch.table(texts.withColumn("key", F.xxhash64("host", "path")), "texts")
    chars = texts.withColumn("c", characters(F.col("host"), F.col("path")))
    spot = F.explode(F.sequence(F.lit(1), F.size("c") - ORDER))
    spots = chars.select("host", "path", "key", "n", "blocked", "half", "c", spot.alias("i"))
    spots = spots.select("host", "path", "key", "n", "blocked", "half", F.concat_ws("", F.slice("c", F.col("i"), F.lit(ORDER + 1))).alias("w"))
    seen = lambda bad, h: F.sum(F.when((F.col("blocked") == bad) & (F.col("half") == h), F.col("n")).otherwise(0))
    counts = [seen(bad, h).alias(f"{c}{h}") for c, bad in (("a", False), ("r", True)) for h in (0, 1)]
    windows = scratch.table(spots.groupBy("w").agg(*counts, F.count(F.lit(1)).alias("uses")), "windows")
    delta = windows.select("w", "uses")
    for h in (0, 1):
        own = window_weights(windows.select("w", F.col(f"a{h}").alias("a"), F.col(f"r{h}").alias("r"))).select("w", F.col("delta").alias(f"d{h}"))
        delta = scratch.table(delta.join(own, "w"), f"deltas{h}")
    # The windows used most stand in nearly every URL; they are few by definition, so they alone are broadcast.
    hot = delta.orderBy(F.col("uses").desc(), "w").limit(HOT).select("w", F.col("d0").alias("h0"), F.col("d1").alias("h1"))
    hot = scratch.table(hot, "hot")
    of_other = lambda zero, one: F.when(F.col("half") == 0, F.col(one)).otherwise(F.col(zero))
    tried = spots.select("key", "host", "path", "half", "w").join(F.broadcast(hot), "w", "left")
    sums = tried.groupBy("key", "host", "path", "half").agg(F.sum(of_other("h0", "h1")).alias("llr"), F.collect_list(F.when(F.col("h0").isNull(), F.col("w"))).alias("cold"))
    sums = scratch.table(sums, "sums")
    rest = sums.select("key", "host", "path", "half", F.explode("cold").alias("w")).join(delta.select("w", "d0", "d1"), "w").groupBy("key", "host", "path").agg(F.sum(of_other("d0", "d1")).alias("more"))
    length = F.length("host") + F.length("path") + 1
    scored = texts.join(sums.select("key", "host", "path", "llr"), ["key", "host", "path"], "left").join(rest, ["key", "host", "path"], "left")
    scored = scored.withColumn("score", (F.coalesce("llr", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))) / length)
    scored = scratch.table(scored.select("host", "path", "n", "blocked", "half", "score"), "scores")
    # A histogram of bounded size instead of all scores.
    held = scored.filter("not blocked").withColumn("bin", F.greatest(F.least(F.floor(F.col("score") * BIN), F.lit(LAST)), F.lit(-LAST)))
    bins = held.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    known = {r["half"] for r in scored.filter("blocked").select("half").distinct().collect()}
    total, below, limit = sum(b["n"] for b in bins), 0, -LAST / BIN
    for b in bins:
        limit = b["bin"] / BIN
        below += b["n"]
        if below > wrong * total:
            break
    verdicts = scored.select("host", "path", "half", "score")
    fit = (F.lit(1) - F.col("half")).isin(*known) if known else F.lit(False)
    say = F.when((F.col("score") < limit) & fit, "block").otherwise("allow")
    joined = rows.join(verdicts, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", say).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: verdicts on all pages."""
    return judge(spark, table(spark, sf_dir, "pages"))
