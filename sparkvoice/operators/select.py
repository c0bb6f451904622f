"""Row filters. What is dropped is counted and said, never silent."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("sparkvoice")


def name(c: str) -> Column:
    """A column by its whole name; names of measurements hold a dot."""
    return F.col(f"`{c}`")


def require(df: DataFrame, *columns: str) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise KeyError(f"missing columns: {', '.join(gone)}")


def unique_or_raise(df: DataFrame, keys: list[str], message: str, shown: int = 5) -> None:
    """ValueError naming the first few keys that stand for more than one row."""
    twice = df.groupBy(*[name(k) for k in keys]).count().filter("count > 1").orderBy(*[name(k) for k in keys]).limit(shown).collect()
    if twice:
        raise ValueError(f"{message}: " + ", ".join(str(r[0] if len(keys) == 1 else tuple(r[:-1])) for r in twice))


def with_transcript(manifest: DataFrame, needs_text: bool = True) -> DataFrame:
    """Rows whose text is neither null nor blank; none where there is no such column."""
    if not needs_text:
        return manifest
    if "text" not in manifest.columns:
        return manifest.limit(0)
    return manifest.filter(F.col("text").isNotNull() & (F.regexp_replace("text", r"(?U)\s+", "") != ""))


def status_column_for(value_col: str, df: DataFrame) -> str | None:
    """The status column beside a measurement, if there is one."""
    found = value_col.rsplit(".", 1)[0] + ".status"
    return found if found in df.columns else None


def status_counts(df: DataFrame, status_col: str, ok: Iterable[str] = ("ok",)) -> DataFrame:
    """How many rows each flag other than ok would drop."""
    flag = F.coalesce(name(status_col).cast("string"), F.lit("nan"))
    return df.select(flag.alias("status")).filter(~F.col("status").isin(*ok)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def exclude_flagged_rows(df: DataFrame, status_col: str | None, ok: Iterable[str] = ("ok",), label: str = "", report: bool = False) -> DataFrame:
    """Rows whose status is ok; a null status is not. ``report`` logs the counts, at the cost of a job."""
    if status_col is None:
        return df
    require(df, status_col)
    ok = tuple(ok)
    if report:
        dropped = {r["status"]: r["n"] for r in status_counts(df, status_col, ok).collect()}
        log.info("%s: %d rows excluded by %s: %s", label, sum(dropped.values()), status_col, dropped)
    return df.filter(F.coalesce(name(status_col).cast("string"), F.lit("nan")).isin(*ok))


def duration_floor(df: DataFrame, duration_col: str, least: float | None) -> DataFrame:
    """Drops shorter rows; an unknown duration is kept."""
    if least is None:
        return df
    require(df, duration_col)
    d = name(duration_col)
    return df.filter(~F.coalesce((d < least) & ~F.isnan(d.cast("double")), F.lit(False)))


def in_conditions(df: DataFrame, condition_col: str, conditions: Iterable | None) -> DataFrame:
    if conditions is None:
        return df
    return df.filter(name(condition_col).cast("string").isin(*[str(c) for c in conditions]))


def subjects(df: DataFrame, condition_col: str, source: str, baseline: str | None, chosen: Iterable | None = None) -> DataFrame:
    """The rows under study: those chosen, or all that are neither source nor baseline (null conditions among them)."""
    c = name(condition_col).cast("string")
    if chosen is not None:
        return df.filter(c.isin(*[str(x) for x in chosen]))
    return df.filter(F.coalesce(~c.isin(*[x for x in (source, baseline) if x is not None]), F.lit(True)))


def carried(df: DataFrame, carry: Iterable[str], identifying: Iterable[str]) -> list[str]:
    """Carry columns that are there and do not identify rows already, once each, in order."""
    have = set(identifying)
    return [c for c in dict.fromkeys(carry) if c in df.columns and c not in have]


def usable_rows(df: DataFrame, artifacts: DataFrame, embedding_col: str, status_col: str | None = "auto", ok: Iterable[str] = ("ok",), min_duration_s: float | None = None) -> DataFrame:
    """Rows with an ok status, long enough, joined with their embedding (columns utt_id, value in artifacts)."""
    from ..functions.vec import finite

    if status_col == "auto":
        status_col = status_column_for(embedding_col, df)
    df = exclude_flagged_rows(df, status_col, ok, embedding_col)
    if min_duration_s is not None:
        df = duration_floor(df, embedding_col.rsplit(".", 1)[0] + ".duration_s", min_duration_s)
    vectors = artifacts.filter(F.col("column") == embedding_col) if "column" in artifacts.columns else artifacts
    vectors = vectors.filter(finite(F.col("value"))).select(F.col("utt_id").cast("string").alias("__utt"), F.col("value").alias("__vector"))
    return df.withColumn("__utt", F.col("utt_id").cast("string")).join(vectors, "__utt").drop("__utt")


def resolve_reference(df: DataFrame, reference_condition: str, value_col: str, group_col: str = "group_id", condition_col: str = "condition", validate: bool = True) -> DataFrame:
    """Rows with ``__reference``, the value of their group's row of the reference condition; groups without drop out."""
    require(df, value_col, group_col, condition_col)
    ref = df.filter(name(condition_col).cast("string") == str(reference_condition)).select(name(group_col).alias("__g"), name(value_col).alias("__reference"))
    if validate:
        unique_or_raise(ref, ["__g"], f"several rows of {reference_condition} in a group")
    value = F.col("__reference")
    kind = dict(ref.dtypes)["__reference"]
    ref = ref.filter(value.isNotNull() & (~F.isnan(value) if kind in ("double", "float") else F.lit(True)))
    return df.join(ref, name(group_col).eqNullSafe(F.col("__g"))).drop("__g")


def without_reference(df: DataFrame, reference_condition: str, value_col: str, group_col: str = "group_id", condition_col: str = "condition") -> DataFrame:
    """The rows that resolve_reference drops."""
    ref = df.filter((name(condition_col).cast("string") == str(reference_condition)) & name(value_col).isNotNull()).select(name(group_col).alias("__g"))
    return df.join(ref, name(group_col).eqNullSafe(F.col("__g")), "left_anti")


def already_done(previous: DataFrame, metric: str) -> DataFrame:
    """utt_id of rows that have any value of a metric."""
    own = [c for c in previous.columns if c.startswith(metric + ".")]
    if not own:
        return previous.select("utt_id").limit(0)
    return previous.filter(F.coalesce(*[name(c).cast("string") for c in own]).isNotNull()).select("utt_id").distinct()


def pending(manifest: DataFrame, previous: DataFrame | None, metric: str) -> DataFrame:
    """Rows that a metric has still to be computed for."""
    return manifest if previous is None else manifest.join(already_done(previous, metric), "utt_id", "left_anti")
