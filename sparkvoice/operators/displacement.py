"""Requested against achieved displacement of measurements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contrasts import cluster_bootstrap_ci, slope_vs_target
from .select import carried, name, subjects, unique_or_raise


def _long(df: DataFrame, keys: dict[str, str], value_cols: list[str]) -> DataFrame:
    """keys (new name -> column) beside metric and value, a row for each measure."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), name(v).cast("double").alias("value")) for v in value_cols])).alias("__m")
    out = df.select(*[name(c).alias(k) for k, c in keys.items()], each)
    return out.select(*keys, "__m.metric", F.when(~F.isnan("__m.value"), F.col("__m.value")).alias("value"))


def _reference(df: DataFrame, value_cols: list[str], source_col: str, condition_col: str, condition: str, validate: bool) -> DataFrame:
    rows = df.filter(name(condition_col).cast("string") == str(condition)).filter(name(source_col).isNotNull())
    if validate:
        unique_or_raise(rows, [source_col], f"{source_col} does not identify a unique row of {condition}")
    return _long(rows, {"__k": source_col}, value_cols)


def displacement_table(
    df: DataFrame, value_cols: Iterable[str], *, source_col: str, target_col: str, key_col: str, condition_col: str, source_condition: str = "real",
    baseline_condition: str | None = None, subject_conditions: Iterable | None = None, carry: Iterable[str] = (), validate: bool = True,
) -> DataFrame:
    """Per subject row and measure: requested = reference at target - at source, achieved = value - baseline at source,
    error = achieved - requested. The target is looked up by the key of its own row."""
    values = [v for v in value_cols if v in df.columns]
    keep = carried(df, carry, (key_col, source_col, target_col, condition_col))
    chosen = subjects(df, condition_col, source_condition, baseline_condition, subject_conditions)
    if not values:
        return chosen.select(name(key_col), F.lit(None).cast("string").alias("metric"), *[F.lit(None).cast("double").alias(c) for c in ("requested", "achieved", "value", "value_source", "value_target", "value_baseline")], *[name(c) for c in keep], F.lit(None).cast("double").alias("error")).limit(0)
    if validate:
        unique_or_raise(df.filter(name(key_col).isNotNull()), [key_col], f"{key_col} does not identify a unique row")
    source = _reference(df, values, source_col, condition_col, source_condition, validate)
    base = source if baseline_condition is None else _reference(df, values, source_col, condition_col, baseline_condition, validate)
    target = _long(df, {"__t": key_col}, values)
    rows = _long(chosen, {"__id": key_col, "__src": source_col, "__tgt": target_col} | {f"__c{i}": c for i, c in enumerate(keep)}, values)
    met = (
        rows.join(source.select(F.col("__k").alias("__src"), "metric", F.col("value").alias("value_source")), ["__src", "metric"], "left")
        .join(base.select(F.col("__k").alias("__src"), "metric", F.col("value").alias("value_baseline")), ["__src", "metric"], "left")
        .join(target.select(F.col("__t").alias("__tgt"), "metric", F.col("value").alias("value_target")), ["__tgt", "metric"], "left")
    )
    met = met.withColumn("requested", F.col("value_target") - F.col("value_source")).withColumn("achieved", F.col("value") - F.col("value_baseline"))
    return met.select(F.col("__id").alias(key_col), "metric", "requested", "achieved", "value", "value_source", "value_target", "value_baseline", *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], (F.col("achieved") - F.col("requested")).alias("error"))


def baseline_displacement_table(
    df: DataFrame, value_cols: Iterable[str], *, source_col: str, target_col: str, key_col: str, condition_col: str, source_condition: str = "real",
    baseline_condition: str | None = None, subject_conditions: Iterable | None = None, carry: Iterable[str] = (), validate: bool = True,
) -> DataFrame:
    """The displacement that the baseline itself shows between target and source: what could be achieved at best."""
    values = [v for v in value_cols if v in df.columns]
    keep = carried(df, carry, (key_col, source_col, target_col, condition_col))
    chosen = subjects(df, condition_col, source_condition, baseline_condition, subject_conditions)
    source = _reference(df, values, source_col, condition_col, source_condition, validate)
    base = source if baseline_condition is None else _reference(df, values, source_col, condition_col, baseline_condition, validate)
    rows = _long(chosen, {"__id": key_col, "__src": source_col, "__tgt": target_col} | {f"__c{i}": c for i, c in enumerate(keep)}, values).drop("value")
    for side, at in ((source, "source"), (base, "baseline")):
        for end in ("src", "tgt"):
            rows = rows.join(side.select(F.col("__k").alias(f"__{end}"), "metric", F.col("value").alias(f"__{at}_{end}")), [f"__{end}", "metric"], "left")
    met = rows.withColumn("requested", F.col("__source_tgt") - F.col("__source_src")).withColumn("achieved", F.col("__baseline_tgt") - F.col("__baseline_src"))
    return met.select(
        F.col("__id").alias(key_col), "metric", "requested", "achieved", F.col("__baseline_tgt").alias("value"), F.col("__source_src").alias("value_source"), F.col("__source_tgt").alias("value_target"),
        F.col("__baseline_src").alias("value_baseline"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], (F.col("achieved") - F.col("requested")).alias("error"),
    )


def per_group_slopes(displacements: DataFrame, group_col: str, min_points: int = 3) -> DataFrame:
    """Slope of achieved on requested, for each measure and group: one pass over all measures."""
    both = displacements.filter(name(group_col).isNotNull()).withColumn("__key", F.struct("metric", name(group_col).alias("g")))
    out = slope_vs_target(both, "achieved", "requested", "__key", min_points)
    return out.select(F.col("__key.metric").alias("metric"), F.col("__key.g").alias(group_col), "slope", "intercept", "r", "n")


def summarise(slopes: DataFrame, displacements: DataFrame, group_col: str, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Per measure: groups, items, mean slope with its bootstrap interval over groups, spreads, mean error."""
    s = slopes.groupBy("metric").agg(F.count_distinct(name(group_col)).alias("n_groups"), F.avg("slope").alias("slope_mean"), F.stddev_samp("slope").alias("slope_sd_across_groups"), F.avg("intercept").alias("intercept_mean"))
    e = displacements.groupBy("metric").agg(F.count(F.lit(1)).alias("n_items"), F.avg("error").alias("error_mean"), F.stddev_samp("error").alias("error_sd"))
    ci = cluster_bootstrap_ci(slopes, "slope", group_col, by=["metric"], n_boot=n_boot, alpha=alpha, seed=seed).select("metric", F.col("ci_low").alias("slope_lo"), F.col("ci_high").alias("slope_hi"))
    return s.join(e, "metric").join(ci, "metric", "left").select("metric", "n_groups", "n_items", "slope_mean", "slope_lo", "slope_hi", "slope_sd_across_groups", "intercept_mean", "error_mean", "error_sd")


def cell_means(displacements: DataFrame, row_col: str, col_col: str, value: str = "error") -> DataFrame:
    """mean, std and n of each measure and cell."""
    v = name(value)
    known = displacements.filter(name(row_col).isNotNull() & name(col_col).isNotNull())
    return known.groupBy("metric", name(row_col), name(col_col)).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(F.lit(1)).alias("n"))
