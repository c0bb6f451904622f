"""Contrasts between conditions: wide tables, slopes per group, cluster bootstrap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import name, require, unique_or_raise


def to_wide(df: DataFrame, value_columns: list[str], group_col: str = "group_id", condition_col: str = "condition", conditions: list[str] | None = None, validate: bool = True) -> DataFrame:
    """One row for each group, a column ``<condition>.<value>`` for each condition and value."""
    require(df, group_col, condition_col, *value_columns)
    if validate:
        unique_or_raise(df, [group_col, condition_col], "several rows for a group and condition")
    if conditions is None:
        conditions = sorted(str(r[0]) for r in df.select(name(condition_col)).distinct().collect() if r[0] is not None)
    is_c = lambda c: name(condition_col).cast("string") == c
    cells = [F.max(F.when(is_c(c), name(v))).alias(f"{c}.{v}") for v in value_columns for c in conditions]
    return df.groupBy(name(group_col)).agg(*cells)


def slope_vs_target(df: DataFrame, value_col: str, target_col: str, group_col: str | None = "subject_id", min_points: int = 3) -> DataFrame:
    """Least squares of value on target in each group: slope, intercept, r, n. Groups with too few points or a constant
    target drop out; r is null where the value is constant."""
    y, x = name(value_col).cast("double"), name(target_col).cast("double")
    pairs = df.select((name(group_col) if group_col else F.lit("all")).alias(group_col or "__group"), y.alias("y"), x.alias("x"))
    group = group_col or "__group"
    pairs = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & name(group).isNotNull())
    fit = pairs.groupBy(name(group)).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.covar_samp("x", "y").alias("c"),
        F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"),
    )
    return fit.filter((F.col("n") >= min_points) & (F.col("hi") > F.col("lo"))).select(name(group), "slope", "intercept", F.try_divide("c", F.col("sx") * F.col("sy")).alias("r"), "n")


def bootstrap_mean(sums: np.ndarray, counts: np.ndarray, n_boot: int, alpha: float, seed: int) -> tuple[float, float]:
    """Percentile interval of the mean over clusters drawn with replacement; clusters by their sums and counts."""
    rng, k = np.random.default_rng(seed), len(sums)
    means = np.empty(n_boot)
    for i in range(n_boot):
        draw = rng.integers(0, k, size=k)
        means[i] = sums[draw].sum() / counts[draw].sum()
    return tuple(np.quantile(means, [alpha / 2, 1 - alpha / 2]))


def cluster_bootstrap_ci(df: DataFrame, value_col: str, cluster_col: str, by: list[str] | None = None, statistic: Callable[[np.ndarray], float] | None = None, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """estimate, ci_low, ci_high, n_clusters, n, in each group of ``by`` or over all rows.

    The mean needs a sum and a count of each cluster only; another statistic needs the values of a whole group."""
    by = by or []
    rows = df.select(*[name(c) for c in by], name(cluster_col).alias("__cluster"), name(value_col).cast("double").alias("__value")).filter(F.col("__value").isNotNull() & ~F.isnan("__value") & F.col("__cluster").isNotNull())
    out = "estimate double, ci_low double, ci_high double, n_clusters long, n long"
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    if statistic is None:
        rows = rows.groupBy(*[name(c) for c in by], "__cluster").agg(F.sum("__value").alias("__sum"), F.count(F.lit(1)).alias("__n"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__cluster")
            s, n = pdf["__sum"].to_numpy(), pdf["__n"].to_numpy()
            lo, hi = bootstrap_mean(s, n, n_boot, alpha, seed)
            return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), s.sum() / n.sum(), lo, hi, len(s), n.sum()]], columns=[*by, "estimate", "ci_low", "ci_high", "n_clusters", "n"])
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = [g.to_numpy() for _, g in pdf.groupby("__cluster", sort=True)["__value"]]
            rng = np.random.default_rng(seed)
            stats = [statistic(np.concatenate([own[i] for i in rng.integers(0, len(own), size=len(own))])) for _ in range(n_boot)]
            lo, hi = np.quantile(stats, [alpha / 2, 1 - alpha / 2])
            return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), statistic(np.concatenate(own)), lo, hi, len(own), len(pdf)]], columns=[*by, "estimate", "ci_low", "ci_high", "n_clusters", "n"])

    if not by and rows.limit(1).count() == 0:
        raise ValueError("no value to take an interval of")
    return rows.groupBy(*[name(c) for c in by]).applyInPandas(run, f"{keys}, {out}" if by else out)
