"""The tables behind figures; drawing needs the optional package matplotlib and stays outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import name

MOST_HUES = 3


def displacement_scatter(displacements: DataFrame, hue: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points with both values, and one row of shared limits (5 % wider) with the pooled line where there are over two."""
    points = displacements.filter(F.col("requested").isNotNull() & F.col("achieved").isNotNull() & ~F.isnan("requested") & ~F.isnan("achieved"))
    if hue is not None and points.select(name(hue)).distinct().limit(MOST_HUES + 1).count() > MOST_HUES:
        raise ValueError(f"{hue} has more than {MOST_HUES} levels")
    lo, hi = F.least(F.min("requested"), F.min("achieved")), F.greatest(F.max("requested"), F.max("achieved"))
    fit = points.agg(lo.alias("lo"), hi.alias("hi"), F.count(F.lit(1)).alias("n"), F.regr_slope("achieved", "requested").alias("s"), F.regr_intercept("achieved", "requested").alias("i"))
    pad = 0.05 * (F.col("hi") - F.col("lo"))
    return points, fit.select((F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"), "n", F.when(F.col("n") > 2, F.col("s")).alias("slope"), F.when(F.col("n") > 2, F.col("i")).alias("intercept"))


def proportion_curve(df: DataFrame, x: str, value: str, low: str, high: str, n: str | None = None) -> DataFrame:
    return df.select(name(x).alias("x"), name(value).alias("value"), name(low).alias("low"), name(high).alias("high"), *([name(n).alias("n")] if n else [])).orderBy("x")


def cell_heatmap(cells: DataFrame, row_col: str, col_col: str, value: str = "mean", levels: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells as a matrix, and the bound of a colour scale that is even around zero."""
    bound = cells.agg(F.max(F.abs(name(value))).alias("bound"))
    pivot = cells.groupBy(name(row_col)).pivot(col_col, levels) if levels else cells.groupBy(name(row_col)).pivot(col_col)
    return pivot.agg(F.first(name(value))).orderBy(name(row_col)), bound


def group_slopes(slopes: DataFrame, group_col: str) -> tuple[DataFrame, DataFrame]:
    """A dot for each measure and group, and the mean of each measure."""
    return slopes.select("metric", name(group_col), "slope").orderBy("metric", "slope"), slopes.groupBy("metric").agg(F.avg("slope").alias("slope_mean"))
