"""The results table and the table of array artifacts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.select import carried, name

ID_COLUMNS = ("utt_id", "group_id", "condition")


def split_features(df: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """Columns of one metric's output (beside utt_id): scalars as ``<metric>.<key>``, arrays as rows of artifacts."""
    scalars, arrays = [], []
    for f in df.schema.fields:
        if f.name != "utt_id":
            (arrays if isinstance(f.dataType, T.ArrayType) else scalars).append(f.name)
    table = df.select("utt_id", *[name(c).alias(f"{metric}.{c}") for c in scalars])
    rows = None
    for c in arrays:
        part = df.filter(name(c).isNotNull()).select("utt_id", F.lit(f"{metric}.{c}").alias("column"), name(c).cast("array<double>").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return table, rows if rows is not None else df.select("utt_id", F.lit("").alias("column"), F.array().cast("array<double>").alias("value")).limit(0)


def assemble(manifest: DataFrame, results: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """Identifying and carried columns of all manifest rows, then the metric columns in order of name."""
    base = manifest.select(*[name(c) for c in [*ID_COLUMNS, *carried(manifest, carry, ID_COLUMNS)]])
    metrics = sorted(c for c in results.columns if c != "utt_id")
    return base.join(results.select("utt_id", *[name(c) for c in metrics]), "utt_id", "left")


def write_results(table: DataFrame, path: str, csv: bool = False) -> None:
    table.write.mode("overwrite").parquet(path)
    if csv:
        table.write.mode("overwrite").csv(path.rstrip("/") + "-csv", header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_artifacts(artifacts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each column, so reading one column reads its files only."""
    artifacts.write.mode(mode).partitionBy("column").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path).select("utt_id", F.col("column").cast("string").alias("column"), "value")
    except AnalysisException:
        return spark.createDataFrame([], "utt_id string, column string, value array<double>")


def array_features(artifacts: DataFrame, column: str, utt_ids: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """utt_id and value of one column; KeyError naming the columns there are if it has no row."""
    out = artifacts.filter(F.col("column") == column).select("utt_id", "value")
    if validate and out.limit(1).count() == 0:
        known = [r[0] for r in artifacts.select("column").distinct().orderBy("column").limit(50).collect()]
        raise KeyError(f"no artifact {column!r}; known: {known}")
    return out if utt_ids is None else out.join(utt_ids.select("utt_id").distinct(), "utt_id", "left_semi")
