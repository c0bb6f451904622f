"""The manifest: one row for each audio item, any further columns passed through."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("utt_id", "signal_path", "group_id", "condition")


def check_manifest(df: DataFrame, validate: bool = True) -> DataFrame:
    """ValueError for a missing column or a repeated utt_id; utt_id becomes a string."""
    gone = [c for c in REQUIRED if c not in df.columns]
    if gone:
        raise ValueError(f"the manifest lacks {', '.join(gone)}")
    df = df.withColumn("utt_id", F.col("utt_id").cast("string"))
    if validate:
        twice = df.groupBy("utt_id").count().filter("count > 1").orderBy("utt_id").limit(10).collect()
        if twice:
            raise ValueError("utt_id is not unique: " + ", ".join(str(r[0]) for r in twice))
    return df


def resolve_paths(df: DataFrame, dataset_roots: Mapping[str, str] | None = None, dataset_root: str | None = None) -> DataFrame:
    """signal_path below the root of its corpus, or below one root; without roots paths stay as they are."""
    if dataset_roots and dataset_root:
        raise ValueError("give dataset_roots or dataset_root, not both")
    path = F.col("signal_path")
    if dataset_root:
        return df.withColumn("signal_path", F.concat_ws("/", F.lit(dataset_root.rstrip("/")), path))
    if dataset_roots:
        roots = F.create_map(*[F.lit(x) for k, v in dataset_roots.items() for x in (k, v.rstrip("/"))])
        root = F.element_at(roots, F.col("corpus"))
        return df.withColumn("signal_path", F.when(root.isNotNull(), F.concat_ws("/", root, path)).otherwise(path))
    return df


def load_manifest(spark: SparkSession, path: str, dataset_roots: Mapping[str, str] | None = None, dataset_root: str | None = None, validate: bool = True) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True)
    return resolve_paths(check_manifest(df, validate), dataset_roots, dataset_root)


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by utt_id."""
    return df if n is None else df.orderBy("utt_id").limit(int(n))
