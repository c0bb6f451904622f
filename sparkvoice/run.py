"""Extraction from a configuration: ``python -m sparkvoice.run config.yaml output``.

Keys: ``data.manifest``, ``data.dataset_roots`` or ``data.dataset_root``, ``data.carry_columns``, ``data.limit``,
``runner.resume``, and ``metrics``, a list of ``type``, ``name`` and further arguments. Every run writes a table and
artifacts of its own number below the output; the last complete one is what a resumed run starts from.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame, SparkSession

from .cluster import ship
from .plans.extract import build_metrics, run_metrics
from .sources import results
from .sources.audio import read_audio
from .sources.manifest import limited, load_manifest


def runs(spark: SparkSession, output: str) -> list[int]:
    """Numbers of the complete runs below a folder."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/metrics-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(re.search(r"metrics-(\d+)", str(f.getPath().toString()))[1]) for f in found)


def last_run(spark: SparkSession, output: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Table and artifacts of the last complete run."""
    done = runs(spark, output)
    if not done:
        return None, None
    return results.read_results(spark, f"{output}/metrics-{done[-1]:05d}"), results.read_artifacts(spark, f"{output}/artifacts-{done[-1]:05d}")


def run_config(spark: SparkSession, config: dict, output: str, backends: dict | None = None) -> DataFrame:
    """Extract what a configuration asks for and return the table as written. ``backends``: functions by metric name."""
    if not config.get("metrics"):
        raise ValueError("the configuration names no metrics")
    ship(spark)
    data, runner = config["data"], config.get("runner") or {}
    metrics = build_metrics(config["metrics"])
    for m in metrics:
        if backends and m.name in backends:
            m.backend = backends[m.name]
    manifest = limited(load_manifest(spark, data["manifest"], data.get("dataset_roots"), data.get("dataset_root")), data.get("limit"))
    audio = read_audio(spark, manifest).select("utt_id", "sample_rate", "channels")
    before, arrays = last_run(spark, output) if runner.get("resume") else (None, None)
    table, artifacts = run_metrics(manifest, audio, metrics, data.get("carry_columns") or [], before)
    number = (runs(spark, output) or [0])[-1] + 1
    if arrays is not None:
        artifacts = artifacts.unionByName(arrays.join(artifacts.select("utt_id", "column"), ["utt_id", "column"], "left_anti"))
    # The table comes last: its marker is what makes a run complete.
    results.write_artifacts(artifacts, f"{output}/artifacts-{number:05d}")
    results.write_results(table, f"{output}/metrics-{number:05d}")
    return results.read_results(spark, f"{output}/metrics-{number:05d}")


def main(args: list[str]) -> None:
    import yaml

    with open(args[0], encoding="utf-8") as f:
        config = yaml.safe_load(f)
    spark = SparkSession.builder.appName("sparkvoice").getOrCreate()
    print(run_config(spark, config, args[1]).count())


if __name__ == "__main__":
    main(sys.argv[1:])
