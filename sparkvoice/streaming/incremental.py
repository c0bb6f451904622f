"""Incremental extraction: a stream of manifest rows, each computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import pending
from ..sources.results import read_results


def extract_stream(manifests: DataFrame, compute: Callable[[DataFrame], DataFrame], metric: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the results of every new row to Parquet at ``path``; rows that have them already are passed over, so a
    batch that is run again adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        todo = pending(rows.dropDuplicates(["utt_id"]), read_results(rows.sparkSession, path), metric)
        compute(todo).write.mode("append").parquet(path)

    return manifests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
