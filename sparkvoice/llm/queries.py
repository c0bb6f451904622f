"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship
from . import bpe, hmm, html, mixing, neardup, quality, sharding, topk, toxicity, urls



def _shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after its code has gone to the executors."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {
    "op1_topk_search": topk.query,
    "op2_toxicity": toxicity.query,
    "op3_html_extraction": html.query,
    "op4_quality_rules": quality.query,
    "op5_url_filters": urls.query,
    "op6_sharding": sharding.query,
    "op7_bpe": bpe.query,
    "op8_mixing": mixing.query,
    "op9_lm_scoring": hmm.query,
    "op10_minhash_dedup": neardup.query,
}
QUERIES = {name: _shipped(run) for name, run in QUERIES.items()}

ORACLES = {
    "op1_topk_search": topk.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op10_minhash_dedup": neardup.ORACLE,
}
