"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash; pass two puts each bucket into one order
that does not depend on how rows arrived and shuffles it by Fisher-Yates with a generator seeded by bucket. Buckets
one after another are the shuffled order, and shards are equal stretches of it, so their row counts differ by one at
most.

Defined cases: a null text counts as empty; null ids take part; repeated rows each have a place of their own (equal
rows are spread over buckets by their place among equals in their input partition); an empty table gives no rows;
other columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SEED = 20240117
#: Rows and bytes that a bucket holds on average; a bucket's keys are what a task shuffles in memory.
BUCKET_ROWS = 200_000


def fisher_yates(n: int, seed: int) -> list[int]:
    """A permutation of range(n): position of the element that goes to each place."""
    rng, order = random.Random(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = rng.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending"), ("row", "ascending")])
        b = bucket["bucket"][0].as_py()
        bucket = bucket.take(pa.array(fisher_yates(bucket.num_rows, seed * 1_000_003 + b)))
        return bucket.select(["row", "doc_id", "size", "text_crc32", "bucket"]).append_column("place", pa.array(range(bucket.num_rows), pa.int64()))

    return run


def assign(spark: SparkSession, docs: DataFrame, shards: int = 16, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, text: str = "text", doc_id: str = "doc_id", row=None) -> DataFrame:
    """row, doc_id, size, text_crc32, law, shard and slot of every row."""
    scratch = Scratch(spark, "sharding")
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    slim = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    # The id, text and length decide the bucket; the low bits of the row number only part rows equal in all of these.
    slim = slim.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    slim = scratch.table(slim, "rows")
    total = slim.count()
    buckets = max(shards, shards * math.ceil(total / shards / bucket_rows))
    repeated = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, bucket_rows // 20)).select("key", F.lit(True).alias("many"))
    slim = slim.join(repeated, "key", "left")
    spot = F.when(F.col("many"), F.xxhash64(F.lit(seed), "key", "row")).otherwise(F.xxhash64(F.lit(seed + 1), "key"))
    dealt = slim.select("row", "doc_id", "size", "text_crc32", "key", F.pmod(spot, F.lit(buckets)).cast("int").alias("bucket"))
    placed = dealt.groupBy("bucket").applyInArrow(_shuffled(seed), "row long, doc_id long, size long, text_crc32 long, bucket int, place long")
    placed = scratch.table(placed, "places")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.select("bucket", before.alias("before"))
    at = F.col("before") + F.col("place")
    # Shard s holds the places from ceil(s * total / shards) on.
    shard = F.expr(f"cast(((before + place) * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.join(spans, "bucket").withColumn("shard", shard)
        .select("row", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - first).cast("long").alias("slot"))
    )


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write all columns of docs as Parquet, a folder per shard, rows in slot order within each stretch."""
    whole = Scratch(spark, "sharding").table(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
    where = assign(spark, whole, shards, seed, bucket_rows, row=F.col("__row")).select(F.col("row").alias("__row"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = whole.join(where, "__row").withColumn("__part", F.expr(f"__slot div {bucket_rows}"))
    parts = max(shards, 1)
    (
        out.repartition(parts * 4, "__shard", "__part").sortWithinPartitions("__shard", "__slot")
        .drop("__row", "__part").withColumnsRenamed({"__shard": "shard", "__slot": "slot"} if not {"shard", "slot"} & set(docs.columns) else {})
        .write.partitionBy("shard" if not {"shard", "slot"} & set(docs.columns) else "__shard").mode("overwrite").parquet(path)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: shard and slot of every document under the law ``rows``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(spark, docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
