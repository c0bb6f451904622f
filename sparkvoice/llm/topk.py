"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers floor(1024 x). With M the longest norm, a vector gets the further component sqrt(M^2 - |x|^2)
and a query a 0, so distance falls as the inner product rises. The distances of every vector to a fixed number of
pivots are computed once and kept with it. For a query, the triangle inequality over all pivots gives each candidate a
lower bound of its distance, hence an upper bound of its score; candidates are evaluated in bound order until the next
bound is below the k-th best score, which makes the answer exact.

Queries and candidates are dealt by hash into blocks of bounded size; each pair of blocks is one group, and the best k
of a query's groups are merged. A query enters its groups with a floor: the k-th best score among the pivot sample.

Defined cases: vectors that are null or hold null or non-finite components, and null ids, take no part; shorter
vectors count as filled up with zeros; of rows with the same id each is a query or candidate of its own, none is a
candidate for its own id, and the best of all queries of an id are ranked together; an empty table gives no rows;
scores beyond 64 bits are cut to the range of a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Rows from which pivots are chosen, and pivots.
SAMPLE, PIVOTS = 512, 64
QUERY_BLOCK, ROW_BLOCK, STEP = 1024, 8192, 256
SEED = 11


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of numbers as rows of floor(1024 x), filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim))
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return np.floor(out * 1024.0)


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal over the sample."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        far = int(near.argmax())
        chosen.append(far)
        near = np.minimum(near, ((sample - sample[far]) ** 2).sum(1))
    return sample[chosen]


def _exact(rows: np.ndarray, query: np.ndarray) -> list[int] | np.ndarray:
    """Integer inner products; beyond 2^53 in Python's integers, cut to 64 bits."""
    if len(rows) == 0 or float(np.abs(rows).max()) * float(np.abs(query).max()) * rows.shape[1] < 2.0**52:
        return (rows @ query).astype(np.int64)
    q = [int(v) for v in query]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for r in rows], dtype=np.int64)


def search_block(ids, rows, dists, q_id, query, q_dist, top, floor, k: int) -> tuple[list[tuple[int, int]], int]:
    """The best k (score, id) of one block for one query, and how many candidates were evaluated.

    top: |q|^2 + M^2. floor: a score that k candidates anywhere reach, or None."""
    low = np.abs(dists - q_dist).max(axis=1) if dists.shape[1] else np.zeros(len(ids))
    # Rounding: the bound is raised by more than the error of double arithmetic.
    high = (top - low * low) / 2 + 1 + 1e-9 * top
    order = np.argsort(-high, kind="stable")
    high = high[order]
    best_s, best_i, seen, kth = np.empty(0, np.int64), np.empty(0, np.int64), 0, floor
    while seen < len(order) and (kth is None or high[seen] >= kth):
        part = order[seen : seen + STEP]
        seen += len(part)
        part = part[ids[part] != q_id]
        s = np.concatenate([best_s, np.asarray(_exact(rows[part], query))])
        i = np.concatenate([best_i, ids[part]])
        keep = np.lexsort((i, -s))[:k] if len(s) == 0 or s.min() > -(2**63) else np.array(sorted(range(len(s)), key=lambda x: (-int(s[x]), i[x]))[:k], dtype=int)
        best_s, best_i = s[keep], i[keep]
        if len(best_s) == k and (kth is None or best_s[-1] > kth):
            kth = int(best_s[-1])
    return [(int(s), int(i)) for s, i in zip(best_s, best_i, strict=True)], seen


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query row (those where ``is_query`` holds)."""
    scratch = Scratch(spark, "topk")
    x = F.col(f"`{vector}`").cast("array<double>")
    fit = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & fit)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("id"), x.alias("v"))
    rows = scratch.table(rows.withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False))), "vectors")
    floored = F.transform("v", lambda c: F.floor(c * 1024.0).cast("double"))
    norm = F.aggregate(floored, F.lit(0.0), lambda a, c: a + c * c)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(norm).alias("m"), F.max(F.size("v")).alias("dim")).first()
    n, asked, longest, dim = facts["n"], facts["q"] or 0, facts["m"] or 0.0, max(facts["dim"] or 1, 1)
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "id", "row"), "id", "row").limit(SAMPLE).collect()
    s_ids = np.array([r["id"] for r in sample], dtype=np.int64)
    s_rows = _matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), dim) if sample else np.zeros((0, dim))
    lift = lambda m: np.hstack([m, np.sqrt(np.maximum(longest - (m * m).sum(1), 0))[:, None]])
    pivots = choose_pivots(lift(s_rows), PIVOTS)

    def distances(points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * points @ pivots.T
        # Cancellation can leave an error of a few units in the last place of the squares.
        return np.sqrt(np.maximum(square, 0))

    def measured(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            m = _matrix(t["v"], dim)
            d = distances(lift(m))
            dq = distances(np.hstack([m, np.zeros((len(m), 1))]))
            asks = t["asks"].to_numpy()
            ids = t["id"].to_numpy()
            floors = []
            for i, ask in enumerate(asks):
                s = np.sort(np.asarray(_exact(s_rows[s_ids != ids[i]], m[i])))[::-1] if ask else []
                floors.append(int(s[k - 1]) if len(s) >= k else None)
            lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64())) if a.shape[1] else pa.array([[]] * len(a), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([t["row"].combine_chunks(), t["id"].combine_chunks(), t["v"].combine_chunks(), lists(d), lists(dq), t["asks"].combine_chunks(), pa.array(floors, pa.int64())], names=["row", "id", "v", "d", "dq", "asks", "floor"])

    known = rows.mapInArrow(measured, "row long, id long, v array<double>, d array<double>, dq array<double>, asks boolean, floor long")
    known = scratch.table(known, "pivots")
    q_blocks, r_blocks = max(1, math.ceil(asked / QUERY_BLOCK)), max(1, math.ceil(n / ROW_BLOCK))
    left = known.filter("asks").select("id", "v", F.col("dq").alias("d"), "floor", F.pmod(F.xxhash64(F.lit(SEED + 1), "row"), F.lit(q_blocks)).alias("qb"))
    left = left.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    right = known.select("id", "v", "d", F.pmod(F.xxhash64(F.lit(SEED + 2), "row"), F.lit(r_blocks)).alias("rb"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def pair(asking: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and given.num_rows:
            ids, rows_, d = given["id"].to_numpy(), _matrix(given["v"], dim), _doubles(given["d"])
            qs, qd = _matrix(asking["v"], dim), _doubles(asking["d"])
            for i, q_id in enumerate(asking["id"].to_pylist()):
                top = float((qs[i] * qs[i]).sum()) + longest
                found, _ = search_block(ids, rows_, d, q_id, qs[i], qd[i], top, asking["floor"][i].as_py(), k)
                out += [(q_id, v, s) for s, v in found]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

    best = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(pair, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(f"rank <= {k}").select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the ten best for every vector whose id is divisible by 100."""
    return top_k(spark, table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
