"""Exact top-k search by inner product: aggregation over sorted lists without random access.

Each dimension is a list of the candidates sorted by their component; a query reads it from the top where its own component
is positive and from the bottom where it is negative. After each stretch of reading every candidate has a lower and an
upper bound: what was read of it counts as it is, the rest as the worst or the best that may still come. Reading stops when
no outsider's upper bound reaches the k-th lower bound; the scores of those still in question are then resolved.

Vectors become integers floor(64 x). All queries meet all candidates, block by block: a block of candidates and a block of
queries are one group of bounded size, its lists are sorted once for all of its queries, and the bounds of all pairs in it
are matrix products. Only each block's best k of a query go on to the final ranking. Both kinds of blocks are dealt by a
hash of the row's own number, so equal vectors spread.

Vectors that are null or hold null, NaN or infinite components, or have no ``vec_id``, take no part; an empty vector has only scores of 0. Vectors
meet those of equal length. Ties go to the smaller ``vec_id``. A row never finds itself, but rows that repeat find each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.llm.common import stored, table

K, SCALE, CANDIDATES, QUERIES, AT_ONCE = 20, 64, 4096, 4096, 256
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)
SCHEMA = "query long, query_id long, vec_id long, score long"


def best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of its best ``k``; ``own`` is the position to leave out, or -1."""
    n, dims = vectors.shape
    ordered = np.sort(vectors, axis=0)
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1)
    out: list = [None] * len(queries)
    left = np.arange(len(queries))
    for depth in DEPTHS:
        read = min(n, max(int(np.ceil(n * depth)), 1))
        from_top, from_bottom = ordered[n - read], ordered[read - 1]
        high, low = vectors >= from_top, vectors <= from_bottom
        # a list's unread entries lie below what was read of it
        most = np.concatenate([np.where(high, vectors, from_top - 1), np.where(low, vectors, from_bottom + 1)], 1)
        least = np.concatenate([np.where(high, vectors, ordered[0]), np.where(low, vectors, ordered[-1])], 1)
        upper, lower = weights[left] @ most.T, weights[left] @ least.T
        rows = np.flatnonzero(own[left] >= 0)
        upper[rows, own[left][rows]] = lower[rows, own[left][rows]] = -np.inf
        bound = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(left), -np.inf)
        within = upper >= bound[:, None]
        done = np.ones(len(left), bool) if read == n else within.sum(1) <= 4 * k
        for i in np.flatnonzero(done):
            q = left[i]
            at = np.flatnonzero(within[i] & (upper[i] > -np.inf))
            scores = vectors[at] @ queries[q]
            order = np.lexsort((ids[at], -scores))[:k]
            out[q] = (at[order], scores[order])
        left = left[~done]
        if not len(left):
            break
    return out


def searched(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``rows(vec_id, embedding)`` that ``is_query`` marks."""
    x = F.col("embedding")
    finite = F.coalesce(F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    valid = stored(rows.where(finite & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    counts = valid.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    n_blocks, q_blocks = -(-counts["n"] // CANDIDATES) or 1, -(-counts["q"] // QUERIES) or 1
    part = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = valid.select("row", "vec_id", "v", F.size("v").alias("d"), part(n_blocks, 1).alias("c"), every(q_blocks).alias("q"))
    queries = valid.where("asks").select("row", "vec_id", "v", F.size("v").alias("d"), part(q_blocks, 2).alias("q"), every(n_blocks).alias("c"))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))

    def match(cs: pa.Table, qs: pa.Table) -> pa.Table:
        found: dict[str, list] = {c.split()[0]: [np.zeros(0, np.int64)] for c in SCHEMA.split(", ")}
        if cs.num_rows and qs.num_rows:
            vectors, asked = matrix(cs), matrix(qs)
            if vectors.shape[1] and np.abs(vectors).max() * np.abs(asked).max() * vectors.shape[1] >= 2.0**53:
                vectors, asked = vectors.astype(int).astype(object), asked.astype(int).astype(object)
            # in the order of their ids, so that the first of equal scores has the smallest
            ids, rows_ = cs.column("vec_id").to_numpy(), cs.column("row").to_numpy()
            order = np.argsort(rows_)
            place = np.minimum(np.searchsorted(rows_[order], qs.column("row").to_numpy()), len(order) - 1)
            own = np.where(rows_[order][place] == qs.column("row").to_numpy(), order[place], -1)
            row, name = qs.column("row").to_numpy(), qs.column("vec_id").to_numpy()
            for i in range(0, len(asked), AT_ONCE):
                for j, (at, scores) in enumerate(best(asked[i : i + AT_ONCE], vectors, ids, own[i : i + AT_ONCE], k), i):
                    for c, x in zip(found, (np.full(len(at), row[j]), np.full(len(at), name[j]), ids[at], scores.astype(np.int64)), strict=True):
                        found[c].append(x)
        return pa.table({c: pa.array(np.concatenate(x), pa.int64()) for c, x in found.items()})

    keys = ["d", "c", "q"]
    pairs = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(match, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark, folder: str) -> DataFrame:
    return searched(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.r AS query, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
