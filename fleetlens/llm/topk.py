"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are compared by distance bounds from coarse to fine. On the resolution
with s segments a vector is described by mean and deviation of every segment, and

    q . x <= sum over segments of length * (mean_q * mean_x + dev_q * dev_x)

(Cauchy-Schwarz on what is left of each segment without its mean). Together with
|q - x|^2 = |q|^2 + |x|^2 - 2 q . x this is the lower bound of the distance. A
candidate whose bound stays below the query's k-th best score so far is out; the
survivors meet the next resolution, and those of the finest get the exact product.

Every query has to meet every candidate, so both are dealt to a grid of cells:
query block x candidate block. A cell holds a bounded number of vectors, finds the
best k of its candidates for each of its queries, and only these few are compared
across cells. The blocks are cut by hashes of the ids, so no cell depends on how ids
or vectors are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
SCALE = 256
RESOLUTIONS = (1, 4, 16)
QUERIES_PER_CELL = 1024
CANDIDATES_PER_CELL = 2048
#: Integers of this size and sums of them are exact in a double.
_EXACT = float(1 << 53)


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): means and deviations times the root of the segment length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = []
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        part = x[:, a:b]
        mean = part.mean(axis=1)
        parts += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1) if parts else np.zeros((len(x), 0))


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


def search_cell(
    q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, candidate positions, scores) of the best k, ties to the smaller id.

    `q` and `x` hold integers as doubles, small enough for exact products.
    """
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    own = [(_statistics(q, s), _statistics(x, s)) for s in RESOLUTIONS if s <= max(1, q.shape[1])]
    # bounds are rounded; this slack is far above the error and far below 1
    slack = 0.25
    for i in range(len(q)):
        left = np.flatnonzero(x_ids != q_ids[i])
        if not len(left):
            continue
        least = -np.inf
        for of_q, of_x in own:
            bound = of_x[left] @ of_q[i] + slack
            if least == -np.inf and len(left) > k:
                first = left[np.argpartition(-bound, k - 1)[:k]]
                least = (x[first] @ q[i]).min()
            kept = bound >= least
            left = left[kept]
        score = x[left] @ q[i]
        best = np.lexsort((left, -score))[:k]
        yield i, order[left[best]], score[best]


def _cells(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids = table.column("vec_id").to_numpy()
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), dim)
        q, x = v[is_query], v[~is_query]
        q_key = table.column("q_key").to_numpy()[is_query]
        if not len(q) or not len(x):
            return
        exact = not dim or float(np.abs(q).max()) * float(np.abs(x).max()) * dim < _EXACT
        rows = []
        if exact:
            found = search_cell(ids[is_query], q, ids[~is_query], x, k)
        else:
            found = _wide(ids[is_query], q, ids[~is_query], x, k)
        x_ids, q_ids = ids[~is_query], ids[is_query]
        for i, at, score in found:
            rows += [(q_key[i], q_ids[i], x_ids[j], _long(s)) for j, s in zip(at, score)]
        if rows:
            columns = [pa.array([int(r[c]) for r in rows], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["q_key", "query_id", "vec_id", "score"])

    return run


def _long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _wide(q_ids, q, x_ids, x, k):
    """The same by whole numbers of any size, for components beyond the exact doubles."""
    whole = [[int(c) for c in row] for row in x]
    for i, row in enumerate(q):
        row = [int(c) for c in row]
        scores = [sum(a * b for a, b in zip(row, other)) for other in whole]
        left = [j for j in range(len(whole)) if x_ids[j] != q_ids[i]]
        best = sorted(left, key=lambda j: (-scores[j], x_ids[j]))[:k]
        yield i, np.array(best, int), [scores[j] for j in best]


def quantized(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with floor(scale * component); rows that take no part are gone.

    Out: NULL ids, NULL vectors, vectors holding a NULL, NaN or infinite component.
    """
    v = F.col(f"`{column}`").cast("array<double>")
    sound = v.isNotNull() & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    kept = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    # floor() of a double is a long; rounding down by the remainder keeps any size
    down = F.transform(v, lambda c: c * float(scale) - F.pmod(c * float(scale), F.lit(1.0)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), down.alias("v"))


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest products of every query.

    Both tables have (vec_id, v); a query does not meet candidates of its own id.
    Vectors are compared with those of the same length only. Repeated query rows
    are one query; different vectors under one id are different queries. Repeated
    candidate rows count each. Fewer than k candidates give fewer rows; empty tables
    give none. Scores beyond a long are clipped to its range.
    """
    sizes = candidates.groupBy(F.size("v").alias("dim")).count().collect()
    n_queries = queries.count()
    found = None
    for dim, n in sorted(map(tuple, sizes)):  # as many as there are embedding models
        x_blocks = -(-n // CANDIDATES_PER_CELL)
        q_blocks = max(1, -(-n_queries // QUERIES_PER_CELL))
        across = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        block = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
        x = candidates.where(F.size("v") == dim).select(
            F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("q_key"), "vec_id", "v",
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(x_blocks)).cast("int").alias("x"),
            across(q_blocks).alias("q"),
        )
        q = queries.where(F.size("v") == dim).distinct().select(
            F.lit(True).alias("is_query"), F.xxhash64("vec_id", "v").alias("q_key"), "vec_id", "v",
            across(x_blocks).alias("x"), block(1, q_blocks).alias("q"),
        )
        cells = x.unionByName(q).groupBy("x", "q").applyInArrow(
            _grouped(_cells(k, dim)), "q_key long, query_id long, vec_id long, score long"
        )
        found = cells if found is None else found.unionByName(cells)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _grouped(run):
    def solve(table: pa.Table) -> pa.Table:
        out = list(run(iter(table.to_batches())))
        schema = pa.schema([(n, pa.int64()) for n in ("q_key", "query_id", "vec_id", "score")])
        return pa.Table.from_batches(out, schema)

    return solve
