"""Exact top-k inner-product search as a Voronoi join.

Queries and data are assigned to the nearest of a set of pivots, which are data
vectors. Summaries per cell (rows, radius) and the pivots' own scores give every
query a score that its k-th best reaches for certain. As q.x <= q.p + |q| |x - p|
for x in the cell of p, a group of queries needs from that cell only the vectors
at least some distance from p; those are replicated to the group, all others are
not. Each (query group, data chunk) is solved with one matrix product and the
partial lists are merged, so neither a popular cell nor a popular query vector
meets in one task.

Components become floor(256 * x). Vectors that are null or hold null or
non-finite components, and rows with a null id, take no part. Repeated rows count
once. A shorter vector counts as ending in zeros. Other columns are not read.
Products are exact while components stay below 2**20 or so in size (double
products), beyond that 64-bit integer products are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage

#: Queries in a group, and data rows that meet a group in one task.
GROUP_ROWS, CHUNK_ROWS = 2048, 16_384


def quantised(column: str, scale: int = 256) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(column: str) -> Column:
    def finite(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    return F.col(column).isNotNull() & F.forall(column, finite)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two integer matrices."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        return a @ b.T
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the k best of every row, ties to smaller ids; a row's own id is left out."""
    rows, found, values = [], [], []
    for i, score in enumerate(scores):
        some = np.flatnonzero(ids != own[i])
        if len(some) > k:
            edge = np.partition(score[some], len(some) - k)[len(some) - k]
            some = some[score[some] >= edge]
        some = some[np.lexsort((ids[some], -score[some]))][:k]
        rows.append(np.full(len(some), i))
        found.append(ids[some])
        values.append(score[some])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found, values))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 96
) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score``: the k best of all other rows for each query row.

    ``pivots`` bounds the sample of pivots and, squared, the bounds per (query group, cell).
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), quantised(vector_col).alias("v"), is_query.alias("asks")
    )
    rows = rows.withColumn("asks", F.coalesce("asks", F.lit(False))).distinct()
    width = rows.agg(F.max(F.size("v"))).head()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    rows = write_stage(rows, "knn-rows")
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).select("id", "v").collect()
    shape = "query_id long, rank int, `%s` long, score long" % id_col
    if not sample:
        return spark.createDataFrame([], shape)
    pivot_ids = np.array([r["id"] for r in sample], np.int64)
    points = np.array([r["v"] for r in sample], np.int64).reshape(len(sample), -1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = points.astype(float)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1)).reshape(batch.num_rows, -1).astype(float)
                far = np.maximum((v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * v @ p.T, 0)
                cell = far.argmin(axis=1)
                away = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
                yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["id", "v", "asks", "cell", "away"])

    placed = write_stage(rows.mapInArrow(assigned, "id long, v array<bigint>, asks boolean, cell int, away double"), "knn-cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.sum(F.col("asks").cast("int")).alias("asking"))
    cells = sorted(cells.collect())  # at most one row per pivot
    kept = np.array([c["cell"] for c in cells])
    size, radius = np.array([c["n"] for c in cells]), np.array([c["radius"] for c in cells])
    asking = np.array([c["asking"] for c in cells])
    first = dict(zip(kept.tolist(), (np.cumsum(asking) - asking).tolist(), strict=True))
    # Queries of neighbouring cell numbers share groups; a cell with many queries is dealt over several.
    place = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], first[c["cell"]])])[F.col("cell")]
    many = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], max(1, c["asking"]))])[F.col("cell")]
    queries = placed.where("asks").withColumn("grp", F.floor((place + F.pmod(F.xxhash64("id", "v"), many)) / GROUP_ROWS).cast("int"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = points[kept].astype(float)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1)).reshape(batch.num_rows, -1)
            norm = np.maximum(np.sqrt((v.astype(float) ** 2).sum(axis=1)), 1e-300)
            centre = v.astype(float) @ p.T
            # A score that k other rows reach: from whole cells, or from the pivots themselves.
            low = centre - norm[:, None] * radius
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(size[order], axis=1) > k
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
            sure = np.where(enough.any(axis=1), np.take_along_axis(low, order[np.arange(len(v)), at][:, None], 1)[:, 0], -np.inf)
            own = products(v, points).astype(float)
            own[batch.column(0).to_numpy()[:, None] == pivot_ids] = -np.inf
            if own.shape[1] >= k:
                sure = np.maximum(sure, np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k])
            slack = 1e-9 * (np.abs(centre) + norm[:, None] * (radius + 1)) + 1e-6  # for rounding
            need = (sure[:, None] - centre - slack) / norm[:, None]
            grp = batch.column(5).to_numpy()
            for g in np.unique(grp):
                least = need[grp == g].min(axis=0)
                yield pa.record_batch([pa.array(np.full(len(kept), g, np.int32)), pa.array(kept, pa.int32()), pa.array(least)], names=["grp", "cell", "least"])

    bounds = queries.mapInArrow(bounded, "grp int, cell int, least double").groupBy("grp", "cell").agg(F.min("least").alias("least"))
    chunks = F.pmod(F.xxhash64("id", "v"), F.lit(1 + int(size.sum()) // CHUNK_ROWS)).cast("int")
    data = placed.select("id", "v", "cell", "away", chunks.alias("chunk")).join(bounds, "cell").where("away >= least")
    data = data.select("grp", "chunk", F.col("id").alias("row"), F.col("v").alias("x"))
    asked = queries.select("grp", F.explode(F.sequence(F.lit(0), F.lit(int(size.sum()) // CHUNK_ROWS))).alias("chunk"), "id", "v")

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = right["row"].to_numpy(), left["id"].to_numpy()
        parts = [np.zeros((0, 3), np.int64)]
        if left.num_rows and right.num_rows:
            q, x = matrix(left["v"]).reshape(left.num_rows, -1), matrix(right["x"]).reshape(right.num_rows, -1)
            for at in range(0, len(q), 256):
                row, found, score = best(products(q[at : at + 256], x), ids, own[at : at + 256], k)
                parts.append(np.column_stack([own[at : at + 256][row], found, score]).astype(np.int64))
        got = np.concatenate(parts)
        return pa.table({"query_id": got[:, 0], "found": got[:, 1], "score": got[:, 2]})

    partial = asked.groupBy("grp", "chunk").cogroup(data.groupBy("grp", "chunk")).applyInArrow(solved, "query_id long, found long, score long")
    gathered = partial.groupBy("query_id").agg(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("s"), "found"))).alias("all"))
    ranked = gathered.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.found").alias(id_col), (-F.col("hit.s")).alias("score"))


SQL_TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_exact_top_k", SQL_TOP_K)
def op4_exact_top_k(spark, folder: str) -> DataFrame:
    """The five highest inner products of every vector whose id is divisible by 50."""
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
