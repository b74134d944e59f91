"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

Vectors of integers are sorted along a Hilbert curve through their most varied
dimensions and written as Parquet, one folder per shard (a range of the curve)
and a fixed number of rows per block. A block's zone map holds the smallest and
largest entry per dimension and its labels. For an anchor a and a block,
interval arithmetic bounds every inner product from below and above:
sum of min(a_j lo_j, a_j hi_j) and of max(a_j lo_j, a_j hi_j).

Anchors are dealt in the curve's order into groups. A group's positives are read
from the blocks that hold an anchor's label and whose upper bound reaches the
score that the anchor's own shard already offers; its negatives from the blocks
whose bounds meet the window of one of its positives, [low * p, high * p] / 100,
and that hold another label. Neighbouring shards form bundles of about one full
shard, however many shards there are; a group meets a bundle's chosen blocks in one
task of bounded size, with one matrix product per slice; short lists are merged. All
blocks can be needed (high dimensions prune little), so the work is at most
anchors x rows, in blocks; what is kept is always whole.

Rows with a null id or label, a null vector, or null or non-finite components take
no part. A shorter vector counts as ending in zeros. Repeated rows count once;
rows that share an id but differ are rows of their own, and never partners of
each other. Higher scores come first, ties by smaller id. An anchor without a
row of its label, or a positive score at or below zero unless products are zero
too, has no result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.knn import matrix, products, quantised, usable
from panelcast.llm.registry import query, table
from panelcast.sources.stage import stage_folder, write_stage

#: Rows of a block (one zone map), of a shard (one folder, one task's data) and anchors of a group.
BLOCK_ROWS, SHARD_ROWS, GROUP_ROWS = 1024, 32_768, 2048
#: Dimensions and bits per dimension of the curve.
AXES, BITS = 8, 6


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points below 2**bits, one row each (at most 63 bits in all)."""
    x = cells.astype(np.int64).T.copy()
    axes, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess turns of every level, from the coarsest
        for i in range(axes):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    keys = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = (keys << 1) | ((x[i] >> b) & 1)
    return keys


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible inner product of every anchor with a vector of every box, with room for rounding."""
    plus, minus = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    slack = 1e-9 * (np.abs(anchors).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def dimension_stats(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, and the mean and the spread of every dimension of ``v``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0)).astype(float)
                columns = [np.full(v.shape[1], len(v)), v.sum(axis=0), (v * v).sum(axis=0)]
                yield pa.record_batch([pa.array(range(v.shape[1]), pa.int32()), *map(pa.array, columns)], names=["pos", "n", "s", "q"])

    parts = rows.select("v").mapInArrow(partial, "pos int, n long, s double, q double")
    found = sorted(parts.groupBy("pos").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect())  # a row per dimension
    n = found[0][1] if found else 0
    mean = np.array([r[2] for r in found]) / max(n, 1)
    return n, mean, np.sqrt(np.maximum(np.array([r[3] for r in found]) / max(n, 1) - mean**2, 0))


def blocks(rows: DataFrame, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, v, label, asks) in the curve's order with ``block`` and ``shard``, stored as one Parquet folder per shard."""
    spark = rows.sparkSession
    n, mean, spread = dimension_stats(rows)
    axes = np.argsort(-spread, kind="stable")[:AXES]
    centre, width = mean[axes], np.maximum(spread[axes], 1e-9)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1)).reshape(batch.num_rows, -1)[:, axes]
                # Three spreads on either side of the mean fill the cube; what lies beyond is on its faces.
                cells = np.clip((v - centre) / width / 6 + 0.5, 0, 1 - 1e-12) * (1 << BITS)
                keys = hilbert_keys(cells) if len(axes) else np.zeros(batch.num_rows, np.int64)
                yield pa.record_batch([*batch.columns, pa.array(keys)], names=["id", "v", "label", "asks", "key"])

    shape = "id long, v array<bigint>, label long, asks boolean"
    rows = rows.select("id", "v", "label", "asks").mapInArrow(keyed, shape + ", key long")
    rows = rows.withColumn("spot", F.xxhash64("id", "v", "label"))  # rows of one key may fill many shards
    rows = rows.repartitionByRange(max(1, -(-n // shard_rows)), "key", "spot").sortWithinPartitions("key", "spot")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                at = pa.array((np.arange(seen, seen + batch.num_rows) // block_rows).astype(np.int32))
                seen += batch.num_rows
                yield pa.record_batch([*batch.columns[:4], at], names=["id", "v", "label", "asks", "block"])

    placed = rows.mapInArrow(numbered, shape + ", block int").withColumn("shard", F.spark_partition_id())
    path = f"{stage_folder(spark)}/{spark.sparkContext.applicationId}/hilbert-blocks-{uuid.uuid4().hex}"
    placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def zone_maps(placed: DataFrame) -> DataFrame:
    """``shard``, ``block``, row count ``n``, ``low`` and ``high`` per dimension, and the ``labels`` of every block."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard, block, label = (batch.column(i).to_numpy() for i in (0, 1, 3))
                v, out = matrix(batch.column(2)).reshape(batch.num_rows, -1), []
                for s, b in sorted(set(zip(shard.tolist(), block.tolist(), strict=True))):
                    here = (shard == s) & (block == b)
                    out.append([s, b, int(here.sum()), v[here].min(axis=0).tolist(), v[here].max(axis=0).tolist(), np.unique(label[here]).tolist()])
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "block", "n", "low", "high", "labels"])

    shape = "shard int, block int, n long, low array<bigint>, high array<bigint>, labels array<bigint>"
    parts = placed.select("shard", "block", "v", "label").mapInArrow(mapped, shape)

    def folded(column: str, pick) -> Column:
        # A block lies in one Arrow batch or a few, so the list is short.
        return F.aggregate(column, F.element_at(column, 1), lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y)))

    lists = parts.groupBy("shard", "block").agg(F.sum("n").alias("n"), *[F.collect_list(c).alias(c) for c in ("low", "high", "labels")])
    return lists.select(
        "shard", "block", "n", folded("low", F.least).alias("low"), folded("high", F.greatest).alias("high"), F.array_distinct(F.flatten("labels")).alias("labels")
    )


def least_of_best(scores: np.ndarray, may: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest allowed score of every row; the smallest integer where fewer are allowed."""
    floor = np.iinfo(np.int64).min
    if scores.shape[1] < k:
        return np.full(len(scores), floor)
    return np.partition(np.where(may, scores, floor), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def top(some: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k positions of ``some`` with the highest scores, ties to smaller ids, in that order."""
    if len(some) > k:
        some = some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
    return some[np.lexsort((ids[some], -score[some]))][:k]


def merged(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rank (from 1) and the k best (score, id) per key of short lists per bundle, merged in two steps."""
    hit = F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("s"), "found")))
    some = partial.groupBy(*keys, F.floor(F.col("bundle") / 256).alias("part")).agg(F.slice(F.array_sort(hit), 1, k).alias("best"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    each = some.groupBy(*keys).agg(best.alias("best")).select(*keys, F.posexplode("best").alias("at", "hit"))
    return each.select(*keys, (F.col("at") + 1).alias("rank"), F.col("hit.found").alias("found"), (-F.col("hit.s")).alias("score"))


ANCHOR = ["anchor", "own"]


class Mine:
    """Blocks, zone maps and anchors of one table, and the search of both kinds of partners."""

    def __init__(self, rows: DataFrame, shard_rows: int, block_rows: int, group_rows: int):
        self.placed = blocks(rows, shard_rows, block_rows)
        zones = write_stage(zone_maps(self.placed), "zone-maps")
        shards = zones.groupBy("shard").agg(F.sum("n").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per shard
        shards = shards.select("shard", F.floor(before / shard_rows).alias("bundle"))
        self.zones = write_stage(zones.drop("n").join(shards, "shard"), "zone-bundles")
        self.zone_chunks = 1 + self.zones.count() // 4096
        self.group_rows = group_rows

    def anchors(self, k: int) -> DataFrame:
        """Anchors with their group along the curve and ``sure``, the k-th best score of their label in their own shard."""

        def own_shard(rows: pa.Table) -> pa.Table:
            ids, label, asks = rows["id"].to_numpy(), rows["label"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
            at = np.flatnonzero(asks)
            v = matrix(rows["v"]).reshape(rows.num_rows, -1)
            sure = [np.zeros(0, np.int64)]
            for i in range(0, len(at), 256):
                some = at[i : i + 256]
                may = (label[some][:, None] == label) & (ids[some][:, None] != ids)
                sure.append(least_of_best(products(v[some], v), may, k))
            return rows.select(["id", "v", "label", "shard"]).take(pa.array(at)).append_column("sure", pa.array(np.concatenate(sure)))

        found = self.placed.groupBy("shard").applyInArrow(own_shard, "id long, v array<bigint>, label long, shard int, sure long")
        found = write_stage(found.withColumnRenamed("id", "anchor").withColumn("own", F.xxhash64("anchor", "v", "label")), "anchors")
        sizes = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
        sizes = sizes.select("shard", "n", F.coalesce(before, F.lit(0)).alias("before"))
        place = F.col("before") + F.pmod("own", "n")
        return found.join(sizes, "shard").withColumn("grp", F.floor(place / self.group_rows)).drop("shard", "n", "before")

    def search(self, anchors: DataFrame, columns: list[str], needs, solve, shape: str) -> DataFrame:
        """``solve(anchors, rows)`` of every group with its needed blocks of a bundle, as tables.

        ``needs(anchors, low, high, zones)`` tells which blocks at least one anchor of a group must read,
        from its bounds for every (anchor, block).
        """
        chunk = F.pmod(F.xxhash64("shard", "block"), F.lit(self.zone_chunks)).cast("int")
        last = anchors.agg(F.max("grp")).head()[0] or 0
        zones = self.zones.select("*", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("grp"))
        asking = anchors.select("grp", "v", *columns, F.explode(F.sequence(F.lit(0), F.lit(self.zone_chunks - 1))).alias("chunk"))

        def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
            picked = np.zeros(right.num_rows, bool)
            if left.num_rows and right.num_rows:
                a = matrix(left["v"]).reshape(left.num_rows, -1)
                box = [matrix(right[c]).reshape(right.num_rows, -1) for c in ("low", "high")]
                for i in range(0, len(a), 256):
                    picked |= needs(left.slice(i, 256), *bounds(a[i : i + 256], *box), right).any(axis=0)
            return right.select(["grp", "bundle", "shard", "block"]).filter(pa.array(picked))

        need = asking.groupBy("grp", "chunk").cogroup(zones.groupBy("grp", "chunk")).applyInArrow(chosen, "grp long, bundle long, shard int, block int")
        need = write_stage(need, "needed-blocks")
        data = self.placed.join(need, ["shard", "block"]).select("grp", "bundle", "id", F.col("v").alias("x"), "label")
        met = need.select(F.col("grp").alias("grp"), F.col("bundle").alias("bundle")).distinct()
        asked = anchors.select("grp", "v", *columns).join(met, "grp")
        return asked.groupBy("grp", "bundle").cogroup(data.groupBy("grp", "bundle")).applyInArrow(solve, shape)


def table_of(rows: list[tuple], shape: str) -> pa.Table:
    names = [c.split()[0] for c in shape.split(", ")]
    columns = [np.concatenate([np.asarray(p, np.int64) for p in part]) if part else np.zeros(0, np.int64) for part in (zip(*rows, strict=True) if rows else [()] * len(names))]
    return pa.table(dict(zip(names, columns, strict=True)))


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hardest allowed negatives.

    ``window`` bounds a negative's score in per cent of the positive's.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).distinct()
    width = rows.agg(F.max(F.size("v"))).head()[0] or 0
    rows = write_stage(rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))), "mine-rows")
    job = Mine(rows, shard_rows, block_rows, group_rows)
    anchors = write_stage(job.anchors(positives), "mine-anchors")
    least, most = window

    def holds_label(left: pa.Table, zones: pa.Table, same: bool) -> np.ndarray:
        kinds = [np.array(x, np.int64) for x in zones["labels"].to_pylist()]
        mine_too = np.column_stack([np.isin(left["label"].to_numpy(), k) for k in kinds])
        return mine_too if same else ~mine_too | (np.array([len(k) for k in kinds]) > 1)

    def may_hold_positives(left: pa.Table, low: np.ndarray, high: np.ndarray, zones: pa.Table) -> np.ndarray:
        return (high >= left["sure"].to_numpy().astype(float)[:, None]) & holds_label(left, zones, True)

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, kind, x = right["id"].to_numpy(), right["label"].to_numpy(), matrix(right["x"]).reshape(right.num_rows, -1)
            a, bundle = matrix(left["v"]).reshape(left.num_rows, -1), right["bundle"][0].as_py()
            anchor, own, label_, sure = (left[c].to_numpy() for c in ("anchor", "own", "label", "sure"))
            for i, score in enumerate(s for at in range(0, len(a), 256) for s in products(a[at : at + 256], x)):
                best = top(np.flatnonzero((kind == label_[i]) & (ids != anchor[i]) & (score >= sure[i])), score, ids, positives)
                out.append((np.full(len(best), anchor[i]), np.full(len(best), own[i]), np.full(len(best), bundle), ids[best], score[best]))
        return table_of(out, POSITIVE)

    found = job.search(anchors, [*ANCHOR, "label", "sure"], may_hold_positives, positives_of, POSITIVE)
    found = write_stage(merged(found, ANCHOR, positives), "positives")
    listed = found.groupBy(*ANCHOR).agg(F.array_sort(F.collect_list(F.struct("rank", "found", "score"))).alias("p"))
    listed = listed.select(*ANCHOR, F.col("p.found").alias("pid"), F.col("p.score").alias("ps"))
    asking = write_stage(anchors.join(listed, ANCHOR), "negative-windows")

    def may_hold_negatives(left: pa.Table, low: np.ndarray, high: np.ndarray, zones: pa.Table) -> np.ndarray:
        open_ = np.zeros(low.shape, bool)
        for i, scores in enumerate(left["ps"].to_pylist()):
            for p in scores:
                open_[i] |= (100 * high[i] >= least * p) & (100 * low[i] <= most * p) & (least * p <= most * p)
        return open_ & holds_label(left, zones, False)

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, kind, x = right["id"].to_numpy(), right["label"].to_numpy(), matrix(right["x"]).reshape(right.num_rows, -1)
            a, bundle = matrix(left["v"]).reshape(left.num_rows, -1), right["bundle"][0].as_py()
            anchor, own, label_ = (left[c].to_numpy() for c in (*ANCHOR, "label"))
            pids, scores = left["pid"].to_pylist(), left["ps"].to_pylist()
            for i, score in enumerate(s for at in range(0, len(a), 256) for s in products(a[at : at + 256], x)):
                other = (kind != label_[i]) & (ids != anchor[i])
                for place, (pid, p) in enumerate(zip(pids[i], scores[i], strict=True)):
                    some = np.flatnonzero(other & (100 * score >= least * p) & (100 * score <= most * p))
                    best = top(some, score, ids, negatives)
                    same = [np.full(len(best), c) for c in (anchor[i], own[i], place, pid, p, bundle)]
                    out.append((*same, ids[best], score[best]))
        return table_of(out, NEGATIVE)

    hard = job.search(asking, [*ANCHOR, "label", "pid", "ps"], may_hold_negatives, negatives_of, NEGATIVE)
    hard = merged(hard, [*ANCHOR, "place", "positive", "ps"], negatives)
    return hard.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"),
    )


POSITIVE = "anchor long, own long, bundle long, found long, score long"
NEGATIVE = "anchor long, own long, place long, positive long, ps long, bundle long, found long, score long"

SQL_HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


@query("op12_hard_negatives", SQL_HARD_NEGATIVES)
def op12_hard_negatives(spark, folder: str) -> DataFrame:
    """Ten hard negatives of every positive of the rows whose id is divisible by 100; every seventh row has a shifted label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)
