"""Stratified dealing of entities into folds, for all tasks and seeds at once."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelcast import spec
from panelcast.operators.order_stats import exact_quantiles, number_in_order

#: Rows of a task that one Spark task deals or scores as arrays (about 50 bytes a row); larger ones are cut into buckets.
GROUP_ROWS = 5_000_000


def with_strata(rows: DataFrame, keys: Sequence[str], labels: DataFrame | None = None, y: str = "y") -> DataFrame:
    """Add ``stratum``: the class label where ``is_class``, else the quintile of y within ``keys``.

    An edge belongs to the upper bin; keys with at most five values form one stratum.
    """
    keys = list(keys)
    probs = {f"e{i}": i / spec.N_STRATA for i in range(1, spec.N_STRATA)}
    numeric = rows.where(~F.col("is_class"))
    edges = exact_quantiles(numeric, keys, y, probs)
    sizes = numeric.groupBy(*keys).agg(F.count(y).alias("_n"))
    cut = rows.join(edges.join(sizes, keys), keys, "left")
    # Interpolated edges are rounded so that a value equal to an edge is recognised as such.
    binned = sum((F.col(y) >= F.round(e, 9)).cast("int") for e in probs)
    stratum = F.when(F.col("is_class"), F.col(y).cast("int")).when(
        (F.col("_n") > spec.N_STRATA) & F.col(y).isNotNull(), binned
    )
    return cut.withColumn("stratum", F.coalesce(stratum, F.lit(0))).drop(*probs, "_n")


def deal(rows: DataFrame, keys: Sequence[str], k: int, hashed, out: str = "fold") -> DataFrame:
    """Deal each stratum round-robin in hash order, starting at fold 0."""
    numbered = number_in_order(rows.withColumn("_h", hashed), [*keys, "stratum"], "_h", "entity_id", "_pos")
    return numbered.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_h", "_pos")


def outer_folds(targets: DataFrame, grid: DataFrame, seeds: Sequence[int], k: int = spec.N_FOLDS) -> DataFrame:
    """(task_key, seed, entity_id, y, stratum, fold)."""
    kinds = grid.select("task_key", (F.col("task_type") == "classification").alias("is_class"))
    rows = with_strata(targets.join(F.broadcast(kinds), "task_key"), ["task_key"])
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = F.md5(F.concat_ws("|", F.col("seed"), F.col("entity_id")))
    return deal(rows, ["task_key", "seed"], k, hashed).select("task_key", "seed", "entity_id", "y", "stratum", "fold")


def largest_task(rows: DataFrame) -> int:
    return rows.groupBy("task_no").count().agg(F.max("count")).first()[0] or 0


def _edge(ordered: np.ndarray, q: float) -> float:
    """Linear quantile, rounded half up at 1e-9 as in :func:`with_strata`."""
    at = (len(ordered) - 1) * q
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    edge = float(ordered[lo] if lo == hi or ordered[lo] == ordered[hi] else (hi - at) * ordered[lo] + (at - lo) * ordered[hi])
    return float(Decimal(repr(edge)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if np.isfinite(edge) else edge


def task_strata(y: np.ndarray, null: np.ndarray, is_class: bool) -> np.ndarray:
    """The strata of one task as in :func:`with_strata`."""
    out = np.zeros(len(y), dtype=np.int32)
    known = y[~null]
    if is_class:
        out[~null] = known.astype(np.int32)
    elif len(known) > spec.N_STRATA:
        ordered = np.sort(known)
        for i in range(1, spec.N_STRATA):
            out[~null] += (known >= _edge(ordered, i / spec.N_STRATA)) | np.isnan(known)
    return out


def deal_task(table: pa.Table, classes: set[int], seeds: Sequence[int], k: int, shape: pa.Schema) -> pa.Table:
    """Strata and folds of one task: every stratum dealt in each seed's order, given by ``order_<seed>``."""
    raw = table["y"].combine_chunks()
    null = raw.is_null().to_numpy(zero_copy_only=False)
    stratum = task_strata(raw.fill_null(0.0).to_numpy(zero_copy_only=False), null, table["task_no"][0].as_py() in classes)
    out = {n: table[n] for n in ("task_no", "entity_id", "y", "last_value")} | {"stratum": pa.array(stratum)}
    for s in seeds:
        order = np.argsort(table[f"order_{s}"].to_numpy())
        fold = np.empty(len(stratum), dtype=np.int32)
        for v in np.unique(stratum):
            rows = order[stratum[order] == v]
            fold[rows] = np.arange(len(rows)) % k
        out[f"fold_{s}"] = pa.array(fold)
    return pa.table([out[n] for n in shape.names], names=shape.names).cast(shape)


def dealt(members: DataFrame, grid: DataFrame, seeds: Sequence[int], k: int = spec.N_FOLDS, most: int = GROUP_ROWS) -> DataFrame:
    """(task_no, task_key, task_type, entity_id, y, last_value, stratum, fold_<seed> ...): all seeds' folds beside each other.

    An entity is hashed and numbered once per seed, whatever the number of its tasks. A task of up to ``most`` rows moves
    once and is dealt as arrays for all seeds; if one is larger, :func:`outer_folds` deals all of them in buckets.
    """
    wide = [F.max(F.when(F.col("seed") == s, F.col("_pos"))).alias(f"order_{s}") for s in seeds]
    names = [f"fold_{s}" for s in seeds]
    if largest_task(members) > most:
        long = outer_folds(members.select("task_key", "entity_id", "y"), grid, seeds, k)
        beside = [F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(n) for s, n in zip(seeds, names)]
        return members.join(long.groupBy("task_key", "entity_id").agg(F.max("stratum").alias("stratum"), *beside), ["task_key", "entity_id"])
    entities = members.select("entity_id").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = F.md5(F.concat_ws("|", F.col("seed"), F.col("entity_id")))
    numbered = number_in_order(entities.withColumn("_h", hashed), ["seed"], "_h", "entity_id", "_pos")
    kinds = members.select("task_no", "task_key", "task_type").distinct()  # one row per task
    classes = {r.task_no for r in kinds.where("task_type = 'classification'").collect()}
    slim = members.drop("task_key", "task_type")
    rows = slim.join(numbered.groupBy("entity_id").agg(*wide), "entity_id")
    shape = slim.select("*", F.lit(0).alias("stratum"), *[F.lit(0).alias(n) for n in names]).schema
    arrow = to_arrow_schema(shape)
    out = rows.groupBy("task_no").applyInArrow(lambda table: deal_task(table, classes, seeds, k, arrow), shape)
    return out.join(F.broadcast(kinds), "task_no")


def long_folds(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One row per seed of rows with the folds of all seeds beside each other."""
    each = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"fold_{s}").alias("fold")) for s in seeds])
    return rows.select(*[c for c in rows.columns if not c.startswith("fold_")], F.inline(each))


def train_rows(folds: DataFrame, k: int = spec.N_FOLDS) -> DataFrame:
    """One row per (entity, fold it trains for); ``fold`` is the held-out fold."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return folds.withColumn("fold", F.explode(others))


def _inner_sizes(table: pa.Table, classes: set[int], seeds: Sequence[int], k: int, shape: pa.Schema) -> pa.Table:
    """Sizes and id sums of every inner fold of one task; rows are put in hash order once for all training sets."""
    table = table.take(pa.array(np.argsort(table["order"].to_numpy())))
    raw, ids, task = table["y"].combine_chunks(), table["entity_id"].to_numpy(), table["task_no"][0].as_py()
    y, null = raw.fill_null(0.0).to_numpy(zero_copy_only=False), raw.is_null().to_numpy(zero_copy_only=False)
    rows = []
    for s in seeds:
        own = table[f"fold_{s}"].to_numpy()
        for fold in range(spec.N_FOLDS):
            train = np.flatnonzero(own != fold)
            if not len(train):
                continue
            stratum = task_strata(y[train], null[train], task in classes)
            inner = np.empty(len(train), dtype=np.int64)
            for v in np.unique(stratum):
                at = np.flatnonzero(stratum == v)
                inner[at] = np.arange(len(at)) % k
            rows += [(task, s, fold, i, int((inner == i).sum()), int(ids[train][inner == i].sum())) for i in np.unique(inner).tolist()]
    return pa.table([pa.array(c) for c in zip(*rows)], names=shape.names).cast(shape)


def inner_order(rows: DataFrame) -> DataFrame:
    """(entity_id, order): the place of every entity in the hash order of the inner folds."""
    entities = rows.select("entity_id", F.lit(0).alias("_all")).distinct()
    hashed = F.md5(F.concat_ws("|", F.lit(spec.TEST_SEED), F.col("entity_id")))
    return number_in_order(entities.withColumn("_h", hashed), ["_all"], "_h", "entity_id", "order").select("entity_id", "order")


def inner_sizes(rows: DataFrame, grid: DataFrame, seeds: Sequence[int], k: int = spec.N_INNER_FOLDS, most: int = GROUP_ROWS) -> DataFrame:
    """(task_key, seed, fold, inner_fold, n, id_sum) of :func:`inner_folds`, from rows of :func:`dealt`.

    A task of up to ``most`` rows moves once and is dealt as arrays for all its training sets, so no row is copied per fold.
    """
    if largest_task(rows) > most:
        long = inner_folds(long_folds(rows, seeds).select("task_key", "seed", "entity_id", "y", "stratum", "fold"), grid, k)
        return long.groupBy("task_key", "seed", "fold", "inner_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("entity_id").alias("id_sum"))
    kinds = rows.select("task_no", "task_key", "task_type").distinct()  # one row per task
    classes = {r.task_no for r in kinds.where("task_type = 'classification'").collect()}
    slim = rows.select("task_no", "entity_id", "y", *[f"fold_{s}" for s in seeds]).join(inner_order(rows), "entity_id")
    shape = "task_no int, seed int, fold int, inner_fold int, n bigint, id_sum bigint"
    arrow = pa.schema([(c.split()[0], {"int": pa.int32(), "bigint": pa.int64()}[c.split()[1]]) for c in shape.split(", ")])
    out = slim.groupBy("task_no").applyInArrow(lambda table: _inner_sizes(table, classes, seeds, k, arrow), shape)
    return out.join(F.broadcast(kinds.drop("task_type")), "task_no").drop("task_no")


def inner_folds(folds: DataFrame, grid: DataFrame, k: int = spec.N_INNER_FOLDS) -> DataFrame:
    """Inner folds of every outer training set, strata recomputed inside it, fixed seed."""
    kinds = grid.select("task_key", (F.col("task_type") == "classification").alias("is_class"))
    keys = ["task_key", "seed", "fold"]
    rows = with_strata(train_rows(folds).drop("stratum").join(F.broadcast(kinds), "task_key"), keys)
    hashed = F.md5(F.concat_ws("|", F.lit(spec.TEST_SEED), F.col("entity_id")))
    return deal(rows, keys, k, hashed, "inner_fold").select(*keys, "entity_id", "y", "inner_fold")
