"""Per-fold column statistics fitted on training rows only, and their application."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.operators.order_stats import exact_quantiles

KEYS = ["task_key", "seed", "fold"]


def training_counts(features: DataFrame, folds: DataFrame, k: int = spec.N_FOLDS) -> DataFrame:
    """(keys, feature, value, w): how often a value occurs in the training rows of each held-out fold.

    Rows are counted once per own fold; a training count is the total minus the held-out count.
    """
    rows = folds.select("task_key", "seed", "entity_id", F.col("fold").alias("own"))
    values = features.where("value is not null").select("task_key", "entity_id", "feature", "value")
    per = [F.count_if(F.col("own") == f).alias(f"c{f}") for f in range(k)]
    counts = values.join(rows, ["task_key", "entity_id"]).groupBy("task_key", "seed", "feature", "value").agg(*per)
    total = sum(F.col(f"c{f}") for f in range(k))
    held = F.array(*[F.struct(F.lit(f).alias("fold"), (total - F.col(f"c{f}")).alias("w")) for f in range(k)])
    return counts.select("task_key", "seed", "feature", "value", F.inline(held)).where("w > 0")


def missing_fractions(features: DataFrame, folds: DataFrame) -> DataFrame:
    """Share of training rows without the feature, as total minus held-out counts: no row is copied."""
    rows = folds.select("task_key", "seed", "entity_id", "fold")
    per_fold = features.join(rows, ["task_key", "entity_id"]).groupBy(*KEYS, "feature").agg(F.count("value").alias("c"))
    total = per_fold.groupBy("task_key", "seed", "feature").agg(F.sum("c").alias("tc"))
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("task_key", "seed").agg(F.sum("n").alias("tn"))
    n_train = sizes.join(whole, ["task_key", "seed"]).select(*KEYS, (F.col("tn") - F.col("n")).alias("n_train"))
    grid = total.join(n_train, ["task_key", "seed"]).join(per_fold, [*KEYS, "feature"], "left")
    have = F.col("tc") - F.coalesce(F.col("c"), F.lit(0))
    return grid.select(*KEYS, "feature", "n_train", have.alias("n_value"), (1 - have / F.col("n_train")).alias("missing")).where(
        F.col("n_value") > 0
    )


def fit(counts: DataFrame) -> DataFrame:
    """norm_stats(keys, feature, kind, mode, lo, hi, median, mean, std) from training value counts.

    Clipping keeps order, so the median of the clipped values is the median itself
    and one quantile pass is enough. Moments are taken around the median.
    """
    by = [*KEYS, "feature"]
    v, w = F.col("value"), F.col("w")
    kinds = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("levels"),
        F.bool_and(v.isin(0.0, 1.0)).alias("zero_one"),
        F.bool_and(v == F.floor(v)).alias("whole"),
        F.max(F.struct("w", (-v).alias("neg"))).alias("top"),
    )
    kind = (
        F.when(F.col("zero_one"), "binary")
        .when((F.col("levels") <= spec.MAX_ORDINAL_LEVELS) & F.col("whole"), "ordinal")
        .otherwise("continuous")
    )
    kinds = kinds.select(*by, kind.alias("kind"), (-F.col("top.neg")).alias("mode"))
    lo, hi = spec.WINSOR
    cuts = exact_quantiles(counts, by, "value", {"lo": lo, "hi": hi, "median": 0.5}, weight="w")
    # One row per task, seed, fold and feature: the size of the specification.
    table = kinds.join(cuts, by)
    d = F.greatest(F.col("lo"), F.least(F.col("hi"), v)) - F.col("median")
    sums = counts.join(table.where("kind = 'continuous'"), by).groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * d).alias("s"), F.sum(w * d * d).alias("ss")
    )
    out = table.join(sums, by, "left")
    continuous = F.col("kind") == "continuous"
    mean = F.col("median") + F.col("s") / F.col("n")
    var = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return out.select(
        *by, "kind", F.when(~continuous, F.col("mode")).alias("mode"),
        *[F.when(continuous, F.col(c)).alias(c) for c in ("lo", "hi", "median")],
        mean.alias("mean"), F.when(continuous & F.col("s").isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"),
    )


def scaled(v: Column, s: Callable[[str], Column]) -> Column:
    """One normalised value from a raw value (null = missing) and its statistics ``s(name)``."""
    clipped = F.greatest(s("lo"), F.least(s("hi"), v))
    z = (F.when(v.isNull(), s("median")).otherwise(clipped) - s("mean")) / s("std")
    z = F.greatest(F.lit(-spec.Z_CLIP), F.least(F.lit(spec.Z_CLIP), z))
    return F.when(s("kind") != "continuous", F.coalesce(v, s("mode"))).when(s("std") > 1e-10, z).otherwise(0.0)


def apply(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Impute, winsorise, scale and clip every cell with its fold's statistics."""
    return cells.join(stats, [*KEYS, "feature"]).withColumn("x", scaled(F.col("value"), F.col))


def kept_stats(features: DataFrame, folds: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of the features present in more than 10 % of the training rows."""
    kept = missing_fractions(features, folds).where(F.col("missing") < spec.MAX_MISSING)
    return stats.join(kept.select(*KEYS, "feature"), [*KEYS, "feature"], "left_semi")


def fold_vectors(features: DataFrame, folds: DataFrame, kept: DataFrame) -> DataFrame:
    """(keys, entity_id, y, is_test, features, x): dense normalised rows, features in name order.

    An entity's values are gathered once per task as a map; each fold's statistics are
    an array broadcast by (task, seed), so no cell is exploded or shuffled per fold.
    """
    pairs = F.collect_list(F.struct("feature", "value"))
    maps = features.where("value is not null").groupBy("task_key", "entity_id").agg(F.map_from_entries(pairs).alias("_m"))
    names = ["feature", "kind", "mode", "lo", "hi", "median", "mean", "std"]
    table = kept.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_s"))
    rows = folds.select("task_key", "seed", "entity_id", "y", F.col("fold").alias("_own")).join(maps, ["task_key", "entity_id"])
    rows = rows.join(F.broadcast(table), ["task_key", "seed"])
    x = F.transform("_s", lambda s: scaled(F.element_at("_m", s["feature"]), lambda c: s[c]))
    listed = F.transform("_s", lambda s: s["feature"])
    return rows.select(*KEYS, "entity_id", "y", (F.col("_own") == F.col("fold")).alias("is_test"), listed.alias("features"), x.alias("x"))


def fold_cells(features: DataFrame, folds: DataFrame, stats: DataFrame, k: int = spec.N_FOLDS) -> DataFrame:
    """Every (entity, kept feature) cell of every fold, missing ones as null, with ``is_test``.

    Features missing in at least 90 % of the training rows are left out.
    """
    rows = folds.select("task_key", "seed", "entity_id", "y", F.col("fold").alias("own"))
    wanted = kept_stats(features, folds, stats).select(*KEYS, "feature")
    grid = rows.join(wanted, ["task_key", "seed"]).withColumn("is_test", F.col("own") == F.col("fold")).drop("own")
    values = features.select("task_key", "entity_id", "feature", "value")
    return grid.join(values, ["task_key", "entity_id", "feature"], "left")


def column_stats(v: np.ndarray, n_train: int) -> dict | None:
    """:func:`fit` of one feature from its ascending training values; nothing where :func:`kept_stats` leaves the feature out."""
    return value_stats(v) if is_kept(len(v), n_train) else None


def is_kept(n: int, n_train: int) -> bool:
    return n > 0 and 1 - n / n_train < spec.MAX_MISSING


def value_stats(v: np.ndarray) -> dict:
    """:func:`fit` of one feature from its ascending training values, of which there are some."""
    n = len(v)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    levels, counts = v[starts], np.diff(np.r_[starts, n])
    if np.isin(levels, (0.0, 1.0)).all() or (len(levels) <= spec.MAX_ORDINAL_LEVELS and (levels == np.floor(levels)).all()):
        return {"mode": levels[np.argmax(counts)]}  # the first of equals is the smallest
    at = (n - 1) * np.array([*spec.WINSOR, 0.5])
    below, above = np.floor(at).astype(int), np.ceil(at).astype(int)
    lo, hi, median = np.where(v[below] == v[above], v[below], (above - at) * v[below] + (at - below) * v[above])
    d = np.clip(v, lo, hi) - median
    var = (d @ d - d.sum() ** 2 / n) / (n - 1) if n > 1 else 0.0
    return {"lo": lo, "hi": hi, "median": median, "mean": median + d.sum() / n, "std": np.sqrt(max(var, 0.0))}


def scale_column(v: np.ndarray, there: np.ndarray, s: dict) -> np.ndarray:
    """:func:`scaled` of one feature's values with its :func:`column_stats`."""
    if "mode" in s:
        return np.where(there, v, s["mode"])
    if not s["std"] > 1e-10:
        return np.zeros(len(v))
    return np.clip((np.where(there, np.clip(v, s["lo"], s["hi"]), s["median"]) - s["mean"]) / s["std"], -spec.Z_CLIP, spec.Z_CLIP)
