"""Reference predictors that need only aggregates: training mean, majority class, last value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.folds import long_folds

KEYS = ["task_key", "seed", "fold"]


def exact() -> Column:
    """Decimal sums do not depend on summation order, so a retried task gives the same mean."""
    return F.col("y").cast("decimal(28,8)")


def sums(summed: Column | None = None) -> list:
    """``summed`` is the column of :func:`exact`, when the caller has it."""
    y = F.col("y")
    return [F.sum(exact() if summed is None else summed).alias("s"), F.count(y).alias("c"), F.count_if(y == 1).alias("p")]


def train_summary(folds: DataFrame) -> DataFrame:
    """Per (task, seed, held-out fold): training mean, size and class counts, as total minus fold.

    At most seeds x folds rows per task, whatever the input size.
    """
    return _less_held(folds.groupBy(*KEYS).agg(*sums()))


def dealt_summary(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """:func:`train_summary` of rows with the folds of all seeds beside each other: summed per combination of folds, then per seed."""
    return summary_of(rows.groupBy("task_key", *[f"fold_{s}" for s in seeds]).agg(*sums()), seeds)


def summary_of(parts: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """:func:`train_summary` from the :func:`sums` of every combination of folds."""
    per_fold = long_folds(parts, seeds).groupBy(*KEYS).agg(F.sum("s").cast("decimal(38,8)").alias("s"), F.sum("c").alias("c"), F.sum("p").alias("p"))
    return _less_held(per_fold)


def _less_held(per_fold: DataFrame) -> DataFrame:
    total = per_fold.groupBy("task_key", "seed").agg(
        F.sum("s").alias("ts"), F.sum("c").alias("tc"), F.sum("p").alias("tp")
    )
    out = per_fold.join(total, ["task_key", "seed"])
    n = F.col("tc") - F.col("c")
    return out.select(
        *KEYS, n.alias("n_train"), ((F.col("ts") - F.col("s")).cast("double") / n).alias("train_mean"),
        (F.col("tp") - F.col("p")).alias("n_pos"),
    )


def population_mean(folds: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """``summary`` is the folds' :func:`train_summary`, when the caller has it."""
    rows = folds.join(F.broadcast(summary or train_summary(folds)), KEYS)  # at most seeds x folds rows per task
    return rows.select(*KEYS, "entity_id", "y", F.col("train_mean").alias("yhat"), F.lit("population_mean").alias("model"))


def majority_class(folds: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Most frequent training class (ties to the smaller label) and the training prevalence."""
    rows = folds.join(F.broadcast(summary or train_summary(folds)), KEYS)
    major = F.when(F.col("n_pos") * 2 > F.col("n_train"), 1.0).otherwise(0.0)
    return rows.select(
        *KEYS, "entity_id", "y", major.alias("yhat"), (F.col("n_pos") / F.col("n_train")).alias("prob"),
        F.lit("majority_class").alias("model"),
    )


def last_values(history: DataFrame) -> DataFrame:
    """(task_key, entity_id, last_value): the latest non-null past value."""
    seen = history.where("value is not null")
    return seen.groupBy("task_key", "entity_id").agg(F.max_by("value", "months").alias("last_value"))


def locf(folds: DataFrame, history: DataFrame) -> DataFrame:
    """Last observation carried forward; the training mean where nothing was seen. Needs raw history."""
    with_history = F.broadcast(history.select("task_key").distinct())
    rows = folds.join(with_history, "task_key", "left_semi")
    rows = rows.join(last_values(history), ["task_key", "entity_id"], "left").join(train_summary(rows), KEYS)
    yhat = F.coalesce(F.col("last_value"), F.col("train_mean"))
    return rows.select(*KEYS, "entity_id", "y", yhat.alias("yhat"), F.lit("locf").alias("model"))


def carried_forward(folds: DataFrame, history_tasks: DataFrame, summary: DataFrame) -> DataFrame:
    """:func:`locf` of folds that hold their ``last_value``; ``history_tasks`` names the tasks with any history."""
    rows = folds.join(F.broadcast(history_tasks), "task_key", "left_semi").join(F.broadcast(summary), KEYS)
    yhat = F.coalesce(F.col("last_value"), F.col("train_mean"))
    return rows.select(*KEYS, "entity_id", "y", yhat.alias("yhat"), F.lit("locf").alias("model"))
