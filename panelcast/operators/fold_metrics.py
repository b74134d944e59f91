"""Regression scores of the reference models for all seeds and folds of a task at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.metrics import TINY

SCORES = "task_key string, model string, seed int, fold int, n_test bigint, r2 double, mae double, rmse double, pearson double, spearman double"


def _centred(v: np.ndarray) -> np.ndarray:
    """Deviations from the mean; exactly zero for a constant."""
    d = v - v[0]
    return d - d.mean()


def _ranks(v: np.ndarray) -> np.ndarray:
    """Average-tie ranks less their mean."""
    _, place, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place] - (len(v) + 1) / 2


def ranks_in_order(v: np.ndarray, order: np.ndarray) -> np.ndarray:
    """:func:`_ranks` of values whose order is known."""
    ordered = v[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.r_[start, len(v)])
    out = np.empty(len(v))
    out[order] = np.repeat(start + (count + 1) / 2, count) - (len(v) + 1) / 2
    return out


def pair_scores(y: np.ndarray, yhat: np.ndarray, ranks: tuple[np.ndarray, np.ndarray] | None = None) -> list:
    """[n, r2, mae, rmse, pearson, spearman] as in ``metrics.regression_metrics``; null below five pairs.

    ``ranks`` are the :func:`_ranks` of both, when the caller has them.
    """
    n = len(y)
    if n < 5:
        return [n, None, None, None, None, None]
    err, dy, dp = y - yhat, _centred(y), _centred(yhat)
    sse, vy, vp = float(err @ err), float(dy @ dy) / n, float(dp @ dp) / n
    r2 = 1 - sse / (n * vy) if vy else float(sse == 0)
    pearson = 0.0 if np.sqrt(vy) < TINY or np.sqrt(vp) < TINY else float(dy @ dp) / n / np.sqrt(vy * vp)
    spearman = 0.0
    if vy and vp:
        a, b = ranks or (_ranks(y), _ranks(yhat))
        spearman = float(a @ b) / np.sqrt(float(a @ a) * float(b @ b))
    return [n, r2, float(np.abs(err).mean()), float(np.sqrt(sse / n)), pearson, spearman]


def _inversions(v: np.ndarray) -> int:
    """Pairs in which the larger of two ranks comes first, counted bit by bit from the highest."""
    total = 0
    for b in reversed(range(int(v.max(initial=0)).bit_length())):
        block, one = v >> (b + 1), (v >> b) & 1
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        before = np.cumsum(one) - one
        before -= np.repeat(before[start], np.diff(np.r_[start, len(v)]))
        total += int(before[one == 0].sum())
        v = v[np.argsort(v >> b, kind="stable")]
    return total


def kendall(y: np.ndarray, yhat: np.ndarray) -> float:
    """Tau-b as in ``metrics.kendall_tau``."""
    (_, a, ca), (_, b, cb) = (np.unique(v, return_inverse=True, return_counts=True) for v in (y, yhat))
    both = np.unique(a.astype(np.int64) * len(cb) + b, return_counts=True)[1]
    n0, n1, n2, n3 = (int((c.astype(np.int64) * (c.astype(np.int64) - 1) // 2).sum()) for c in (np.array([len(y)]), ca, cb, both))
    discordant = _inversions(b[np.lexsort((b, a))].astype(np.int64))
    den = np.sqrt(float(n0 - n1) * float(n0 - n2))
    return float(n0 - n1 - n2 + n3 - 2 * discordant) / den if den else 0.0


def _taus_of_task(table: pa.Table, means: Mapping[str, list]) -> pa.Table:
    y, last = (table[c].to_numpy() for c in ("y", "last_value"))  # null becomes NaN
    key, rows = table["task_key"][0].as_py(), []
    for seed, fold, train_mean in means[key]:
        at = np.flatnonzero(table[f"fold_{seed}"].to_numpy() == fold)
        yhat = np.where(np.isnan(last[at]), np.nan if train_mean is None else train_mean, last[at])
        known = ~(np.isnan(y[at]) | np.isnan(yhat))
        if known.any():
            rows.append((key, seed, fold, kendall(y[at][known], yhat[known])))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["task_key", "seed", "fold", "kendall_tau"])


def _score_task(table: pa.Table, means: Mapping[str, list], with_history: set[str]) -> pa.Table:
    y, last = (table[c].to_numpy() for c in ("y", "last_value"))  # null becomes NaN
    key, rows = table["task_key"][0].as_py(), []
    for seed, fold, train_mean in means[key]:
        mean = np.nan if train_mean is None else train_mean
        at = np.flatnonzero(table[f"fold_{seed}"].to_numpy() == fold)
        guesses = {"population_mean": np.full(len(at), mean)}
        if key in with_history:
            guesses["locf"] = np.where(np.isnan(last[at]), mean, last[at])
        for model, yhat in guesses.items():
            known = ~(np.isnan(y[at]) | np.isnan(yhat))
            if known.any():
                rows.append((key, model, seed, fold, *pair_scores(y[at][known], yhat[known])))
    names = [c.split()[0] for c in SCORES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def fold_means(summary: DataFrame) -> dict[str, list]:
    """[(seed, fold, train_mean) ...] by task."""
    means: dict[str, list] = {}
    for r in summary.select("task_key", "seed", "fold", "train_mean").collect():  # tasks of the grid x seeds x folds
        means.setdefault(r.task_key, []).append((r.seed, r.fold, r.train_mean))
    return means


def task_taus(rows: DataFrame, summary: DataFrame, history_tasks: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(task_key, seed, fold, kendall_tau) of the last value; a task of bounded size moves once, as in :func:`task_scores`."""
    means = fold_means(summary)
    slim = rows.join(F.broadcast(history_tasks), "task_key", "left_semi")
    slim = slim.select("task_no", "task_key", "y", "last_value", *[f"fold_{s}" for s in seeds])
    shape = "task_key string, seed int, fold int, kendall_tau double"
    return slim.groupBy("task_no").applyInArrow(lambda table: _taus_of_task(table, means), shape)


def task_scores(rows: DataFrame, summary: DataFrame, history_tasks: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(task_key, model, seed, fold, n_test, r2, mae, rmse, pearson, spearman) of training mean and last value.

    ``rows`` hold a task's folds of all seeds beside each other, so a task of bounded size moves once instead of once per
    seed and model; larger ones go through ``metrics.regression_metrics``.
    """
    means = fold_means(summary)
    seen = {r.task_key for r in history_tasks.collect()}
    slim = rows.select("task_no", "task_key", "y", "last_value", *[f"fold_{s}" for s in seeds])
    return slim.groupBy("task_no").applyInArrow(lambda table: _score_task(table, means, seen), SCORES)


def _scores_of_model(table: pa.Table, shape: pa.Schema) -> pa.Table:
    y, yhat = (table[c].to_numpy() for c in ("y", "yhat"))  # null becomes NaN
    known = ~(np.isnan(y) | np.isnan(yhat))
    seed, fold = (table[c].to_numpy()[known] for c in ("seed", "fold"))
    y, yhat, rows = y[known], yhat[known], []
    order = np.lexsort((fold, seed))
    starts = np.flatnonzero(np.r_[len(order) > 0, (np.diff(seed[order]) != 0) | (np.diff(fold[order]) != 0)][: len(order)])
    for at in np.split(order, starts[1:]) if len(order) else []:
        rows.append((table["task_key"][0].as_py(), table["model"][0].as_py(), seed[at[0]], fold[at[0]], *pair_scores(y[at], yhat[at])))
    columns = list(zip(*rows)) or [[]] * len(shape)
    return pa.table([pa.array(c, k) for c, k in zip(columns, shape.types)], schema=shape)


def stored_scores(pred: DataFrame) -> DataFrame:
    """Regression scores of stored predictions (task_key, seed, fold, model, y, yhat), a model's predictions of a task in one Spark task."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
    shape = pa.schema([(c.split()[0], k) for c, k in zip(SCORES.split(", "), kinds)])
    slim = pred.select("task_key", "model", "seed", "fold", "y", "yhat")
    return slim.groupBy("task_key", "model").applyInArrow(lambda table: _scores_of_model(table, shape), SCORES)
