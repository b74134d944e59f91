"""Random intercept and slope model for every (task, seed, fold), by EM on pattern sums.

Visits come from a fixed calendar, so entities fall into a few patterns of observed
visits, and inside a pattern every EM quantity is a fixed matrix times moments of
q = (sum y, sum t*y). One aggregate over the data therefore feeds all iterations,
which run on at most 2^visits rows per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelcast import spec
from panelcast.operators import tasks
from panelcast.operators.fold_metrics import fold_means, pair_scores

KEYS = ["task_key", "seed", "fold"]
MIN_OBS, MIN_ENTITIES, MIN_VISITS = 20, 10, 2
SUMS = ["cnt", "q0", "q1", "q00", "q01", "q11", "yy"]
SCORES = "task_key string, seed int, fold int, model string, n_test bigint, r2 double, mae double, rmse double, pearson double, spearman double"
#: Fits take the same time whatever the input, so their small table is dealt to as many tasks as this, and not combined by its bytes.
FIT_TASKS = 400


def entity_moments(history: DataFrame) -> DataFrame:
    """(task_key, entity_id, pattern, sy, sty, syy): pattern is the bitmask of observed visits."""
    bits = F.lit(0)
    for i, v in enumerate(spec.VISIT_ORDER):
        bits = F.when(F.col("visit") == v, 1 << i).otherwise(bits)
    t, y = F.col("months").cast("double"), F.col("value")
    rows = history.where("value is not null").withColumn("_bit", bits)
    return rows.groupBy("task_key", "entity_id").agg(
        F.sum("_bit").cast("int").alias("pattern"), F.sum(y).alias("sy"), F.sum(t * y).alias("sty"), F.sum(y * y).alias("syy")
    )


def pattern_sums(folds: DataFrame, moments: DataFrame) -> DataFrame:
    """Training sums per (keys, pattern) as total minus held-out fold."""
    rows = folds.select(*KEYS, "entity_id").join(moments, ["task_key", "entity_id"])
    a, b = F.col("sy"), F.col("sty")
    parts = {"cnt": F.lit(1.0), "q0": a, "q1": b, "q00": a * a, "q01": a * b, "q11": b * b, "yy": F.col("syy")}
    held = rows.groupBy(*KEYS, "pattern").agg(*[F.sum(e).alias(n) for n, e in parts.items()])
    total = held.groupBy("task_key", "seed", "pattern").agg(*[F.sum(n).alias(f"t_{n}") for n in parts])
    keys = folds.select(*KEYS).distinct()
    grid = keys.join(total, ["task_key", "seed"]).join(held, [*KEYS, "pattern"], "left")
    left = [(F.col(f"t_{n}") - F.coalesce(n, F.lit(0.0))).alias(n) for n in parts]
    return grid.select(*KEYS, "pattern", *left)


def _design(pattern: int, months: np.ndarray) -> np.ndarray:
    t = np.array([m for i, m in enumerate(months) if pattern >> i & 1], dtype=float)
    return np.array([[len(t), t.sum()], [t.sum(), (t * t).sum()]])


def em_fit(patterns, sums: np.ndarray, months, iterations: int = 300, tol: float = 1e-8, trace: list | None = None):
    """(beta, D, sigma2) by REML-type EM; ``sums`` columns follow SUMS."""
    keep = sums[:, 0] > 0
    patterns, sums = np.asarray(patterns)[keep], sums[keep]
    s = np.array([_design(int(p), months) for p in patterns])
    n_i, n_obs = sums[:, 0], float((sums[:, 0] * s[:, 0, 0]).sum())
    q = sums[:, 1:3]
    qq = np.stack([sums[:, [3, 4]], sums[:, [4, 5]]], axis=1)
    total_s, total_q, yy = np.einsum("i,ijk->jk", n_i, s), q.sum(0), sums[:, 6].sum()
    beta = np.linalg.lstsq(total_s, total_q, rcond=None)[0]
    sigma2 = max((yy - beta @ total_q) / n_obs, 1e-6) / 2
    span = max(float(np.max(months)), 1.0)
    d = np.diag([sigma2, sigma2 / span**2])
    eye = np.eye(2)
    for _ in range(iterations):
        k = np.linalg.inv(np.linalg.inv(d) + s / sigma2)
        a = eye / sigma2 - s @ k / sigma2**2  # r = A q
        w = a @ s
        c = np.linalg.inv(np.einsum("i,ijk->jk", n_i, w))
        beta = c @ np.einsum("ijk,ik->j", a, q)
        # b = D (A q - W beta): first and second moments summed over a pattern
        wb = w @ beta
        aq = np.einsum("ijk,ik->ij", a, q)
        aqqa = a @ qq @ a.transpose(0, 2, 1)
        cross = np.einsum("ij,ik->ijk", aq, wb)
        uu = aqqa - cross - cross.transpose(0, 2, 1) + n_i[:, None, None] * np.einsum("ij,ik->ijk", wb, wb)
        bb = d @ uu.sum(0) @ d
        p_mat = w - w @ c @ w
        new_d = (bb + n_i.sum() * d - d @ np.einsum("i,ijk->jk", n_i, p_mat) @ d) / n_i.sum()
        new_d = (new_d + new_d.T) / 2
        # residual y - Z(beta + b), b + beta = M q + g inside a pattern
        m_mat, g = d @ a, beta - wb @ d.T
        mq = np.einsum("ijk,ik->ij", m_mat, q)
        fit_q = np.einsum("ijk,ikj->i", m_mat, qq) + np.einsum("ij,ij->i", g, q)
        smm = np.einsum("ijk,ikl,ilj->i", s, m_mat @ qq, m_mat.transpose(0, 2, 1))
        smg = 2 * np.einsum("ij,ijk,ik->i", mq, s, g) + n_i * np.einsum("ij,ijk,ik->i", g, s, g)
        rss = yy - 2 * fit_q.sum() + (smm + smg).sum()
        # trace of I - sigma2 P over the observations of each entity
        vinv_tr = s[:, 0, 0] / sigma2 - np.einsum("ijj->i", k @ s) / sigma2**2
        zvvz = a @ s @ a.transpose(0, 2, 1)  # Z'V^-1 V^-1 Z
        p_tr = vinv_tr - np.einsum("ijk,kj->i", zvvz, c)
        new_s = (rss + sigma2 * (n_obs - sigma2 * (n_i * p_tr).sum())) / n_obs
        if trace is not None:
            trace.append((new_d.copy(), float(new_s)))
        moved = max(np.abs(new_d - d).max() / max(np.abs(d).max(), 1e-300), abs(new_s - sigma2) / sigma2)
        d, sigma2 = new_d, max(float(new_s), 1e-6)
        d = d + 1e-12 * np.trace(d) * np.diag([1.0, 1.0 / span**2])
        if moved < tol:
            break
    return beta, d, sigma2


def _fit_key(pdf: pd.DataFrame, horizon_months: dict, months: np.ndarray) -> pd.DataFrame:
    key = list(pdf.iloc[0][KEYS])
    cols = [*KEYS, "pattern", "p0", "p1", "p2"]
    sums = pdf[SUMS].to_numpy(dtype=float)
    patterns = pdf["pattern"].to_numpy(dtype=int)
    live = sums[:, 0] > 0.5
    n_obs = sum(c * bin(p).count("1") for c, p in zip(sums[:, 0], patterns))
    seen = int(np.bitwise_or.reduce(patterns[live])) if live.any() else 0
    if n_obs < MIN_OBS or sums[:, 0].sum() < MIN_ENTITIES or bin(seen).count("1") < MIN_VISITS:
        return pd.DataFrame(columns=cols)
    beta, d, sigma2 = em_fit(patterns, np.where(live[:, None], sums, 0.0), months)
    z = np.array([1.0, horizon_months[key[0]]])
    out = [[*key, 0, float(z @ beta), 0.0, 0.0]]
    for p in patterns:
        s = _design(int(p), months)
        k = np.linalg.inv(np.linalg.inv(d) + s / sigma2)
        a = np.eye(2) / sigma2 - s @ k / sigma2**2
        lin = z @ d @ a
        out.append([*key, int(p), float(z @ beta - z @ d @ a @ s @ beta), float(lin[0]), float(lin[1])])
    return pd.DataFrame(out, columns=cols)


def predict_mixed(folds: DataFrame, history: DataFrame, horizon_months: dict[str, int], fallback: DataFrame) -> DataFrame:
    """Horizon predictions from best linear unbiased predictors; ``fallback`` (last value) where the gates fail.

    Inside a pattern the prediction is linear in (sy, sty), so scoring is a join and a sum.
    """
    months = np.array([spec.VISIT_MONTHS[v] for v in spec.VISIT_ORDER], dtype=float)
    moments = entity_moments(history)
    schema = "task_key string, seed int, fold int, pattern int, p0 double, p1 double, p2 double"
    lines = pattern_sums(folds, moments).repartition(FIT_TASKS, *KEYS).groupBy(*KEYS).applyInPandas(lambda p: _fit_key(p, horizon_months, months), schema)
    rows = folds.select(*KEYS, "entity_id", "y").join(moments, ["task_key", "entity_id"], "left")
    rows = rows.withColumn("pattern", F.coalesce("pattern", F.lit(0)))
    rows = rows.join(lines, [*KEYS, "pattern"], "left")
    line = F.col("p0") + F.col("p1") * F.coalesce("sy", F.lit(0.0)) + F.col("p2") * F.coalesce("sty", F.lit(0.0))
    rows = rows.select(*KEYS, "entity_id", "y", line.alias("_line"))
    back = fallback.select(*KEYS, "entity_id", F.col("yhat").alias("_back"))
    both = rows.join(back, [*KEYS, "entity_id"])
    return both.select(*KEYS, "entity_id", "y", F.coalesce("_line", "_back").alias("yhat"), F.lit("lme").alias("model"))


def with_moments(rows: DataFrame, panel: DataFrame, grid: DataFrame) -> DataFrame:
    """``rows`` of tasks with their :func:`entity_moments` (pattern 0: nothing seen): one join on the entity, no row per past value."""
    rules = tasks.task_rules(grid).select("task_key", "modality", "measure", "seen")
    past = tasks.past_values(panel, rules.select("modality", "measure").distinct())
    both = rows.join(F.broadcast(rules), "task_key").join(past, ["entity_id", "modality", "measure"], "left")
    sums = {"pattern": F.lit(0), "sy": F.lit(0.0), "sty": F.lit(0.0), "syy": F.lit(0.0)}
    for i, v in enumerate(spec.VISIT_ORDER):
        y, t = F.get("past", F.lit(i)), F.lit(float(spec.VISIT_MONTHS[v]))
        here = (F.col("seen").bitwiseAND(F.lit(1 << i)) != 0) & y.isNotNull()
        terms = {"pattern": F.lit(1 << i), "sy": y, "sty": t * y, "syy": y * y}
        sums = {n: e + F.when(here, terms[n]).otherwise(F.lit(0)) for n, e in sums.items()}
    return both.withColumns(sums).drop("modality", "measure", "seen", "past")


def _predicted(table: pa.Table, means: Mapping[str, list], horizon_months: Mapping[str, int], months: np.ndarray):
    """(seed, fold, test rows, predictions) of every seed and fold of one task."""
    last, sy, sty, syy = (table[c].to_numpy() for c in ("last_value", "sy", "sty", "syy"))  # null becomes NaN
    key = table["task_key"][0].as_py()
    patterns, code = np.unique(table["pattern"].to_numpy(), return_inverse=True)
    seen, held, seed_now = patterns > 0, np.zeros(0), None
    for seed, fold, train_mean in sorted(means[key], key=lambda m: m[:2]):
        own = table[f"fold_{seed}"].to_numpy()
        if seed != seed_now:
            at, size = own * len(patterns) + code, (int(own.max()) + 1) * len(patterns)
            columns = (None, sy, sty, sy * sy, sy * sty, sty * sty, syy)
            held = np.stack([np.bincount(at, c, size) for c in columns], axis=1).reshape(-1, len(patterns), len(SUMS))
            seed_now = seed
        sums = pd.DataFrame((held.sum(0) - held[fold])[seen], columns=SUMS)
        lines = _fit_key(sums.assign(pattern=patterns[seen], task_key=key, seed=seed, fold=fold), horizon_months, months) if seen.any() else []
        test = np.flatnonzero(own == fold)
        if len(lines):
            p0, p1, p2 = lines.set_index("pattern").loc[patterns, ["p0", "p1", "p2"]].to_numpy(dtype=float)[code[test]].T
            yield seed, fold, test, p0 + p1 * sy[test] + p2 * sty[test]
        else:
            yield seed, fold, test, np.where(np.isnan(last[test]), np.nan if train_mean is None else train_mean, last[test])


def _score_task(table: pa.Table, means: Mapping[str, list], horizon_months: Mapping[str, int], months: np.ndarray) -> pa.Table:
    y, key, rows = table["y"].to_numpy(), table["task_key"][0].as_py(), []
    for seed, fold, test, yhat in _predicted(table, means, horizon_months, months):
        known = ~(np.isnan(y[test]) | np.isnan(yhat))
        if known.any():
            rows.append((key, seed, fold, "lme", *pair_scores(y[test][known], yhat[known])))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.float64()] * 5]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SCORES.split(", ")])


def _task_moments(rows: DataFrame, panel: DataFrame, grid: DataFrame, history_tasks: DataFrame, seeds: Sequence[int]) -> DataFrame:
    slim = rows.join(F.broadcast(history_tasks), "task_key", "left_semi")
    slim = slim.select("task_no", "task_key", "entity_id", "y", "last_value", *[f"fold_{s}" for s in seeds])
    return with_moments(slim, panel, grid).repartition(FIT_TASKS, "task_no")


def task_predictions(
    rows: DataFrame, panel: DataFrame, grid: DataFrame, summary: DataFrame, history_tasks: DataFrame, horizon_months: dict[str, int], seeds: Sequence[int]
) -> DataFrame:
    """:func:`predict_mixed` of rows with the folds of all seeds beside each other: a task of bounded size moves once."""
    means, months = fold_means(summary), np.array([spec.VISIT_MONTHS[v] for v in spec.VISIT_ORDER], dtype=float)
    shape = rows.select(*[F.lit(0).alias(c) if c != "task_key" else "task_key" for c in KEYS], "entity_id", "y", F.lit(0.0).alias("yhat"), F.lit("").alias("model")).schema
    arrow = to_arrow_schema(shape)

    def predicted(table: pa.Table) -> pa.Table:
        own, parts = table.select(["task_key", "entity_id", "y"]).combine_chunks(), []
        for seed, fold, test, yhat in _predicted(table, means, horizon_months, months):
            cells, n = own.take(pa.array(test)), len(test)
            cols = [cells["task_key"], pa.array(np.full(n, seed)), pa.array(np.full(n, fold)), cells["entity_id"], cells["y"], pa.array(yhat, from_pandas=True), pa.array(["lme"] * n)]
            parts.append(pa.table(cols, names=arrow.names).cast(arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    return _task_moments(rows, panel, grid, history_tasks, seeds).groupBy("task_no").applyInArrow(predicted, shape)


def task_scores(
    rows: DataFrame, panel: DataFrame, grid: DataFrame, summary: DataFrame, history_tasks: DataFrame, horizon_months: dict[str, int], seeds: Sequence[int]
) -> DataFrame:
    """Regression scores of :func:`predict_mixed` for all seeds and folds, from rows with the folds of all seeds beside each other.

    A task of bounded size moves once and is summed, fitted, predicted and scored as arrays, so that no row is copied per seed
    and no prediction is written or joined.
    """
    means, months = fold_means(summary), np.array([spec.VISIT_MONTHS[v] for v in spec.VISIT_ORDER], dtype=float)
    slim = _task_moments(rows, panel, grid, history_tasks, seeds).drop("entity_id")
    return slim.groupBy("task_no").applyInArrow(lambda table: _score_task(table, means, horizon_months, months), SCORES)
