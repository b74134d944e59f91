"""Scores of the mixed model from one pass per task against stored predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.models import mixed, naive
from panelcast.operators import fold_metrics, folds, metrics, tasks
from panelcast.plans.panel import grid_table

SEEDS = (0, 1)


def test_scores_of_a_task_are_those_of_the_predictions(spark):
    rng = np.random.default_rng(11)
    level = rng.normal(100000, 30000, 130)
    rows = [
        (i, "orders", v, "TOTAL", float(level[i] + 500 * k + rng.normal(0, 8000)))
        for i in range(130) for k, v in enumerate(spec.VISIT_ORDER) if rng.random() < (0.7 if i % 9 else 0.15)
    ]
    panel = spark.createDataFrame(rows, "entity_id bigint, modality string, visit string, measure string, value double").cache()
    static = spark.createDataFrame([(i, "account", "ACCTBAL", 1.0) for i in range(130)], "entity_id bigint, modality string, measure string, value double")
    grid = grid_table(spark).where("target = 'order_total' and horizon = 'V08' and regime in ('baseline_only', 'rolling')")
    members = tasks.task_members(panel, static, grid, tasks.target_values(panel, grid))
    dealt = folds.dealt(members, grid, SEEDS).cache()
    long, summary, past = folds.long_folds(dealt, SEEDS), naive.train_summary(folds.long_folds(dealt, SEEDS)).cache(), tasks.raw_history(panel, grid)
    seen = past.select("task_key").distinct()
    months = {r.task_key: r.horizon_months for r in grid.collect()}
    pred = mixed.predict_mixed(long, past, months, naive.carried_forward(long, seen, summary)).cache()
    want = {tuple(r)[:3]: tuple(r)[3:] for r in metrics.regression_metrics(pred, ["task_key", "seed", "fold"]).select("task_key", "seed", "fold", "n_test", "r2", "mae", "rmse", "pearson", "spearman").collect()}
    got = mixed.task_scores(dealt, panel, grid, summary, seen, months, SEEDS).drop("model")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in got.select("task_key", "seed", "fold", "n_test", "r2", "mae", "rmse", "pearson", "spearman").collect()}
    assert got.keys() == want.keys() and len(got) == 20
    assert any(v[1] != pytest.approx(0, abs=1e-3) for v in got.values())
    for k, v in got.items():
        assert v == pytest.approx(want[k], rel=1e-6, abs=1e-6), k
    cols = ["task_key", "seed", "fold", "entity_id"]
    stored = mixed.task_predictions(dealt, panel, grid, summary, seen, months, SEEDS).cache()
    assert stored.columns == pred.columns
    rows, asked = ({tuple(r)[:4]: tuple(r)[4:] for r in x.select(*cols, "y", "yhat").collect()} for x in (stored, pred))
    assert rows.keys() == asked.keys() and len(rows) > 200
    for k, v in rows.items():
        assert v == pytest.approx(asked[k], rel=1e-6), k


def test_scores_of_stored_predictions(spark):
    rng = np.random.default_rng(5)
    rows = [(k, s, f, m, float(rng.integers(0, 9)), None if i == 3 else float(rng.integers(0, 5))) for k in "ab" for m in ("one", "two") for s in (0, 7) for f in (0, 1) for i in range(9 if f else 4)]
    pred = spark.createDataFrame(rows, "task_key string, seed int, fold int, model string, y double, yhat double")
    keys = ["task_key", "seed", "fold", "model"]
    cols = ["n_test", "r2", "mae", "rmse", "pearson", "spearman"]
    got, want = ({tuple(r)[:4]: tuple(r)[4:] for r in x.select(*keys, *cols).collect()} for x in (fold_metrics.stored_scores(pred), metrics.regression_metrics(pred, keys)))
    assert got.keys() == want.keys() and len(got) == 16
    for k, v in got.items():
        assert [x is None for x in v] == [x is None for x in want[k]]
        assert [x for x in v if x is not None] == pytest.approx([x for x in want[k] if x is not None], abs=1e-9), k
