"""Tree queries ask for all tasks, seeds and folds with the full grid; the fits themselves are stood in for."""

import pytest
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.models import trees
from panelcast.plans import modelling

KEYS = ["task_key", "seed", "fold"]
CURVE = modelling.REDUCTION_TASKS[0]
KINDS = {CURVE: "regression", "order_total__baseline_only__V08": "regression", "low_quantity__rolling__V08": "classification", "total_rank__rolling__V08": "ranking"}


@pytest.fixture
def asked(spark, tmp_path, monkeypatch):
    """Calls of (model, key, grid, features); the key of fold 4 in seed 7 fails."""
    calls = []
    keys = [(k, s, f) for k in KINDS for s in spec.CV_SEEDS for f in range(5)]

    class OnePanel:
        def __init__(self, t):
            self.all_folds = spark.createDataFrame([], "entity_id bigint")
            self.grid = spark.createDataFrame([(k, v, *k.split("__")[1:]) for k, v in KINDS.items()], "task_key string, task_type string, regime string, horizon string")
            self.train_summary = spark.createDataFrame([(*k, 40) for k in keys], "task_key string, seed int, fold int, n_train bigint")

    def fit(source, inner, model, keys, grid, *_):
        known = [n for n in source.columns if n.startswith("x")]
        calls.extend((model, k, grid, source.select(F.size("x")).first()[0] if known else None) for k in keys)
        rows = [(*k, i, float(i % 2), float(i % 3 > 1), 0.5, model) for k in keys if k[1:] != (7, 4) for i in range(12)]
        pred = spark.createDataFrame(rows, "task_key string, seed int, fold int, entity_id bigint, y double, yhat double, prob double, model string")
        chosen = [{"task_key": k[0], "seed": k[1], "fold": k[2], "best_params": {n: str(v[min(1, len(v) - 1)]) for n, v in grid.items()}, "error": "singular" if k[1:] == (7, 4) else None} for k in keys]
        return pred, chosen, {}

    def vectors(t, task, seeds=(0,)):
        rows = [(task, s, f, ["lineitem__BL__TAX", "orders__BL__TOTAL", "orders__V02__TOTAL", "account__ACCTBAL"], [1.0, 2.0, 3.0, 4.0]) for s in seeds for f in range(5)]
        return spark.createDataFrame(rows, "task_key string, seed int, fold int, features array<string>, x array<double>")

    monkeypatch.setattr(modelling, "Panel", OnePanel)
    monkeypatch.setattr(modelling, "task_vectors", vectors)
    monkeypatch.setattr(modelling, "task_inner", lambda *_: None)
    monkeypatch.setattr(modelling, "store_folder", lambda *_: str(tmp_path / "store"))
    monkeypatch.setattr(modelling, "staged", lambda spark, version, name, build: build())
    monkeypatch.setattr(trees, "tune_and_predict", fit)

    class Here:
        version = "here"

    Here.spark = spark
    return Here(), calls


@pytest.mark.parametrize("query, kind", [("model_boosted_trees", "regression"), ("model_boosted_trees_clf", "classification")])
def test_boosted_trees_run_on_every_task_seed_and_fold(asked, query, kind):
    t, calls = asked
    rows = getattr(modelling, query)(t).collect()
    wanted = {(k, s, f) for k, v in KINDS.items() if v == kind for s in spec.CV_SEEDS for f in range(5)}
    assert {c[1] for c in calls} == wanted and len(calls) == len(wanted)
    assert all(c[2] == spec.GRIDS["boosted_trees"] for c in calls)
    assert {(r.task_key, r.seed, r.fold) for r in rows} == wanted
    assert {(r.seed, r.fold) for r in rows if r.n_test is None} == {(7, 4)}
    getattr(modelling, query)(t)
    assert len(calls) == len(wanted)


def test_the_curve_covers_seeds_folds_and_every_size(asked, monkeypatch):
    t, calls = asked
    ranked = []
    monkeypatch.setattr(modelling, "importances", lambda t, task, top, grid: ranked.append((task, grid)) or [("orders__BL__TOTAL", 0.6), ("account__ACCTBAL", 0.4), ("orders__V02__TOTAL", 0.1), ("lineitem__BL__TAX", 0.0)])
    monkeypatch.setattr(spec, "CV_SEEDS", [0, 42])
    monkeypatch.setattr(modelling, "write_stage", lambda df, name: df)
    monkeypatch.setattr(modelling.metrics, "regression_metrics", lambda pred, keys: pred.groupBy(*keys).agg(F.lit(0.5).alias("r2")))
    rows = {r.k: r for r in modelling.feature_reduction_curve(t).collect() if r.task_key == CURVE}
    assert set(rows) == {3, 5, 10, 15, 20} and all(r.delta_r2 == 0 for r in rows.values())
    assert ranked == [(CURVE, spec.GRIDS["boosted_trees"])]
    one = {n: [v[1]] for n, v in spec.GRIDS["boosted_trees"].items()}
    fits = [c for c in calls if c[2] == one]
    assert {c[1][1:] for c in fits} == {(s, f) for s in (0, 42) for f in range(5)}
    assert sorted(c[3] for c in fits if c[1][1:] == (0, 0)) == [3, 4, 4, 4, 4, 4]


def test_ablation_of_a_fold_covers_all_types_with_the_full_grid(asked):
    t, calls = asked
    rows = modelling.ablation_single_fold(t).collect()
    here = {k for k in KINDS if k != "order_total__baseline_only__V08"}
    assert {r.task_key for r in rows} == here and {c[1] for c in calls} == {(k, 0, 0) for k in here}
    assert all(c[2] == spec.GRIDS["boosted_trees"] for c in calls)
    for k in here:
        assert {r.metric for r in rows if r.task_key == k} == set(modelling.ABLATED_METRICS[KINDS[k]])
        assert {(r.dropped_modality, r.n_dropped_features) for r in rows if r.task_key == k} == {("account", 1), ("lineitem", 1), ("orders", 2)}


def test_splits_hold_seven_models(asked, monkeypatch):
    t, calls = asked
    cols = "task_key string, model string, seed int, fold int, r2 double, spearman double, mae double"
    for name, models in (("fold_scores", ["population_mean", "locf"]), ("mixed_scores", ["lme"]), ("linear_scores", ["ridge", "elastic_net"])):
        own = t.spark.createDataFrame([(k, m, 0, 0, 0.1, 0.2, 3.0) for k in (CURVE, "total_rank__rolling__V08") for m in models], cols)
        monkeypatch.setattr(modelling, name, lambda t, own=own: own)
    found = modelling.split_scores(t, [CURVE]).select("task_key", "model").distinct().collect()
    assert sorted(map(tuple, found)) == sorted((CURVE, m) for m in ("population_mean", "locf", "lme", "ridge", "elastic_net", "random_forest", "boosted_trees"))
    assert {c[0] for c in calls} == {"random_forest", "boosted_trees"} and {c[1][0] for c in calls} == {CURVE}
    assert all(c[2] == spec.GRIDS[c[0]] for c in calls)
