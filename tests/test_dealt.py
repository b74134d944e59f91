"""Folds, members, medians and scores from one pass per task against the row-by-row operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.models import naive
from panelcast.operators import fold_metrics, folds, metrics, reshape, tasks
from panelcast.plans.panel import grid_table

SEEDS = (0, 1)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    rows = [
        (i, m, v, c, float(rng.integers(0, 40) if c == "QUANTITY" else rng.integers(0, 9) * 30000))
        for i in range(90) for m, c in (("orders", "TOTAL"), ("lineitem", "QUANTITY")) for v in spec.VISIT_ORDER if rng.random() < 0.6
    ]
    panel = spark.createDataFrame(rows, "entity_id bigint, modality string, visit string, measure string, value double")
    static = spark.createDataFrame([(i, "account", "ACCTBAL", None if i % 7 else 1.0) for i in range(0, 90, 2)], "entity_id bigint, modality string, measure string, value double")
    grid = grid_table(spark)
    return panel, static, grid, tasks.target_values(panel, grid).cache()


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_members_cells_and_sums_are_those_of_the_matrices(small):
    panel, static, grid, values = small
    matrix = tasks.task_features(panel, static, grid, values).cache()
    members = tasks.task_members(panel, static, grid, values)
    assert rows_of(members, "task_key", "entity_id", "y") == rows_of(tasks.task_targets(matrix, grid, 0), "task_key", "entity_id", "y")
    last = naive.last_values(tasks.raw_history(panel, grid))
    want = members.drop("last_value").join(last, ["task_key", "entity_id"], "left")
    cols = ("task_key", "entity_id", F.coalesce("last_value", F.lit(-1.0)))
    assert rows_of(members, *cols) == rows_of(want, *cols)
    counted = matrix.groupBy("task_key", "feature").agg(F.count(F.lit(1)).alias("n"))
    assert rows_of(tasks.feature_cells(panel, static, grid, values), "task_key", "feature", "n") == rows_of(counted, "task_key", "feature", "n")
    per = matrix.groupBy("task_key", "entity_id").agg(F.count(F.lit(1)).alias("n_values"), F.sum("value").alias("value_sum"), F.min("feature").alias("first_feature"))
    cols = ("task_key", "entity_id", "n_values", F.coalesce("value_sum", F.lit(-1.0)), "first_feature")
    assert rows_of(tasks.task_summaries(panel, static, grid, values), *cols) == rows_of(per, *cols)


def test_dealing_and_scores_agree_on_both_ways(small, spark):
    panel, static, grid, values = small
    members = tasks.task_members(panel, static, grid, values).cache()
    fast = folds.dealt(members, grid, SEEDS).cache()
    cols = ("task_key", "entity_id", "stratum", "fold_0", "fold_1")
    assert rows_of(fast, *cols) == rows_of(folds.dealt(members, grid, SEEDS, most=0), *cols)
    cols = ("task_key", "seed", "fold", "inner_fold", "n", "id_sum")
    assert rows_of(folds.inner_sizes(fast, grid, SEEDS), *cols) == rows_of(folds.inner_sizes(fast, grid, SEEDS, most=0), *cols)

    keys = ["task_key", "seed", "fold"]
    long = folds.long_folds(fast.where("task_type = 'regression'"), SEEDS)
    summary = naive.dealt_summary(fast, SEEDS)
    assert rows_of(summary, *keys, "n_train", "train_mean") == rows_of(naive.train_summary(folds.long_folds(fast, SEEDS)), *keys, "n_train", "train_mean")
    past = tasks.raw_history(panel, grid)
    seen = past.select("task_key").distinct()
    pred = naive.population_mean(long).unionByName(naive.locf(long.drop("last_value"), past)).cache()
    want = {tuple(r)[:4]: tuple(r)[4:] for r in metrics.regression_metrics(pred, ["task_key", "model", "seed", "fold"]).collect()}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in fold_metrics.task_scores(fast.where("task_type = 'regression'"), summary, seen, SEEDS).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-9), k
    taus = fold_metrics.task_taus(fast.where("task_type = 'regression'"), summary, seen, SEEDS)
    tau = {tuple(r)[:3]: r.kendall_tau for r in metrics.kendall_tau(pred.where("model = 'locf'"), keys, "y", "yhat").select(*keys, "kendall_tau").collect()}
    assert {tuple(r)[:3]: r.kendall_tau for r in taus.collect()} == pytest.approx(tau, abs=1e-9)


def test_medians_of_agree_on_both_ways(spark):
    rows = [(i % 7 if i % 11 else None, "ab"[i % 2], float(i % 13) if i % 5 else None, None if i % 7 == 3 else i * 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v string, a double, b double")
    cols = (F.coalesce("k", F.lit(-1)), "v", "measure", "value")
    fast, slow = (reshape.medians_of(df, ["k", "v"], ["a", "b"], hot_rows=h) for h in (10**6, 1))
    assert rows_of(fast, *cols) == rows_of(slow, *cols)
    assert reshape.medians_of(df.limit(0), ["k", "v"], ["a", "b"]).count() == 0


def test_weighted_class_scores_are_those_of_the_rows(spark):
    rows = [("t", float(i % 3 == 0), 0.0, 0.25) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, y double, yhat double, prob double")
    counted = df.groupBy("k", "y", "yhat", "prob").agg(F.count(F.lit(1)).alias("w"))
    a, b = metrics.classification_metrics(df, ["k"]).first(), metrics.classification_metrics(counted, ["k"], weight="w").first()
    assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])
