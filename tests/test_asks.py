"""Rows that hold all regimes of a (target, horizon) against the operators that take tasks one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.models import naive
from panelcast.operators import asks, fold_metrics, folds, order_stats, tasks
from panelcast.plans.panel import grid_table

SEEDS = (0, 1)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(6)
    rows = [
        (i, m, v, c, float(rng.integers(0, 40) if c == "QUANTITY" else rng.integers(0, 9) * 30000))
        for i in range(90) for m, c in (("orders", "TOTAL"), ("lineitem", "QUANTITY")) for v in spec.VISIT_ORDER if rng.random() < 0.6
    ]
    panel = spark.createDataFrame(rows, "entity_id bigint, modality string, visit string, measure string, value double")
    fixed = [(i, "account", "ACCTBAL", None if i % 7 else 1.0) for i in range(0, 90, 2)] + [(4, "account", "ACCTBAL", 2.0)]  # one twice
    static = spark.createDataFrame(fixed, "entity_id bigint, modality string, measure string, value double")
    grid = grid_table(spark)
    names = asks.feature_names(panel, static).orderBy("code").collect()
    listed = asks.ask_list(grid)
    entities = asks.entity_rows(panel, static, names, listed).cache()
    return panel, static, grid, names, listed, entities, asks.asked_rows(entities, names, listed).cache()


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_values_members_and_cells_are_those_of_the_tasks(made, spark, monkeypatch):
    panel, static, grid, names, listed, entities, asked = made
    old = tasks.target_values(panel, grid).cache()
    values = asked.join(asks.ask_table(spark, listed), "ask_no")
    cols = ("target", "horizon", "entity_id", "y")
    assert rows_of(values, *cols) == rows_of(old, *cols)
    cols = ("task_no", "task_key", "task_type", "entity_id", "y", F.coalesce("last_value", F.lit(-1.0)))
    got = asks.by_task(asked, listed, ["last"]).withColumnRenamed("last", "last_value")
    assert rows_of(got, *cols) == rows_of(tasks.task_members(panel, static, grid, old), *cols)
    cols = ("task_key", "feature", "modality", F.coalesce("visit", F.lit("")), "n", "y_sum")
    want = rows_of(tasks.feature_cells(panel, static, grid, old), *cols)
    assert rows_of(asks.cells(asked, panel, static, grid, names, listed), *cols) == want
    monkeypatch.setattr(asks, "BITS", 5)  # several words
    wide = asks.asked_rows(asks.entity_rows(panel, static, names, listed), names, listed)
    assert rows_of(wide, "ask_no", "entity_id", "bits") == rows_of(asked, "ask_no", "entity_id", "bits")
    assert rows_of(asks.cells(wide, panel, static, grid, names, listed), *cols) == want


def test_folds_scores_and_spread_are_those_of_the_tasks(made):
    panel, static, grid, names, listed, entities, asked = made
    rows = asks.gate(asked, listed, 25).cache()
    long = asks.by_task(rows, listed, ["last"]).withColumnRenamed("last", "last_value").cache()
    old = tasks.size_gate(tasks.task_members(panel, static, grid, tasks.target_values(panel, grid)), grid, 25)
    assert rows_of(long, "task_key", "entity_id") == rows_of(old, "task_key", "entity_id")
    assert 0 < long.select("task_key").distinct().count() < grid.count()
    dealt = asks.dealt(rows, entities, listed, SEEDS).cache()
    beside = [f"fold_{s}" for s in SEEDS]
    fast = asks.by_task(dealt, listed, ["last", "stratum"]).withColumnRenamed("last", "last_value").cache()
    want = folds.dealt(old, grid, SEEDS).cache()
    cols = ("task_key", "entity_id", "stratum", *beside)
    assert rows_of(fast, *cols) == rows_of(want, *cols)

    reg = want.where("task_type = 'regression'")
    summary, seen = naive.dealt_summary(want, SEEDS), tasks.raw_history(panel, grid).select("task_key").distinct()
    cols = ("task_key", "seed", "fold", "n_train", "train_mean", "n_pos")
    assert rows_of(asks.summary(dealt, listed, SEEDS), *cols) == rows_of(summary, *cols)
    scores = {tuple(r)[:4]: tuple(r)[4:] for r in fold_metrics.task_scores(reg, summary, seen, SEEDS).collect()}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in asks.ask_scores(dealt, listed, summary, seen, SEEDS).collect()}
    assert got.keys() == scores.keys() and len(got) > 100
    for k, v in got.items():
        assert v == pytest.approx(scores[k], abs=1e-9), k

    keys, y = ["task_key", "seed", "fold"], folds.long_folds(reg, SEEDS)
    probs = {"q25": 0.25, "median": 0.5}
    plain = y.groupBy(*keys).agg(F.count("y").alias("n"), F.sum("y").alias("sum"), F.stddev_pop("y").alias("std"), (F.max("y") - F.min("y")).alias("range"))
    plain = plain.join(order_stats.exact_quantiles(y, keys, "y", probs), keys)
    cols = (*keys, "n", "sum", "std", "range", *probs)
    a, b = rows_of(asks.target_spread(dealt, listed, SEEDS, probs), *cols), rows_of(plain, *cols)
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [x for r in a for x in r[3:]] == pytest.approx([x for r in b for x in r[3:]])
