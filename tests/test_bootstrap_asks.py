"""Bootstraps of the last value from one row per (target, horizon, entity), and what moves and is stored on the way."""

import numpy as np
from pyspark.sql import functions as F

from panelcast.operators import asks, metrics, resample


def test_tasks_and_seeds_of_an_ask_are_drawn_together(spark):
    rng, seeds = np.random.default_rng(6), (0, 7)
    rows = []
    for i in range(60):
        folds = [int(rng.integers(0, 5)) | int(rng.integers(0, 5)) << asks.PACK for _ in seeds]
        rows.append((0, i, float(rng.integers(0, 9)), 3 if i % 4 else 1, None if i % 3 == 0 else float(rng.integers(0, 9)), float(rng.normal()), *folds))
    rows += [(1, i, 1.0, 1, 2.0, None, 0, 0) for i in range(4)]
    dealt = spark.createDataFrame(rows, "ask_no int, entity_id bigint, y double, bits int, last_0 double, last_1 double, fold_0 bigint, fold_7 bigint")
    listed = [{"ask_no": 0, "task_type": "regression", "tasks": [(0, "a"), (1, "b")]}, {"ask_no": 1, "task_type": "regression", "tasks": [(2, "few")]}]
    means = {(k, s, f): 3.0 + f / 7 + s for k in ("a", "b", "few") for s in seeds for f in range(5)}
    summary = spark.createDataFrame([(*k, v) for k, v in means.items()], "task_key string, seed int, fold int, train_mean double")
    seen = spark.createDataFrame([("a",), ("b",), ("few",)], "task_key string")
    order = spark.range(60).select(F.col("id").alias("entity_id"), F.md5(F.concat_ws("|", F.lit(5), "id")).alias("h"))
    order = spark.createDataFrame([(r.entity_id, n) for n, r in enumerate(order.orderBy("h").collect())], "entity_id bigint, order int")
    names = ["r2", "mae", "rmse", "pearson", "spearman"]
    got = asks.bootstrap_last(dealt, order, listed, summary, seen, seeds, resample.score_regression, names, n_boot=30, seed=5)
    long = []
    for ask, i, y, bits, *rest in rows:
        for j, (_, key) in enumerate(listed[ask]["tasks"]):
            if bits >> j & 1:
                for s, packed in zip(seeds, rest[2:]):
                    last = rest[j]
                    long.append((key, s, i, y, means[key, s, packed >> asks.PACK * j & 15] if last is None else last))
    flat = spark.createDataFrame(long, "task_key string, seed int, entity_id bigint, y double, yhat double")
    want = resample.bootstrap_scores(flat, ["task_key", "seed"], "entity_id", ["y", "yhat"], resample.score_regression, metrics.regression_metrics, names, n_boot=30, seed=5)
    cols = ["point", "mean", "ci_lo", "ci_hi", "se"]
    a, b = ({tuple(r)[:3]: tuple(r)[3:] for r in x.select("task_key", "seed", "metric", *cols).collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) == 3 * 2 * 5
    for k in a:
        assert [v is None for v in a[k]] == [v is None for v in b[k]] == [k[0] == "few"] * 5
        if k[0] != "few":
            np.testing.assert_allclose(a[k], b[k], atol=1e-9, err_msg=str(k))


def test_rows_are_stored_as_numbers_of_their_pairs(spark):
    """A row was stored with its key, place and values and moved once for each of hundreds of blocks."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("p"))
    packed = resample._packed(rows, ["k"], "id", "y", "p", 5).collect()
    assert sorted((r.k, r.n, len(r.a), len(r.codes)) for r in packed) == [(0, 1500, 15, 1500), (1, 1500, 15, 1500)]
    assert len(resample.block_edges(2000, 5, 8)) - 1 == 4 and resample.block_edges(10, 99, 8) == [1, 11]


def test_regression_bootstrap_holds_spearman():
    y, p = np.array([1.0, 2, 3, 4, 9]), np.array([2.0, 1, 4, 3, 5])
    got = resample.score_regression(y, p)(np.ones((1, 5)))
    assert set(got) == {"r2", "mae", "rmse", "pearson", "spearman"}
    np.testing.assert_allclose(got["spearman"], [0.8])
