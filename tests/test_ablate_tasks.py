"""Ablations from one matrix per task against rows normalised fold by fold."""

import numpy as np

from panelcast import spec
from panelcast.models import linear
from panelcast.operators import folds, normalise, tasks
from panelcast.plans.panel import grid_table

SEEDS = (0, 1)


def test_ablations_agree_on_both_ways(spark):
    rng = np.random.default_rng(3)
    seen = [(m, c) for m, c in (("orders", "TOTAL"), ("orders", "PRIORITY"), ("lineitem", "QUANTITY"))]
    rows = [
        (i, m, v, c, float(rng.integers(1, 6) if c == "PRIORITY" else rng.normal(30, 9)))
        for i in range(100) for m, c in seen for v in spec.VISIT_ORDER if rng.random() < (0.08 if (c, v) == ("PRIORITY", "BL") else 0.7)
    ]
    panel = spark.createDataFrame(rows, "entity_id bigint, modality string, visit string, measure string, value double").cache()
    flat = [(i, "account", c, v) for i in range(100) for c, v in (("ACCTBAL", None if i % 9 == 0 else float(i % 40)), ("SEG_A", float(i % 2)))]
    static = spark.createDataFrame(flat, "entity_id bigint, modality string, measure string, value double").cache()
    grid = grid_table(spark).where("target = 'order_total' and horizon = 'V08'").cache()
    values = tasks.target_values(panel, grid).cache()
    dealt = folds.dealt(tasks.task_members(panel, static, grid, values), grid, SEEDS).cache()
    long = folds.long_folds(dealt, SEEDS).drop("task_no", "last_value", "task_type").cache()
    matrix = tasks.task_features(panel, static, grid, values).cache()
    stats = normalise.fit(normalise.training_counts(matrix, long)).cache()
    vectors = normalise.fold_vectors(matrix, long, normalise.kept_stats(matrix, long, stats)).cache()
    want = linear.ablate_modalities(vectors, folds.inner_folds(long, grid)).collect()
    members = dealt.drop("task_type", "last_value", "stratum").join(folds.inner_order(dealt), "entity_id")
    got = linear.ablate_tasks(*tasks.task_matrices(members, panel, static, grid), SEEDS).collect()

    def by_key(found):
        return {tuple(r[:4]): tuple(r[4:]) for r in found}

    a, b = by_key(got), by_key(want)
    assert a.keys() == b.keys() and len({k[0] for k in a}) == 3
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-7, atol=1e-9)
