"""Normaliser statistics, cells and missing shares from columns and bits against the long task matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.models import naive
from panelcast.operators import asks, normalise, tasks
from panelcast.plans.panel import grid_table
from panelcast.sources.stage import write_stage

KEYS = ["task_key", "seed", "fold"]


@pytest.fixture(scope="module", params=["once", "twice"])
def small(spark, request):
    rng = np.random.default_rng(9)
    seen = [(m, c) for m, c in (("orders", "TOTAL"), ("orders", "PRIORITY"), ("lineitem", "QUANTITY"))]
    rows = [
        (i, m, v, c, float(rng.integers(1, 6) if c == "PRIORITY" else rng.normal(30, 9)))
        for i in range(80) for m, c in seen for v in spec.VISIT_ORDER if rng.random() < (0.08 if (c, v) == ("PRIORITY", "BL") else 0.7)
    ]
    flat = [(i, "account", c, v) for i in range(80) for c, v in (("ACCTBAL", None if i % 9 == 0 else float(i % 40)), ("SEG_A", float(i % 2)))]
    flat += [(3, "account", "ACCTBAL", 5.0), (9, "account", "SEG_A", 0.0)] if request.param == "twice" else []
    panel = write_stage(spark.createDataFrame(rows, "entity_id bigint, modality string, visit string, measure string, value double"), "panel")
    static = write_stage(spark.createDataFrame(flat, "entity_id bigint, modality string, measure string, value double"), "static")
    grid = grid_table(spark).where("target in ('order_total', 'total_worsen') and horizon in ('V04', 'V08')")
    listed, names = asks.ask_list(grid), asks.feature_names(panel, static).orderBy("code").collect()
    entities = write_stage(asks.entity_rows(panel, static, names, listed), "entities")
    asked = write_stage(asks.asked_rows(entities, names, listed), "asked")
    dealt = write_stage(asks.dealt(asks.gate(asked, listed, 10), entities, listed, [0]), "dealt")
    long = asks.by_task(dealt, listed, ["stratum"]).select("task_key", F.lit(0).alias("seed"), "entity_id", "y", "stratum", F.col("fold_0").alias("fold"))
    values = asked.join(asks.ask_table(spark, listed), "ask_no").select("target", "horizon", "entity_id", "y")
    matrix = write_stage(tasks.task_features(panel, static, grid, values), "matrix")
    return request.param, panel, static, grid, listed, names, dealt, write_stage(long, "long"), matrix


def by_key(df, keys, cols):
    rows = [(tuple(r[: len(keys)]), tuple(r[len(keys) :])) for r in df.select(*keys, *cols).collect()]
    assert len(rows) == len(dict(rows)) > 100
    return dict(rows)


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert a == b if a is None or b is None or isinstance(a, str) else abs(a - b) < 1e-9, k


def test_missing_shares_count_values_by_bits(small):
    _, panel, static, grid, listed, names, dealt, long, matrix = small
    cols = ["n_train", "n_value", "missing"]
    got = asks.missing(dealt, panel, static, grid, names, listed, naive.train_summary(long), 0)
    same(by_key(got, [*KEYS, "feature"], cols), by_key(normalise.missing_fractions(matrix, long), [*KEYS, "feature"], cols))


def test_columns_are_fitted_and_scaled_as_in_the_matrices(small):
    kind, panel, static, grid, listed, names, dealt, long, matrix = small
    if kind == "twice":
        pytest.skip("repeated features go through the matrices")
    got = write_stage(asks.normalised(dealt, panel, static, listed, 0), "columns")
    stats = write_stage(normalise.fit(write_stage(normalise.training_counts(matrix, long), "counts")), "stats")
    cols = ["kind", "mode", "lo", "hi", "median", "mean", "std"]
    same(by_key(got.where("is_test"), [*KEYS, "feature"], cols), by_key(stats, [*KEYS, "feature"], cols))
    cells = normalise.apply(normalise.fold_cells(matrix, long, stats), stats).groupBy(*KEYS, "feature", "is_test")
    want = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.max(F.abs("x")).alias("largest"))
    sums = ["n", "s", "ss", "largest"]
    same(by_key(got.where("kept"), [*KEYS, "feature", "is_test"], sums), by_key(want, [*KEYS, "feature", "is_test"], sums))
