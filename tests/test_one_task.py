"""Queries about one task build that task only, with the rows it has among all tasks."""

from pyspark.sql import functions as F

from panelcast.operators import tasks
from panelcast.plans import modelling
from panelcast.plans.panel import Panel
from panelcast.sources import stage
from panelcast.sources.tables import Tables


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_a_task_alone_is_that_task_among_all(spark):
    t, task = Tables(spark, "/root/testdata/sf0.01"), modelling.TREE_CLF_TASK
    stage.forget()
    vectors = modelling.task_vectors(t, task)
    assert not [k for k in stage._BUILT if k[1] == t.version and k[2] in ("features", "folds", "vectors")]
    whole, own, here = Panel(t), Panel(t, task=task), F.col("task_key") == task
    folds = ("entity_id", "seed", "y", "stratum", "fold")
    want = rows_of(whole.all_folds.where(here), *folds)
    assert rows_of(own.all_folds, *folds) == want
    cells = ("task_key", "entity_id", "feature", "value")
    matrix = tasks.task_features(whole.panel, whole.static, whole.grid, whole.target_values).where(here)
    assert rows_of(own.features, *cells) == rows_of(matrix, *cells)
    entities = {r[0] for r in want}
    for fold in range(5):
        got = vectors.where(F.col("fold") == fold)
        assert rows_of(got.where("is_test"), "entity_id") == sorted((r[0],) for r in want if r[1] == modelling.SEED and r[4] == fold)
        assert {r[0] for r in got.select("entity_id").collect()} == entities
