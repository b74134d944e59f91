import os

from panelcast import spec
from panelcast.plans.panel import grid_table
from panelcast.sources.stage import release, write_stage


def test_grid_is_one_partition_of_broadcast_loops(spark):
    grid = spec.task_grid(spark)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and grid.rdd.getNumPartitions() == 1
    months = [spec.VISIT_MONTHS[h] for h in spec.HORIZONS]
    last = [max((spec.VISIT_MONTHS[v] for v in r.visits or []), default=0) for r in spec.REGIMES]
    assert grid.count() == len(spec.ORDER_TARGETS) * sum(m > h for m in months for h in last)


def test_stored_grid_is_read_from_one_file(spark):
    stored = grid_table(spark)
    assert stored.rdd.getNumPartitions() == 1
    assert sorted(map(str, stored.collect())) == sorted(map(str, spec.task_grid(spark).collect()))


def test_released_stages_are_gone_and_inputs_stay(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/input")
    source = spark.read.parquet(f"{tmp_path}/input")
    done, needed = write_stage(source, "done"), write_stage(source, "needed")
    folder = done.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    release(spark, done, source)
    assert not os.path.exists(folder) and needed.count() == source.count() == 10
