"""Sources, sinks, stores and step reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.operators import cleaning, tasks
from panelcast.plans.cleaning import SQL_MESSY, messy_orders, sql_visit
from panelcast.plans.evaluation import SQL_LEADERBOARD, leaderboard
from panelcast.plans.panel import SQL_PANEL, SQL_PRED, SQL_SCORES, SQL_STATIC, SQL_TASKS, Panel, fold_scores, grid_table
from panelcast.plans.registry import query, rnd
from panelcast.sources.stage import stage_folder
from panelcast.sources.tables import Tables, scan_csv, write_partitioned


def _folder(t: Tables, name: str) -> str:
    return f"{stage_folder(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_SQL_SEG = "CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN NULL WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END"


@query("scan_csv_clean", f"SELECT CAST(c_custkey AS VARCHAR) AS PATNO, {_SQL_SEG} AS SEGMENT, c_name AS NAME FROM customer")
def scan_csv_clean(t: Tables) -> DataFrame:
    """Messy CSV written from the customer table and read back: tokens to null, headers cleaned."""
    seg = F.col("c_mktsegment")
    tokens = F.when(seg == "BUILDING", "NA").when(seg == "FURNITURE", ".").when(seg == "MACHINERY", " ").otherwise(seg)
    raw = t.scan("customer").select(F.col("c_custkey").alias(" patno"), tokens.alias("Segment "), F.col("c_name").alias("name"))
    path = _folder(t, "csv")
    raw.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return scan_csv(t.spark, path)


@query("scan_projected", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def scan_projected(t: Tables) -> DataFrame:
    rows = t.scan("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.select("l_orderkey", "l_quantity")


@query("scan_raw_by_name", "SELECT c_custkey, c_acctbal, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def scan_raw_by_name(t: Tables) -> DataFrame:
    # nation and region hold one row per country and continent at any scale
    n, r = F.broadcast(t.scan("nation")), F.broadcast(t.scan("region"))
    c = t.scan("customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).select("c_custkey", "c_acctbal", "n_name", "r_name")


@query("export_partitioned", f"WITH {SQL_PANEL} SELECT modality, visit, count(*) AS n, round(sum(value), 3) AS value_sum FROM panel GROUP BY ALL")
def export_partitioned(t: Tables) -> DataFrame:
    """One folder per modality and visit; read back by partition."""
    path = _folder(t, "longitudinal")
    write_partitioned(Panel(t).panel, path, ["modality", "visit"])
    back = t.spark.read.parquet(path)
    return back.groupBy("modality", "visit").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 3).alias("value_sum"))


@query("export_static", f"WITH {SQL_PANEL}, {SQL_STATIC} SELECT modality, count(DISTINCT entity_id) AS n, count(DISTINCT measure) AS p FROM static GROUP BY modality")
def export_static(t: Tables) -> DataFrame:
    path = _folder(t, "static")
    write_partitioned(Panel(t).static, path, ["modality"])
    back = t.spark.read.parquet(path)
    return back.groupBy("modality").agg(F.countDistinct("entity_id").alias("n"), F.countDistinct("measure").alias("p"))


@query("output_manifest", f"""WITH {SQL_PANEL}, {SQL_STATIC} SELECT 'longitudinal' AS kind, modality, visit, count(DISTINCT entity_id) AS n, count(DISTINCT measure) AS p FROM panel GROUP BY ALL
UNION ALL SELECT 'static', modality, 'ALL', count(DISTINCT entity_id), count(DISTINCT measure) FROM static GROUP BY modality""")
def output_manifest(t: Tables) -> DataFrame:
    p = Panel(t)
    long = p.panel.select(F.lit("longitudinal").alias("kind"), "modality", "visit", "entity_id", "measure")
    fixed = p.static.select(F.lit("static").alias("kind"), "modality", F.lit("ALL").alias("visit"), "entity_id", "measure")
    agg = long.unionByName(fixed).groupBy("kind", "modality", "visit")
    return agg.agg(F.countDistinct("entity_id").alias("n"), F.countDistinct("measure").alias("p")).orderBy("kind", "modality", "visit")


_STEP_SQL = f"""{SQL_MESSY}, s1 AS (SELECT * FROM messy WHERE regexp_matches({sql_visit('raw_event')}, '{spec.ALLOWED_EVENTS}')),
  s2 AS (SELECT * FROM s1 WHERE event_id <> 'SC' OR entity_id NOT IN (SELECT entity_id FROM s1 WHERE event_id = 'BL'))"""


@query("step_reports", f"""WITH {_STEP_SQL}, c AS (SELECT 'filter_events' AS step, (SELECT count(*) FROM messy) AS rows_before, (SELECT count(*) FROM s1) AS rows_after
  UNION ALL SELECT 'drop_screening', (SELECT count(*) FROM s1), (SELECT count(*) FROM s2))
SELECT step, rows_before, rows_after, round(rows_after / rows_before, 6) AS fraction_kept FROM c""")
def step_reports(t: Tables) -> DataFrame:
    """Row counts before and after each cleaning step, one aggregate per step."""
    raw = messy_orders(t)
    kept = cleaning.filter_events(raw, spec.ALLOWED_EVENTS, "raw_event")
    steps = [("0", raw), ("filter_events", kept), ("drop_screening", cleaning.drop_sc_if_bl(kept, "entity_id", "event_id"))]
    out = None
    for (_, before), (name, after) in zip(steps, steps[1:]):
        b, a = before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("n"))
        row = b.select(F.lit(name).alias("step"), "rows_before", a.scalar().alias("rows_after"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("fraction_kept", rnd(F.col("rows_after") / F.col("rows_before")))


@query("step_report_json", f"WITH {_STEP_SQL} SELECT to_json({{'rows_before': (SELECT count(*) FROM messy), 'rows_after': (SELECT count(*) FROM s1)}}) AS report")
def step_report_json(t: Tables) -> DataFrame:
    raw = messy_orders(t)
    after = F.count_if(F.coalesce(F.col("ok"), F.lit(False)))
    from panelcast.functions.text import canonical_visit

    rows = raw.select(canonical_visit(F.col("raw_event")).rlike(spec.ALLOWED_EVENTS).alias("ok"))
    return rows.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("rows_before"), after.alias("rows_after"))).alias("report"))


@query("metadata_dump", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def metadata_dump(t: Tables) -> DataFrame:
    path = _folder(t, "metadata")
    t.scan("nation").write.parquet(path)
    return t.spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


NAIVE = ["population_mean", "locf"]


def naive_store(t: Tables):
    from panelcast.plans.modelling import store

    return store(t, tuple(NAIVE))


@query("pred_store", f"WITH {SQL_PRED} SELECT task_key, model, seed, fold, count(*) AS n FROM pred GROUP BY ALL")
def pred_store(t: Tables) -> DataFrame:
    """Rows per key of the stored naive predictions; a second call finds no open key and adds nothing."""
    place = naive_store(t)
    return place.predictions(NAIVE).groupBy("task_key", "model", "seed", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("pred_scan", f"WITH {SQL_PRED} SELECT task_key, model, count(*) AS n, round(avg(y - yhat), 3) + 0.0 AS bias FROM pred WHERE yhat IS NOT NULL GROUP BY ALL HAVING count(*) >= 20")
def pred_scan(t: Tables) -> DataFrame:
    rows = naive_store(t).whole(NAIVE).where("yhat is not null")
    agg = rows.groupBy("task_key", "model").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.col("y") - F.col("yhat")), 3).alias("bias"))
    return agg.where("n >= 20")


@query("shard_union", f"WITH {SQL_SCORES} SELECT g.task_key, count(s.task_key) AS n_rows, count(s.task_key) = 0 AS missing FROM grid g LEFT JOIN scores s USING (task_key) GROUP BY g.task_key")
def shard_union(t: Tables) -> DataFrame:
    """Union of the models' shards (missing columns null) against the manifest of expected tasks."""
    s = fold_scores(t)
    a = s.where("model = 'locf'")
    b = s.where("model = 'population_mean'").drop("pearson")
    merged = a.unionByName(b, allowMissingColumns=True).groupBy("task_key").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = grid_table(t.spark).select("task_key").join(merged, "task_key", "left")
    n = F.coalesce("n_rows", F.lit(0))
    return rows.select("task_key", n.alias("n_rows"), (n == 0).alias("missing"))


@query("recover_aggregate", SQL_LEADERBOARD)
def recover_aggregate(t: Tables) -> DataFrame:
    """Aggregates rebuilt from the stored fold table."""
    return leaderboard(t)


@query("task_store", f"WITH {SQL_TASKS} SELECT entity_id, feature, round(value, 4) AS value FROM features WHERE task_key = 'order_total__baseline_only__V08'")
def task_store(t: Tables) -> DataFrame:
    """Task matrices written by task; loading one task reads its folder only."""
    path = _folder(t, "tasks")
    p = Panel(t)
    tasks.task_features(p.panel, p.static, p.grid, p.target_values).write.partitionBy("task_key").parquet(path)
    one = t.spark.read.parquet(path).where("task_key = 'order_total__baseline_only__V08'")
    return one.select("entity_id", "feature", rnd("value", 4).alias("value"))
