"""Analyses, quality checks, hyper-parameter reports and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.functions.pvalues import student_t_two_sided
from panelcast.operators import analyses, resample, tasks
from panelcast.plans.evaluation import SQL_CLS, SQL_MAJ_SCORES, item_scores, majority_scores
from panelcast.plans.inference import _SQL_MODEL, _SQL_REGIME, model_tests, regime_tests
from panelcast.plans.panel import SQL_PANEL, SQL_SCORES, SQL_TASKS, Panel, fold_scores, grid_table, with_task
from panelcast.plans.registry import query, rnd
from panelcast.plans.relational import _SQL_REG, _reg_targets, horizon_changes, split_stability
from panelcast.sources.stage import staged
from panelcast.sources.tables import Tables

LATE = ["V04", "V06", "V08", "V10", "V12"]

# --- survivorship -----------------------------------------------------------------


def survivorship_table(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        p = Panel(t).panel
        bl = p.where("visit = 'BL'").join(F.broadcast(_reg_targets(t)), ["modality", "measure"]).select("entity_id", F.col("target").alias("feature"), "value")
        seen = p.where("modality = 'orders'").select("entity_id", "visit").distinct()
        return analyses.survivorship(bl, seen, LATE)

    return staged(t.spark, t.version, "survivorship", build)


_SQL_SURV = f"""{SQL_PANEL}, {_SQL_REG}, sb AS (SELECT entity_id, target AS feature, value FROM reg JOIN panel USING (modality, measure) WHERE visit = 'BL'),
  seen AS (SELECT DISTINCT entity_id, visit FROM panel WHERE modality = 'orders'),
  sx AS (SELECT v.visit, feature, value, (v.visit, entity_id) IN (SELECT visit, entity_id FROM seen) AS alive FROM sb, (SELECT unnest({LATE!r}) AS visit) v),
  sa AS (SELECT visit, feature, count(*) FILTER (alive) AS ns, count(*) FILTER (NOT alive) AS nd, avg(value) FILTER (alive) AS ms, avg(value) FILTER (NOT alive) AS md,
    var_samp(value) FILTER (alive) AS vs, var_samp(value) FILTER (NOT alive) AS vd FROM sx GROUP BY ALL HAVING ns >= 10 AND nd >= 10),
  surv AS (SELECT *, CASE WHEN sqrt(((ns - 1) * vs + (nd - 1) * vd) / (ns + nd - 2)) > 1e-10 THEN (ms - md) / sqrt(((ns - 1) * vs + (nd - 1) * vd) / (ns + nd - 2)) ELSE 0.0 END AS d,
    (ms - md) / sqrt(vs / ns + vd / nd) AS t_stat, pow(vs / ns + vd / nd, 2) / (vs * vs / (ns * ns * (ns - 1.0)) + vd * vd / (nd * nd * (nd - 1.0))) AS df FROM sa)"""


@query("survivorship_bias", f"WITH {_SQL_SURV} SELECT visit, feature, ns AS n_survivors, nd AS n_dropouts, round(100.0 * ns / (ns + nd), 6) AS pct_retained, round(ms, 3) AS survivors_mean, round(md, 3) AS dropouts_mean, round(d, 6) + 0.0 AS cohens_d, round(t_stat, 6) + 0.0 AS t_stat, round(df, 4) AS df FROM surv")
def survivorship_bias(t: Tables) -> DataFrame:
    s = survivorship_table(t)
    return s.select(
        "visit", "feature", "n_survivors", "n_dropouts", rnd("pct_retained").alias("pct_retained"), rnd("survivors_mean", 3).alias("survivors_mean"),
        rnd("dropouts_mean", 3).alias("dropouts_mean"), rnd("cohens_d").alias("cohens_d"), rnd("t_stat").alias("t_stat"), rnd("df", 4).alias("df"),
    )


@query("pooled_cohens_d", f"WITH {_SQL_SURV} SELECT visit, feature, round(d, 6) + 0.0 AS cohens_d FROM surv")
def pooled_cohens_d(t: Tables) -> DataFrame:
    return survivorship_table(t).select("visit", "feature", rnd("cohens_d").alias("cohens_d"))


@query("welch_t_test")
def welch_t_test(t: Tables) -> DataFrame:
    """Two-sided p-values with FDR over all (visit, feature) tests."""
    s = survivorship_table(t).withColumn("p_value", student_t_two_sided(F.col("t_stat"), F.col("df")))
    s = resample.benjamini_hochberg(s, "p_value", "p_adjusted")
    return s.select("visit", "feature", rnd("t_stat").alias("t_stat"), rnd("df", 4).alias("df"), rnd("p_value").alias("p_value"), rnd("p_adjusted").alias("p_adjusted"), (F.col("p_adjusted") < 0.05).alias("significant_fdr05"))


@query("effect_size_matrix", f"WITH {_SQL_SURV} SELECT feature, " + ", ".join(f"round(max(d) FILTER (visit = '{v}'), 6) + 0.0 AS {v}" for v in LATE[:4]) + " FROM surv GROUP BY feature")
def effect_size_matrix(t: Tables) -> DataFrame:
    return survivorship_table(t).groupBy("feature").pivot("visit", LATE[:4]).agg(rnd(F.max("cohens_d")))


_SQL_ATTR = f"{SQL_PANEL}, {_SQL_REG}, base AS (SELECT DISTINCT entity_id FROM reg JOIN panel USING (modality, measure) WHERE visit = 'BL')"


def attrition_table(t: Tables) -> DataFrame:
    p = Panel(t).panel
    bl = p.where("visit = 'BL'").join(F.broadcast(_reg_targets(t)), ["modality", "measure"], "left_semi")
    return analyses.attrition(bl, p.where("modality = 'orders'").select("entity_id", "visit"))


_SQL_ATTR_SELECT = f"""WITH {_SQL_ATTR} SELECT visit, months, CASE WHEN visit = 'BL' THEN (SELECT count(*) FROM base) ELSE count(DISTINCT entity_id) END AS n_patients,
  round(100.0 * CASE WHEN visit = 'BL' THEN (SELECT count(*) FROM base) ELSE count(DISTINCT entity_id) END / (SELECT count(*) FROM base), 6) AS pct_of_baseline
  FROM calendar LEFT JOIN (SELECT entity_id, visit FROM panel WHERE modality = 'orders') USING (visit) GROUP BY visit, months"""


@query("attrition", _SQL_ATTR_SELECT)
def attrition(t: Tables) -> DataFrame:
    return attrition_table(t).select("visit", "months", "n_patients", rnd("pct_of_baseline").alias("pct_of_baseline"))


@query("survivorship_attrition", _SQL_ATTR_SELECT)
def survivorship_attrition(t: Tables) -> DataFrame:
    return attrition(t)


# --- calibration ------------------------------------------------------------------

_SQL_BINS = f"""{SQL_CLS}, cb AS (SELECT model, y, prob, {" + ".join(f"(prob >= {i} / 10.0::DOUBLE)::INT" for i in range(1, 10))} AS bin FROM cls),
  cg AS (SELECT model, bin, count(*) AS n, avg(y) AS fp, avg(prob) AS mp FROM cb GROUP BY ALL),
  bins AS (SELECT m.model, b.bin, (b.bin * 2 + 1) / 20.0 AS bin_center, coalesce(n, 0) AS n, fp, mp FROM (SELECT DISTINCT model FROM cls) m CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS bin) b
    LEFT JOIN cg ON cg.model = m.model AND cg.bin = b.bin)"""


@query("calibration_curve", f"WITH {_SQL_BINS} SELECT model, bin, bin_center, n, round(fp, 6) AS fraction_positive, round(mp, 6) AS mean_predicted FROM bins")
def calibration_curve(t: Tables) -> DataFrame:
    b = analyses.calibration_bins(item_scores(t), ["model"])
    return b.select("model", "bin", "bin_center", "n", rnd("fraction_positive").alias("fraction_positive"), rnd("mean_predicted").alias("mean_predicted"))


@query("calibration_errors", f"WITH {_SQL_BINS} SELECT model, round(sum(n * abs(fp - mp)) / sum(n), 6) AS ece, round(max(abs(fp - mp)), 6) AS mce, CAST(sum(n) AS BIGINT) AS n_total FROM bins GROUP BY model")
def calibration_errors(t: Tables) -> DataFrame:
    e = analyses.calibration_errors(analyses.calibration_bins(item_scores(t), ["model"]), ["model"])
    return e.select("model", rnd("ece").alias("ece"), rnd("mce").alias("mce"), "n_total")


@query("calibration_by_horizon", f"WITH {_SQL_BINS} SELECT CASE WHEN model <= 3 THEN 'early' ELSE 'late' END AS horizon, bin, round(avg(fp), 6) AS fraction_positive, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY ALL")
def calibration_by_horizon(t: Tables) -> DataFrame:
    """Bin-aligned average over the forecasts of a horizon group."""
    b = analyses.calibration_bins(item_scores(t), ["model"])
    group = F.when(F.col("model") <= 3, "early").otherwise("late")
    return b.groupBy(group.alias("horizon"), "bin").agg(rnd(F.avg("fraction_positive")).alias("fraction_positive"), F.sum("n").alias("n"))


# --- quality checks ---------------------------------------------------------------


def frontier(t: Tables) -> DataFrame:
    """Task-model means of the stored fold scores: one row per (task, model)."""
    return with_task(
        fold_scores(t).groupBy("task_key", "model").agg(
            F.avg("r2").alias("r2"), F.avg("spearman").alias("spearman"), F.avg("rmse").alias("rmse"), F.avg("n_test").alias("n_test_mean"),
            F.percentile("r2", F.lit(0.025)).alias("r2_ci_lo"), F.percentile("r2", F.lit(0.975)).alias("r2_ci_hi"), F.max("n_test").alias("n_test_max"),
        ),
        t,
    )


_SQL_FRONTIER = f"""{SQL_SCORES}, frontier AS (SELECT task_key, model, target, domain, task_type, horizon, horizon_months, regime, avg(r2) AS r2, avg(spearman) AS spearman, avg(rmse) AS rmse,
  avg(n_test) AS n_test_mean, quantile_cont(r2, 0.025) AS r2_ci_lo, quantile_cont(r2, 0.975) AS r2_ci_hi, max(n_test) AS n_test_max FROM scores JOIN grid USING (task_key) GROUP BY ALL)"""


def locf_scale(t: Tables) -> DataFrame:
    bad = F.count_if(F.col("r2") < -2.0)
    return frontier(t).where("model = 'locf'").agg(
        F.when(bad > 0, "FAIL").otherwise("PASS").alias("status"), F.count(F.lit(1)).alias("n_tasks"), bad.alias("n_failures"), rnd(F.avg("r2")).alias("mean_r2")
    )


_Q_LOCF = "SELECT CASE WHEN count(*) FILTER (r2 < -2.0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n_tasks, count(*) FILTER (r2 < -2.0) AS n_failures, round(avg(r2), 6) AS mean_r2 FROM frontier WHERE model = 'locf'"


@query("qc_locf_scale", f"WITH {_SQL_FRONTIER} {_Q_LOCF}")
def qc_locf_scale(t: Tables) -> DataFrame:
    return locf_scale(t)


_Q_SIZES = "SELECT CASE WHEN count(DISTINCT task_key) FILTER (n_test_mean < 50) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(DISTINCT task_key) FILTER (n_test_mean < 50) AS n_small_tasks FROM frontier"


@query("qc_sample_sizes", f"WITH {_SQL_FRONTIER} {_Q_SIZES}")
def qc_sample_sizes(t: Tables) -> DataFrame:
    small = F.countDistinct(F.when(F.col("n_test_mean") < spec.MIN_N_WARNING, F.col("task_key")))
    return frontier(t).agg(F.when(small > 0, "WARN").otherwise("PASS").alias("status"), small.alias("n_small_tasks"))


_SQL_STEPS = f"""{_SQL_FRONTIER}, steps AS (SELECT target, regime, model, lag(horizon_months) OVER w AS from_months, horizon_months AS to_months, r2 - lag(r2) OVER w AS r2_change FROM frontier
  WINDOW w AS (PARTITION BY target, regime, model ORDER BY horizon_months)), rising AS (SELECT * FROM steps WHERE r2_change > 0.05)"""


@query("qc_nonmonotonic", f"WITH {_SQL_STEPS} SELECT CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n_nonmonotonic, round(max(r2_change), 6) AS max_increase FROM rising")
def qc_nonmonotonic(t: Tables) -> DataFrame:
    rising = horizon_changes(fold_scores(t), t).where("flagged")
    return rising.agg(
        F.when(F.count(F.lit(1)) > 0, "WARN").otherwise("PASS").alias("status"), F.count(F.lit(1)).alias("n_nonmonotonic"), rnd(F.max("r2_change")).alias("max_increase")
    )


@query("qc_output_completeness", f"WITH {SQL_TASKS}, want AS (SELECT DISTINCT task_key FROM grid WHERE task_type = 'regression'), got AS (SELECT DISTINCT task_key FROM tt WHERE task_type = 'regression') SELECT CASE WHEN count(*) FILTER (got.task_key IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(got.task_key) AS n_task_predictions, count(*) FILTER (got.task_key IS NULL) AS n_missing FROM want LEFT JOIN got USING (task_key)")
def qc_output_completeness(t: Tables) -> DataFrame:
    want = grid_table(t.spark).where("task_type = 'regression'").select("task_key")
    got = Panel(t).naive_predictions.select("task_key").distinct().withColumn("ok", F.lit(1))
    rows = want.join(got, "task_key", "left")
    missing = F.count_if(F.col("ok").isNull())
    return rows.agg(F.when(missing > 0, "FAIL").otherwise("PASS").alias("status"), F.count("ok").alias("n_task_predictions"), missing.alias("n_missing"))


@query("qc_primary_metric", f"WITH {_SQL_FRONTIER} SELECT CASE WHEN count(*) FILTER (r2 IS NULL) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (r2 IS NULL) AS n_r2_null, round(avg(r2), 6) AS mean_r2 FROM frontier")
def qc_primary_metric(t: Tables) -> DataFrame:
    nulls = F.count_if(F.col("r2").isNull())
    return frontier(t).agg(F.when(nulls > 0, "WARN").otherwise("PASS").alias("status"), nulls.alias("n_r2_null"), rnd(F.avg("r2")).alias("mean_r2"))


def manifest_table(t: Tables) -> DataFrame:
    p = Panel(t)
    return staged(t.spark, t.version, "manifest", lambda: tasks.manifest(p.targets, p.grid, p.names.where("visit is not null"), p.names.where("visit is null")))


_SQL_MANIFEST = f"""{SQL_TASKS}, sz AS (SELECT task_key, count(*) AS n_total, avg(y) AS my FROM tt GROUP BY 1),
  own AS (SELECT DISTINCT modality, visit, measure FROM panel), own_s AS (SELECT DISTINCT modality, measure FROM static),
  wd AS (SELECT task_key, count(*) AS n_features FROM (SELECT v.task_key FROM task_visits v JOIN own o ON o.visit = v.visit AND (v.multimodal OR o.modality = v.target_modality)
    UNION ALL SELECT g.task_key FROM grid g, own_s WHERE g.multimodal) GROUP BY 1),
  manifest AS (SELECT g.task_key, g.target, g.domain, g.target_measure AS target_column, g.task_type, g.primary_metric, g.horizon, g.horizon_months, g.regime, n_total, n_features,
    CASE WHEN g.task_type = 'classification' THEN my END AS prevalence FROM grid g JOIN sz USING (task_key) JOIN wd USING (task_key))"""


@query("manifest_and_cohort_summary", f"WITH {_SQL_MANIFEST} SELECT * REPLACE (round(prevalence, 6) AS prevalence) FROM manifest")
def manifest_and_cohort_summary(t: Tables) -> DataFrame:
    return manifest_table(t).withColumn("prevalence", rnd("prevalence"))


@query("cohort_summary", f"WITH {_SQL_MANIFEST} SELECT task_type, count(*) AS n_tasks, CAST(sum(n_total) AS BIGINT) AS n_rows, (SELECT count(*) FROM cohort) AS n_patients FROM manifest GROUP BY task_type")
def cohort_summary(t: Tables) -> DataFrame:
    n = Panel(t).cohort.agg(F.count(F.lit(1)).alias("n"))
    agg = manifest_table(t).groupBy("task_type").agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("n_total").alias("n_rows"))
    return agg.withColumn("n_patients", n.scalar())


@query("qc_dimensionality", f"""WITH {_SQL_MANIFEST}, a AS (SELECT *, CAST(ceil(n_total * 0.8::DOUBLE) AS BIGINT) AS n_train_cv FROM manifest), b AS (SELECT *, CAST(ceil(n_train_cv * (2 / 3::DOUBLE)) AS BIGINT) AS n_train_inner FROM a)
SELECT task_key, n_total, n_features, n_train_cv, n_train_inner, round(n_features / n_train_cv, 6) AS p_over_n_train, round(n_features / n_train_inner, 6) AS p_over_n_inner,
  round(n_features / n_total, 6) AS p_over_n_total, n_features > n_train_cv AS flag_train, n_features > n_total AS flag_total FROM b""")
def qc_dimensionality(t: Tables) -> DataFrame:
    d = analyses.dimensionality(manifest_table(t))
    return d.select("task_key", "n_total", "n_features", "n_train_cv", "n_train_inner", *[rnd(c).alias(c) for c in ("p_over_n_train", "p_over_n_inner", "p_over_n_total")], "flag_train", "flag_total")


@query("qc_overall", f"""WITH {_SQL_STEPS}, st AS (SELECT status FROM ({_Q_LOCF}) UNION ALL SELECT status FROM ({_Q_SIZES}) UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END FROM rising
  UNION ALL SELECT CASE WHEN count(*) FILTER (r2 IS NULL) > 0 THEN 'WARN' ELSE 'PASS' END FROM frontier UNION ALL SELECT CASE WHEN count(DISTINCT task_key) < (SELECT count(*) FROM grid WHERE task_type = 'regression') THEN 'FAIL' ELSE 'PASS' END FROM frontier)
SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM st""")
def qc_overall(t: Tables) -> DataFrame:
    checks = [qc_locf_scale, qc_sample_sizes, qc_nonmonotonic, qc_output_completeness, qc_primary_metric]
    rows = None
    for check in checks:
        one = check(t).select("status")
        rows = one if rows is None else rows.unionByName(one)
    return analyses.overall_status(rows)


# --- sensitivity, correlation, hyper-parameters -----------------------------------


@query("sensitivity_splits")
def sensitivity_splits(t: Tables) -> DataFrame:
    """Split stability of the representative three-year tasks under all seven regression models; without SQL, as five of them are fitted."""
    from panelcast.plans.modelling import split_scores

    names = Panel(t).grid.where("task_type = 'regression' and horizon = 'V08'").select("task_key").orderBy("task_key").collect()
    return split_stability(split_scores(t, [r.task_key for r in names]))


@query("target_correlation", f"""WITH {SQL_PANEL}, {_SQL_REG}, v AS (SELECT entity_id, target, value FROM reg JOIN panel USING (modality, measure) WHERE visit = 'BL'),
  p AS (SELECT a.target AS target_a, b.target AS target_b, a.value AS va, b.value AS vb FROM v a JOIN v b ON a.entity_id = b.entity_id AND a.target < b.target),
  r AS (SELECT *, rank() OVER (PARTITION BY target_a, target_b ORDER BY va) + (count(*) OVER (PARTITION BY target_a, target_b, va) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY target_a, target_b ORDER BY vb) + (count(*) OVER (PARTITION BY target_a, target_b, vb) - 1) / 2.0 AS rb FROM p)
SELECT target_a, target_b, count(*) AS n, round(covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)), 6) + 0.0 AS spearman FROM r GROUP BY ALL""")
def target_correlation(t: Tables) -> DataFrame:
    v = Panel(t).panel.where("visit = 'BL'").join(F.broadcast(_reg_targets(t)), ["modality", "measure"])
    return analyses.target_correlations(v).select("target_a", "target_b", "n", rnd("spearman").alias("spearman"))


def tuned_rows(t: Tables) -> DataFrame:
    """Line items dressed as tuned fits: model, regime, chosen parameters as JSON text, primary metric."""
    params = F.to_json(F.struct(
        F.col("l_discount").cast("string").alias("learning_rate"), F.col("l_linenumber").cast("string").alias("max_depth"), F.lit("-1").alias("n_jobs")
    ))
    return t.scan("lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("regime"), params.alias("best_params"), F.col("l_tax").alias("metric"))


def clean_params(rows: DataFrame) -> DataFrame:
    """Drop fixed keys and bring the rest into one canonical text."""
    parsed = F.from_json("best_params", "map<string,string>")
    kept = F.map_filter(parsed, lambda k, v: ~k.isin(spec.FIXED_PARAM_KEYS))
    entries = F.array_sort(F.map_entries(kept))
    return rows.withColumn("config", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ", "))


_SQL_HP = """hp AS (SELECT l_returnflag AS model, l_linestatus AS regime, 'learning_rate=' || CAST(l_discount AS VARCHAR) || ', max_depth=' || CAST(l_linenumber AS VARCHAR) AS config,
  l_discount AS lr, l_linenumber AS depth, l_tax AS metric FROM lineitem),
cf AS (SELECT model, config, count(*) AS n, avg(metric) AS m, stddev_samp(metric) AS s, min(lr) AS lr, min(depth) AS depth FROM hp GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, config) AS rnk, sum(n) OVER (PARTITION BY model) AS total, count(*) OVER (PARTITION BY model) AS n_distinct FROM cf)"""


def config_ranks(rows: DataFrame) -> DataFrame:
    """Distinct configurations per model by frequency: a grid-sized table after the aggregate."""
    agg = rows.groupBy("model", "config").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean_metric"), F.stddev_samp("metric").alias("std_metric")
    )
    w = Window.partitionBy("model")
    return agg.withColumn("rnk", F.row_number().over(w.orderBy(F.desc("n"), "config"))).withColumn("total", F.sum("n").over(w)).withColumn("n_distinct", F.count(F.lit(1)).over(w))


@query("hp_frequency", f"""WITH {_SQL_HP} SELECT model, CAST(rnk AS INT) AS rnk, config, n, round(100.0 * n / total, 4) AS freq_pct, round(m, 6) AS mean_metric, round(s, 6) AS std_metric, n_distinct,
  CASE WHEN 100.0 * max(n) OVER (PARTITION BY model) / total > 50 THEN 'STABLE' WHEN 100.0 * max(n) OVER (PARTITION BY model) / total > 25 THEN 'MODERATE' ELSE 'UNSTABLE' END AS stability FROM rk QUALIFY rnk <= 5""")
def hp_frequency(t: Tables) -> DataFrame:
    r = config_ranks(clean_params(tuned_rows(t)))
    top = 100.0 * F.max("n").over(Window.partitionBy("model")) / F.col("total")
    label = F.when(top > 50, "STABLE").when(top > 25, "MODERATE").otherwise("UNSTABLE")
    return r.withColumn("stability", label).where("rnk <= 5").select(
        "model", "rnk", "config", "n", rnd(100.0 * F.col("n") / F.col("total"), 4).alias("freq_pct"), rnd("mean_metric").alias("mean_metric"),
        rnd("std_metric").alias("std_metric"), "n_distinct", "stability",
    )


_EDGES = {k: (min(v), max(v)) for k, v in spec.GRIDS["boosted_trees"].items() if k in ("learning_rate", "max_depth")}


@query("hp_grid_edge", f"""WITH {_SQL_HP}, b(param, lo, hi) AS (VALUES {", ".join(f"('{k}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for k, (lo, hi) in _EDGES.items())}),
  v AS (SELECT model, 'learning_rate' AS param, CAST(lr AS DOUBLE) AS value FROM rk WHERE rnk = 1 UNION ALL SELECT model, 'max_depth', depth FROM rk WHERE rnk = 1)
SELECT model, param, value, CASE WHEN value <= lo THEN 'LOW' WHEN value >= hi THEN 'HIGH' ELSE 'INTERIOR' END AS edge FROM v JOIN b USING (param)""")
def hp_grid_edge(t: Tables) -> DataFrame:
    """Whether the modal values lie at or beyond an edge of the searched grid."""
    best = config_ranks(clean_params(tuned_rows(t))).where("rnk = 1")
    parts = best.withColumn("part", F.explode(F.split("config", ", ")))
    parts = parts.select("model", F.split("part", "=")[0].alias("param"), F.split("part", "=")[1].cast("double").alias("value"))
    grid = t.spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in _EDGES.items()], "param string, lo double, hi double")
    edge = F.when(F.col("value") <= F.col("lo"), "LOW").when(F.col("value") >= F.col("hi"), "HIGH").otherwise("INTERIOR")
    return parts.join(F.broadcast(grid), "param").select("model", "param", "value", edge.alias("edge"))  # one row per parameter


@query("hp_by_regime", f"WITH {_SQL_HP} SELECT hp.model, regime, count(*) FILTER (hp.config = rk.config) AS n_top, count(*) AS n, round(100.0 * count(*) FILTER (hp.config = rk.config) / count(*), 4) AS pct FROM hp JOIN rk ON rk.model = hp.model AND rk.rnk = 1 GROUP BY ALL")
def hp_by_regime(t: Tables) -> DataFrame:
    rows = clean_params(tuned_rows(t))
    # One row per model: as small as the model list.
    top = F.broadcast(config_ranks(rows).where("rnk = 1").select("model", F.col("config").alias("top")))
    hit = F.count_if(F.col("config") == F.col("top"))
    return rows.join(top, "model").groupBy("model", "regime").agg(hit.alias("n_top"), F.count(F.lit(1)).alias("n"), rnd(100.0 * hit / F.count(F.lit(1)), 4).alias("pct"))


@query("hp_modal_config", f"WITH {_SQL_HP} SELECT model, config FROM rk WHERE rnk = 1")
def hp_modal_config(t: Tables) -> DataFrame:
    return config_ranks(clean_params(tuned_rows(t))).where("rnk = 1").select("model", "config")


@query("hyperparameter_report", f"WITH {_SQL_HP} SELECT model, n_distinct, CAST(total AS BIGINT) AS n_fits, config AS top_config, round(100.0 * n / total, 4) AS top_pct FROM rk WHERE rnk = 1")
def hyperparameter_report(t: Tables) -> DataFrame:
    r = config_ranks(clean_params(tuned_rows(t))).where("rnk = 1")
    return r.select("model", "n_distinct", F.col("total").alias("n_fits"), F.col("config").alias("top_config"), rnd(100.0 * F.col("n") / F.col("total"), 4).alias("top_pct"))


# --- tables behind the figures ----------------------------------------------------

MONTHS = [spec.VISIT_MONTHS[h] for h in spec.HORIZONS]


@query("frontier_matrix", f"WITH {_SQL_FRONTIER}, f AS (SELECT * FROM frontier WHERE model = 'locf' AND regime = 'rolling') SELECT target, " + ", ".join(
    f"round(max(r2) FILTER (horizon_months = {m}), 6) + 0.0 AS m{m}" for m in MONTHS) + ", CAST(rank() OVER (ORDER BY avg(r2) DESC) AS INT) AS position FROM f GROUP BY target")
def frontier_matrix(t: Tables) -> DataFrame:
    f = frontier(t).where("model = 'locf' and regime = 'rolling'")
    cells = [rnd(F.max(F.when(F.col("horizon_months") == m, F.col("r2")))).alias(f"m{m}") for m in MONTHS]
    wide = f.groupBy("target").agg(*cells, F.avg("r2").alias("_m"))
    return wide.withColumn("position", F.rank().over(Window.orderBy(F.desc("_m")))).drop("_m")  # one row per target


@query("model_comparison_table", f"WITH {_SQL_FRONTIER} SELECT target, round(max(r2) FILTER (model = 'locf'), 6) + 0.0 AS locf, round(max(r2) FILTER (model = 'population_mean'), 6) + 0.0 AS population_mean, round(max(r2), 6) + 0.0 AS best FROM frontier WHERE regime = 'rolling' AND horizon = 'V08' GROUP BY target")
def model_comparison_table(t: Tables) -> DataFrame:
    f = frontier(t).where("regime = 'rolling' and horizon = 'V08'")
    pick = {m: F.max(F.when(F.col("model") == m, F.col("r2"))) for m in ("locf", "population_mean")}
    return f.groupBy("target").agg(*[rnd(c).alias(m) for m, c in pick.items()], rnd(F.max("r2")).alias("best"))


@query("regime_comparison_table", f"""WITH {_SQL_REGIME}, fr AS (SELECT target, horizon, regime, avg(s.r2) AS r2, quantile_cont(s.r2, 0.025) AS lo, quantile_cont(s.r2, 0.975) AS hi FROM scores s JOIN grid USING (task_key) WHERE model = 'locf' GROUP BY ALL)
SELECT f.target, f.horizon, f.regime, round(f.r2, 6) + 0.0 AS r2, round(lo, 6) + 0.0 AS ci_lo, round(hi, 6) + 0.0 AS ci_hi, round(t.p_adjusted, 6) AS p_adjusted
FROM fr f LEFT JOIN rtb t ON t.target = f.target AND t.horizon = f.horizon AND t.regime_a = f.regime AND t.regime_b = 'baseline_only'""")
def regime_comparison_table(t: Tables) -> DataFrame:
    f = frontier(t).where("model = 'locf'")
    tests = regime_tests(t).where("regime_b = 'baseline_only'").select("target", "horizon", F.col("regime_a").alias("regime"), "p_adjusted")
    rows = f.join(tests, ["target", "horizon", "regime"], "left")
    return rows.select("target", "horizon", "regime", rnd("r2").alias("r2"), rnd("r2_ci_lo").alias("ci_lo"), rnd("r2_ci_hi").alias("ci_hi"), rnd("p_adjusted").alias("p_adjusted"))


@query("ablation_matrix", f"""WITH {_SQL_MODEL}, m AS (SELECT target, avg(r2) FILTER (model = 'locf') AS f, avg(r2) FILTER (model = 'population_mean') AS a FROM scores JOIN grid USING (task_key) GROUP BY 1),
  p AS (SELECT target, min(p_adjusted) AS p FROM mtb JOIN grid USING (task_key) WHERE metric = 'r2' GROUP BY 1)
SELECT target, round(f - a, 6) + 0.0 AS delta, round((f - a) / greatest(1 - f, 1e-6), 6) + 0.0 AS cohen_f2, round(p, 6) AS min_p_adjusted, p < 0.05 AND abs((f - a) / greatest(1 - f, 1e-6)) >= 0.02 AS bold FROM m JOIN p USING (target)""")
def ablation_matrix(t: Tables) -> DataFrame:
    f, a = (F.avg(F.when(F.col("model") == m, F.col("r2"))) for m in ("locf", "population_mean"))
    m = with_task(fold_scores(t), t).groupBy("target").agg(f.alias("f"), a.alias("a"))
    p = with_task(model_tests(t).where("metric = 'r2'").select("task_key", "p_adjusted"), t).groupBy("target").agg(F.min("p_adjusted").alias("p"))
    f2 = (F.col("f") - F.col("a")) / F.greatest(1 - F.col("f"), F.lit(1e-6))
    return m.join(p, "target").select(
        "target", rnd(F.col("f") - F.col("a")).alias("delta"), rnd(f2).alias("cohen_f2"), rnd("p").alias("min_p_adjusted"), ((F.col("p") < 0.05) & (F.abs(f2) >= 0.02)).alias("bold")
    )


@query("classification_panel", f"WITH {SQL_MAJ_SCORES} SELECT target, " + ", ".join(
    f"round(avg({m}), 6) + 0.0 AS {m}, round(quantile_cont({m}, 0.025), 6) + 0.0 AS {m}_lo, round(quantile_cont({m}, 0.975), 6) + 0.0 AS {m}_hi" for m in ("auroc", "auprc", "mcc", "prevalence")) + " FROM ms JOIN grid USING (task_key) GROUP BY target")
def classification_panel(t: Tables) -> DataFrame:
    cols = []
    for m in ("auroc", "auprc", "mcc", "prevalence"):
        cols += [rnd(F.avg(m)).alias(m), rnd(F.percentile(m, F.lit(0.025))).alias(f"{m}_lo"), rnd(F.percentile(m, F.lit(0.975))).alias(f"{m}_hi")]
    return with_task(majority_scores(t), t).groupBy("target").agg(*cols)


@query("sample_size_table", f"WITH {_SQL_FRONTIER} SELECT target, " + ", ".join(f"coalesce(max(n_test_max) FILTER (horizon = '{h}'), 0) AS {h}" for h in spec.HORIZONS) + " FROM frontier GROUP BY target")
def sample_size_table(t: Tables) -> DataFrame:
    cells = [F.coalesce(F.max(F.when(F.col("horizon") == h, F.col("n_test_max"))), F.lit(0)).alias(h) for h in spec.HORIZONS]
    return frontier(t).groupBy("target").agg(*cells)


@query("horizon_diagnosis", f"WITH {_SQL_FRONTIER} SELECT target, regime, model, horizon_months, round(r2, 6) + 0.0 AS r2, round(r2_ci_lo, 6) + 0.0 AS ci_lo, round(r2_ci_hi, 6) + 0.0 AS ci_hi, round(n_test_mean, 6) AS n_test FROM frontier WHERE target = 'order_total'")
def horizon_diagnosis(t: Tables) -> DataFrame:
    f = frontier(t).where("target = 'order_total'").orderBy("regime", "model", "horizon_months")
    return f.select("target", "regime", "model", "horizon_months", rnd("r2").alias("r2"), rnd("r2_ci_lo").alias("ci_lo"), rnd("r2_ci_hi").alias("ci_hi"), rnd("n_test_mean").alias("n_test"))


@query("model_ranking", f"WITH {_SQL_FRONTIER} SELECT model, round(avg(r2), 6) + 0.0 AS mean_r2, round(stddev_samp(r2), 6) AS std_r2, count(*) AS n_tasks FROM frontier GROUP BY model")
def model_ranking(t: Tables) -> DataFrame:
    return frontier(t).groupBy("model").agg(rnd(F.avg("r2")).alias("mean_r2"), rnd(F.stddev_samp("r2")).alias("std_r2"), F.count(F.lit(1)).alias("n_tasks"))


@query("anchor_gap_scatter", f"""WITH {_SQL_FRONTIER} SELECT task_key, domain, round(max(r2) FILTER (model = 'locf') - max(r2) FILTER (model = 'population_mean'), 6) + 0.0 AS r2_gap,
  round(max(spearman) FILTER (model = 'locf') - max(spearman) FILTER (model = 'population_mean'), 6) + 0.0 AS spearman_gap FROM frontier GROUP BY ALL HAVING r2_gap IS NOT NULL AND spearman_gap IS NOT NULL""")
def anchor_gap_scatter(t: Tables) -> DataFrame:
    def gap(m: str):
        return F.max(F.when(F.col("model") == "locf", F.col(m))) - F.max(F.when(F.col("model") == "population_mean", F.col(m)))

    rows = frontier(t).groupBy("task_key", "domain").agg(rnd(gap("r2")).alias("r2_gap"), rnd(gap("spearman")).alias("spearman_gap"))
    return rows.where("r2_gap is not null and spearman_gap is not null")


@query("frontier_points", f"WITH {_SQL_FRONTIER} SELECT target, domain, regime, model, horizon_months, round(r2, 6) + 0.0 AS r2, round(r2_ci_lo, 6) + 0.0 AS ci_lo, round(r2_ci_hi, 6) + 0.0 AS ci_hi, greatest(30.0, least(200.0, round(n_test_mean, 6))) AS marker FROM frontier")
def frontier_points(t: Tables) -> DataFrame:
    marker = F.greatest(F.lit(30.0), F.least(F.lit(200.0), rnd("n_test_mean")))
    return frontier(t).select("target", "domain", "regime", "model", "horizon_months", rnd("r2").alias("r2"), rnd("r2_ci_lo").alias("ci_lo"), rnd("r2_ci_hi").alias("ci_hi"), marker.alias("marker"))
