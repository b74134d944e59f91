"""Hypothesis tests and resampling intervals over fold scores and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.functions.pvalues import normal_upper, signed_rank_upper
from panelcast.operators import asks, metrics, resample
from panelcast.operators import folds as fold_ops
from panelcast.operators.metrics import ratio
from panelcast.operators.order_stats import average_ranks
from panelcast.plans.evaluation import SQL_CLS, SQL_MAJ_SCORES, item_scores, majority_scores, sql_ranking
from panelcast.plans.panel import SQL_PRED, SQL_SCORES, Panel, fold_scores, with_task
from panelcast.plans.registry import query, rnd
from panelcast.plans.relational import paired_folds
from panelcast.sources.stage import staged
from panelcast.sources.tables import Tables

TEST_COLS = ["observed_diff", "p_value", "cohens_d", "ci_lo", "ci_hi"]


def sql_paired(src: str, keys: str, out: str, n_perm: int = spec.N_PERMUTATIONS, n_boot: int = spec.N_BOOTSTRAP) -> str:
    """Sign-flip test and bootstrap interval of ``src(keys, seed, fold, d)`` as CTE ``out``."""
    return f"""{out}_i AS (SELECT {keys}, d, row_number() OVER (PARTITION BY {keys} ORDER BY seed, fold) AS i, count(*) OVER (PARTITION BY {keys}) AS n
  FROM {src} WHERE d IS NOT NULL QUALIFY count(*) OVER (PARTITION BY {keys}) >= 3),
{out}_o AS (SELECT {keys}, avg(d) AS observed_diff, CASE WHEN count(*) < 2 OR stddev_pop(d) < 1e-10 THEN 0.0 ELSE avg(d) / stddev_samp(d) END AS cohens_d, max(n) AS n_folds FROM {out}_i GROUP BY ALL),
{out}_s AS (SELECT perm, i, CASE WHEN substr(md5(concat('{spec.TEST_SEED}|', perm, '|', i)), 1, 1) < '8' THEN -1.0 ELSE 1.0 END AS s
  FROM (SELECT unnest(range(1, {n_perm + 1})) AS perm), (SELECT unnest(range(1, 26)) AS i)),
{out}_f AS (SELECT {keys}, perm, sum(d * s) / max(n) AS m FROM {out}_i JOIN {out}_s USING (i) GROUP BY ALL),
{out}_p AS (SELECT {keys}, (count(*) FILTER (abs(m) >= abs(observed_diff) - 1e-12) + 1) / {n_perm + 1}.0 AS p_value FROM {out}_f JOIN {out}_o USING ({keys}) GROUP BY ALL),
{out}_d AS (SELECT boot, n, CAST('0x' || substr(md5(concat('{spec.TEST_SEED}|', boot, '|', j)), 1, 8) AS BIGINT) % n + 1 AS i
  FROM (SELECT unnest(range(1, {n_boot + 1})) AS boot), (SELECT unnest(range(1, 26)) AS j), (SELECT DISTINCT n FROM {out}_i) WHERE j <= n),
{out}_b AS (SELECT {keys}, boot, sum(d) / max(n) AS m FROM {out}_i JOIN {out}_d USING (n, i) GROUP BY ALL),
{out}_c AS (SELECT {keys}, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM {out}_b GROUP BY ALL),
{out} AS (SELECT * FROM {out}_o JOIN {out}_p USING ({keys}) JOIN {out}_c USING ({keys}))"""


def sql_bh(src: str, p: str, out_col: str) -> str:
    """``src`` with the step-up adjusted p-value added."""
    return f"""(SELECT * EXCLUDE (raw_), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(raw_) OVER (PARTITION BY {p} IS NULL ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {out_col}
  FROM (SELECT *, {p} * count(*) OVER (PARTITION BY {p} IS NULL) / row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}) AS raw_ FROM {src}))"""


def _rounded(cols) -> list:
    return [rnd(c).alias(c) for c in cols]


def _sql_rounded(cols) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def long_pairs(t: Tables, pairs=(("locf", "population_mean"),)) -> DataFrame:
    """(task_key, model_a, model_b, metric, seed, fold, d) for ordered model pairs that were scored."""
    out = None
    for a, b in pairs:
        rows = paired_folds(fold_scores(t), a, b).select(
            "task_key", F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "seed", "fold",
            F.inline(F.array(*[
                F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_a") - F.col(f"{m}_b")).alias("d")) for m in ("r2", "spearman")
            ])),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def model_tests(t: Tables) -> DataFrame:
    """One row per (task, pair, metric), kept as a stage table: several reports read it."""
    keys = ["task_key", "model_a", "model_b", "metric"]

    def build() -> DataFrame:
        tests = resample.paired_tests(long_pairs(t), keys, ["seed", "fold"])
        return resample.benjamini_hochberg(tests, "p_value", "p_adjusted", ["metric"])

    return staged(t.spark, t.version, "model_tests", build)


_SQL_MODEL = f"""{SQL_SCORES}, mp AS (SELECT a.task_key, 'locf' AS model_a, 'population_mean' AS model_b, m.metric, a.seed, a.fold,
    CASE m.metric WHEN 'r2' THEN a.r2 - b.r2 ELSE a.spearman - b.spearman END AS d
  FROM scores a JOIN scores b USING (task_key, seed, fold), (SELECT unnest(['r2', 'spearman']) AS metric) m WHERE a.model = 'locf' AND b.model = 'population_mean'),
  {sql_paired('mp', 'task_key, model_a, model_b, metric', 'mt')},
  mtb AS (SELECT * FROM {sql_bh("(SELECT * FROM mt WHERE metric = 'r2')", "p_value", "p_adjusted")} UNION ALL BY NAME SELECT * FROM {sql_bh("(SELECT * FROM mt WHERE metric = 'spearman')", "p_value", "p_adjusted")})"""


@query("model_comparison_tests", f"WITH {_SQL_MODEL} SELECT task_key, model_a, model_b, metric, {_sql_rounded([*TEST_COLS, 'p_adjusted'])}, n_folds, p_adjusted < 0.05 AS significant FROM mtb")
def model_comparison_tests(t: Tables) -> DataFrame:
    m = model_tests(t)
    return m.select(
        "task_key", "model_a", "model_b", "metric", *_rounded([*TEST_COLS, "p_adjusted"]), "n_folds",
        (F.col("p_adjusted") < spec.ALPHA).alias("significant"),
    )


@query("paired_permutation_folds", f"WITH {_SQL_MODEL} SELECT task_key, metric, {_sql_rounded(['observed_diff', 'p_value'])} FROM mt")
def paired_permutation_folds(t: Tables) -> DataFrame:
    return model_tests(t).select("task_key", "metric", *_rounded(["observed_diff", "p_value"]))


@query("bootstrap_mean_ci", f"WITH {_SQL_MODEL} SELECT task_key, metric, {_sql_rounded(['ci_lo', 'ci_hi'])} FROM mt")
def bootstrap_mean_ci(t: Tables) -> DataFrame:
    return model_tests(t).select("task_key", "metric", *_rounded(["ci_lo", "ci_hi"]))


@query("paired_cohens_d", f"WITH {_SQL_MODEL} SELECT task_key, metric, {_sql_rounded(['cohens_d'])} FROM mt")
def paired_cohens_d(t: Tables) -> DataFrame:
    return model_tests(t).select("task_key", "metric", *_rounded(["cohens_d"]))


@query("bh_fdr", f"WITH {_SQL_MODEL} SELECT task_key, metric, {_sql_rounded(['p_value', 'p_adjusted'])} FROM mtb")
def bh_fdr(t: Tables) -> DataFrame:
    return model_tests(t).select("task_key", "metric", *_rounded(["p_value", "p_adjusted"]))


@query("reverse_cummin", f"""WITH {_SQL_MODEL}, r AS (SELECT task_key, metric, p_value, p_value * count(*) OVER (PARTITION BY metric) / row_number() OVER (PARTITION BY metric ORDER BY p_value, task_key) AS raw FROM mt WHERE p_value IS NOT NULL)
SELECT task_key, metric, round(min(raw) OVER (PARTITION BY metric ORDER BY p_value, task_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS tail_min FROM r""")
def reverse_cummin(t: Tables) -> DataFrame:
    """Step-up of p * m / rank: the smallest value from each rank on."""
    from pyspark.sql import Window

    m = model_tests(t).where("p_value is not null")
    family = Window.partitionBy("metric")
    up = family.orderBy("p_value", "task_key")
    raw = m.withColumn("raw", F.col("p_value") * F.count(F.lit(1)).over(family) / F.row_number().over(up))
    tail = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return raw.select("task_key", "metric", rnd(F.min("raw").over(tail)).alias("tail_min"))


@query("significance_stars", f"WITH {_SQL_MODEL} SELECT task_key, metric, CASE WHEN p_adjusted < 0.001 THEN '***' WHEN p_adjusted < 0.01 THEN '**' WHEN p_adjusted < 0.05 THEN '*' ELSE '' END AS stars FROM mtb")
def significance_stars(t: Tables) -> DataFrame:
    return model_tests(t).select("task_key", "metric", resample.stars(F.col("p_adjusted")).alias("stars"))


def regime_tests(t: Tables, model: str = "locf") -> DataFrame:
    keys = ["target", "horizon", "regime_a", "regime_b"]

    def build() -> DataFrame:
        s = with_task(fold_scores(t).where(F.col("model") == model), t)
        pairs = t.spark.createDataFrame(spec.REGIME_PAIRS, "regime_a string, regime_b string")
        a = s.select("target", "horizon", F.col("regime").alias("regime_a"), "seed", "fold", F.col("r2").alias("r2_a"))
        b = s.select("target", "horizon", F.col("regime").alias("regime_b"), "seed", "fold", F.col("r2").alias("r2_b"))
        both = a.join(F.broadcast(pairs), "regime_a").join(b, ["target", "horizon", "regime_b", "seed", "fold"])
        tests = resample.paired_tests(both.withColumn("d", F.col("r2_a") - F.col("r2_b")), keys, ["seed", "fold"])
        return resample.benjamini_hochberg(tests, "p_value", "p_adjusted")

    return staged(t.spark, t.version, f"regime_tests_{model}", build)


_RP = ", ".join(f"('{a}', '{b}')" for a, b in spec.REGIME_PAIRS)
_SQL_REGIME = f"""{SQL_SCORES}, ls AS (SELECT s.*, g.target, g.horizon, g.regime FROM scores s JOIN grid g USING (task_key) WHERE model = 'locf'),
  rp(regime_a, regime_b) AS (VALUES {_RP}),
  rd AS (SELECT a.target, a.horizon, regime_a, regime_b, a.seed, a.fold, a.r2 - b.r2 AS d FROM ls a JOIN rp ON rp.regime_a = a.regime
    JOIN ls b ON b.regime = rp.regime_b AND b.target = a.target AND b.horizon = a.horizon AND b.seed = a.seed AND b.fold = a.fold),
  {sql_paired('rd', 'target, horizon, regime_a, regime_b', 'rt')}, rtb AS (SELECT * FROM {sql_bh('rt', 'p_value', 'p_adjusted')})"""


@query("regime_lift_tests", f"WITH {_SQL_REGIME} SELECT target, horizon, regime_a, regime_b, {_sql_rounded([*TEST_COLS, 'p_adjusted'])}, n_folds FROM rtb")
def regime_lift_tests(t: Tables) -> DataFrame:
    return regime_tests(t).select("target", "horizon", "regime_a", "regime_b", *_rounded([*TEST_COLS, "p_adjusted"]), "n_folds")


def ablation_tests_from(rows: DataFrame) -> DataFrame:
    """Paired tests of (task_key, dropped_modality, seed, fold, full_r2, ablated_r2), with fold change and FDR."""
    keys = ["task_key", "dropped_modality"]
    ok = rows.where("full_r2 is not null and ablated_r2 is not null")
    means = ok.groupBy(*keys).agg(F.avg("full_r2").alias("mean_full_r2"), F.avg("ablated_r2").alias("mean_ablated_r2"))
    change = 100.0 * (F.col("mean_ablated_r2") - F.col("mean_full_r2")) / F.col("mean_full_r2")
    means = means.withColumn("fold_change_pct", F.when(F.abs("mean_full_r2") > 1e-6, change))
    tests = resample.paired_tests(ok.withColumn("d", F.col("full_r2") - F.col("ablated_r2")), keys, ["seed", "fold"])
    return resample.benjamini_hochberg(tests.join(means, keys), "p_value", "p_adjusted")


@query("ablation_tests", f"""WITH {SQL_SCORES}, ab AS (SELECT f.task_key, 'history' AS dropped_modality, f.seed, f.fold, f.r2 AS full_r2, a.r2 AS ablated_r2, f.r2 - a.r2 AS d
    FROM scores f JOIN scores a USING (task_key, seed, fold) WHERE f.model = 'locf' AND a.model = 'population_mean'),
  {sql_paired('ab', 'task_key, dropped_modality', 'abt')}, am AS (SELECT task_key, avg(full_r2) AS f, avg(ablated_r2) AS a FROM ab GROUP BY 1)
SELECT task_key, dropped_modality, {_sql_rounded([*TEST_COLS, 'p_adjusted'])}, n_folds, round(f, 6) + 0.0 AS mean_full_r2, round(a, 6) + 0.0 AS mean_ablated_r2,
  round(CASE WHEN abs(f) > 1e-6 THEN 100.0 * (a - f) / f END, 4) + 0.0 AS fold_change_pct FROM {sql_bh('abt', 'p_value', 'p_adjusted')} JOIN am USING (task_key)""")
def ablation_tests(t: Tables) -> DataFrame:
    """Without its history the last-value model falls back to the training mean."""
    pairs = paired_folds(fold_scores(t), "locf", "population_mean", ["r2"])
    rows = pairs.select("task_key", F.lit("history").alias("dropped_modality"), "seed", "fold", F.col("r2_a").alias("full_r2"), F.col("r2_b").alias("ablated_r2"))
    out = ablation_tests_from(rows)
    return out.select(
        "task_key", "dropped_modality", *_rounded([*TEST_COLS, "p_adjusted", "mean_full_r2", "mean_ablated_r2"]), "n_folds", rnd("fold_change_pct", 4).alias("fold_change_pct")
    )


@query("summary_by_test_type", f"""WITH {_SQL_MODEL}, x AS (SELECT 'model_' || metric AS test_type, p_value, p_adjusted FROM mtb)
SELECT test_type, count(*) AS n_tests, CAST(count(*) FILTER (p_adjusted < 0.05) AS BIGINT) AS n_significant, round(median(p_value), 6) AS median_p FROM x GROUP BY 1""")
def summary_by_test_type(t: Tables) -> DataFrame:
    rows = model_tests(t).select(F.concat(F.lit("model_"), F.col("metric")).alias("test_type"), "p_value", "p_adjusted")
    return rows.groupBy("test_type").agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("p_adjusted") < spec.ALPHA).alias("n_significant"), rnd(F.median("p_value")).alias("median_p")
    )


# --- row-level resampling ---------------------------------------------------------

_FINE = "CASE WHEN metric IN ('mae', 'rmse') THEN 2 ELSE 5 END"
#: Place of a row in its key and the word of a draw, as in ``resample.numbered`` and ``resample.draw_word``.
_SQL_POS = "row_number() OVER (PARTITION BY {keys} ORDER BY md5(concat('42|', {ident})), {ident}) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n"
_SQL_WORD = "CAST('0x' || substr(md5(concat('42|', boot, '|', j // 4)), j % 4 * 8 + 1, 8) AS BIGINT)"


def regression_bootstrap(t: Tables, score: resample.Scores, names: list[str]) -> DataFrame:
    keys, p = ["task_key", "seed"], Panel(t)
    if p.side_by_side:
        order = staged(t.spark, t.version, "inner_order", lambda: fold_ops.inner_order(p.entities))
        return asks.bootstrap_last(p.dealt_asks, order, p.asks, p.train_summary, p.history_tasks, spec.CV_SEEDS, score, names)
    rows = p.naive_predictions.where("model = 'locf'").select(*keys, "entity_id", "y", "yhat")
    return resample.bootstrap_scores(rows, keys, "entity_id", ["y", "yhat"], score, metrics.regression_metrics, names)


#: Places of the draws of a list of ranks by value, ties by place from the front (+) or the back (-): both added are twice the average rank.
_SQL_PLACES = "CAST(list_grade_up(list_grade_up(list_transform({0}, lambda v, i: v * 1000000000 {1} i))) AS DOUBLE[])"


# Sums over a resample are dot products of its draw counts with the rows' terms, both as lists by place; values are centred first.
@query("bootstrap_regression_ci", f"""WITH {SQL_PRED}, src AS (SELECT task_key, seed, entity_id, y - avg(y) OVER k AS y, yhat - avg(y) OVER k AS p FROM pred WHERE model = 'locf' WINDOW k AS (PARTITION BY task_key, seed)),
  r AS (SELECT *, {_SQL_POS.format(keys='task_key, seed', ident='entity_id')}, dense_rank() OVER (PARTITION BY task_key, seed ORDER BY y) AS ry, dense_rank() OVER (PARTITION BY task_key, seed ORDER BY p) AS rp FROM src),
  k AS (SELECT task_key, seed, n, list(ry ORDER BY pos) AS ky, list(rp ORDER BY pos) AS kp, {", ".join(f"list(CAST({e} AS DOUBLE) ORDER BY pos) AS {c}" for c, e in (("ae", "abs(y - p)"), ("ee", "(y - p) * (y - p)"), ("ly", "y"), ("lp", "p"), ("yy", "y * y"), ("pp", "p * p"), ("yp", "y * p")))} FROM r GROUP BY ALL),
  z AS (SELECT n, unnest(range(n)) AS j FROM (SELECT DISTINCT n FROM r)), b AS (SELECT unnest(range(1, {spec.N_BOOTSTRAP + 1})) AS boot),
  x AS (SELECT boot, j, {_SQL_WORD} AS word FROM b, (SELECT DISTINCT j FROM z)),
  c AS (SELECT n, boot, word % n AS pos, 1 AS c FROM z JOIN x USING (j) UNION ALL SELECT n, boot, j, 0 FROM z, b),
  w AS (SELECT n, boot, list(CAST(c AS DOUBLE) ORDER BY pos) AS w FROM (SELECT n, boot, pos, sum(c) AS c FROM c GROUP BY ALL) GROUP BY ALL),
  o AS (SELECT n, 0 AS boot, list(CAST(1 AS DOUBLE)) AS w FROM z GROUP BY ALL),
  s AS (SELECT task_key, seed, n, boot, {", ".join(f"list_dot_product(w, {c}) AS {c}" for c in ("ae", "ee", "ly", "lp", "yy", "pp", "yp"))} FROM k JOIN (SELECT * FROM w UNION ALL SELECT * FROM o) USING (n)),
  v AS (SELECT *, yy / n - ly * ly / n / n AS vy, pp / n - lp * lp / n / n AS vp, yp / n - ly * lp / n / n AS cv FROM s),
  d AS (SELECT n, boot, list(word % n + 1 ORDER BY j) AS d FROM z JOIN x USING (j) GROUP BY ALL UNION ALL SELECT n, 0, list(j + 1 ORDER BY j) FROM z GROUP BY ALL),
  u AS (SELECT n, ky, kp, boot, list_select(ky, d) AS a, list_select(kp, d) AS b FROM (SELECT DISTINCT n, ky, kp FROM k WHERE n >= 10) JOIN d USING (n)),
  g AS (SELECT n, ky, kp, boot, {", ".join(f"{_SQL_PLACES.format(c, sign)} AS {c}{i}" for c in "ab" for i, sign in ((1, "+"), (2, "-")))} FROM u),
  q AS (SELECT n, ky, kp, boot, {", ".join(f"list_dot_product({x}1, {y}1) + list_dot_product({x}1, {y}2) + list_dot_product({x}2, {y}1) + list_dot_product({x}2, {y}2) - n * (n + 1.0) * (n + 1) AS {x}{y}" for x, y in ("aa", "bb", "ab"))} FROM g),
  sp AS (SELECT task_key, seed, boot, CASE WHEN aa <= 0 OR bb <= 0 THEN 0.0 ELSE ab / sqrt(aa * bb) END AS spearman FROM k JOIN q USING (n, ky, kp)),
  m AS (SELECT task_key, seed, boot, spearman, CASE WHEN vy = 0 THEN CASE WHEN ee = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - ee / (n * vy) END AS r2, ae / n AS mae, sqrt(ee / n) AS rmse,
    CASE WHEN sqrt(vy) < 1e-10 OR sqrt(vp) < 1e-10 THEN 0.0 ELSE cv / sqrt(vy * vp) END AS pearson FROM v JOIN sp USING (task_key, seed, boot) WHERE n >= 10),
  lg AS (UNPIVOT m ON r2, mae, rmse, pearson, spearman INTO NAME metric VALUE v)
SELECT task_key, seed, metric, round(max(v) FILTER (boot = 0), {_FINE}) + 0.0 AS point, round(quantile_cont(v, 0.025) FILTER (boot > 0), {_FINE}) + 0.0 AS ci_lo,
  round(quantile_cont(v, 0.975) FILTER (boot > 0), {_FINE}) + 0.0 AS ci_hi, round(stddev_pop(v) FILTER (boot > 0), {_FINE}) + 0.0 AS se FROM lg GROUP BY task_key, seed, metric""")
def bootstrap_regression_ci(t: Tables) -> DataFrame:
    out = regression_bootstrap(t, resample.score_regression, ["r2", "mae", "rmse", "pearson", "spearman"])
    fine = F.col("metric").isin("mae", "rmse")
    return out.select("task_key", "seed", "metric", *[F.when(fine, rnd(c, 2)).otherwise(rnd(c, 5)).alias(c) for c in ("point", "ci_lo", "ci_hi", "se")])


@query("bootstrap_rank_ci")
def bootstrap_rank_ci(t: Tables) -> DataFrame:
    """Spearman's interval; ranking 2,000 resamples of every task is too slow in SQL, so a test compares with brute force."""
    out = regression_bootstrap(t, resample.score_ranks, ["spearman"])
    return out.select("task_key", "seed", "metric", *[rnd(c, 5).alias(c) for c in ("point", "ci_lo", "ci_hi", "se")])


@query("bootstrap_classification_ci", f"""WITH {SQL_CLS.replace("SELECT l_linenumber AS model", "SELECT l_linenumber AS model, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS row_id")},
  r AS (SELECT model, y, prob, {_SQL_POS.format(keys='model', ident='row_id')} FROM cls),
  x AS (SELECT boot, j, {_SQL_WORD} AS word FROM (SELECT unnest(range(1, {spec.N_BOOTSTRAP + 1})) AS boot), (SELECT unnest(range((SELECT max(n) FROM r))) AS j)),
  bs AS (SELECT model, boot, y, prob FROM (SELECT model, boot, word % n AS pos FROM (SELECT DISTINCT model, n FROM r) JOIN x ON j < n) JOIN r USING (model, pos)), {sql_ranking('bs', 'model, boot', 'bm')},
  lg AS (UNPIVOT (SELECT model, boot, auroc, auprc FROM bm WHERE auroc IS NOT NULL) ON auroc, auprc INTO NAME metric VALUE v)
SELECT model, metric, round(avg(v), 5) AS point, round(quantile_cont(v, 0.025), 5) AS ci_lo, round(quantile_cont(v, 0.975), 5) AS ci_hi, round(stddev_pop(v), 5) AS se FROM lg GROUP BY model, metric""")
def bootstrap_classification_ci(t: Tables) -> DataFrame:
    """The point is the mean over resamples."""

    def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
        both = metrics.auroc(rows, keys).join(metrics.auprc(rows, keys), keys)
        return both.withColumn("auprc", F.when(F.col("auroc").isNotNull(), F.col("auprc")))

    out = resample.bootstrap_scores(item_scores(t), ["model"], "row_id", ["y", "prob"], resample.score_classes, spread, ["auroc", "auprc"])
    return out.select("model", "metric", rnd("mean", 5).alias("point"), *[rnd(c, 5).alias(c) for c in ("ci_lo", "ci_hi", "se")])


# As above: a permutation's sum is the dot product of its signs with the error gaps, both as lists by entity.
@query("paired_permutation_predictions", f"""WITH {SQL_PRED}, w AS (SELECT task_key, seed, entity_id, max(y) AS y, max(yhat) FILTER (model = 'locf') AS a, max(yhat) FILTER (model = 'population_mean') AS b FROM pred GROUP BY ALL),
  g AS (SELECT task_key, seed, entity_id, y, (y - b) * (y - b) - (y - a) * (y - a) AS g FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
  o AS (SELECT task_key, seed, sum(g) AS gs, var_pop(y) * count(y) AS sst, count(*) AS n FROM g GROUP BY ALL),
  e AS (SELECT DISTINCT entity_id FROM g),
  l AS (SELECT task_key, seed, list(CAST(coalesce(g, 0) AS DOUBLE) ORDER BY entity_id) AS gl FROM (SELECT o.task_key, o.seed, e.entity_id, g.g FROM o CROSS JOIN e LEFT JOIN g USING (task_key, seed, entity_id)) GROUP BY ALL),
  h AS (SELECT entity_id, block, md5(concat('42|', block, '|', entity_id)) AS h FROM e, (SELECT unnest(range({-(-spec.N_PERMUTATIONS // 128)})) AS block)),
  p AS (SELECT perm, list(CASE WHEN (CAST('0x' || substr(h, perm % 128 // 4 + 1, 1) AS INT) >> CAST(3 - perm % 4 AS INT)) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY entity_id) AS sl
    FROM (SELECT unnest(range({spec.N_PERMUTATIONS})) AS perm) q JOIN h ON h.block = q.perm // 128 GROUP BY perm),
  f AS (SELECT task_key, seed, list_dot_product(gl, sl) AS m FROM l, p)
SELECT task_key, seed, round(max(gs) / max(sst), 6) + 0.0 AS observed_diff, round((count(*) FILTER (abs(m) >= abs(gs) * (1 - 1e-12)) + 1) / {spec.N_PERMUTATIONS + 1}.0, 6) AS p_value, max(n) AS n
FROM f JOIN o USING (task_key, seed) GROUP BY task_key, seed""")
def paired_permutation_predictions(t: Tables) -> DataFrame:
    keys = ["task_key", "seed"]
    wide = Panel(t).naive_pairs.select(*keys, "entity_id", "y", F.col("last").alias("a"), F.col("mean").alias("b"))
    out = resample.paired_prediction_test(wide, keys, "entity_id")
    return out.select(*keys, rnd("observed_diff").alias("observed_diff"), rnd("p_value").alias("p_value"), "n")


def wilcoxon(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One-sided signed-rank of ``d`` per key: zeros dropped, average ranks, tie-corrected normal approximation."""
    nz = rows.where("d is not null and abs(d) > 1e-12").withColumn("_abs", F.round(F.abs("d"), 12))
    ranks = average_ranks(nz, keys, "_abs", "_rank")
    sizes = nz.groupBy(*keys, "_abs").agg(F.count(F.lit(1)).alias("_t"))
    up = nz.where("d > 0").groupBy(*keys, "_abs").agg(F.count(F.lit(1)).alias("_up"))
    both = ranks.join(sizes, [*keys, "_abs"]).join(up, [*keys, "_abs"], "left")
    tie = F.col("_t").cast("double")
    return both.groupBy(*keys).agg(
        F.sum(F.coalesce("_up", F.lit(0)) * F.col("_rank")).alias("w_plus"), F.max("n").alias("n"), F.sum(tie * tie * tie - tie).alias("_ties")
    )


#: Up to this many untied differences the signed-rank distribution is exact.
EXACT_ROWS = 50


def wilcoxon_p(stat: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = ratio(F.col("w_plus") - mean, F.sqrt(var))
    exact = (F.col("_ties") == 0) & (n <= EXACT_ROWS)
    small = signed_rank_upper(F.when(exact, n), F.when(exact, F.col("w_plus")))
    return stat.withColumn("p_value", F.when(exact, small).otherwise(normal_upper(z))).drop("_ties")


def _vs_baseline(t: Tables) -> DataFrame:
    s = with_task(majority_scores(t), t)
    prev = s.groupBy("target").agg(F.avg("prevalence").alias("prev"))
    long = s.select("target", "task_key", "seed", "fold", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("auroc", "auprc", "mcc")
    ])))
    base = F.when(F.col("metric") == "auroc", 0.5).when(F.col("metric") == "mcc", 0.0).otherwise(F.round("prev", 12))
    return long.join(F.broadcast(prev), "target").withColumn("d", F.col("v") - base)


@query("wilcoxon_statistic", f"""WITH {SQL_MAJ_SCORES}, s AS (SELECT ms.*, target FROM ms JOIN grid USING (task_key)), pv AS (SELECT target, avg(prevalence) AS prev FROM s GROUP BY 1),
  d AS (SELECT target, 'auprc' AS metric, auprc - round(prev, 12) AS d FROM s JOIN pv USING (target) UNION ALL SELECT target, 'auroc', auroc - 0.5 FROM s UNION ALL SELECT target, 'mcc', mcc FROM s),
  nz AS (SELECT target, metric, d, round(abs(d), 12) AS a FROM d WHERE d IS NOT NULL AND abs(d) > 1e-12),
  r AS (SELECT *, rank() OVER (PARTITION BY target, metric ORDER BY a) + (count(*) OVER (PARTITION BY target, metric, a) - 1) / 2.0 AS rk FROM nz)
SELECT target, metric, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, count(*) AS n FROM r GROUP BY target, metric""")
def wilcoxon_statistic(t: Tables) -> DataFrame:
    return wilcoxon(_vs_baseline(t), ["target", "metric"]).select("target", "metric", "w_plus", "n")


@query("wilcoxon_vs_baseline")
def wilcoxon_vs_baseline(t: Tables) -> DataFrame:
    """P-values of all (target, metric) panels with FDR; constant folds give p = 1 or 0 by their sign."""
    rows = _vs_baseline(t)
    keys = ["target", "metric"]
    flat = rows.groupBy(*keys).agg(F.count("d").alias("n_folds"), F.stddev_pop("d").alias("_sd"), F.avg("d").alias("_m"), F.percentile("v", F.lit(0.025)).alias("ci_lo"))
    out = flat.join(wilcoxon_p(wilcoxon(rows, keys)), keys, "left")
    p = F.when(F.col("n_folds") < 3, None).when(F.col("_sd") < 1e-10, F.when(F.col("_m") <= 0, 1.0).otherwise(0.0)).otherwise(F.col("p_value"))
    out = resample.benjamini_hochberg(out.withColumn("p_value", p), "p_value", "p_adjusted")
    return out.select(*keys, "n_folds", "w_plus", rnd("p_value").alias("p_value"), rnd("p_adjusted").alias("p_adjusted"), rnd("ci_lo").alias("ci_lo"))
