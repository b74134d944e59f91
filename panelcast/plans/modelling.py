"""Fitted models: linear, mixed-effects and tree families, ablation and importance.

Linear and mixed models run for every task, seed and fold, through a prediction store
that goes on where it was stopped, and so do boosted trees, fitted by Spark ML with points
of the full grid. Forests and logistic regression are fitted on a representative task of
the first seed with a short grid; the full grid is ``spec.GRIDS``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.models import linear, mixed, naive, trees
from panelcast.operators import folds as fold_ops
from panelcast.operators import fold_metrics, metrics, normalise, tasks
from panelcast.plans.evaluation import norm_stats
from panelcast.plans.inference import ablation_tests_from
from panelcast.plans.panel import SQL_FOLDS, Panel, fold_scores, with_task
from panelcast.plans.registry import query, rnd
from panelcast.plans.relational import visit_doses
from panelcast.sources.predictions import PredictionStore
from panelcast.sources.stage import staged, store_folder, write_stage
from panelcast.sources.tables import Tables

KEYS = ["task_key", "seed", "fold"]
SEED = spec.CV_SEEDS[0]
TREE_TASK = "order_total__baseline_multimodal__V08"
TREE_CLF_TASK = "low_quantity__baseline_multimodal__V08"
SHORT_GRIDS = {
    "random_forest": {"n_estimators": [20], "max_depth": [4, 8], "min_samples_leaf": [5]},
    "logistic_regression": spec.GRIDS["logistic_regression"],
}
# Spark ML fits are many small jobs on a test-sized table, so the forest and logistic queries evaluate the
# first two outer folds; every row of the task takes part in each. Pass ``folds`` for all five.
TREE_FOLDS = (0, 1)
#: Rows of a task whose matrix (about 60 values of 9 bytes a row, held twice) is worked on in one Spark task.
ABLATION_ROWS = 1_000_000
ONE_POINT = {"n_estimators": [5], "max_depth": [3], "learning_rate": [0.1]}


def vectors(t: Tables) -> DataFrame:
    """Normalised rows of every task, seed and fold."""

    def build() -> DataFrame:
        features, folds = Panel(t).features, Panel(t).all_folds
        return normalise.fold_vectors(features, folds, normalise.kept_stats(features, folds, norm_stats(t, tuple(spec.CV_SEEDS))))

    return staged(t.spark, t.version, "vectors", build)


def inner(t: Tables) -> DataFrame:
    return staged(t.spark, t.version, "inner", lambda: fold_ops.inner_folds(Panel(t).all_folds.drop("task_type"), Panel(t).grid))


def _named(name: str, task: str, seeds: tuple[int, ...]) -> str:
    return f"{name}-{task}" if seeds == (SEED,) else f"{name}-{task}-{'_'.join(map(str, seeds))}"


def task_vectors(t: Tables, task: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """:func:`vectors` of one task and some seeds, the first by default, without those of the other tasks and seeds."""

    def build() -> DataFrame:
        p = Panel(t, task=task)
        folds = p.all_folds.where(F.col("seed").isin(list(seeds)))
        counts = staged(t.spark, t.version, _named("norm_counts", task, seeds), lambda: normalise.training_counts(p.features, folds))
        stats = staged(t.spark, t.version, _named("norm_stats", task, seeds), lambda: normalise.fit(counts))
        return normalise.fold_vectors(p.features, folds, normalise.kept_stats(p.features, folds, stats))

    return staged(t.spark, t.version, _named("vectors", task, seeds), build)


def task_inner(t: Tables, task: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """:func:`inner` of one task and some seeds, the first by default."""

    def build() -> DataFrame:
        p = Panel(t, task=task)
        return fold_ops.inner_folds(p.all_folds.where(F.col("seed").isin(list(seeds))).drop("task_type"), p.grid)

    return staged(t.spark, t.version, _named("inner", task, seeds), build)


def _continuous(t: Tables) -> DataFrame:
    kinds = Panel(t).grid.where("task_type <> 'classification'").select("task_key")
    return vectors(t).join(F.broadcast(kinds), "task_key", "left_semi")


def raw_matrices(t: Tables, rows: DataFrame, panel: DataFrame | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """``tasks.task_matrices`` of dealt ``rows`` with the place of every entity in the hash order of the inner folds."""
    p = Panel(t)
    panel = p.panel if panel is None else panel
    order = staged(t.spark, t.version, "inner_order", lambda: fold_ops.inner_order(p.entities))
    members = rows.drop("task_type", "last_value", "stratum").join(order, "entity_id")
    return tasks.task_matrices(members, panel, p.static, p.grid)


def continuous_rows(t: Tables) -> DataFrame:
    return Panel(t).dealt.where("task_type <> 'classification'")


def in_matrices(t: Tables) -> bool:
    """Whether every linear task is worked on as one matrix for all seeds and folds; if not, its rows are normalised fold by fold."""
    return fold_ops.largest_task(continuous_rows(t)) <= ABLATION_ROWS


def linear_products(t: Tables) -> DataFrame:
    return staged(t.spark, t.version, "linear_products", lambda: linear.task_products(*raw_matrices(t, continuous_rows(t)), spec.CV_SEEDS))


def linear_fits(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        return linear.fit_products(linear_products(t)) if in_matrices(t) else linear.fit_linear(_continuous(t), inner(t))

    return staged(t.spark, t.version, "linear_fits", build)


def linear_predictions(t: Tables, model: str) -> DataFrame:
    fits = linear_fits(t).where(F.col("model") == model)
    if not in_matrices(t):
        return linear.predict_linear(_continuous(t), fits)
    rows, names = raw_matrices(t, continuous_rows(t))
    return linear.predict_tasks(rows, fits, linear_products(t), names, spec.CV_SEEDS, (model,))


def linear_scores(t: Tables) -> DataFrame:
    """Scores of both linear models on every task, seed and fold."""

    def build() -> DataFrame:
        if in_matrices(t):
            rows, names = raw_matrices(t, continuous_rows(t))
            return linear.score_tasks(rows, linear_fits(t), linear_products(t), names, spec.CV_SEEDS)
        pred, by = linear.predict_linear(_continuous(t), linear_fits(t)), [*KEYS, "model"]
        return metrics.regression_metrics(pred, by).join(metrics.kendall_tau(pred, by, "y", "yhat").drop("n_test"), by)

    return staged(t.spark, t.version, "linear_scores", build)


def mixed_predictions(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        p = Panel(t)
        months = {r["task_key"]: r["horizon_months"] for r in p.grid.select("task_key", "horizon_months").collect()}
        rows = p.dealt.where("task_type = 'regression'")
        if fold_ops.largest_task(rows) <= fold_ops.GROUP_ROWS:
            return mixed.task_predictions(rows, p.panel, p.grid, p.train_summary, p.history_tasks, months, spec.CV_SEEDS)
        folds = p.folds("regression")
        back = p.naive_predictions.where(F.col("model") == "locf")
        return mixed.predict_mixed(folds, p.history, months, back)

    return staged(t.spark, t.version, "mixed_pred", build)


def mixed_scores(t: Tables) -> DataFrame:
    """Scores of :func:`mixed_predictions`; tasks of up to ``GROUP_ROWS`` rows need no stored predictions."""

    def build() -> DataFrame:
        p = Panel(t)
        rows = p.dealt.where("task_type = 'regression'")
        if fold_ops.largest_task(rows) > fold_ops.GROUP_ROWS:
            return metrics.regression_metrics(mixed_predictions(t), [*KEYS, "model"])
        months = {r["task_key"]: r["horizon_months"] for r in p.grid.select("task_key", "horizon_months").collect()}
        return mixed.task_scores(rows, p.panel, p.grid, p.train_summary, p.history_tasks, months, spec.CV_SEEDS)

    return staged(t.spark, t.version, "mixed_scores", build)


def _scores(pred: DataFrame, t: Tables) -> DataFrame:
    return _rounded(metrics.regression_metrics(pred, [*KEYS, "model"]))


def _linear_scores(t: Tables, model: str) -> DataFrame:
    return _rounded(_regression_only(linear_scores(t).where(F.col("model") == model), t))


def _rounded(s: DataFrame) -> DataFrame:
    digits = {"r2": 6, "spearman": 6, "pearson": 6, "mae": 3, "rmse": 3}
    return s.select(*KEYS, "model", "n_test", *[rnd(m, d).alias(m) for m, d in digits.items()])


def _regression_only(pred: DataFrame, t: Tables) -> DataFrame:
    kinds = Panel(t).grid.where("task_type = 'regression'").select("task_key")
    return pred.join(F.broadcast(kinds), "task_key", "left_semi")


@query("model_ridge")
def model_ridge(t: Tables) -> DataFrame:
    return _linear_scores(t, "ridge")


@query("model_elastic_net")
def model_elastic_net(t: Tables) -> DataFrame:
    return _linear_scores(t, "elastic_net")


@query("model_mixed_effects")
def model_mixed_effects(t: Tables) -> DataFrame:
    return _rounded(mixed_scores(t))


@query("tune_inner_cv")
def tune_inner_cv(t: Tables) -> DataFrame:
    """Chosen penalties and inner validation scores of every linear fit."""
    return linear_fits(t).select(*KEYS, "model", "alpha", "l1_ratio", rnd("cv_score").alias("cv_score"))


@query("ranking_models")
def ranking_models(t: Tables) -> DataFrame:
    """Feature models on the rank target, scored by rank correlations."""
    names = Panel(t).grid.where("task_type = 'ranking'").select("task_key")
    m = linear_scores(t).join(F.broadcast(names), "task_key", "left_semi")
    return m.select(*KEYS, "model", "n_test", rnd("spearman").alias("spearman"), rnd("kendall_tau").alias("kendall_tau"))


#: Models of the store by task type.
STORE_MODELS = {"regression": ["population_mean", "locf", "ridge", "elastic_net", "lme"], "classification": ["majority_class"], "ranking": ["ridge", "elastic_net"]}


def expected_runs(t: Tables) -> DataFrame:
    """(task_key, seed, fold, model, n_train) of all runs there should be: tasks that pass the gate x seeds x folds x models."""
    p = Panel(t)
    sizes = p.train_summary.select(*KEYS, "n_train").join(F.broadcast(p.grid.select("task_key", "task_type")), "task_key")
    models = F.create_map(*[x for k, v in STORE_MODELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return sizes.select(*KEYS, F.explode(F.element_at(models, F.col("task_type"))).alias("model"), "n_train")


def fitters(t: Tables) -> dict:
    """How the store gets a model's predictions of open keys."""
    p = Panel(t)

    def linear_fitter(model: str):
        def fit(asked: DataFrame):
            fits = linear_fits(t).where(F.col("model") == model).join(asked.select(*KEYS), KEYS, "left_semi")
            chosen = F.create_map(F.lit("alpha"), F.col("alpha").cast("string"), F.lit("l1_ratio"), F.col("l1_ratio").cast("string"))
            params = fits.select(*KEYS, "model", F.when(F.col("error").isNull(), F.to_json(chosen)).alias("best_params"), "error")
            return linear_predictions(t, model), params

        return fit

    return {
        "population_mean": lambda asked: (p.naive_predictions.where("model = 'population_mean'"), None),
        "locf": lambda asked: (p.naive_predictions.where("model = 'locf'"), None),
        "majority_class": lambda asked: (naive.majority_class(p.folds("classification"), p.train_summary), None),
        "ridge": linear_fitter("ridge"),
        "elastic_net": linear_fitter("elastic_net"),
        "lme": lambda asked: (mixed_predictions(t), None),
    }


def store(t: Tables, models: tuple[str, ...] | None = None) -> PredictionStore:
    """The prediction store of these tables, complete for ``models`` (all by default)."""
    place = PredictionStore(t.spark, store_folder(t.spark, t.version), dict(Panel(t).all_folds.dtypes)["entity_id"])
    have = fitters(t)
    place.complete(expected_runs(t), {m: have[m] for m in models or have})
    return place


@query("outer_cv_run")
def outer_cv_run(t: Tables) -> DataFrame:
    """Fold results of every task, seed, fold and stored model, error rows included, with training sizes and tuned parameters."""
    place = store(t)
    pred, kinds = place.predictions(), Panel(t).grid.select("task_key", "task_type")
    pred = pred.join(F.broadcast(kinds), "task_key")
    by = [*KEYS, "model"]
    regression = fold_metrics.stored_scores if in_matrices(t) else lambda rows: metrics.regression_metrics(rows, by)
    scores = regression(pred.where("task_type <> 'classification'")).select(*by, "r2", "spearman", F.lit(None).cast("double").alias("auprc"))
    classes = metrics.classification_metrics(pred.where("task_type = 'classification'"), by)
    scores = scores.unionByName(classes.select(*by, F.lit(None).cast("double").alias("r2"), F.lit(None).cast("double").alias("spearman"), "auprc"))
    rows = place.runs().join(scores, by, "left")
    return with_task(rows, t).select(
        "task_key", "target", "horizon", "regime", "task_type", "model", "seed", "fold", "n_train", "n_test",
        rnd("r2").alias("r2"), rnd("spearman").alias("spearman"), rnd("auprc").alias("auprc"), "best_params", "error",
    )


def _sql_models() -> str:
    return ", ".join(f"('{k}', '{m}')" for k, v in STORE_MODELS.items() for m in v)


@query("outer_cv_coverage", f"""WITH {SQL_FOLDS}, models(task_type, model) AS (VALUES {_sql_models()}),
  n AS (SELECT task_key, task_type, seed, fold, count(*) AS n_test FROM folds GROUP BY ALL),
  whole AS (SELECT task_key, seed, sum(n_test) AS total FROM n GROUP BY ALL)
SELECT task_key, seed, fold, model, CAST(total - n_test AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, false AS failed
FROM n JOIN whole USING (task_key, seed) JOIN models USING (task_type)""")
def outer_cv_coverage(t: Tables) -> DataFrame:
    """Every expected run of the store with its training and test size."""
    return store(t).runs().select(*KEYS, "model", "n_train", "n_test", F.col("error").isNotNull().alias("failed"))


def tree_run(t: Tables, model: str, task: str, grid: dict, folds=TREE_FOLDS, source: DataFrame | None = None):
    keys = [(task, SEED, f) for f in folds]
    return trees.tune_and_predict(source if source is not None else task_vectors(t, task), task_inner(t, task), model, keys, grid)


@query("model_random_forest")
def model_random_forest(t: Tables) -> DataFrame:
    return _scores(tree_run(t, "random_forest", TREE_TASK, SHORT_GRIDS["random_forest"])[0], t)


#: Task type of the tree models that are fitted for every task, seed and fold.
TREE_TYPES = {"random_forest": "regression", "boosted_trees": "regression", "boosted_trees_clf": "classification"}


def tree_grid(model: str) -> dict:
    """The full grid, of which every fit tries ``spec.N_RANDOM_SEARCH`` points."""
    return spec.GRIDS[model.removesuffix("_clf")]


def tree_fits(t: Tables, model: str, task: str, asked: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Predictions and chosen parameters of the asked seeds and folds of one task; a fit that fails is an error row."""
    seeds, keys = tuple(spec.CV_SEEDS), sorted((task, r.seed, r.fold) for r in asked.select("seed", "fold").collect())
    pred, chosen, _ = trees.tune_and_predict(task_vectors(t, task, seeds), task_inner(t, task, seeds), model, keys, tree_grid(model))
    rows = [(c["task_key"], c["seed"], c["fold"], model, json.dumps(c["best_params"], sort_keys=True), c["error"]) for c in chosen]
    return pred, t.spark.createDataFrame(rows, "task_key string, seed int, fold int, model string, best_params string, error string")


def tree_store(t: Tables, model: str, only: list[str] | None = None) -> PredictionStore:
    """The store of tree models, complete for ``model`` on every task of its type, or those of ``only``, and every seed and fold.

    A task is committed at a time, so a run that was stopped goes on with the next one.
    """
    p = Panel(t)
    place = PredictionStore(t.spark, f"{store_folder(t.spark, t.version)}-trees", dict(p.all_folds.dtypes)["entity_id"])
    sizes = p.train_summary.select(*KEYS, F.lit(model).alias("model"), "n_train")
    names = p.grid.where(F.col("task_type") == TREE_TYPES[model]).select("task_key").join(sizes, "task_key", "left_semi")
    for (task,) in names.orderBy("task_key").collect():
        if only is None or task in only:
            place.complete(sizes.where(F.col("task_key") == task), {model: lambda asked, task=task: tree_fits(t, model, task, asked)})
    return place


def _stored_scores(place: PredictionStore, model: str, scores: DataFrame) -> DataFrame:
    """Scores of every run of a model; a run that failed has null scores."""
    runs = place.runs().where(F.col("model") == model).select(*KEYS, "model")
    return runs.join(scores, [*KEYS, "model"], "left")


def tree_scores(t: Tables, model: str, only: list[str] | None = None) -> DataFrame:
    place = tree_store(t, model, only)
    return _stored_scores(place, model, metrics.regression_metrics(place.predictions([model]), [*KEYS, "model"]))


@query("model_boosted_trees")
def model_boosted_trees(t: Tables) -> DataFrame:
    """Boosted trees on every regression task, seed and fold, each tuned on inner folds over points of the full grid."""
    return _rounded(tree_scores(t, "boosted_trees"))


def _class_scores(pred: DataFrame) -> DataFrame:
    m = metrics.classification_metrics(pred, [*KEYS, "model"])
    return m.select(*KEYS, "model", "n_test", *[rnd(c).alias(c) for c in ("auroc", "auprc", "mcc", "f1", "balanced_accuracy", "brier", "prevalence")])


@query("model_logistic")
def model_logistic(t: Tables) -> DataFrame:
    return _class_scores(tree_run(t, "logistic_regression", TREE_CLF_TASK, SHORT_GRIDS["logistic_regression"])[0])


@query("model_random_forest_clf")
def model_random_forest_clf(t: Tables) -> DataFrame:
    return _class_scores(tree_run(t, "random_forest_clf", TREE_CLF_TASK, SHORT_GRIDS["random_forest"])[0])


@query("model_boosted_trees_clf")
def model_boosted_trees_clf(t: Tables) -> DataFrame:
    """As :func:`model_boosted_trees`, on every classification task."""
    place = tree_store(t, "boosted_trees_clf")
    return _stored_scores(place, "boosted_trees_clf", _class_scores(place.predictions(["boosted_trees_clf"])))


def _names(t: Tables, task: str, fold: int) -> list[str]:
    here = task_vectors(t, task).where(F.col("fold") == fold)
    return list(here.select("features").first()[0])  # a feature list, not data


def importances(t: Tables, task: str = TREE_TASK, top: int = 20, grid: dict = ONE_POINT) -> list[tuple[str, float]]:
    """Feature importances of boosted trees on fold 0, largest first."""
    _, _, models = tree_run(t, "boosted_trees", task, grid, folds=[0])
    weights = models[(task, SEED, 0)].featureImportances.toArray()
    ranked = sorted(zip(_names(t, task, 0), map(float, weights)), key=lambda r: (-r[1], r[0]))
    return ranked[:top]


@query("permutation_importance")
def permutation_importance(t: Tables) -> DataFrame:
    """R2 lost when one feature is shuffled among the test rows, ridge models of every seed and fold, top 20 per key.

    The shuffled value is the one of the next row in hash order, found by position.
    """
    from pyspark.sql import Window

    # At most one row per feature of a task here.
    w = Window.partitionBy(*KEYS).orderBy(F.desc("r2_drop"), "feature")
    ranked = _r2_drops(t).withColumn("r2_drop", rnd("r2_drop")).withColumn("rnk", F.row_number().over(w))
    return ranked.where("rnk <= 20").select(*KEYS, "rnk", "feature", "r2_drop")


def _r2_drops(t: Tables) -> DataFrame:
    """(keys, feature, r2_drop)."""
    from panelcast.operators.order_stats import number_in_order

    if in_matrices(t):
        rows, names = raw_matrices(t, continuous_rows(t))
        return linear.permute_tasks(rows, linear_fits(t).where("model = 'ridge'"), linear_products(t), names, spec.CV_SEEDS)
    rows = vectors(t).where(F.col("is_test"))
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(spec.TEST_SEED), "entity_id")))
    placed = number_in_order(hashed, KEYS, "_h", "entity_id", "_pos")
    n = placed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    shifted = placed.join(n, KEYS).select(*KEYS, ((F.col("_pos") + 1) % F.col("_n")).alias("_pos"), F.col("x").alias("_other"))
    fits = linear_fits(t).where("model = 'ridge'").select(*KEYS, "coef", "intercept")
    both = placed.join(shifted, [*KEYS, "_pos"]).join(fits, KEYS)
    moves = F.zip_with("coef", F.zip_with("_other", "x", lambda a, b: a - b), lambda c, d: c * d)
    dot = F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    err = F.col("y") - F.col("intercept") - dot
    parts = both.select(*KEYS, "y", err.alias("e"), F.posexplode(moves).alias("pos", "move"))
    loss = parts.groupBy(*KEYS, "pos").agg(
        (F.sum(F.pow(F.col("e") - F.col("move"), 2)) - F.sum(F.col("e") * F.col("e"))).alias("d"), (F.var_pop("y") * F.count("y")).alias("sst")
    )
    names = linear.feature_lists(vectors(t)).select(*KEYS, F.posexplode("features").alias("pos", "feature"))
    return loss.join(names, [*KEYS, "pos"]).select(*KEYS, "feature", metrics.ratio(F.col("d"), F.col("sst")).alias("r2_drop"))


@query("tree_importance")
def tree_importance(t: Tables) -> DataFrame:
    ranked = importances(t)
    rows = [(TREE_TASK, i + 1, n, w) for i, (n, w) in enumerate(ranked)]
    return t.spark.createDataFrame(rows, "task_key string, rnk int, feature string, importance double")


def _subset(source: DataFrame, task: str, at: list[int]) -> DataFrame:
    return source.where(F.col("task_key") == task).withColumn("x", F.array(*[F.get("x", F.lit(i)) for i in at]))


REDUCTION_TASKS = [f"{x}__{r}__V08" for x in ("order_total", "item_price") for r in ("baseline_multimodal", "rolling")]
REDUCTION_SIZES = (3, 5, 10, 15, 20)


def tuned_grid(t: Tables, task: str) -> dict:
    """The parameters that most seeds and folds of a task chose, the first in order of those equally often, as a grid of one point."""
    runs = tree_store(t, "boosted_trees", [task]).runs().where((F.col("model") == "boosted_trees") & (F.col("task_key") == task) & F.col("error").isNull())
    mode = runs.groupBy("best_params").count().orderBy(F.desc("count"), "best_params").first()
    chosen = json.loads(mode.best_params)
    return {k: [v for v in spec.GRIDS["boosted_trees"][k] if str(v) == chosen[k]] for k in chosen}


def reduction_scores(t: Tables, task: str) -> DataFrame:
    """(keys, k, r2, r2_full): R2 of tuned boosted trees on the k most important features of each seed and fold, and on all of them."""
    seeds, grid = tuple(spec.CV_SEEDS), tuned_grid(t, task)
    ranked = [n for n, _ in importances(t, task, max(REDUCTION_SIZES), spec.GRIDS["boosted_trees"])]
    source, inner_rows = task_vectors(t, task, seeds), task_inner(t, task, seeds)
    parts = []
    for key in sorted(tuple(r) for r in source.select(*KEYS).distinct().collect()):  # seeds x folds
        here = source.where((F.col("seed") == key[1]) & (F.col("fold") == key[2]))
        names = list(here.select("features").first()[0])
        keep = [names.index(n) for n in ranked if n in names]
        for k, at in (*((k, keep[:k]) for k in REDUCTION_SIZES), (0, list(range(len(names))))):
            if at:
                pred, chosen, _ = trees.tune_and_predict(_subset(here, task, at), inner_rows, "boosted_trees", [key], grid)
                if pred is None:
                    raise RuntimeError(f"{key}, {k} features: {chosen[0]['error']}")
                parts.append(write_stage(metrics.regression_metrics(pred, KEYS).select(*KEYS, F.lit(k).alias("k"), "r2"), "reduction"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where("k > 0").join(rows.where("k = 0").select(*KEYS, F.col("r2").alias("r2_full")), KEYS)


@query("feature_reduction_curve")
def feature_reduction_curve(t: Tables) -> DataFrame:
    """R2 of boosted trees on the k most important features against all of them, over the seeds and folds of four tasks.

    Features are ranked by tuned trees on the first fold; fits take the parameters most often chosen for the task.
    """
    there = {r[0] for r in Panel(t).train_summary.select("task_key").distinct().collect()}
    tasks_here = [task for task in REDUCTION_TASKS if task in there]
    shape = "task_key string, seed int, fold int, k int, r2 double, r2_full double"
    none = t.spark.createDataFrame([], shape)
    curve = reduce(DataFrame.unionByName, [staged(t.spark, t.version, f"reduction-{task}", lambda task=task: reduction_scores(t, task)) for task in tasks_here], none)
    return curve.groupBy("task_key", "k").agg(
        rnd(F.avg("r2")).alias("r2_mean"), rnd(F.percentile("r2", F.lit(0.025))).alias("ci_lo"), rnd(F.percentile("r2", F.lit(0.975))).alias("ci_hi"),
        rnd(F.avg(F.col("r2") - F.col("r2_full"))).alias("delta_r2"),
    )


#: (regime, horizon) of the tasks that are ablated on one fold, and what is reported by task type (1: higher is better).
ABLATED = [("baseline_multimodal", "V06"), ("baseline_multimodal", "V08"), ("baseline_plus_12m", "V08"), ("rolling", "V08")]
ABLATED_METRICS = {
    "regression": {"r2": 1, "spearman": 1, "mae": -1, "rmse": -1}, "ranking": {"spearman": 1, "kendall_tau": 1},
    "classification": {"mcc": 1, "balanced_accuracy": 1, "f1": 1},
}


def ablated_task(t: Tables, task: str, kind: str) -> DataFrame:
    """(task_key, dropped_modality, n_dropped_features, metric, sign, v) on fold 0; "(none)" is the full model. Every fit is tuned anew."""
    names, score = _names(t, task, 0), {"regression": metrics.regression_metrics, "ranking": metrics.ranking_metrics, "classification": metrics.classification_metrics}[kind]
    owner, model = [n.split("__")[0] for n in names], "boosted_trees_clf" if kind == "classification" else "boosted_trees"
    parts = []
    for modality in ["(none)", *sorted(set(owner))]:
        keep = [i for i, o in enumerate(owner) if o != modality]
        if not keep:
            continue
        pred, chosen, _ = tree_run(t, model, task, tree_grid(model), [0], _subset(task_vectors(t, task), task, keep))
        if pred is None:
            raise RuntimeError(f"{task} without {modality}: {chosen[0]['error']}")
        values = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(sign).alias("sign"), F.col(m).cast("double").alias("v")) for m, sign in ABLATED_METRICS[kind].items()])
        s = score(pred, KEYS).select("task_key", F.lit(modality).alias("dropped_modality"), F.lit(len(names) - len(keep)).alias("n_dropped_features"), F.inline(values))
        parts.append(write_stage(s, "ablated"))
    return reduce(DataFrame.unionByName, parts)


@query("ablation_single_fold")
def ablation_single_fold(t: Tables) -> DataFrame:
    """Fold 0 of the first seed: tuned boosted trees without one modality at a time, all tasks of four (regime, horizon); positive delta means dropping it hurts."""
    p = Panel(t)
    wanted = p.grid.where(F.concat_ws("|", "regime", "horizon").isin(["|".join(x) for x in ABLATED]))
    rows = wanted.join(p.train_summary.where((F.col("seed") == SEED) & (F.col("fold") == 0)), "task_key", "left_semi").orderBy("task_key").collect()
    shape = "task_key string, dropped_modality string, n_dropped_features int, metric string, sign int, v double"
    long = reduce(
        DataFrame.unionByName,
        [staged(t.spark, t.version, f"ablated-{r.task_key}", lambda r=r: ablated_task(t, r.task_key, r.task_type)) for r in rows], t.spark.createDataFrame([], shape),
    )
    full = long.where("dropped_modality = '(none)'").select("task_key", "metric", F.col("v").alias("full"))
    return long.where("dropped_modality <> '(none)'").join(full, ["task_key", "metric"]).select(
        "task_key", "dropped_modality", "n_dropped_features", "metric", rnd("full").alias("full"), rnd("v").alias("ablated"),
        rnd((F.col("full") - F.col("v")) * F.col("sign")).alias("delta"),
    )


def split_scores(t: Tables, tasks_here: list[str]) -> DataFrame:
    """(task_key, model, seed, fold, r2, spearman, mae) of all seven regression models on some tasks."""
    cols = ["task_key", "model", "seed", "fold", "r2", "spearman", "mae"]
    own = [fold_scores(t), mixed_scores(t), linear_scores(t)]
    own += [tree_scores(t, model, tasks_here) for model in ("random_forest", "boosted_trees")]
    return reduce(DataFrame.unionByName, [s.where(F.col("task_key").isin(tasks_here)).select(*cols) for s in own])


def ablation_rows(t: Tables) -> DataFrame:
    """A task of up to ``ABLATION_ROWS`` rows is one matrix for all seeds and folds; with a larger one, rows are normalised per fold."""

    def build() -> DataFrame:
        p = Panel(t)
        rows = p.dealt.where("task_type = 'regression'")
        if fold_ops.largest_task(rows) > ABLATION_ROWS:
            return linear.ablate_modalities(_regression_only(_continuous(t), t), inner(t))
        return linear.ablate_tasks(*raw_matrices(t, rows), spec.CV_SEEDS)

    return staged(t.spark, t.version, "ablation", build)


@query("ablation_per_fold")
def ablation_per_fold(t: Tables) -> DataFrame:
    a = ablation_rows(t)
    return a.select(*KEYS, "dropped_modality", "n_dropped_features", rnd("full_r2").alias("full_r2"), rnd("ablated_r2").alias("ablated_r2"), "alpha")


@query("ablation_per_fold_tests")
def ablation_per_fold_tests(t: Tables) -> DataFrame:
    tests = ablation_tests_from(ablation_rows(t))
    cols = ("observed_diff", "p_value", "p_adjusted", "cohens_d", "ci_lo", "ci_hi", "fold_change_pct")
    return tests.select("task_key", "dropped_modality", "n_folds", *[rnd(c).alias(c) for c in cols])


SENSITIVITY_TASKS = [f"{x}__{r}__V08" for x in ("order_total", "item_price", "item_quantity", "item_discount") for r in ("baseline_plus_12m", "rolling")]


@query("sensitivity_with_without_modality")
def sensitivity_with_without_modality(t: Tables) -> DataFrame:
    """Eight tasks rebuilt with the dose log as another modality: ridge R2 with, without, and their difference."""

    def build() -> DataFrame:
        p = Panel(t)
        doses = staged(t.spark, t.version, "doses", lambda: visit_doses(t).join(p.cohort, "entity_id", "left_semi"))
        dosed = p.panel.unionByName(doses.select(
            "entity_id", F.lit("dose").alias("modality"), "visit", F.lit("DOSE_TOTAL").alias("measure"), F.col("dose_total").alias("value")
        ))
        rows = p.dealt.where(F.col("task_key").isin(SENSITIVITY_TASKS))
        if fold_ops.largest_task(rows) <= ABLATION_ROWS:
            return linear.ablate_tasks(*raw_matrices(t, rows, dosed), spec.CV_SEEDS)
        grid = p.grid.where(F.col("task_key").isin(SENSITIVITY_TASKS))
        names = grid.select("target", "horizon").distinct()
        values = p.target_values.join(F.broadcast(names), ["target", "horizon"], "left_semi")
        features = staged(t.spark, t.version, "dose_features", lambda: tasks.task_features(dosed, p.static, grid, values))
        kept = F.broadcast(grid.select("task_key"))
        folds = Panel(t).all_folds.join(kept, "task_key", "left_semi").drop("task_type")
        counts = staged(t.spark, t.version, "dose_counts", lambda: normalise.training_counts(features, folds))
        stats = normalise.kept_stats(features, folds, normalise.fit(counts))
        dosed_rows = staged(t.spark, t.version, "dose_vectors", lambda: normalise.fold_vectors(features, folds, stats))
        return linear.ablate_modalities(dosed_rows, inner(t))

    rows = staged(t.spark, t.version, "dose_ablation", build).where("dropped_modality = 'dose'")
    locf = fold_scores(t).where(F.col("model") == "locf").select(*KEYS, F.col("r2").alias("locf_r2"))
    delta = F.avg("full_r2") - F.avg("ablated_r2")
    return rows.join(locf, KEYS).groupBy("task_key").agg(
        rnd(F.avg("full_r2")).alias("r2_with"), rnd(F.avg("ablated_r2")).alias("r2_without"), rnd(delta).alias("delta"), rnd(F.avg("locf_r2")).alias("locf_r2")
    )
