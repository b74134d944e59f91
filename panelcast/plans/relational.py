"""Joins, aggregations, pivots, windows, top-k and set operations over the panel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.functions import text
from panelcast.operators import asks, cleaning, reshape
from panelcast.operators.order_stats import average_ranks, exact_quantiles
from panelcast.plans.cleaning import (
    ASSAY_TESTS, CSF, PLASMA, SQL_ASSAY, SQL_ASSAY_WHERE, assay_rows, baseline_assays,
)
from panelcast.plans.panel import (
    SQL_FOLDS, SQL_GRID, SQL_PANEL, SQL_RAW, SQL_SCORES, SQL_TASKS, Panel,
    fold_scores, with_task,
)
from panelcast.plans.registry import query, rnd
from panelcast.sources.tables import Tables, clean_column_names

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# --- joins ------------------------------------------------------------------------


@query("inner_equi", f"""WITH {SQL_PANEL} SELECT b.entity_id, h.visit, b.measure, round(h.value - b.value, 4) AS delta
  FROM panel b JOIN panel h USING (entity_id, modality, measure) WHERE b.visit = 'BL' AND h.visit <> 'BL' AND modality = 'orders'""")
def inner_equi(t: Tables) -> DataFrame:
    p = Panel(t).panel.where("modality = 'orders'")
    bl = p.where("visit = 'BL'").select("entity_id", "measure", F.col("value").alias("bl"))
    later = p.where("visit <> 'BL'")
    return later.join(bl, ["entity_id", "measure"]).select(
        "entity_id", "visit", "measure", rnd(F.col("value") - F.col("bl"), 4).alias("delta")
    )


_BLOCKS = [("orders", "BL", "TOTAL"), ("orders", "V04", "TOTAL"), ("lineitem", "BL", "QUANTITY"), ("lineitem", "V06", "PRICE")]


@query("full_outer_chain", f"WITH {SQL_PANEL} SELECT entity_id, " + ", ".join(
    f"round(max(value) FILTER (modality = '{m}' AND visit = '{v}' AND measure = '{c}'), 4) AS {m}__{v}__{c}" for m, v, c in _BLOCKS
) + " FROM panel WHERE " + " OR ".join(f"(modality = '{m}' AND visit = '{v}' AND measure = '{c}')" for m, v, c in _BLOCKS) + " GROUP BY entity_id")
def full_outer_chain(t: Tables) -> DataFrame:
    """A chain of full outer joins is one union of long rows and one pivot."""
    names = ["__".join(b) for b in _BLOCKS]
    rows = Panel(t).panel.withColumn("feature", F.concat_ws("__", "modality", "visit", "measure"))
    wide = reshape.pivot_values(rows.where(F.col("feature").isin(names)), ["entity_id"], "feature", names)
    return wide.select("entity_id", *[rnd(n, 4).alias(n) for n in names])


@query("left_equi", f"WITH {SQL_RAW} SELECT r.order_id, coalesce(s.q, 0.0) AS total_quantity FROM raw_orders r LEFT JOIN (SELECT order_id, sum(QUANTITY) q FROM raw_items GROUP BY 1) s USING (order_id)")
def left_equi(t: Tables) -> DataFrame:
    items = t.scan("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").alias("q"))
    spine = t.scan("orders").select(F.col("o_orderkey").alias("order_id"))
    return spine.join(items, "order_id", "left").select("order_id", F.coalesce("q", F.lit(0.0)).alias("total_quantity"))


_SQL_LOG = """log AS (SELECT o.o_custkey AS entity_id, l_orderkey, l_linenumber, year(l_shipdate) * 100 + month(l_shipdate) AS start_ym,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE year(l_shipdate + to_months(l_linenumber)) * 100 + month(l_shipdate + to_months(l_linenumber)) END AS stop_ym,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS dose, CASE WHEN l_returnflag = 'R' THEN l_discount END AS factor
  FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey)"""
_SQL_VISITS = f"""{SQL_RAW}, visits AS (SELECT entity_id, event_id AS visit, CAST(trunc(median(year(o_orderdate) * 100 + month(o_orderdate))) AS INT) AS visit_ym
  FROM raw_orders WHERE event_id <> 'SC' GROUP BY ALL)"""


def interval_log(t: Tables) -> DataFrame:
    """Line items as a dose log: shipped month to shipped month + line number, open for status O."""
    ship = F.col("l_shipdate")
    stop = F.add_months(ship, F.col("l_linenumber"))

    def ym(d):
        return F.year(d) * 100 + F.month(d)

    orders = t.scan("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity_id"))
    flag = F.col("l_returnflag")
    return t.scan("lineitem").join(orders, "l_orderkey").select(
        "entity_id", "l_orderkey", "l_linenumber", ym(ship).alias("start_ym"),
        F.when(F.col("l_linestatus") != "O", ym(stop)).alias("stop_ym"),
        F.when(flag != "R", F.col("l_quantity")).alias("dose"), F.when(flag == "R", F.col("l_discount")).alias("factor"),
    )


def visit_dates(t: Tables) -> DataFrame:
    rows = Panel(t).raw_orders.where("event_id <> 'SC'")
    ym = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("double")
    dated = rows.select("entity_id", F.col("event_id").alias("visit"), ym.alias("ym"))
    med = exact_quantiles(dated, ["entity_id", "visit"], "ym", {"m": 0.5})
    return med.select("entity_id", "visit", F.floor("m").cast("int").alias("visit_ym"))


_ACTIVE = "start_ym <= visit_ym AND (stop_ym IS NULL OR stop_ym >= visit_ym)"


@query("interval_active_join", f"WITH {_SQL_VISITS}, {_SQL_LOG} SELECT v.entity_id, v.visit, l_orderkey, l_linenumber, count(*) AS n FROM visits v JOIN log USING (entity_id) WHERE {_ACTIVE} GROUP BY ALL")
def interval_active_join(t: Tables) -> DataFrame:
    rows = reshape.active_intervals(visit_dates(t), interval_log(t), ["entity_id"])
    return rows.groupBy("entity_id", "visit", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("semi_in_set", f"WITH {SQL_PANEL} SELECT DISTINCT entity_id FROM panel WHERE visit = 'BL' AND entity_id IN (SELECT entity_id FROM panel WHERE visit = 'V08')")
def semi_in_set(t: Tables) -> DataFrame:
    p = Panel(t).panel
    return p.where("visit = 'BL'").select("entity_id").distinct().join(p.where("visit = 'V08'"), "entity_id", "left_semi")


@query("anti_not_in_set", f"WITH {SQL_PANEL} SELECT DISTINCT entity_id FROM panel WHERE visit = 'BL' AND entity_id NOT IN (SELECT entity_id FROM panel WHERE visit = 'V08')")
def anti_not_in_set(t: Tables) -> DataFrame:
    p = Panel(t).panel
    return p.where("visit = 'BL'").select("entity_id").distinct().join(p.where("visit = 'V08'"), "entity_id", "left_anti")


def paired_folds(scores: DataFrame, a: str, b: str, metrics=("r2", "spearman")) -> DataFrame:
    """Model a beside model b on (task, seed, fold): one conditional aggregate instead of a self-join."""
    keys = ["task_key", "seed", "fold"]
    cols = []
    for m in metrics:
        cols += [F.max(F.when(F.col("model") == n, F.col(m))).alias(f"{m}_{s}") for n, s in ((a, "a"), (b, "b"))]
    both = F.count_if(F.col("model").isin(a, b)).alias("_n")
    rows = scores.groupBy(*keys).agg(*cols, both).where("_n = 2").drop("_n")
    enough = rows.groupBy("task_key").count().where("count >= 3").select("task_key")
    return rows.join(enough, "task_key", "left_semi")


@query("paired_fold_join", f"""WITH {SQL_SCORES} SELECT a.task_key, a.seed, a.fold, round(a.r2 - b.r2, 6) + 0.0 AS r2_diff, round(a.spearman - b.spearman, 6) + 0.0 AS spearman_diff
  FROM scores a JOIN scores b USING (task_key, seed, fold) WHERE a.model = 'locf' AND b.model = 'population_mean'""")
def paired_fold_join(t: Tables) -> DataFrame:
    rows = paired_folds(fold_scores(t), "locf", "population_mean")
    diffs = [rnd(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_diff") for m in ("r2", "spearman")]
    return rows.select("task_key", "seed", "fold", *diffs)


@query("fold_lookup_join", f"""WITH {SQL_SCORES} SELECT a.task_key, a.seed, a.fold, round(a.r2, 6) + 0.0 AS ablated_r2, round(f.r2, 6) + 0.0 AS full_r2
  FROM scores a JOIN scores f USING (task_key, seed, fold) WHERE a.model = 'population_mean' AND f.model = 'locf' AND f.r2 IS NOT NULL""")
def fold_lookup_join(t: Tables) -> DataFrame:
    keys = ["task_key", "seed", "fold"]
    s = fold_scores(t)
    full = s.where("model = 'locf' and r2 is not null").select(*keys, rnd("r2").alias("full_r2"))
    return s.where("model = 'population_mean'").select(*keys, rnd("r2").alias("ablated_r2")).join(full, keys)


@query("pair_theta_self_join", f"""WITH {SQL_SCORES}, m AS (SELECT task_key, model, avg(r2) AS r2 FROM scores GROUP BY ALL)
  SELECT a.task_key, a.model AS model_a, b.model AS model_b, round(a.r2 - b.r2, 6) + 0.0 AS d FROM m a JOIN m b ON a.task_key = b.task_key AND a.model < b.model""")
def pair_theta_self_join(t: Tables) -> DataFrame:
    m = fold_scores(t).groupBy("task_key", "model").agg(F.avg("r2").alias("r2"))
    a = m.select("task_key", F.col("model").alias("model_a"), F.col("r2").alias("ra"))
    b = m.select("task_key", F.col("model").alias("model_b"), F.col("r2").alias("rb"))
    both = a.join(b, "task_key").where("model_a < model_b")
    return both.select("task_key", "model_a", "model_b", rnd(F.col("ra") - F.col("rb")).alias("d"))


@query("grid_cross_join", f"WITH {SQL_PANEL}, {SQL_GRID} SELECT g.task_key, count(p.entity_id) AS n_rows FROM grid g LEFT JOIN panel p ON p.modality = g.target_modality AND p.measure = g.target_measure AND p.visit = g.horizon GROUP BY 1")
def grid_cross_join(t: Tables) -> DataFrame:
    p = Panel(t)
    sizes = p.panel.groupBy("modality", "measure", "visit").agg(F.count("entity_id").alias("n"))
    g = p.grid.select("task_key", F.col("target_modality").alias("modality"), F.col("target_measure").alias("measure"), F.col("horizon").alias("visit"))
    return g.join(sizes, ["modality", "measure", "visit"], "left").select("task_key", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("history_visit_join", f"WITH {SQL_PANEL}, {SQL_GRID} SELECT v.task_key, v.visit, count(*) AS n_values FROM task_visits v JOIN panel p ON p.visit = v.visit AND (v.multimodal OR p.modality = v.target_modality) GROUP BY ALL")
def history_visit_join(t: Tables) -> DataFrame:
    from panelcast.operators.tasks import history_visits

    p = Panel(t)
    sizes = p.panel.groupBy("modality", "visit").agg(F.count(F.lit(1)).alias("n"))
    rows = history_visits(p.grid).join(sizes, "visit").where(F.col("multimodal") | (F.col("modality") == F.col("target_modality")))
    return rows.groupBy("task_key", "visit").agg(F.sum("n").alias("n_values"))


@query("target_block_align", f"WITH {SQL_PANEL} SELECT entity_id, " + ", ".join(
    f"round(max(value) FILTER (measure = '{m}'), 4) AS {m}" for m in ["TOTAL", "QUANTITY", "PRICE"]) + " FROM panel WHERE visit = 'BL' AND measure IN ('TOTAL', 'QUANTITY', 'PRICE') GROUP BY entity_id")
def target_block_align(t: Tables) -> DataFrame:
    names = ["TOTAL", "QUANTITY", "PRICE"]
    rows = Panel(t).panel.where("visit = 'BL'").where(F.col("measure").isin(names))
    wide = reshape.pivot_values(rows, ["entity_id"], "measure", names)
    return wide.select("entity_id", *[rnd(n, 4).alias(n) for n in names])


@query("concept_intersection", f"""WITH {SQL_SCORES}, g AS (SELECT task_key, avg(r2) FILTER (model = 'locf') - avg(r2) FILTER (model = 'population_mean') AS r2_gap,
  avg(spearman) FILTER (model = 'locf') - avg(spearman) FILTER (model = 'population_mean') AS rho_gap FROM scores GROUP BY 1)
SELECT task_key, round(r2_gap, 6) + 0.0 AS r2_gap, round(rho_gap, 6) + 0.0 AS rho_gap FROM g WHERE r2_gap IS NOT NULL AND rho_gap IS NOT NULL""")
def concept_intersection(t: Tables) -> DataFrame:
    s = fold_scores(t)

    def gap(m: str) -> DataFrame:
        mean = {n: F.avg(F.when(F.col("model") == n, F.col(m))) for n in ("locf", "population_mean")}
        out = s.groupBy("task_key").agg((mean["locf"] - mean["population_mean"]).alias("g"))
        return out.where("g is not null")

    r2 = gap("r2").select("task_key", rnd("g").alias("r2_gap"))
    return r2.join(gap("spearman").select("task_key", rnd("g").alias("rho_gap")), "task_key")


# --- aggregations and pivots ------------------------------------------------------


@query("median_dedup", f"WITH {SQL_PANEL} SELECT entity_id, visit, measure, round(value, 4) AS value FROM panel")
def median_dedup(t: Tables) -> DataFrame:
    return Panel(t).panel.select("entity_id", "visit", "measure", rnd("value", 4).alias("value"))


@query("mixed_dedup", f"""WITH {SQL_RAW} SELECT entity_id, event_id, min_by(state, order_id) FILTER (state IS NOT NULL) AS state,
  round(median(TOTAL), 4) AS TOTAL, round(median(PRIORITY), 4) AS PRIORITY, round(median(year(o_orderdate)), 4) AS o_orderdate FROM raw_orders GROUP BY entity_id, event_id""")
def mixed_dedup(t: Tables) -> DataFrame:
    """Orders as a wide text extract; a date parses by its first number, the year."""
    text_columns = {c: F.col(c).cast("string") for c in ("PRIORITY", "o_orderdate")}
    out = reshape.mixed_dedup(Panel(t).raw_orders.withColumns(text_columns), ["entity_id", "event_id"], "order_id")
    return out.select("entity_id", "event_id", "state", *[rnd(c, 4).alias(c) for c in ("TOTAL", "PRIORITY", "o_orderdate")])


@query("age_dedup", f"WITH {SQL_RAW} SELECT entity_id, event_id, round_even(avg(PRIORITY + 0.5), 1) + 0.0 AS mean_age, min_by(state, order_id) FILTER (state IS NOT NULL) AS state, count(*) > 1 AS is_dup FROM raw_orders GROUP BY entity_id, event_id")
def age_dedup(t: Tables) -> DataFrame:
    """Mean of parsed age text with one digit, ties to the even one; the text is the priority number with a decimal comma."""
    age = text.loose_number(F.concat(F.col("PRIORITY").cast("int").cast("string"), F.lit(",5 y")))
    return Panel(t).raw_orders.groupBy("entity_id", "event_id").agg(
        (F.bround(F.avg(age), 1) + F.lit(0.0)).alias("mean_age"),
        F.min_by("state", F.when(F.col("state").isNotNull(), F.col("order_id"))).alias("state"),
        (F.count(F.lit(1)) > 1).alias("is_dup"),
    )


def weekly_events(t: Tables) -> DataFrame:
    """Events as a long assay: entity = user, visit = week of the month, code = event type."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    return t.scan("events").select(F.col("user_id").alias("entity_id"), week.alias("week"), F.col("event_type").alias("feature"), "value")


@query("long_to_wide", "SELECT user_id AS entity_id, CAST(floor((day(ts) - 1) / 7) AS INT) AS week, " + ", ".join(
    f"round(median(value) FILTER (event_type = '{e}'), 4) AS {e}" for e in EVENT_TYPES) + " FROM events GROUP BY 1, 2")
def long_to_wide(t: Tables) -> DataFrame:
    """One column per event type that occurs."""
    keys = ["entity_id", "week"]
    events = weekly_events(t)
    names = reshape.observed_names(events, "feature")
    med = reshape.median_per(events, [*keys, "feature"])
    wide = reshape.pivot_values(med, keys, "feature", names)
    return wide.select(*keys, *[rnd(e, 4).alias(e) for e in names])


@query("code_list_columns", "SELECT user_id AS entity_id, CAST(floor((day(ts) - 1) / 7) AS INT) AS week, " + ", ".join(
    f"round(median(value) FILTER (event_type = '{e}'), 4) AS {e}" for e in ("click", "purchase", "view")) + " FROM events GROUP BY 1, 2")
def code_list_columns(t: Tables) -> DataFrame:
    """The code list on a wide table: wanted columns stay."""
    return cleaning.keep_codes(long_to_wide(t), ["entity_id", "week"], ["Cli-ck", "VIEW ", "purchase"], "code")


def assay_pivot(t: Tables, kind: str, parse) -> DataFrame:
    rows = baseline_assays(assay_rows(t), kind, ASSAY_TESTS).withColumn("value", parse(F.col("raw")))
    med = reshape.median_per(rows, ["entity_id", "test"])
    wide = clean_column_names(reshape.pivot_values(med, ["entity_id"], "test", ASSAY_TESTS))
    names = [c for c in wide.columns if c != "entity_id"]
    return wide.select("entity_id", *[rnd(c, 4).alias(c) for c in names])


@query("assay_pivot_baseline", f"WITH {SQL_ASSAY}, v AS (SELECT entity_id, test, TRY_CAST(raw AS DOUBLE) AS v FROM assay WHERE {SQL_ASSAY_WHERE}) SELECT entity_id, round(median(v) FILTER (test = 'NFL'), 4) AS NFL, round(median(v) FILTER (test = 'CSF Alpha-synuclein'), 4) AS CSF_Alpha_synuclein FROM v WHERE v IS NOT NULL GROUP BY entity_id")
def assay_pivot_baseline(t: Tables) -> DataFrame:
    return assay_pivot(t, CSF, text.to_number)


@query("assay_pivot_lod", f"WITH {SQL_ASSAY}, v AS (SELECT entity_id, test, CASE WHEN raw LIKE '<%' THEN CAST(substr(raw, 2) AS DOUBLE) / sqrt(2.0) ELSE CAST(raw AS DOUBLE) END AS v FROM assay WHERE {SQL_ASSAY_WHERE.replace('CSF|Cerebrospinal', 'Plasma')}) SELECT entity_id, round(median(v) FILTER (test = 'NFL'), 4) AS NFL, round(median(v) FILTER (test = 'CSF Alpha-synuclein'), 4) AS CSF_Alpha_synuclein FROM v GROUP BY entity_id")
def assay_pivot_lod(t: Tables) -> DataFrame:
    return assay_pivot(t, PLASMA, text.lod_number)


@query("visit_date_median", f"WITH {_SQL_VISITS} SELECT * FROM visits")
def visit_date_median(t: Tables) -> DataFrame:
    return visit_dates(t)


def visit_doses(t: Tables) -> DataFrame:
    visits = visit_dates(t)
    active = reshape.active_intervals(visits, interval_log(t), ["entity_id"])
    sums = reshape.dose_totals(active, ["entity_id", "visit"], F.col("dose"), F.col("factor"))
    rows = visits.select("entity_id", "visit").join(sums, ["entity_id", "visit"], "left")
    return rows.select("entity_id", "visit", (F.coalesce("ld_numeric", F.lit(0.0)) + F.coalesce("formula_contrib", F.lit(0.0))).alias("dose_total"))


@query("dose_two_pass_sum", f"""WITH {_SQL_VISITS}, {_SQL_LOG}, a AS (SELECT v.entity_id, v.visit, coalesce(sum(dose), 0) AS s, coalesce(sum(factor), 0) AS f FROM visits v JOIN log USING (entity_id) WHERE {_ACTIVE} GROUP BY ALL)
SELECT v.entity_id, v.visit, round(coalesce(s, 0) + coalesce(s * f, 0), 6) AS dose_total FROM visits v LEFT JOIN a USING (entity_id, visit)""")
def dose_two_pass_sum(t: Tables) -> DataFrame:
    return visit_doses(t).select("entity_id", "visit", rnd("dose_total").alias("dose_total"))


_REG = [x for x in spec.ORDER_TARGETS if x.task_type == "regression"]


def _reg_targets(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x.name, x.domain, x.modality, x.measure) for x in _REG], "target string, domain string, modality string, measure string")


_SQL_REG = "reg(target, domain, modality, measure) AS (VALUES " + ", ".join(f"('{x.name}', '{x.domain}', '{x.modality}', '{x.measure}')" for x in _REG) + ")"


def availability(t: Tables) -> DataFrame:
    """Counts per target and visit, zero where nothing was measured."""
    cal = spec.calendar(t.spark).withColumn("k", F.lit(1))
    grid = _reg_targets(t).withColumn("k", F.lit(1)).join(cal, "k")
    n = Panel(t).panel.groupBy("modality", "measure", "visit").agg(F.count("value").alias("n"))
    rows = grid.join(n, ["modality", "measure", "visit"], "left")
    return rows.select("target", "domain", "visit", "months", F.coalesce("n", F.lit(0)).alias("n_available"))


_SQL_AVAIL = f"""{SQL_PANEL}, {_SQL_REG}, avail AS (SELECT r.target, r.domain, c.visit, c.months, count(p.value) AS n_available
  FROM reg r CROSS JOIN calendar c LEFT JOIN panel p ON p.modality = r.modality AND p.measure = r.measure AND p.visit = c.visit GROUP BY ALL)"""


@query("target_availability", f"WITH {_SQL_AVAIL} SELECT * FROM avail")
def target_availability(t: Tables) -> DataFrame:
    return availability(t)


@query("availability_matrix", f"WITH {_SQL_AVAIL} SELECT target, " + ", ".join(f"max(n_available) FILTER (visit = '{v}') AS {v}" for v in spec.VISIT_ORDER) + " FROM avail GROUP BY target")
def availability_matrix(t: Tables) -> DataFrame:
    return availability(t).groupBy("target").pivot("visit", spec.VISIT_ORDER).agg(F.max("n_available"))


def target_context(t: Tables) -> DataFrame:
    keys, p = ["task_key", "seed", "fold"], Panel(t)
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    if p.side_by_side:
        rows = asks.target_spread(p.dealt_asks, p.asks, spec.CV_SEEDS, probs)
        return rows.withColumn("mean", F.round("sum", 4) / F.col("n")).select(*keys, "mean", "std", "range", *probs)
    y = p.folds("regression")
    q = exact_quantiles(y, keys, "y", probs)
    m = y.groupBy(*keys).agg((F.round(F.sum("y"), 4) / F.count("y")).alias("mean"), F.stddev_pop("y").alias("std"), (F.max("y") - F.min("y")).alias("range"))
    return m.join(q, keys)


@query("target_variance_context", f"""WITH {SQL_FOLDS} SELECT task_key, seed, fold, round(round(sum(y), 4) / count(y), 6) AS target_mean, round(stddev_pop(y), 4) AS target_std, round(median(y), 6) AS target_median,
  round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 6) AS target_iqr, round(max(y) - min(y), 6) AS target_range FROM folds WHERE task_type = 'regression' GROUP BY ALL""")
def target_variance_context(t: Tables) -> DataFrame:
    c = target_context(t)
    cols = {"target_mean": F.col("mean"), "target_std": F.col("std"), "target_median": F.col("median"), "target_iqr": F.col("q75") - F.col("q25"), "target_range": F.col("range")}
    return c.select("task_key", "seed", "fold", *[rnd(e, 4 if n == "target_std" else 6).alias(n) for n, e in cols.items()])


@query("univariate_distribution", f"""WITH {SQL_PANEL}, {_SQL_REG} SELECT target, visit, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median,
  round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr,
  round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurtosis, round(min(value), 4) AS "min", round(max(value), 4) AS "max"
  FROM reg JOIN panel USING (modality, measure) GROUP BY target, visit HAVING count(*) >= 10""")
def univariate_distribution(t: Tables) -> DataFrame:
    keys = ["target", "visit"]
    rows = Panel(t).panel.join(F.broadcast(_reg_targets(t)), ["modality", "measure"])
    q = exact_quantiles(rows, keys, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    v, n = F.col("value"), F.count("value")
    skew = F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6)
    # The size filter sits inside the expressions, so tiny groups never divide by zero.
    m = rows.groupBy(*keys).agg(
        n.alias("n"), rnd(F.avg(v), 4).alias("mean"), rnd(F.stddev_pop(v), 4).alias("std"),
        F.when(n >= 10, rnd(skew, 4)).alias("skew"), F.when(n >= 10, rnd(kurt, 4)).alias("kurtosis"),
        rnd(F.min(v), 4).alias("min"), rnd(F.max(v), 4).alias("max"),
    ).where("n >= 10")
    return m.join(q, keys).select(
        *keys, "n", "mean", "std", rnd("median", 4).alias("median"), rnd("q25", 4).alias("q25"), rnd("q75", 4).alias("q75"),
        rnd(F.col("q75") - F.col("q25"), 4).alias("iqr"), "skew", "kurtosis", "min", "max",
    )


_TRAJ = [(x, v) for x in _REG for v in spec.VISIT_ORDER]


@query("horizon_trajectories", f"WITH {SQL_PANEL} SELECT entity_id, " + ", ".join(
    f"round(avg(value) FILTER (modality = '{x.modality}' AND measure = '{x.measure}' AND visit = '{v}'), 4) AS {x.name}__{v}" for x, v in _TRAJ) + " FROM panel GROUP BY entity_id")
def horizon_trajectories(t: Tables) -> DataFrame:
    rows = Panel(t).panel
    hit = lambda x, v: (F.col("modality") == x.modality) & (F.col("measure") == x.measure) & (F.col("visit") == v)
    return rows.groupBy("entity_id").agg(*[rnd(F.avg(F.when(hit(x, v), F.col("value"))), 4).alias(f"{x.name}__{v}") for x, v in _TRAJ])


def split_stability(scores: DataFrame) -> DataFrame:
    mean, std = F.avg("r2"), F.stddev_samp("r2")
    return scores.groupBy("task_key", "model").agg(
        F.count(F.lit(1)).alias("n"), rnd(mean).alias("r2_mean"), rnd(std).alias("r2_std"),
        rnd(F.when(F.abs(mean) > 1e-10, std / F.abs(mean)), 4).alias("r2_cv"),
        rnd(F.avg("spearman")).alias("spearman_mean"), rnd(F.avg("mae"), 3).alias("mae_mean"),
    )


@query("split_stability", f"""WITH {SQL_SCORES} SELECT task_key, model, count(*) AS n, round(avg(r2), 6) + 0.0 AS r2_mean, round(stddev_samp(r2), 6) + 0.0 AS r2_std,
  round(CASE WHEN abs(avg(r2)) > 1e-10 THEN stddev_samp(r2) / abs(avg(r2)) END, 4) + 0.0 AS r2_cv, round(avg(spearman), 6) + 0.0 AS spearman_mean, round(avg(mae), 3) AS mae_mean FROM scores GROUP BY ALL""")
def split_stability_query(t: Tables) -> DataFrame:
    return split_stability(fold_scores(t))


@query("ablation_fold_change", f"""WITH {SQL_SCORES}, m AS (SELECT task_key, avg(r2) FILTER (model = 'locf') AS f, avg(r2) FILTER (model = 'population_mean') AS a FROM scores GROUP BY 1)
SELECT task_key, round(f, 6) + 0.0 AS mean_full_r2, round(a, 6) + 0.0 AS mean_ablated_r2, round(CASE WHEN abs(f) > 1e-6 THEN 100.0 * (a - f) / f END, 4) + 0.0 AS fold_change_pct FROM m""")
def ablation_fold_change(t: Tables) -> DataFrame:
    full, abl = (F.avg(F.when(F.col("model") == m, F.col("r2"))) for m in ("locf", "population_mean"))
    m = fold_scores(t).groupBy("task_key").agg(full.alias("f"), abl.alias("a"))
    change = F.when(F.abs("f") > 1e-6, 100.0 * (F.col("a") - F.col("f")) / F.col("f"))
    return m.select("task_key", rnd("f").alias("mean_full_r2"), rnd("a").alias("mean_ablated_r2"), rnd(change, 4).alias("fold_change_pct"))


@query("distinct_counts", f"""WITH {SQL_TASKS} SELECT task_key, count(DISTINCT entity_id) AS n_patients, count(DISTINCT visit) AS n_visits, count(DISTINCT feature) AS n_features,
  round(sum(y) FILTER (task_type = 'classification') / count(*), 6) AS prevalence FROM features JOIN grid USING (task_key) GROUP BY task_key""")
def distinct_counts(t: Tables) -> DataFrame:
    p = Panel(t)
    clf = F.sum(F.when(F.col("task_type") == "classification", F.col("y_sum")))
    cells = with_task(p.feature_cells, t).groupBy("task_key").agg(
        F.countDistinct("visit").alias("n_visits"), F.count(F.lit(1)).alias("n_features"), rnd(clf / F.sum("n")).alias("prevalence")
    )
    sizes = p.members.groupBy("task_key").agg(F.count(F.lit(1)).alias("n_patients"))
    return sizes.join(F.broadcast(cells), "task_key").select("task_key", "n_patients", "n_visits", "n_features", "prevalence")  # a row per task


# --- windows, ranks, top-k, sets --------------------------------------------------


def _deltas(t: Tables) -> DataFrame:
    from panelcast.operators.tasks import baseline_change

    p = Panel(t)
    wanted = t.spark.createDataFrame([("orders", "TOTAL")], "modality string, measure string")
    return baseline_change(p.panel, wanted).select("entity_id", "visit", F.round("delta", 6).alias("delta"))


_SQL_DELTA = f"""{SQL_PANEL}, d AS (SELECT h.entity_id, h.visit, round(h.value - b.value, 6) AS delta FROM panel b JOIN panel h USING (entity_id, modality, measure)
  WHERE b.visit = 'BL' AND h.visit <> 'BL' AND modality = 'orders' AND measure = 'TOTAL')"""


@query("average_rank", f"WITH {_SQL_DELTA} SELECT entity_id, visit, rank() OVER (PARTITION BY visit ORDER BY delta) + (count(*) OVER (PARTITION BY visit, delta) - 1) / 2.0 AS rnk FROM d")
def average_rank(t: Tables) -> DataFrame:
    d = _deltas(t)
    return d.join(average_ranks(d, ["visit"], "delta", "rnk").drop("n"), ["visit", "delta"]).select("entity_id", "visit", "rnk")


@query("group_min_filter", f"WITH {SQL_RAW} SELECT order_id, entity_id, event_id, PRIORITY FROM raw_orders QUALIFY PRIORITY = min(PRIORITY) OVER (PARTITION BY entity_id, event_id)")
def group_min_filter(t: Tables) -> DataFrame:
    rows = Panel(t).raw_orders.select("order_id", "entity_id", "event_id", "PRIORITY")
    best = rows.groupBy("entity_id", "event_id").agg(F.min("PRIORITY").alias("PRIORITY"))
    return rows.join(best, ["entity_id", "event_id", "PRIORITY"], "left_semi")


@query("first_per_key_sorted", f"WITH {SQL_RAW} SELECT entity_id, event_id, order_id, TOTAL FROM raw_orders QUALIFY row_number() OVER (PARTITION BY entity_id, event_id ORDER BY TOTAL, order_id) = 1")
def first_per_key_sorted(t: Tables) -> DataFrame:
    rows = Panel(t).raw_orders.select("entity_id", "event_id", "order_id", "TOTAL")
    return cleaning.first_per_key(rows, ["entity_id", "event_id"], F.col("TOTAL"), F.col("order_id"))


@query("lag_increase_flag", f"""WITH {SQL_SCORES}, m AS (SELECT target, regime, horizon_months, model, avg(r2) AS r2 FROM scores JOIN grid USING (task_key) GROUP BY ALL),
  l AS (SELECT *, lag(r2) OVER w AS prev, lag(horizon_months) OVER w AS from_months FROM m WINDOW w AS (PARTITION BY target, regime, model ORDER BY horizon_months))
SELECT target, regime, model, from_months, horizon_months AS to_months, round(r2 - prev, 6) + 0.0 AS r2_change, r2 > prev + 0.05 AS flagged FROM l WHERE prev IS NOT NULL""")
def lag_increase_flag(t: Tables) -> DataFrame:
    return horizon_changes(fold_scores(t), t)


def horizon_changes(scores: DataFrame, t: Tables) -> DataFrame:
    m = with_task(scores, t).groupBy("target", "regime", "horizon_months", "model").agg(F.avg("r2").alias("r2"))
    w = Window.partitionBy("target", "regime", "model").orderBy("horizon_months")
    m = m.withColumn("prev", F.lag("r2").over(w)).withColumn("from_months", F.lag("horizon_months").over(w))
    return m.where("prev is not null").select(
        "target", "regime", "model", "from_months", F.col("horizon_months").alias("to_months"),
        rnd(F.col("r2") - F.col("prev")).alias("r2_change"), (F.col("r2") > F.col("prev") + 0.05).alias("flagged"),
    )


@query("topk_per_group", f"WITH {SQL_RAW} SELECT entity_id, order_id, TOTAL, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY TOTAL DESC, order_id) AS INT) AS rnk FROM raw_orders QUALIFY rnk <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    """Spark keeps only the k best rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("TOTAL"), "order_id")
    rows = Panel(t).raw_orders.select("entity_id", "order_id", "TOTAL").withColumn("rnk", F.row_number().over(w))
    return rows.where("rnk <= 3")


@query("order_by_group_mean", f"WITH {SQL_SCORES}, m AS (SELECT target, avg(r2) AS r2 FROM scores JOIN grid USING (task_key) WHERE model = 'locf' GROUP BY 1) SELECT target, round(r2, 6) AS mean_r2, CAST(rank() OVER (ORDER BY r2 DESC) AS INT) AS position FROM m")
def order_by_group_mean(t: Tables) -> DataFrame:
    m = with_task(fold_scores(t).where("model = 'locf'"), t).groupBy("target").agg(F.avg("r2").alias("r2"))
    # One row per target of the specification, so one task may order them.
    return m.select("target", rnd("r2").alias("mean_r2"), F.rank().over(Window.orderBy(F.desc("r2"))).alias("position"))


@query("first_per_group", f"WITH {SQL_SCORES} SELECT target, min(task_key) AS first_task, min_by(regime, task_key) AS regime FROM scores JOIN grid USING (task_key) GROUP BY target")
def first_per_group(t: Tables) -> DataFrame:
    return with_task(fold_scores(t), t).groupBy("target").agg(F.min("task_key").alias("first_task"), F.min_by("regime", "task_key").alias("regime"))


@query("limit_n", f"WITH {SQL_TASKS}, m AS (SELECT task_key, count(*) AS n_total FROM tt GROUP BY 1) SELECT * FROM m ORDER BY n_total DESC, task_key LIMIT 20")
def limit_n(t: Tables) -> DataFrame:
    m = Panel(t).targets.groupBy("task_key").agg(F.count(F.lit(1)).alias("n_total"))
    return m.orderBy(F.desc("n_total"), "task_key").limit(20)


@query("union_all_by_name", "SELECT c_custkey AS id, c_acctbal AS balance, CAST(NULL AS INT) AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def union_all_by_name(t: Tables) -> DataFrame:
    a = t.scan("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.scan("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_rows", f"WITH {SQL_RAW} SELECT DISTINCT entity_id, event_id FROM raw_orders")
def distinct_rows(t: Tables) -> DataFrame:
    return Panel(t).raw_orders.select("entity_id", "event_id").distinct()


def _ids(t: Tables, event: str) -> DataFrame:
    return Panel(t).raw_orders.where(F.col("event_id") == event).select("entity_id")


@query("intersect_ids", f"WITH {SQL_RAW} SELECT entity_id FROM raw_orders WHERE event_id = 'BL' INTERSECT SELECT entity_id FROM raw_orders WHERE event_id = 'SC'")
def intersect_ids(t: Tables) -> DataFrame:
    return _ids(t, "BL").intersect(_ids(t, "SC"))


@query("except_ids", f"WITH {SQL_RAW} SELECT entity_id FROM raw_orders WHERE event_id = 'SC' EXCEPT SELECT entity_id FROM raw_orders WHERE event_id = 'BL'")
def except_ids(t: Tables) -> DataFrame:
    return _ids(t, "SC").subtract(_ids(t, "BL"))


@query("scalar_function_suite", """SELECT l_orderkey, l_linenumber, upper(trim(l_returnflag)) || '__' || l_linestatus AS code, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS padded,
  round(sqrt(abs(l_quantity - 25)), 6) AS root, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS up, greatest(least(l_quantity, 40), 10) AS clipped,
  coalesce(nullif(l_tax, 0), -1) AS tax, CAST(floor(l_quantity / 7) AS BIGINT) AS month_part, split_part(l_returnflag || '__' || l_linestatus, '__', 2) AS part2,
  (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT AS bin, starts_with(l_returnflag, 'R') AS returned FROM lineitem""")
def scalar_function_suite(t: Tables) -> DataFrame:
    q, flag, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    code = F.concat_ws("__", flag, status)
    return t.scan("lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("__", F.upper(F.trim(flag)), status).alias("code"),
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("padded"), rnd(F.sqrt(F.abs(q - 25))).alias("root"),
        F.ceil(F.col("l_extendedprice") / 1000).alias("up"), F.greatest(F.least(q, F.lit(40.0)), F.lit(10.0)).alias("clipped"),
        F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.lit(-1.0)).alias("tax"), F.floor(q / 7).alias("month_part"),
        F.split(code, "__")[1].alias("part2"), sum((q >= e).cast("int") for e in (10, 20, 30)).alias("bin"),
        flag.startswith("R").alias("returned"),
    )


@query("json_params", """SELECT l_orderkey, l_linenumber, to_json({'disc': CAST(l_discount AS VARCHAR), 'line': CAST(l_linenumber AS VARCHAR)}) AS params FROM lineitem""")
def json_params(t: Tables) -> DataFrame:
    p = F.struct(F.col("l_discount").cast("string").alias("disc"), F.col("l_linenumber").cast("string").alias("line"))
    packed = F.to_json(p)
    back = F.from_json(packed, "map<string,string>")
    return t.scan("lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.map_filter(back, lambda k, v: k != "n_jobs")).alias("params"))
