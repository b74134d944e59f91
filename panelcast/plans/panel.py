"""The star-schema tables seen as a longitudinal panel, with the same definitions in SQL.

entity = customer, visit = order year (1995 is split into screening and baseline),
modalities = orders (state filtered) and lineitem, static data = customer columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.functions.text import simple_visit
from panelcast.models import naive
from panelcast.operators import folds as fold_ops
from panelcast.operators import asks as ask_ops
from panelcast.operators import cleaning, metrics, reshape, tasks
from panelcast.sources.stage import staged
from panelcast.sources.tables import Tables

ORDER_MEASURES = ["TOTAL", "PRIORITY"]
ITEM_MEASURES = ["QUANTITY", "DISCOUNT", "TAX", "PRICE"]
YEARS = dict(zip(range(1996, 2002), ["V02", "V04", "V06", "V08", "V10", "V12"]))
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def grid_table(spark: SparkSession) -> DataFrame:
    """The task grid, written once per application; every plan that uses it reads one small file."""
    return staged(spark, "specification", "grid", lambda: spec.task_grid(spark))


class Panel:
    """Lazy DataFrames of the panel; nothing runs until a query uses one.

    ``task`` restricts the grid, so that a query about one task does not build the others.
    """

    def __init__(self, t: Tables, min_total: int | None = None, task: str | None = None):
        self.t, self.spark, self.min_total, self.task = t, t.spark, min_total, task

    def _staged(self, name: str, build) -> DataFrame:
        gate = "" if self.min_total is None else f"-{self.min_total}"
        return staged(self.spark, self.t.version + gate, name, build)

    def _by_grid(self, name: str, build) -> DataFrame:
        """A stage table that depends on the grid's tasks."""
        return self._staged(name if self.task is None else f"{name}-{self.task}", build)

    @cached_property
    def raw_orders(self) -> DataFrame:
        o = self.t.scan("orders")
        year, month = F.year("o_orderdate"), F.month("o_orderdate")
        event = F.when(year == 1995, F.when(month <= 6, "SC").otherwise("BL"))
        for y, v in YEARS.items():
            event = event.when(year == y, v)
        state = F.when(F.col("o_orderstatus") == "O", "ON").when(F.col("o_orderstatus") == "F", "OFF")
        return o.select(
            F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("order_id"), event.alias("event_id"),
            state.alias("state"), F.col("o_totalprice").alias("TOTAL"),
            F.substring("o_orderpriority", 1, 1).cast("double").alias("PRIORITY"), "o_orderdate",
        )

    @cached_property
    def raw_items(self) -> DataFrame:
        li = self.t.scan("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("QUANTITY"),
            F.col("l_discount").alias("DISCOUNT"), F.col("l_tax").alias("TAX"), F.col("l_extendedprice").alias("PRICE"),
        )
        return li.join(self.raw_orders.select("order_id", "entity_id", "event_id"), "order_id")

    @cached_property
    def cohort(self) -> DataFrame:
        c = self.t.scan("customer", ["c_custkey", "c_mktsegment"])
        return c.where(F.col("c_mktsegment").isin(spec.COHORT_SEGMENTS)).select(F.col("c_custkey").alias("entity_id")).distinct()

    @cached_property
    def panel(self) -> DataFrame:
        """Cohort rows (entity_id, modality, visit, measure, value), one median each."""
        return self._staged("panel", self.build_panel)

    @cached_property
    def visit_orders(self) -> DataFrame:
        """Cohort orders on the calendar, screening included."""

        def build() -> DataFrame:
            rows = self.raw_orders.join(self.cohort, "entity_id", "left_semi").withColumn("visit", simple_visit(F.col("event_id")))
            return rows.where(F.col("visit").isin([*spec.VISIT_ORDER, "SC"])).drop("event_id", "o_orderdate")

        return self._staged("visit_orders", build)

    @cached_property
    def visit_items(self) -> DataFrame:
        """Line items of the calendar's orders: scanned and joined once, and stored for the rules and medians."""

        def build() -> DataFrame:
            li = self.t.scan("lineitem").select(
                F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("QUANTITY"),
                F.col("l_discount").alias("DISCOUNT"), F.col("l_tax").alias("TAX"), F.col("l_extendedprice").alias("PRICE"),
            )
            return li.join(self.visit_orders.select("order_id", "entity_id", "visit"), "order_id").drop("order_id")

        return self._staged("visit_items", build)

    def build_panel(self) -> DataFrame:
        keys = ["entity_id", "visit"]

        def medians(raw: DataFrame, measures: list[str], state: str | None = None) -> DataFrame:
            rows = cleaning.sc_to_bl(raw, "entity_id", "visit").where(F.col("visit").isin(spec.VISIT_ORDER))
            rows = cleaning.keep_off_state(rows, state) if state else rows
            return reshape.medians_of(rows, keys, measures, sized=raw)

        orders, items = medians(self.visit_orders, ORDER_MEASURES, "state"), medians(self.visit_items, ITEM_MEASURES)
        cell = F.struct("measure", "value")
        flag = F.struct(
            F.lit("LOW_QUANTITY").alias("measure"),
            (F.col("value") < spec.IMPAIRMENT_CUTOFF).cast("double").alias("value"),
        )
        cells = F.when(F.col("measure") == "QUANTITY", F.array(cell, flag)).otherwise(F.array(cell))
        items = items.select("entity_id", "visit", F.inline(cells))
        both = orders.withColumn("modality", F.lit("orders")).unionByName(items.withColumn("modality", F.lit("lineitem")))
        return both.select("entity_id", "modality", "visit", "measure", "value")

    @cached_property
    def static(self) -> DataFrame:
        """Cohort rows (entity_id, modality, measure, value) of one-per-entity data."""
        c = self.t.scan("customer").join(
            F.broadcast(self.t.scan("nation", ["n_nationkey", "n_regionkey"])),  # one row per nation
            F.col("c_nationkey") == F.col("n_nationkey"),
        )
        cols = {f"SEG_{s}": (F.col("c_mktsegment") == s).cast("double") for s in SEGMENTS}
        cols["REGION"] = F.col("n_regionkey").cast("double")
        cols["ACCTBAL"] = F.col("c_acctbal")
        wide = c.select(F.col("c_custkey").alias("entity_id"), *[e.alias(n) for n, e in cols.items()])
        long = reshape.to_long(wide.join(self.cohort, "entity_id", "left_semi"), ["entity_id"], list(cols))
        modality = F.when(F.col("measure") == "ACCTBAL", "account").otherwise("demographics")
        return long.withColumn("modality", modality).select("entity_id", "modality", "measure", "value")

    @cached_property
    def grid(self) -> DataFrame:
        grid = grid_table(self.spark)
        return grid if self.task is None else grid.where(F.col("task_key") == self.task)

    @cached_property
    def asks(self) -> list[dict]:
        return ask_ops.ask_list(self.grid)

    @cached_property
    def names(self) -> DataFrame:
        """(code, feature, modality, visit, measure) of every feature that occurs."""
        return staged(self.spark, self.t.version, "feature_names", lambda: ask_ops.feature_names(self.panel, self.static))

    @cached_property
    def name_list(self) -> list:
        return self.names.orderBy("code").collect()  # names of columns

    @cached_property
    def entities(self) -> DataFrame:
        """(entity_id, past, repeats, word_0 ...): a cohort entity's own values and features in one row."""
        return self._by_grid("entities", lambda: ask_ops.entity_rows(self.panel, self.static, self.name_list, self.asks))

    @cached_property
    def asked(self) -> DataFrame:
        """(ask_no, entity_id, y, repeats, word_0 ..., bits, last_0 ...): every target value with what its tasks see."""
        return self._by_grid("asked", lambda: ask_ops.asked_rows(self.entities, self.name_list, self.asks))

    @cached_property
    def target_values(self) -> DataFrame:
        """(target, horizon, entity_id, y)."""
        rows = self.asked.join(F.broadcast(ask_ops.ask_table(self.spark, self.asks)), "ask_no")
        return rows.select("target", "horizon", "entity_id", "y")

    @cached_property
    def features(self) -> DataFrame:
        """Every task matrix in long form, stored by task."""
        return self._by_grid(
            "features", lambda: tasks.task_features(self.panel, self.static, self.grid, self.target_values)
        )

    @cached_property
    def feature_cells(self) -> DataFrame:
        """(task_key, feature, modality, visit, n, y_sum): the task matrices counted by feature."""
        return self._by_grid(
            "feature_cells", lambda: ask_ops.cells(self.asked, self.panel, self.static, self.grid, self.name_list, self.asks)
        )

    @cached_property
    def members(self) -> DataFrame:
        """(task_no, task_key, task_type, entity_id, y, last_value) of entities with features, before the size gate."""
        return ask_ops.by_task(self.asked, self.asks, ["last"]).withColumnRenamed("last", "last_value")

    @cached_property
    def gated_asks(self) -> DataFrame:
        """(ask_no, entity_id, y, bits, last_0 ...): the tasks that pass the size gate, those of an ask beside each other."""
        return ask_ops.gate(self.asked, self.asks, self.min_total)

    @cached_property
    def gated(self) -> DataFrame:
        return ask_ops.by_task(self.gated_asks, self.asks, ["last"]).withColumnRenamed("last", "last_value")

    @cached_property
    def targets(self) -> DataFrame:
        """(task_key, entity_id, y) of the tasks that pass the size gate."""
        return self.gated.select("task_key", "entity_id", "y")

    @cached_property
    def side_by_side(self) -> bool:
        """Whether the rows of every ask fit into the arrays of one Spark task; if not, tasks are dealt and scored in buckets."""
        return ask_ops.largest_ask(self.asked) <= fold_ops.GROUP_ROWS

    @cached_property
    def dealt_asks(self) -> DataFrame:
        """(ask_no, entity_id, y, bits, last_0 ..., stratum_0 ..., fold_<seed> ...)."""
        return self._by_grid("ask_folds", lambda: ask_ops.dealt(self.gated_asks, self.entities, self.asks, spec.CV_SEEDS))

    @cached_property
    def dealt(self) -> DataFrame:
        """Rows of the tasks with their strata and the folds of all seeds beside each other."""
        if not self.side_by_side:
            return self._by_grid("folds", lambda: fold_ops.dealt(self.gated, self.grid, spec.CV_SEEDS))
        return ask_ops.by_task(self.dealt_asks, self.asks, ["last", "stratum"]).withColumnRenamed("last", "last_value")

    @cached_property
    def train_summary(self) -> DataFrame:
        def build() -> DataFrame:
            if not self.side_by_side:
                return naive.dealt_summary(self.dealt, spec.CV_SEEDS)
            return ask_ops.summary(self.dealt_asks, self.asks, spec.CV_SEEDS)

        return self._by_grid("train", build)

    def dealt_folds(self, kind: str | None = None) -> DataFrame:
        rows = self.dealt.where(F.col("task_type") == kind) if kind else self.dealt
        return fold_ops.long_folds(rows, spec.CV_SEEDS)

    @cached_property
    def all_folds(self) -> DataFrame:
        """(task_key, task_type, seed, entity_id, y, stratum, fold) for every task and seed."""
        return self.dealt_folds().drop("task_no", "last_value")

    def folds(self, kind: str | None = None) -> DataFrame:
        return self.dealt_folds(kind).drop("task_no", "last_value", "task_type") if kind else self.all_folds

    @cached_property
    def history(self) -> DataFrame:
        return tasks.raw_history(self.panel, self.grid)

    @cached_property
    def history_tasks(self) -> DataFrame:
        """Tasks whose own measure was seen at all at one of their visits: a table of the grid's size."""
        seen = self.names.where("visit is not null").select("modality", "measure", "visit", F.lit(0).alias("entity_id"), F.lit(0.0).alias("value"))
        return self._by_grid("history_tasks", lambda: tasks.raw_history(seen, self.grid).select("task_key").distinct())

    @cached_property
    def naive_predictions(self) -> DataFrame:
        """(task_key, seed, fold, entity_id, y, yhat, model) of both regression references: a map over the stored folds."""
        folds = self.dealt_folds("regression")
        mean = naive.population_mean(folds, self.train_summary)
        return mean.unionByName(naive.carried_forward(folds, self.history_tasks, self.train_summary))

    @cached_property
    def naive_pairs(self) -> DataFrame:
        """(task_key, seed, fold, entity_id, y, mean, last): both references side by side, ``last`` null without any history."""
        rows = self.dealt_folds("regression").join(F.broadcast(self.train_summary), ["task_key", "seed", "fold"])
        rows = rows.join(F.broadcast(self.history_tasks.withColumn("_seen", F.lit(True))), "task_key", "left")
        last = F.when(F.col("_seen"), F.coalesce("last_value", "train_mean"))
        return rows.select("task_key", "seed", "fold", "entity_id", "y", F.col("train_mean").alias("mean"), last.alias("last"))

    @cached_property
    def naive_scores(self) -> DataFrame:
        """fold_scores(task_key, model, seed, fold, n_test, r2, mae, rmse, pearson, spearman)."""
        keys = ["task_key", "model", "seed", "fold"]

        def build() -> DataFrame:
            if not self.side_by_side:
                return metrics.regression_metrics(self.naive_predictions, keys)
            return ask_ops.ask_scores(self.dealt_asks, self.asks, self.train_summary, self.history_tasks, spec.CV_SEEDS)

        return self._by_grid("fold_scores", build)


def fold_scores(t: Tables) -> DataFrame:
    return Panel(t).naive_scores


def with_task(df: DataFrame, t: Tables) -> DataFrame:
    g = grid_table(t.spark).select(
        "task_key", "target", "domain", "task_type", "horizon", "horizon_months", "regime"
    )
    return df.join(F.broadcast(g), "task_key")


# --- the same definitions for DuckDB ----------------------------------------------

_EVENT = (
    "CASE year(o_orderdate) WHEN 1995 THEN CASE WHEN month(o_orderdate) <= 6 THEN 'SC' ELSE 'BL' END "
    + " ".join(f"WHEN {y} THEN '{v}'" for y, v in YEARS.items())
    + " END"
)
SQL_RAW = f"""
raw_orders AS (
  SELECT o_custkey AS entity_id, o_orderkey AS order_id, {_EVENT} AS event_id,
         CASE o_orderstatus WHEN 'O' THEN 'ON' WHEN 'F' THEN 'OFF' END AS state,
         o_totalprice AS TOTAL, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS PRIORITY, o_orderdate
  FROM orders),
raw_items AS (
  SELECT r.order_id, r.entity_id, r.event_id, l_quantity AS QUANTITY, l_discount AS DISCOUNT, l_tax AS TAX,
         l_extendedprice AS PRICE
  FROM lineitem JOIN raw_orders r ON l_orderkey = r.order_id)"""
SQL_COHORT = f"""
cohort AS (SELECT DISTINCT c_custkey AS entity_id FROM customer
  WHERE c_mktsegment IN ({", ".join(repr(s) for s in spec.COHORT_SEGMENTS)}))"""
SQL_CALENDAR = "calendar(visit, months, ord) AS (VALUES " + ", ".join(
    f"('{v}', {spec.VISIT_MONTHS[v]}, {i})" for i, v in enumerate(spec.VISIT_ORDER)
) + ")"


def _long(source: str, measures: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT entity_id, visit, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {source}" for m in measures
    )


SQL_PANEL = f"""{SQL_RAW}, {SQL_COHORT}, {SQL_CALENDAR},
orders_v AS (
  SELECT *, CASE WHEN event_id = 'SC' THEN 'BL' ELSE event_id END AS visit FROM raw_orders
  WHERE (event_id <> 'SC' OR entity_id NOT IN (SELECT entity_id FROM raw_orders WHERE event_id = 'BL'))
    AND (state = 'OFF' OR state IS NULL)),
items_v AS (
  SELECT *, CASE WHEN event_id = 'SC' THEN 'BL' ELSE event_id END AS visit FROM raw_items
  WHERE event_id <> 'SC' OR entity_id NOT IN (SELECT entity_id FROM raw_items WHERE event_id = 'BL')),
items_m AS (
  SELECT entity_id, visit, measure, median(value) AS value
  FROM ({_long("items_v", ITEM_MEASURES)}) GROUP BY ALL),
panel AS (
  SELECT * FROM (
    SELECT entity_id, 'orders' AS modality, visit, measure, median(value) AS value
    FROM ({_long("orders_v", ORDER_MEASURES)}) GROUP BY ALL
    UNION ALL SELECT entity_id, 'lineitem', visit, measure, value FROM items_m
    UNION ALL SELECT entity_id, 'lineitem', visit, 'LOW_QUANTITY', CAST(value < 26 AS INT) FROM items_m WHERE measure = 'QUANTITY')
  WHERE entity_id IN (SELECT entity_id FROM cohort))"""
SQL_STATIC = f"""
static_w AS (
  SELECT c_custkey AS entity_id, {", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS SEG_{s}" for s in SEGMENTS)},
         n_regionkey AS REGION, c_acctbal AS ACCTBAL
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT entity_id FROM cohort)),
static AS ({" UNION ALL ".join(
    f"SELECT entity_id, '{'account' if m == 'ACCTBAL' else 'demographics'}' AS modality, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM static_w"
    for m in [*(f"SEG_{s}" for s in SEGMENTS), "REGION", "ACCTBAL"])})"""


def sql_grid() -> str:
    """The task grid as VALUES, from the same specification records."""
    targets = ", ".join(
        f"('{x.name}', '{x.domain}', '{x.modality}', '{x.measure}', '{x.task_type}', '{x.rule}', "
        f"CAST({x.threshold} AS DOUBLE), {x.min_patients}, '{x.primary_metric}')"
        for x in spec.ORDER_TARGETS
    )
    regimes, allowed = [], []
    for r in spec.REGIMES:
        last = max((spec.VISIT_MONTHS[v] for v in r.visits), default=0) if r.visits else 0
        regimes.append(f"('{r.name}', {str(r.multimodal).lower()}, {last})")
        allowed += [f"('{r.name}', '{v}')" for v in (r.visits or spec.VISIT_ORDER)]
    horizons = ", ".join(f"('{h}', {spec.VISIT_MONTHS[h]})" for h in spec.HORIZONS)
    return f"""
targets_s(target, domain, target_modality, target_measure, task_type, rule, threshold, min_patients, primary_metric)
  AS (VALUES {targets}),
regimes_s(regime, multimodal, last_month) AS (VALUES {", ".join(regimes)}),
allowed_s(regime, visit) AS (VALUES {", ".join(allowed)}),
horizons_s(horizon, horizon_months) AS (VALUES {horizons}),
grid AS (SELECT target || '__' || regime || '__' || horizon AS task_key, * FROM targets_s, regimes_s, horizons_s
  WHERE horizon_months > last_month),
task_visits AS (SELECT g.*, c.visit, c.months FROM grid g JOIN allowed_s a USING (regime)
  JOIN calendar c ON c.visit = a.visit AND c.months < g.horizon_months)"""


SQL_GRID = sql_grid()
SQL_TARGETS = """
asks AS (SELECT DISTINCT target, rule, threshold, horizon, target_modality, target_measure FROM grid),
deltas AS (
  SELECT a.target, a.rule, a.threshold, a.horizon, h.entity_id, h.value - b.value AS delta
  FROM asks a JOIN panel h ON h.modality = a.target_modality AND h.measure = a.target_measure AND h.visit = a.horizon
  JOIN panel b ON b.entity_id = h.entity_id AND b.modality = h.modality AND b.measure = h.measure AND b.visit = 'BL'
  WHERE a.rule <> 'level'),
target_values AS (
  SELECT a.target, a.horizon, p.entity_id, p.value AS y FROM asks a
  JOIN panel p ON p.modality = a.target_modality AND p.measure = a.target_measure AND p.visit = a.horizon
  WHERE a.rule = 'level'
  UNION ALL SELECT target, horizon, entity_id, CAST(delta >= threshold AS INT) FROM deltas WHERE rule = 'worsen'
  UNION ALL SELECT target, horizon, entity_id,
    rank() OVER (PARTITION BY target, horizon ORDER BY delta)
      + (count(*) OVER (PARTITION BY target, horizon, delta) - 1) / 2.0
  FROM deltas WHERE rule = 'rank')"""
SQL_FEATURES = """
features AS (
  SELECT v.task_key, t.entity_id, t.y, p.modality || '__' || p.visit || '__' || p.measure AS feature,
         p.modality, p.visit, p.measure, p.value
  FROM task_visits v JOIN target_values t ON t.target = v.target AND t.horizon = v.horizon
  JOIN panel p ON p.entity_id = t.entity_id AND p.visit = v.visit AND (v.multimodal OR p.modality = v.target_modality)
  UNION ALL
  SELECT g.task_key, t.entity_id, t.y, s.modality || '__' || s.measure, s.modality, NULL, s.measure, s.value
  FROM grid g JOIN target_values t ON t.target = g.target AND t.horizon = g.horizon
  JOIN static s ON s.entity_id = t.entity_id WHERE g.multimodal),
tt_all AS (SELECT DISTINCT task_key, entity_id, y FROM features),
tt AS (SELECT t.*, g.task_type FROM tt_all t JOIN grid g USING (task_key)
  WHERE task_key IN (SELECT task_key FROM tt_all JOIN grid USING (task_key) GROUP BY task_key, min_patients
                     HAVING count(*) >= 2 * min_patients))"""
SQL_TASKS = f"{SQL_PANEL}, {SQL_STATIC}, {SQL_GRID}, {SQL_TARGETS}, {SQL_FEATURES}"
_SEEDS = ", ".join(str(s) for s in spec.CV_SEEDS)


def sql_folds(seeds: str = _SEEDS) -> str:
    return f"""
edges AS (SELECT task_key, quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS e, count(y) AS n FROM tt
  WHERE task_type <> 'classification' GROUP BY task_key),
strata AS (
  SELECT tt.task_key, tt.task_type, entity_id, y, CASE WHEN task_type = 'classification' THEN CAST(y AS INT)
    WHEN n > 5 THEN (y >= round(e[1], 9))::INT + (y >= round(e[2], 9))::INT + (y >= round(e[3], 9))::INT
      + (y >= round(e[4], 9))::INT ELSE 0 END AS stratum
  FROM tt LEFT JOIN edges USING (task_key)),
folds AS (
  SELECT task_key, task_type, seed, entity_id, y, stratum, CAST((row_number() OVER (PARTITION BY task_key, seed, stratum
    ORDER BY md5(concat(seed, '|', entity_id)), entity_id) - 1) % 5 AS INT) AS fold
  FROM strata, (SELECT unnest([{seeds}]) AS seed))"""


SQL_FOLDS = f"{SQL_TASKS}, {sql_folds()}"
SQL_HISTORY = """
history AS (
  SELECT v.task_key, p.entity_id, p.visit, v.months, p.value FROM task_visits v
  JOIN panel p ON p.visit = v.visit AND p.modality = v.target_modality AND p.measure = v.target_measure),
train AS (
  SELECT f.task_key, f.seed, f.fold, t.c - f.c AS n_train, CAST(t.s - f.s AS DOUBLE) / (t.c - f.c) AS train_mean, t.p - f.p AS n_pos
  FROM (SELECT task_key, seed, fold, sum(CAST(y AS DECIMAL(28, 8))) s, count(y) c, count(*) FILTER (y = 1) p FROM folds GROUP BY ALL) f
  JOIN (SELECT task_key, seed, sum(CAST(y AS DECIMAL(28, 8))) s, count(y) c, count(*) FILTER (y = 1) p FROM folds GROUP BY ALL) t
    USING (task_key, seed))"""
SQL_PRED = f"""{SQL_FOLDS}, {SQL_HISTORY},
last_value AS (SELECT task_key, entity_id, max_by(value, months) AS last_value FROM history GROUP BY ALL),
pred AS (
  SELECT f.task_key, f.seed, f.fold, f.entity_id, f.y, t.train_mean AS yhat, 'population_mean' AS model
  FROM folds f JOIN train t USING (task_key, seed, fold) WHERE task_type = 'regression'
  UNION ALL
  SELECT f.task_key, f.seed, f.fold, f.entity_id, f.y, coalesce(l.last_value, t.train_mean), 'locf'
  FROM folds f JOIN train t USING (task_key, seed, fold) LEFT JOIN last_value l USING (task_key, entity_id)
  WHERE task_type = 'regression' AND f.task_key IN (SELECT task_key FROM history))"""


def sql_regression(source: str, keys: str, out: str) -> str:
    """Regression scores of ``source(keys, y, yhat)`` as the CTE ``out``."""
    return f"""
{out}_r AS (SELECT *,
  rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY {keys} ORDER BY yhat) + (count(*) OVER (PARTITION BY {keys}, yhat) - 1) / 2.0 AS rp
  FROM {source} WHERE y IS NOT NULL AND yhat IS NOT NULL),
{out}_s AS (SELECT {keys}, count(*) AS n, sum((y - yhat) * (y - yhat)) AS sse, var_pop(y) AS vy, var_pop(yhat) AS vp,
  covar_pop(y, yhat) AS c, avg(abs(y - yhat)) AS mae, covar_pop(ry, rp) AS rc, var_pop(ry) AS rvy, var_pop(rp) AS rvp
  FROM {out}_r GROUP BY ALL),
{out} AS (SELECT {keys}, n AS n_test,
  CASE WHEN n < 5 THEN NULL WHEN vy = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / (n * vy) END AS r2,
  CASE WHEN n >= 5 THEN mae END AS mae, CASE WHEN n >= 5 THEN sqrt(sse / n) END AS rmse,
  CASE WHEN n < 5 THEN NULL WHEN sqrt(vy) < 1e-10 OR sqrt(vp) < 1e-10 THEN 0.0 ELSE c / sqrt(vy * vp) END AS pearson,
  CASE WHEN n < 5 THEN NULL WHEN rvy = 0 OR rvp = 0 THEN 0.0 ELSE rc / sqrt(rvy * rvp) END AS spearman
  FROM {out}_s)"""


SQL_SCORES = f"{SQL_PRED}, {sql_regression('pred', 'task_key, model, seed, fold', 'scores')}"
