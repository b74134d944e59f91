"""Forecasting tasks as long tables: every (target, regime, horizon) in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.operators.order_stats import average_ranks

# Grid and calendar tables come from the specification (at most a few hundred rows),
# never from data, so broadcasting them is safe at any input size.


def history_visits(grid: DataFrame) -> DataFrame:
    """(task_key, visit): visits strictly before the horizon that the regime may see."""
    cal = spec.calendar(grid.sparkSession)
    allowed = F.col("regime_visits").isNull() | F.array_contains("regime_visits", F.col("visit"))
    pairs = grid.join(F.broadcast(cal), (cal.months < grid.horizon_months) & allowed)
    return pairs.select("task_key", "target", "target_modality", "target_measure", "multimodal", "visit", "months")


def baseline_change(panel: DataFrame, measures: DataFrame) -> DataFrame:
    """Horizon minus baseline per (entity, modality, measure), for the measures asked for."""
    asked = panel.join(F.broadcast(measures), ["modality", "measure"], "left_semi")
    keys = ["entity_id", "modality", "measure"]
    bl = asked.where(F.col("visit") == "BL").select(*keys, F.col("value").alias("bl"))
    later = asked.where(F.col("visit") != "BL").select(*keys, "visit", F.col("value").alias("hz"))
    return bl.join(later, keys).withColumn("delta", F.col("hz") - F.col("bl"))


def target_values(panel: DataFrame, grid: DataFrame) -> DataFrame:
    """(target, horizon, entity_id, y): level, worsening flag or rank of change."""
    asks = grid.select(
        "target", "rule", "threshold", "horizon",
        F.col("target_modality").alias("modality"), F.col("target_measure").alias("measure"),
    ).distinct()
    level = panel.join(
        F.broadcast(asks.where("rule = 'level'").withColumn("visit", F.col("horizon"))),
        ["modality", "measure", "visit"],
    ).select("target", "horizon", "entity_id", F.col("value").alias("y"))
    changing = asks.where("rule <> 'level'")
    moved = baseline_change(panel, changing.select("modality", "measure").distinct())
    moved = moved.join(
        F.broadcast(changing.withColumn("visit", F.col("horizon"))), ["modality", "measure", "visit"]
    )
    worse = moved.where("rule = 'worsen'").select(
        "target", "horizon", "entity_id", (F.col("delta") >= F.col("threshold")).cast("double").alias("y")
    )
    ranked = moved.where("rule = 'rank'")
    ranks = average_ranks(ranked, ["target", "horizon"], "delta", "y")
    order = ranked.join(ranks, ["target", "horizon", "delta"]).select("target", "horizon", "entity_id", "y")
    return level.unionByName(worse).unionByName(order)


def _seen_by_tasks(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows (target, horizon, modality, visit ...) once for every task that may see them; undated ones go to the multimodal tasks.

    The regime rules are a broadcast lookup on (target, horizon, visit).
    """
    horizons = grid.select("task_key", "horizon")
    rules = history_visits(grid).join(horizons, "task_key").select("task_key", "target", "horizon", "visit", "target_modality", "multimodal")
    dated = rows.join(F.broadcast(rules), ["target", "horizon", "visit"])
    dated = dated.where(F.col("multimodal") | (F.col("modality") == F.col("target_modality"))).drop("target_modality", "multimodal")
    fixed = F.broadcast(grid.where("multimodal").select("task_key", "target", "horizon"))
    return dated.unionByName(rows.where("visit is null").join(fixed, ["target", "horizon"]))


def _with_static(panel: DataFrame, static: DataFrame) -> DataFrame:
    """(entity_id, feature, modality, visit, measure, value) of dated and, with a null visit, undated values."""
    cols = ["entity_id", "feature", "modality", "visit", "measure", "value"]
    dated = panel.withColumn("feature", F.concat_ws("__", "modality", "visit", "measure"))
    fixed = static.withColumn("feature", F.concat_ws("__", "modality", "measure")).withColumn("visit", F.lit(None).cast("string"))
    return dated.select(*cols).unionByName(fixed.select(*cols))


def task_features(panel: DataFrame, static: DataFrame, grid: DataFrame, targets: DataFrame) -> DataFrame:
    """(task_key, entity_id, y, feature, modality, visit, measure, value).

    One shuffle on the entity, of one row per (target, horizon, entity); it becomes one row per task behind the join.
    """
    rows = targets.join(_with_static(panel, static), "entity_id")
    cols = ["task_key", "entity_id", "y", "feature", "modality", "visit", "measure", "value"]
    return _seen_by_tasks(rows, grid).select(*cols)


def feature_cells(panel: DataFrame, static: DataFrame, grid: DataFrame, targets: DataFrame) -> DataFrame:
    """(task_key, feature, modality, visit, n, y_sum): rows of every task matrix counted by feature, without writing the matrices.

    Counts per (target, horizon, feature) are combined before the shuffle; only they are spread over the regimes.
    """
    rows = targets.join(_with_static(panel, static).select("entity_id", "feature", "modality", "visit"), "entity_id")
    counts = rows.groupBy("target", "horizon", "feature", "modality", "visit").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y_sum"))
    return _seen_by_tasks(counts, grid).select("task_key", "feature", "modality", "visit", "n", "y_sum")


def task_summaries(panel: DataFrame, static: DataFrame, grid: DataFrame, targets: DataFrame) -> DataFrame:
    """(task_key, entity_id, y, n_values, value_sum, first_feature) of every entity of a task, from sums per (entity, modality, visit).

    Features are numbered in name order, so that the first one is the minimum of a number.
    """
    rows = _with_static(panel, static)
    names = rows.select("modality", "visit", "measure", "feature").distinct().select("feature").orderBy("feature").collect()  # names of columns
    codes = grid.sparkSession.createDataFrame([(r.feature, i) for i, r in enumerate(names)], "feature string, code int").coalesce(1)
    slots = rows.join(F.broadcast(codes), "feature").groupBy("entity_id", "modality", "visit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("code").alias("code")
    )
    spread = _seen_by_tasks(targets.join(slots, "entity_id"), grid)
    sums = spread.groupBy("task_key", "entity_id", "y").agg(F.sum("n").alias("n_values"), F.sum("s").alias("value_sum"), F.min("code").alias("code"))
    first = codes.withColumnRenamed("feature", "first_feature")
    return sums.join(F.broadcast(first), "code").select("task_key", "entity_id", "y", "n_values", "value_sum", "first_feature")


def entity_values(panel: DataFrame, static: DataFrame) -> tuple[DataFrame, list]:
    """(entity_id, _all): an entity's values of all features that have any, as an array in name order, and (modality, visit, feature) of its places.

    A place is that of a name: the records of features of the same name share it.
    """
    rows = _with_static(panel, static)
    known = sorted(rows.where("value is not null").select("modality", "visit", "feature").distinct().collect(), key=lambda r: (r.feature, str(r)))  # names of columns
    code = {f: i for i, f in enumerate(sorted({r.feature for r in known}))}
    coded = rows.join(F.broadcast(panel.sparkSession.createDataFrame(list(code.items()), "feature string, _code int")), "feature")
    wide = coded.groupBy("entity_id").agg(F.array(*[F.max(F.when(F.col("_code") == i, F.col("value"))) for i in range(len(code))]).cast("array<double>").alias("_all"))
    return wide, [(code[r.feature], r) for r in known]


def task_matrices(members: DataFrame, panel: DataFrame, static: DataFrame, grid: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """``members`` with ``x``, the raw values of their task's features as an array (null: missing), and the features of every task in name order.

    An entity's values are gathered once for all its tasks.
    """
    spark, (wide, known) = grid.sparkSession, entity_values(panel, static)
    code = {r.feature: i for i, r in known}
    shape = spark.createDataFrame([tuple(r) for _, r in known], "modality string, visit string, feature string")
    seen = _seen_by_tasks(shape.crossJoin(F.broadcast(grid.select("target", "horizon").distinct())), grid).select("task_key", "feature").collect()
    names: dict[str, list[str]] = {}
    for r in sorted(map(tuple, seen)):
        names.setdefault(r[0], []).append(r[1])
    at = spark.createDataFrame([(k, [code[f] for f in v]) for k, v in names.items()], "task_key string, _at array<int>")
    both = members.join(F.broadcast(at), "task_key").join(wide, "entity_id")
    return both.withColumn("x", F.transform("_at", lambda i: F.get("_all", i))).drop("_at", "_all"), names


def task_targets(features: DataFrame, grid: DataFrame, min_total: int | None = None) -> DataFrame:
    """(task_key, entity_id, y) of entities with features, for tasks that pass the size gate."""
    rows = features.groupBy("task_key", "entity_id").agg(F.first("y").alias("y"))
    return size_gate(rows, grid, min_total)


def task_rules(grid: DataFrame) -> DataFrame:
    """(task_no, task_key, task_type, target, horizon, modality, measure, mask, seen): the regimes as bits, a table of the grid's size.

    Bit i of ``seen`` is the i-th calendar visit the task may look at. ``mask`` holds the bits of :func:`entity_flags` of which
    one must be set for the entity to have a feature of the task.
    """
    spark, order = grid.sparkSession, {v: i for i, v in enumerate(spec.VISIT_ORDER)}
    tasks = grid.select("task_key", "task_type", "target", "horizon", "target_modality", "target_measure", "multimodal").orderBy("task_key").collect()
    visits: dict[str, int] = {}
    for r in history_visits(grid).select("task_key", "visit").collect():
        visits[r.task_key] = visits.get(r.task_key, 0) | 1 << order[r.visit]
    place = {m: len(order) * (i + 1) + 1 for i, m in enumerate(sorted({r.target_modality for r in tasks}))}
    rows = []
    for i, r in enumerate(tasks):
        seen = visits.get(r.task_key, 0)
        mask = seen << 1 | 1 if r.multimodal else seen << place[r.target_modality]
        rows.append((i, r.task_key, r.task_type, r.target, r.horizon, r.target_modality, r.target_measure, mask, seen))
    shape = "task_no int, task_key string, task_type string, target string, horizon string, modality string, measure string, mask bigint, seen int"
    return spark.createDataFrame(rows, shape).coalesce(1)


def entity_flags(panel: DataFrame, static: DataFrame, grid: DataFrame) -> DataFrame:
    """(entity_id, flags): bit 0 for static data, then one bit per visit with any value, then one per target modality and visit."""
    names = sorted(r[0] for r in grid.select("target_modality").distinct().collect())
    width = len(spec.VISIT_ORDER)
    if width * (len(names) + 1) >= 63:
        raise ValueError(f"{len(names)} modalities of {width} visits do not fit into the bits of a long")
    bits = F.lit(0).cast("bigint")
    for i, v in enumerate(spec.VISIT_ORDER):
        own = F.lit(0).cast("bigint")
        for j, m in enumerate(names):
            own = F.when(F.col("modality") == m, F.lit(1 << (width * (j + 1) + 1 + i)).cast("bigint")).otherwise(own)
        bits = F.when(F.col("visit") == v, own + F.lit(1 << (i + 1)).cast("bigint")).otherwise(bits)
    rows = panel.select("entity_id", bits.alias("flags")).unionByName(static.select("entity_id", F.lit(1).cast("bigint").alias("flags")))
    return rows.groupBy("entity_id").agg(F.bit_or("flags").alias("flags"))


def past_values(panel: DataFrame, measures: DataFrame) -> DataFrame:
    """(entity_id, modality, measure, past): the values of the asked measures, an array in calendar order."""
    asked = panel.join(F.broadcast(measures), ["modality", "measure"], "left_semi")
    at = [F.max(F.when(F.col("visit") == v, F.col("value"))).alias(f"_{i}") for i, v in enumerate(spec.VISIT_ORDER)]
    rows = asked.groupBy("entity_id", "modality", "measure").agg(*at)
    return rows.select("entity_id", "modality", "measure", F.array(*[f"_{i}" for i in range(len(at))]).alias("past"))


def task_members(panel: DataFrame, static: DataFrame, grid: DataFrame, targets: DataFrame) -> DataFrame:
    """(task_no, task_key, task_type, entity_id, y, last_value) of every entity with a feature in a task, without the features.

    ``last_value`` is the target's own latest value among the visits the task may look at. One row per (target, horizon,
    entity) meets its entity's bits, and only then becomes one row per regime.
    """
    rules = task_rules(grid)
    own = rules.select("target", "horizon", "modality", "measure").distinct()
    rows = targets.join(F.broadcast(own), ["target", "horizon"]).join(entity_flags(panel, static, grid), "entity_id")
    rows = rows.join(past_values(panel, rules.select("modality", "measure").distinct()), ["entity_id", "modality", "measure"], "left")
    rows = rows.drop("modality", "measure").join(F.broadcast(rules.drop("modality", "measure")), ["target", "horizon"])
    rows = rows.where(F.col("flags").bitwiseAND(F.col("mask")) != 0)
    latest = [
        F.when(F.col("seen").bitwiseAND(F.lit(1 << i)) != 0, F.get("past", F.lit(i))) for i in reversed(range(len(spec.VISIT_ORDER)))
    ]
    return rows.select("task_no", "task_key", "task_type", "entity_id", "y", F.coalesce(*latest).alias("last_value"))


def size_gate(rows: DataFrame, grid: DataFrame, min_total: int | None = None) -> DataFrame:
    need = F.lit(min_total) if min_total is not None else 2 * F.col("min_patients")
    sizes = rows.groupBy("task_key").count().join(F.broadcast(grid.select("task_key", "min_patients")), "task_key")
    # One row per task of the grid: bounded by the specification.
    return rows.join(F.broadcast(sizes.where(F.col("count") >= need).select("task_key")), "task_key", "left_semi")


def raw_history(panel: DataFrame, grid: DataFrame) -> DataFrame:
    """(task_key, entity_id, months, visit, value): the target's own past values on their raw scale."""
    own = F.broadcast(
        history_visits(grid).select(
            "task_key", "visit", "months",
            F.col("target_modality").alias("modality"), F.col("target_measure").alias("measure"),
        )
    )
    cols = panel.select("entity_id", "modality", "measure", "visit", "value")
    return cols.join(own, ["modality", "measure", "visit"]).select("task_key", "entity_id", "visit", "months", "value")


def leakage_violations(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Features dated at or after their task's horizon; must be empty."""
    spark = features.sparkSession
    used = features.select("task_key", "feature", "visit").where("visit is not null").distinct()
    dated = used.join(F.broadcast(spec.calendar(spark).select("visit", "months")), "visit")
    dated = dated.join(F.broadcast(grid.select("task_key", "horizon", "horizon_months")), "task_key")
    return dated.where(F.col("months") >= F.col("horizon_months"))


def manifest(targets: DataFrame, grid: DataFrame, panel: DataFrame, static: DataFrame) -> DataFrame:
    """Task table with sizes, feature counts and class prevalence."""
    sizes = targets.groupBy("task_key").agg(F.count(F.lit(1)).alias("n_total"), F.avg("y").alias("mean_y"))
    # Columns of a task exist for the whole cohort, whether or not its own entities fill them.
    own = panel.select("modality", "visit", "measure").distinct()
    dated = history_visits(grid).join(own, "visit")
    dated = dated.where(F.col("multimodal") | (F.col("modality") == F.col("target_modality"))).select("task_key")
    fixed = grid.where("multimodal").select("task_key", F.lit(1).alias("k"))
    names = static.select("modality", "measure").distinct().withColumn("k", F.lit(1))
    undated = fixed.join(names, "k").select("task_key")
    widths = dated.unionByName(undated).groupBy("task_key").agg(F.count(F.lit(1)).alias("n_features"))
    prevalence = F.when(F.col("task_type") == "classification", F.col("mean_y"))
    return (
        grid.join(sizes, "task_key")
        .join(widths, "task_key")
        .select(
            "task_key", "target", "domain", F.col("target_measure").alias("target_column"), "task_type",
            "primary_metric", "horizon", "horizon_months", "regime", "n_total", "n_features",
            prevalence.alias("prevalence"),
        )
    )
