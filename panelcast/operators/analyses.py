"""Attrition, calibration and quality-control tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.operators.metrics import TINY, ratio, spearman


def survivorship(baseline: DataFrame, presence: DataFrame, visits: Sequence[str], min_n: int = 10) -> DataFrame:
    """Baseline values (entity_id, feature, value) of entities seen at a visit against those not seen.

    ``presence(entity_id, visit)``. Gives sizes, means, pooled d, Welch t and its degrees of freedom.
    """
    rows = baseline.where("value is not null").withColumn("visit", F.explode(F.array(*[F.lit(v) for v in visits])))
    seen = presence.select("entity_id", "visit", F.lit(True).alias("_seen")).distinct()
    rows = rows.join(seen, ["entity_id", "visit"], "left")
    alive = F.col("_seen").isNotNull()
    s, d = F.when(alive, F.col("value")), F.when(~alive, F.col("value"))
    agg = rows.groupBy("visit", "feature").agg(
        F.count(s).alias("n_survivors"), F.count(d).alias("n_dropouts"), F.avg(s).alias("survivors_mean"),
        F.avg(d).alias("dropouts_mean"), F.var_samp(s).alias("_vs"), F.var_samp(d).alias("_vd"),
    ).where((F.col("n_survivors") >= min_n) & (F.col("n_dropouts") >= min_n))
    ns, nd, vs, vd = (F.col(c) for c in ("n_survivors", "n_dropouts", "_vs", "_vd"))
    gap = F.col("survivors_mean") - F.col("dropouts_mean")
    pooled = F.sqrt(((ns - 1) * vs + (nd - 1) * vd) / (ns + nd - 2))
    se2 = vs / ns + vd / nd
    df = ratio(se2 * se2, vs * vs / (ns * ns * (ns - 1)) + vd * vd / (nd * nd * (nd - 1)))
    return agg.select(
        "visit", "feature", "n_survivors", "n_dropouts", (100.0 * ns / (ns + nd)).alias("pct_retained"), "survivors_mean",
        "dropouts_mean", F.when(pooled > TINY, gap / pooled).otherwise(0.0).alias("cohens_d"),
        ratio(gap, F.sqrt(se2)).alias("t_stat"), df.alias("df"),
    )


def attrition(baseline_entities: DataFrame, presence: DataFrame) -> DataFrame:
    """Distinct entities per visit and their share of all baseline entities."""
    total = baseline_entities.agg(F.countDistinct("entity_id").alias("n"))
    at = presence.where("visit <> 'BL'").groupBy("visit").agg(F.countDistinct("entity_id").alias("n_patients"))
    at = at.unionByName(total.select(F.lit("BL").alias("visit"), F.col("n").alias("n_patients")))
    cal = spec.calendar(presence.sparkSession)
    rows = cal.join(at, "visit", "left").withColumn("n_patients", F.coalesce("n_patients", F.lit(0)))
    return rows.select("visit", "months", "n_patients", (100.0 * F.col("n_patients") / total.scalar()).alias("pct_of_baseline"))


def calibration_bins(pred: DataFrame, keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Equal-width bins of the forecast probability, the last one closed; empty bins are kept."""
    p = F.col("prob")
    index = sum((p >= i / n_bins).cast("int") for i in range(1, n_bins))
    rows = pred.where("y is not null and prob is not null").withColumn("bin", index)
    got = rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("fraction_positive"), F.avg("prob").alias("mean_predicted")
    )
    slots = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    full = slots.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("bin_center", (F.col("bin") * 2 + 1) / (2.0 * n_bins))


def calibration_errors(bins: DataFrame, keys: Sequence[str], min_n: int = 20) -> DataFrame:
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    out = bins.groupBy(*keys).agg(
        (F.sum(F.col("n") * gap) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n_total")
    )
    return out.where(F.col("n_total") >= min_n)


def dimensionality(manifest: DataFrame) -> DataFrame:
    """Feature counts against outer and inner training sizes."""
    k, ki = spec.N_FOLDS, spec.N_INNER_FOLDS
    n_train = F.ceil(F.col("n_total") * F.lit((k - 1) / k))
    rows = manifest.withColumn("n_train_cv", n_train)
    rows = rows.withColumn("n_train_inner", F.ceil(F.col("n_train_cv") * F.lit((ki - 1) / ki)))
    p = F.col("n_features")
    return rows.select(
        "task_key", "n_total", "n_features", "n_train_cv", "n_train_inner",
        (p / F.col("n_train_cv")).alias("p_over_n_train"), (p / F.col("n_train_inner")).alias("p_over_n_inner"),
        (p / F.col("n_total")).alias("p_over_n_total"), (p > F.col("n_train_cv")).alias("flag_train"), (p > F.col("n_total")).alias("flag_total"),
    )


def overall_status(checks: DataFrame) -> DataFrame:
    """FAIL if any check fails, else WARN if any warns, else PASS."""
    level = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checks.agg(F.when(level == 2, "FAIL").when(level == 1, "WARN").otherwise("PASS").alias("status"))


def target_correlations(values: DataFrame) -> DataFrame:
    """Pairwise-complete Spearman between targets of (entity_id, target, value); a handful of targets per entity."""
    a = values.select("entity_id", F.col("target").alias("target_a"), F.col("value").alias("va"))
    b = values.select("entity_id", F.col("target").alias("target_b"), F.col("value").alias("vb"))
    pairs = a.join(b, "entity_id").where("target_a < target_b")
    return spearman(pairs, ["target_a", "target_b"], "va", "vb")
