"""Regression, classification and ranking scores for every key in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.order_stats import average_ranks, has_hot_key, running_sums

TINY = 1e-10


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str, hot: bool | None = None) -> DataFrame:
    """(keys, n, spearman): Pearson of average ranks; 0 when either side is constant."""
    keys = list(keys)
    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    joint = rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w"))
    if hot is None:
        hot = has_hot_key(rows, keys)
    rx = average_ranks(rows, keys, x, "_rx", hot).withColumnRenamed("n", "_n")
    ry = average_ranks(rows, keys, y, "_ry", hot).drop("n")
    both = joint.join(rx, [*keys, x]).join(ry, [*keys, y])
    w, mid = F.col("_w"), (F.col("_n") + 1) / 2
    a, b = F.col("_rx") - mid, F.col("_ry") - mid
    sums = both.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb")
    )
    rho = F.when((F.col("_aa") == 0) | (F.col("_bb") == 0), 0.0).otherwise(
        ratio(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb")))
    )
    return sums.select(*keys, "n", rho.alias("spearman"))


def regression_metrics(pred: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """R2, MAE, RMSE, Pearson and Spearman over complete pairs; null below five pairs."""
    keys = list(keys)
    rows = pred.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(*keys, y, yhat)
    err = F.col(y) - F.col(yhat)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(y).alias("_vy"),
        F.var_pop(yhat).alias("_vp"),
        F.covar_pop(y, yhat).alias("_c"),
        F.avg(F.abs(err)).alias("_mae"),
    )
    n, sse, vy, vp = F.col("n_test"), F.col("_sse"), F.col("_vy"), F.col("_vp")
    r2 = F.when(vy == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - ratio(sse, n * vy))
    flat = (F.sqrt(vy) < TINY) | (F.sqrt(vp) < TINY)
    enough = n >= 5
    scored = sums.select(
        *keys,
        "n_test",
        F.when(enough, r2).alias("r2"),
        F.when(enough, F.col("_mae")).alias("mae"),
        F.when(enough, F.sqrt(sse / n)).alias("rmse"),
        F.when(enough, F.when(flat, 0.0).otherwise(ratio(F.col("_c"), F.sqrt(vy * vp)))).alias("pearson"),
    )
    rho = spearman(rows, keys, y, yhat).drop("n")
    return scored.join(rho, keys).withColumn("spearman", F.when(F.col("n_test") >= 5, F.col("spearman")))


def confusion(pred: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1).cast("bigint")

    def total(a: int, b: int) -> Column:
        return F.sum(F.when((F.col(y) == a) & (F.col(yhat) == b), w).otherwise(0))

    return pred.groupBy(*keys).agg(
        F.sum(w).alias("n"), total(1, 1).alias("tp"), total(0, 1).alias("fp"), total(1, 0).alias("fn"), total(0, 0).alias("tn")
    )


def auroc(
    pred: DataFrame, keys: Sequence[str], y: str = "y", score: str = "prob", hot: bool | None = None, weight: str | None = None
) -> DataFrame:
    """Tie-aware area under the ROC curve from running class counts."""
    w = F.col(weight) if weight else F.lit(1)
    runs = running_sums(pred, keys, score, {"pos": w * F.col(y).cast("double"), "neg": w * (1.0 - F.col(y))}, hot)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    area = runs.groupBy(*keys).agg(
        F.sum(wins).alias("_u"), F.max("pos_total").alias("_p"), F.max("neg_total").alias("_m")
    )
    return area.select(*keys, ratio(F.col("_u"), F.col("_p") * F.col("_m")).alias("auroc"))


def auprc(
    pred: DataFrame, keys: Sequence[str], y: str = "y", score: str = "prob", hot: bool | None = None, weight: str | None = None
) -> DataFrame:
    """Average precision: recall steps at descending distinct thresholds times precision."""
    w = F.col(weight) if weight else F.lit(1)
    runs = running_sums(pred, keys, score, {"pos": w * F.col(y).cast("double"), "cnt": w * F.lit(1.0)}, hot)
    hit = F.col("pos_total") - F.col("pos_before")
    seen = F.col("cnt_total") - F.col("cnt_before")
    step = F.col("pos") * ratio(hit, seen)
    area = runs.groupBy(*keys).agg(F.sum(step).alias("_s"), F.max("pos_total").alias("_p"))
    return area.select(*keys, ratio(F.col("_s"), F.col("_p")).alias("auprc"))


def classification_metrics(
    pred: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat", score: str = "prob", weight: str | None = None
) -> DataFrame:
    """Confusion-based scores, AUROC, AUPRC and Brier; null under ten rows or with one class. ``weight`` counts equal rows."""
    keys = list(keys)
    rows = pred.where(F.col(y).isNotNull() & F.col(yhat).isNotNull() & F.col(score).isNotNull())
    sq = (F.col(score) - F.col(y)) * (F.col(score) - F.col(y))
    mean = F.sum(F.col(weight) * sq) / F.sum(weight) if weight else F.avg(sq)
    brier = rows.groupBy(*keys).agg(mean.alias("brier"))
    base = confusion(rows, keys, y, yhat, weight).join(brier, keys)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    sens, spec_ = F.coalesce(ratio(tp, tp + fn), zero), F.coalesce(ratio(tn, tn + fp), zero)
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    cols = {
        "accuracy": (tp + tn) / F.col("n"),
        "balanced_accuracy": (sens + spec_) / 2,
        "mcc": F.coalesce(ratio(tp * tn - fp * fn, mcc_den), zero),
        "sensitivity": sens,
        "specificity": spec_,
        "ppv": F.coalesce(ratio(tp, tp + fp), zero),
        "npv": F.coalesce(ratio(tn, tn + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        "prevalence": (tp + fn) / F.col("n"),
    }
    usable = (F.col("n") >= 10) & (tp + fn > 0) & (tn + fp > 0)
    scored = base.select(
        *keys, F.col("n").alias("n_test"), *[F.when(usable, c).alias(k) for k, c in cols.items()],
        F.when(usable, F.col("brier")).alias("brier"), usable.alias("_usable"),
    )
    hot = has_hot_key(rows, keys)
    scored = scored.join(auroc(rows, keys, y, score, hot, weight), keys).join(auprc(rows, keys, y, score, hot, weight), keys)
    for c in ("auroc", "auprc"):
        scored = scored.withColumn(c, F.when(F.col("_usable"), F.col(c)))
    return scored.drop("_usable")


def multiclass_metrics(pred: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Macro F1 from (y, yhat) and one-versus-rest macro AUROC from the ``scores`` array."""
    keys = list(keys)
    order = {c: i for i, c in enumerate(classes)}
    one_vs_rest = pred.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    at = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    binary = one_vs_rest.select(
        *keys, "cls",
        (F.col("y") == F.col("cls")).cast("double").alias("y"),
        (F.col("yhat") == F.col("cls")).cast("double").alias("yhat"),
        F.get("scores", at[F.col("cls")]).alias("prob"),
    )
    ck = [*keys, "cls"]
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    f1 = F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    per = confusion(binary, ck).select(*ck, "n", f1.alias("f1")).join(auroc(binary, ck), ck)
    return per.groupBy(*keys).agg(
        F.max("n").alias("n_test"), F.avg("f1").alias("macro_f1"), F.avg("auroc").alias("macro_auroc")
    )


def kendall_tau(pairs: DataFrame, keys: Sequence[str], x: str, y: str, hot: bool | None = None) -> DataFrame:
    """Exact tau-b without listing pairs.

    Discordant pairs are counted level by level over the bits of the x rank: at each
    level a pair that first differs there sits in one block, once on either side, and
    running counts over y inside the block tell how many are out of order. The data
    grows by log2(n) only.
    """
    keys = list(keys)
    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    joint = rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w"))
    if hot is None:
        hot = has_hot_key(rows, keys)
    ranks = running_sums(rows, keys, x, {"cnt": F.lit(1)}, hot).select(
        *keys, x, F.col("cnt_before").alias("_rank"), F.col("cnt_total").alias("_n")
    )
    ranked = joint.join(ranks, [*keys, x])
    top = F.greatest(F.ceil(F.log2(F.col("_n").cast("double"))), F.lit(1)).cast("int")
    levels = ranked.withColumn("_lvl", F.explode(F.sequence(F.lit(0), top)))
    block = F.expr("shiftright(_rank, _lvl + 1)")
    right = F.expr("shiftright(_rank, _lvl) & 1")
    levels = levels.withColumn("_blk", block).withColumn("_right", right)
    bk = [*keys, "_lvl", "_blk"]
    runs = running_sums(
        levels, bk, y,
        {"l": F.when(F.col("_right") == 0, F.col("_w")).otherwise(0), "r": F.when(F.col("_right") == 1, F.col("_w")).otherwise(0)},
        hot,  # a block is a part of a key
    )
    above = F.col("l_total") - F.col("l_before") - F.col("l")
    discordant = runs.groupBy(*keys).agg(F.sum(F.col("r") * above).alias("_d"))

    def tied(cols: list[str], out: str) -> DataFrame:
        c = F.col("_c").cast("double")
        grouped = rows.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_c"))
        return grouped.groupBy(*keys).agg(F.sum(c * (c - 1) / 2).alias(out), F.sum("_c").alias("_m"))

    ties = tied([x], "_n1").join(tied([y], "_n2").drop("_m"), keys).join(tied([x, y], "_n3").drop("_m"), keys)
    m = F.col("_m").cast("double")
    n0 = m * (m - 1) / 2
    net = n0 - F.col("_n1") - F.col("_n2") + F.col("_n3") - 2 * F.col("_d")
    den = F.sqrt((n0 - F.col("_n1")) * (n0 - F.col("_n2")))
    tau = F.coalesce(ratio(net, den), F.lit(0.0))
    return ties.join(discordant, keys).select(*keys, F.col("_m").alias("n_test"), tau.alias("kendall_tau"))


def ranking_metrics(pred: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    hot = has_hot_key(pred, list(keys))
    rho = spearman(pred, keys, y, yhat, hot).drop("n")
    return kendall_tau(pred, keys, y, yhat, hot).join(rho, list(keys))


def metric_divergence(scores: DataFrame, r2_below: float = 0.02, rho_above: float = 0.05) -> DataFrame:
    """Model pairs of a task; ``diverges`` where they agree in R2 but differ in Spearman."""
    cols = ["model", "r2", "spearman"]
    a = scores.select("task_key", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = scores.select("task_key", *[F.col(c).alias(f"{c}_b") for c in cols])
    d_r2, d_rho = F.abs(F.col("r2_a") - F.col("r2_b")), F.abs(F.col("spearman_a") - F.col("spearman_b"))
    both = a.join(b, "task_key").where("model_a < model_b")
    both = both.withColumn("delta_r2", d_r2).withColumn("delta_spearman", d_rho)
    return both.withColumn("diverges", (F.col("delta_r2") < r2_below) & (F.col("delta_spearman") > rho_above))
