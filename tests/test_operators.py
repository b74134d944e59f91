import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import analyses, cleaning, folds, metrics, normalise, resample, reshape
from panelcast.operators.order_stats import exact_quantiles


def test_screening_rules(spark):
    df = spark.createDataFrame([("A", "SC"), ("A", "BL"), ("B", "SC"), ("C", "V04")], "PATNO string, EVENT_ID string")
    got = sorted(map(tuple, cleaning.drop_sc_if_bl(df).collect()))
    assert got == [("A", "BL"), ("B", "SC"), ("C", "V04")]
    got = sorted(map(tuple, cleaning.sc_to_bl(df).collect()))
    assert got == [("A", "BL"), ("A", "SC"), ("B", "BL"), ("C", "V04")]


def test_vital_repairs(spark):
    df = spark.createDataFrame([(v,) for v in (36.5, 97.0, 104.0, 108.0, 60.0, 365.0)], "TEMPC double")
    got = [r[0] for r in df.select(cleaning.repair_temperature(F.col("TEMPC"))).collect()]
    assert got[:3] == pytest.approx([36.5, 36.111111, 40.0]) and got[3:] == [None] * 3
    df = spark.createDataFrame([(70.0,), (50.0,), (100.0,)], "HTCM double")
    assert [r[0] for r in df.select(cleaning.repair_height(F.col("HTCM"))).collect()] == [pytest.approx(177.8), None, 100.0]


def test_zero_vitals(spark):
    cols = cleaning.SUPINE + cleaning.STANDING
    rows = [(0.0,) * 6, (120.0, 80.0, 70.0, 0.0, 0.0, 0.0), (None, None, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got = [tuple(r) for r in cleaning.zero_vitals_to_null(df).select(*cols).collect()]
    assert got == [(None,) * 6, (120.0, 80.0, 70.0, None, None, None), (None, None, None, 0.0, 0.0, 0.0)]


def test_dose_totals(spark):
    df = spark.createDataFrame([(1, 300.0, None), (1, 100.0, None), (1, None, 0.33), (2, None, 0.33)], "e int, d double, f double")
    got = {r["e"]: r["ld_numeric"] + r["formula_contrib"] for r in reshape.dose_totals(df, ["e"], F.col("d"), F.col("f")).collect()}
    assert got[1] == pytest.approx(532.0) and got[2] == 0


def test_strata_edges_and_dealing(spark):
    df = spark.createDataFrame([("t", i, float(i), False) for i in range(1, 11)], "task_key string, entity_id int, y double, is_class boolean")
    got = [r["stratum"] for r in folds.with_strata(df, ["task_key"]).orderBy("y").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    one = spark.createDataFrame([("t", i, 0) for i in range(7)], "task_key string, entity_id int, stratum int")
    dealt = folds.deal(one, ["task_key"], 5, F.md5(F.col("entity_id").cast("string")))
    assert sorted(r["count"] for r in dealt.groupBy("fold").count().collect()) == [1, 1, 1, 2, 2]


def test_normaliser_kinds(spark):
    rows = [("b", v) for v in (0.0, 1.0, 1.0)] + [("o", v) for v in (1.0, 1.0, 2.0, 2.0)] + [("c", 7.5)] * 3
    counts = spark.createDataFrame([("t", 0, 0, f, v) for f, v in rows], "task_key string, seed int, fold int, feature string, value double")
    counts = counts.groupBy("task_key", "seed", "fold", "feature", "value").agg(F.count(F.lit(1)).alias("w"))
    stats = {r["feature"]: r for r in normalise.fit(counts).collect()}
    assert (stats["b"]["kind"], stats["b"]["mode"]) == ("binary", 1.0)
    assert (stats["o"]["kind"], stats["o"]["mode"]) == ("ordinal", 1.0)
    assert stats["c"]["kind"] == "continuous" and stats["c"]["std"] == 0.0


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("k", 1.0, 3), ("k", 5.0, 2), ("k", 9.0, 4)], "k string, v double, w long")
    flat = np.repeat([1.0, 5.0, 9.0], [3, 2, 4])
    for hot in (10**6, 0):
        r = exact_quantiles(df, ["k"], "v", {"a": 0.3, "b": 0.5}, hot, "w").first()
        assert [r["a"], r["b"]] == pytest.approx(list(np.quantile(flat, [0.3, 0.5])))


def test_auc_fixture(spark):
    df = spark.createDataFrame([("k", y, s) for y, s in zip([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])], "k string, y int, prob double")
    assert metrics.auroc(df, ["k"]).first()["auroc"] == pytest.approx(0.75)
    assert metrics.auprc(df, ["k"]).first()["auprc"] == pytest.approx(0.833333, abs=1e-6)


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, 150).astype(float), rng.normal(size=150).round(1)
    y = np.round(0.1 * x + y, 1)
    net = n1 = n2 = 0
    for i, j in itertools.combinations(range(150), 2):
        net += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        n1 += x[i] == x[j]
        n2 += y[i] == y[j]
    n0 = 150 * 149 / 2
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y}))
    got = metrics.kendall_tau(df, ["k"], "x", "y").first()["kendall_tau"]
    assert got == pytest.approx(net / math.sqrt((n0 - n1) * (n0 - n2)))
    small = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 3.0), ("k", 3.0, 2.0), ("k", 4.0, 4.0)], "k string, x double, y double")
    r = metrics.ranking_metrics(small, ["k"], "x", "y").first()
    assert (r["kendall_tau"], r["spearman"]) == (pytest.approx(2 / 3), pytest.approx(0.8))


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", None)], "k string, p double")
    got = {r["k"]: r["q"] for r in resample.benjamini_hochberg(df, "p", "q").collect()}
    assert got == {"a": pytest.approx(0.02), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": pytest.approx(0.02), "e": None}


def test_calibration_fixture(spark):
    df = spark.createDataFrame([("k", float(y), p) for y, p in zip([1, 0, 1, 1], [1.0, 0.95, 0.05, 0.15])], "k string, y double, prob double")
    bins = analyses.calibration_bins(df, ["k"])
    r = analyses.calibration_errors(bins, ["k"], min_n=1).first()
    assert (r["ece"], r["mce"]) == (pytest.approx(0.6875), pytest.approx(0.95))


def test_stars_and_student_tail(spark):
    from panelcast.functions.pvalues import student_t_two_sided

    df = spark.createDataFrame([(0.0005, 2.0, 10.0), (0.005, 0.0, 5.0), (0.04, 1.0, 1.0), (0.05, 3.0, 200.0)], "p double, t double, df double")
    rows = df.select(resample.stars(F.col("p")).alias("s"), student_t_two_sided(F.col("t"), F.col("df")).alias("q")).collect()
    assert [r["s"] for r in rows] == ["***", "**", "*", ""]
    assert [r["q"] for r in rows] == pytest.approx([0.0733880, 1.0, 0.5, 0.0030425], abs=1e-6)
