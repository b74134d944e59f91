import numpy as np
import pandas as pd
import pytest

from panelcast.operators import order_stats as o


def _frame(spark, n=5000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n)),
            "v": np.round(rng.lognormal(3, 2, n), 1),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_agree_on_both_paths(spark):
    pdf, df = _frame(spark)
    probs = {"p05": 0.005, "med": 0.5, "p99": 0.995}
    want = pdf.groupby("k")["v"].quantile(list(probs.values())).unstack()
    for hot_rows in (10**6, 1200, 0):
        got = o.exact_quantiles(df, ["k"], "v", probs, hot_rows).toPandas().set_index("k").sort_index()
        assert np.allclose(got[list(probs)].values, want.sort_index().values)


@pytest.mark.parametrize("hot", [True, False, None])
def test_average_ranks_match_pandas(spark, hot):
    pdf, df = _frame(spark)
    got = o.average_ranks(df, ["k"], "v", "r", hot).toPandas()
    pdf["r"] = pdf.groupby("k")["v"].rank(method="average")
    want = pdf.drop_duplicates(["k", "v"])
    both = got.merge(want, on=["k", "v"], suffixes=("", "_w"))
    assert len(both) == len(want) == len(got)
    assert np.allclose(both["r"], both["r_w"])


@pytest.mark.parametrize("hot", [True, False])
def test_positions_are_a_permutation(spark, hot):
    from pyspark.sql import functions as F

    _, df = _frame(spark)
    df = df.withColumn("id", F.monotonically_increasing_id()).withColumn("h", F.md5(F.col("id").cast("string")))
    got = o.number_in_order(df, ["k"], "h", "id", hot=hot).toPandas().sort_values(["k", "h"])
    assert (got.groupby("k").cumcount() == got["pos"]).all()


@pytest.mark.parametrize("hot", [True, False])
def test_null_keys_heavy_ties_and_one_large_key(spark, hot):
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.9, "big", rng.choice(list("abc"), n)).astype(object)
    key[rng.random(n) < 0.25] = None
    pdf = pd.DataFrame({"k": key, "v": np.round(rng.lognormal(0, 1, n), 1), "id": np.arange(n)})
    df = spark.createDataFrame(pdf)
    keep = pdf.assign(k=pdf["k"].fillna("<null>"))
    got = o.average_ranks(df, ["k"], "v", "r", hot).toPandas()
    got["k"] = got["k"].fillna("<null>")
    keep["r"] = keep.groupby("k")["v"].rank(method="average")
    both = got.merge(keep.drop_duplicates(["k", "v"]), on=["k", "v"], suffixes=("", "_w"))
    assert len(both) == len(got) and np.allclose(both["r"], both["r_w"])
    q = o.exact_quantiles(df, ["k"], "v", {"m": 0.5, "hi": 0.99}, 0 if hot else 10**6).toPandas()
    q["k"] = q["k"].fillna("<null>")
    want = keep.groupby("k")["v"].quantile([0.5, 0.99]).unstack().sort_index()
    assert np.allclose(q.set_index("k").sort_index()[["m", "hi"]].values, want.values)
    from pyspark.sql import functions as F

    placed = o.number_in_order(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["k"], "h", "id", hot=hot).toPandas()
    placed["k"] = placed["k"].fillna("<null>")
    placed = placed.sort_values(["k", "h"])
    assert len(placed) == n and (placed.groupby("k").cumcount() == placed["pos"]).all()
