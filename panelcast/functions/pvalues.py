"""Tail probabilities Spark has no built-in for, as Arrow-batched functions on small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def student_t_two_sided(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        bad = ts.isna() | dfs.isna()
        p = [np.nan if m else _incomplete_beta(v / 2, 0.5, v / (v + x * x)) for x, v, m in zip(ts, dfs, bad)]
        return pd.Series(p).where(~bad.values, None)

    return tail(t.cast("double"), df.cast("double"))


def signed_rank_upper(n: Column, w: Column) -> Column:
    """P(W >= w) of the signed-rank statistic of n untied differences, from the number of rank subsets by their sum."""

    @F.pandas_udf("double")
    def tail(ns: pd.Series, ws: pd.Series) -> pd.Series:
        out = []
        for size, value in zip(ns, ws):
            if pd.isna(size) or pd.isna(value):
                out.append(None)
                continue
            ways = np.ones(1)
            for rank in range(1, int(size) + 1):
                grown = np.zeros(len(ways) + rank)
                grown[: len(ways)] += ways
                grown[rank:] += ways
                ways = grown / 2
            out.append(float(ways[max(0, math.ceil(value)) :].sum()))
        return pd.Series(out, dtype="float64")

    return tail(n.cast("double"), w.cast("double"))


def normal_upper(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(zs: pd.Series) -> pd.Series:
        return zs.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)))

    return tail(z.cast("double"))
