import math

import pytest
from pyspark.sql import functions as F

from panelcast.functions import text as t

CASES = [
    (t.loose_number, {"1,5": 1.5, "<5": 5, ">=3.2": 3.2, "1.2-3.4": 2.3, "-1-2": 0.5, "12 mg": 12, ".5": 5, "1,234": 1.234, "abc": None, "": None}),
    (t.strict_number, {"12 mg": None, ".5": None, "1e3": None, "<5": 5, "1.2-3.4": 2.3, "-1-2": None, "1–3": 2, "-4": -4}),
    (t.lod_number, {"<0.0560": 0.056 / math.sqrt(2), "< 2": math.sqrt(2), "0.5": 0.5, ">3": None, "1e3": 1000}),
    (t.month_year, {"03/2015": 201503, "13/2015": None, "3/2015": None, "2015-03": None, " 3/2015": 201503}),
    (t.dose_factor, {"300": None, "LD x 0.33": 0.33, "(150 + LD) x 0.33": None}),
    (t.canonical_visit, {" v4 ": "V04", "V00": "BL", "V0": "BL", "visit 0": "BL", "Baseline": "BL", "screening": "SC", "V04A": "V04A", "v100": "V100", "RS1": "RS1"}),
    (t.simple_visit, {"SCREENING": "SC", "Baseline": "Baseline", "V00": "BL", "V04": "V04"}),
    (t.state_tag, {"ON": "ON", "NONE": "ON", "off state": "OFF", "": "UNK", "x": "UNK"}),
    (t.to_number, {"1d": None, "NaN": None, " 2.5 ": 2.5, "1e3": 1000, "x": None}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_text_rules(spark, fn, cases):
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["o"] for r in df.select("s", fn(F.col("s")).alias("o")).collect()}
    for key, want in cases.items():
        if isinstance(want, (int, float)):
            assert got[key] == pytest.approx(want), key
        else:
            assert got[key] == want, key


def test_allele_counts(spark):
    df = spark.createDataFrame([("E3/E4",), ("33",), ("E2/E2/E4",), ("E3",)], "s string")
    c = t.allele_counts(F.col("s"))
    got = [tuple(r) for r in df.select(c["2"], c["3"], c["4"]).collect()]
    assert got == [(0, 1, 1), (0, 2, 0), (2, 0, 0), (None, None, None)]
