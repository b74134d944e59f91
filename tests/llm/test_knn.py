import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelcast.llm import knn
from panelcast.llm.registry import ORACLES, QUERIES


def brute(rows, k):
    data = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            data.append((i, tuple(math.floor(256 * x) for x in v)))
    data = sorted(set(data))
    out = set()
    for i, q in data:
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in data if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("scale,small", [(1.0, True), (1.0, False), (3e5, False)])
def test_matches_brute_force(spark, monkeypatch, scale, small):
    if small:
        monkeypatch.setattr(knn, "GROUP_ROWS", 7)
        monkeypatch.setattr(knn, "CHUNK_ROWS", 50)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [scale * float(f"{x + rng.gauss(0, 0.1):.3f}") for x in rng.choice(centres)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (505, [1.0, None]), (510, [math.nan] * 6), (515, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (520, [0.5, 0.25]), (525, []), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    got = knn.top_k(df, F.col("vec_id") % 5 == 0, pivots=12)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert knn.top_k(df.where("vec_id = 5"), F.col("vec_id") % 5 == 0).count() == 0


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = {tuple(r) for r in QUERIES["op4_exact_top_k"](spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert got == set(con.execute(ORACLES["op4_exact_top_k"]).fetchall())
