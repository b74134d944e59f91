import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<float>, label int, id string"


def brute(rows, shift=True):
    clean = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if shift and i % 7 == 0 else label
        clean[(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), label)] = None
    out = []
    for a, v, la in clean:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, lb == la) for i, w, lb in clean if i != a]
        for ps, pid, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted(x for x in scored if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            out += [(a, pid, r + 1, nid, -ps, -s) for r, (s, nid, _) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SHAPE)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hn.mine(df, F.col("vec_id") % 100 == 0, label, **sizes).collect()))


def rows_of(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, dims))
    kind = rng.integers(labels * 2, size=n)
    return [(i * 25, (centres[k] + 0.4 * rng.normal(size=dims)).tolist(), int(k % labels), "x") for i, k in enumerate(kind)]


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = hn.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, x = rng.integers(-300, 300, (5, 7)), rng.integers(-300, 300, (40, 7))
    low, high = hn.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    assert (low <= (a @ x.T).min(axis=1)[:, None]).all() and (high >= (a @ x.T).max(axis=1)[:, None]).all()


@pytest.mark.parametrize("dims", [3, 16])
def test_against_brute_force_over_many_shards(spark, dims):
    rows = rows_of(400, dims, dims)
    got = run(spark, rows, shard_rows=60, block_rows=10, group_rows=30)
    assert got == brute(rows) and got


def test_blocks_are_pruned_in_few_dimensions(spark):
    rows = spark.createDataFrame(rows_of(600, 2, 5), SHAPE).select(
        F.col("vec_id").alias("id"), hn.quantised("embedding").alias("v"), F.col("label").cast("long").alias("label"), F.lit(False).alias("asks"))
    zones = hn.zone_maps(hn.blocks(rows, 200, 20)).collect()
    sizes = [np.prod([h - low for low, h in zip(z["low"], z["high"])]) for z in zones]
    whole = np.prod(np.max([z["high"] for z in zones], axis=0) - np.min([z["low"] for z in zones], axis=0))
    assert len(zones) >= 30 and np.median(sizes) < whole / 10


def test_ties_repeats_unusable_rows_and_hot_vector(spark):
    rows = rows_of(40, 4, 9) + [(10_000 + i, [1.0, 0.5, 0.25, 1.0], 1, "copy") for i in range(150)]
    rows += rows[:20] + [(None, [1.0] * 4, 1, "x"), (100_000, None, 1, "x"), (100_100, [1.0, None, 0.0, 0.0], 1, "x"),
                         (100_200, [float("nan")] * 4, 1, "x"), (100_300, [1.0] * 4, None, "x"), (100_400, [0.0] * 4, 3, "zero"), (100_500, [1.0], 9, "short")]
    padded = [(i, (v + [0.0] * (4 - len(v))) if v else v, label, s) for i, v, label, s in rows]
    assert run(spark, rows, shard_rows=50, block_rows=8, group_rows=4) == brute(padded)


def test_empty_and_single(spark):
    assert run(spark, []) == [] and run(spark, [(100, [1.0, 2.0], 1, "x")]) == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted(map(tuple, hn.op12_hard_negatives(spark, folder).collect()))
    want = duckdb.sql(hn.SQL_HARD_NEGATIVES.replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'")).fetchall()
    assert got == sorted(want)
