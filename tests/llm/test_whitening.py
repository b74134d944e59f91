import numpy as np
import pytest

from panelcast.llm import whitening

SHAPE = "vec_id long, embedding array<float>, n string"


def matrix_with(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1], [1e8, 1e4, 1, 1e-3], [5, 5 - 1e-9, 5 - 3e-9, 2, 1], [5, 5 + 1e-12, 5 + 1e-11, 4, 4 + 1e-10, 1], [2, 2, 2, 1, 1], [3, 0, 0, 0],
])
def test_refined_pairs_are_double_precise(values):
    v = matrix_with(values)
    v = (v + v.T) / 2
    found, x = whitening.refined_eigenpairs(v)
    assert np.allclose(found, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-15 * max(values) * len(values))
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-15 * len(v)
    a, y = v.astype(np.longdouble), x.astype(np.longdouble)
    assert np.abs(a @ y - y * found).max() < 4e-16 * max(values) * len(v)


def test_clustered_eigenvectors_are_separated():
    """Neighbours 1e-9 apart: float32 cannot tell them apart, the sub-solve does."""
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(6, 6)))[0].astype(np.longdouble)
    values = np.array([5, 5 - 1e-9, 5 - 2e-9, 3, 2, 1], np.longdouble)
    v = ((q * values) @ q.T).astype(float)
    _, x = whitening.refined_eigenpairs(v)
    assert np.abs(np.abs((q.T @ x).astype(float)) - np.eye(6)).max() < 1e-5  # the matrix itself is rounded at 1e-16 / 1e-9


def rows_of(x, start=0):
    return [(start + i, [float(c) for c in v], "x") for i, v in enumerate(x)]


def brute(x):
    v = np.floor(1024 * x.astype(np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(v), v.sum(axis=0)
    d = v - s / n
    e, w = np.linalg.eigh(d.T @ d / n)
    return n, ((n * v - s) ** 2).sum(axis=1), d @ w[:, ::-1] / np.sqrt(e[::-1]), e[::-1]


def test_against_brute_force_with_unusable_rows(spark):
    x = np.random.default_rng(1).normal(size=(300, 12)) * np.linspace(1, 3, 12)
    bad = [(900, None, "x"), (901, [None] + [1.0] * 11, "x"), (902, [float("nan")] * 12, "x"), (903, [float("inf")] * 12, "x")]
    rows = rows_of(x) + [(None, [0.5] * 12, "null id")] * 2
    df = spark.createDataFrame(rows + bad, SHAPE).repartition(5)
    got, model, error = whitening.whiten(df, components=8)
    n, deviation, white, values = brute(np.vstack([x, [[0.5] * 12] * 2]))
    assert model.n == n and error < 1e-12 and np.allclose(model.values, values, rtol=1e-12)
    found = {r["vec_id"]: r for r in got.collect() if r["vec_id"] is not None}
    assert sorted(found) == list(range(300)) and got.count() == 302
    mine = np.array([found[i]["whitened"] for i in range(300)])
    sign = np.sign((mine * white[:300, :8]).sum(axis=0))
    assert np.allclose(mine * sign, white[:300, :8], atol=1e-9)
    assert [int(found[i]["deviation"]) for i in range(300)] == deviation[:300].tolist()


def test_query_columns(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(60, 9))
    spark.createDataFrame(rows_of(x), SHAPE).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_embedding_whitening(spark, str(tmp_path))
    assert got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    rows = got.collect()
    _, _, _, values = brute(x)
    assert len(rows) == 480 and {r["n"] for r in rows} == {60}
    assert sorted({round(r["explained"], 12) for r in rows}, reverse=True) == [round(v / values.sum(), 12) for v in values[:8]]


def test_empty_constant_short_and_huge_vectors(spark):
    for rows in ([], [(1, None, "x")], rows_of(np.ones((4, 3)))):
        got, model, error = whitening.whiten(spark.createDataFrame(rows, SHAPE))
        assert error == 0 and model.rank == 0 and all(r["whitened"] == [] for r in got.collect())
    got, model, _ = whitening.whiten(spark.createDataFrame([(1, [1.0], "x"), (2, [0.0, 2.0], "x"), (3, [], "x")], SHAPE))
    assert model.rank == 2 and model.sums == [301024, 302048]
    big = [(i, [float(2.0**40 * (i + 1)), 1.0], "x") for i in range(3)]
    got, model, _ = whitening.whiten(spark.createDataFrame(big, SHAPE))
    v = [int(1024 * 2**40 * (i + 1)) + 100_000 for i in range(3)]
    assert sorted(int(r["deviation"]) for r in got.collect()) == sorted((3 * a - sum(v)) ** 2 for a in v)
