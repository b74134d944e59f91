import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import metrics, resample
from panelcast.operators.resample import paired_tests
from panelcast.sources import stage


def _md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_paired_tests_with_more_rows_than_folds(spark):
    rng = np.random.default_rng(0)
    sizes = {"long": 40, "short": 6}
    d = {k: rng.normal(0.3, 1, n) for k, n in sizes.items()}
    rows = [(k, i, float(x)) for k, v in d.items() for i, x in enumerate(v)] + [("few", 0, 1.0), ("few", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, d double")
    got = {r.k: r for r in paired_tests(df.withColumnRenamed("i", "fold"), ["k"], ["fold"], n_perm=60, n_boot=50, seed=9).collect()}
    assert set(got) == set(d)
    for k, v in d.items():
        n = len(v)
        signs = np.array([[-1.0 if _md5(9, p, i)[0] < "8" else 1.0 for i in range(1, n + 1)] for p in range(1, 61)])
        extreme = (np.abs(signs @ v / n) >= abs(v.mean()) - 1e-12).sum()
        means = [np.mean([v[int(_md5(9, b, i)[:8], 16) % n] for i in range(1, n + 1)]) for b in range(1, 51)]
        r = got[k]
        assert r.n_folds == n
        np.testing.assert_allclose(
            [r.observed_diff, r.p_value, r.ci_lo, r.ci_hi, r.cohens_d],
            [v.mean(), (extreme + 1) / 61, *np.quantile(means, [0.025, 0.975]), v.mean() / v.std(ddof=1)],
        )


def test_stage_folder_must_be_shared_off_local_mode():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.stage_folder(Session())


def test_changed_input_has_another_version(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    first = stage.input_version(spark, str(tmp_path))
    assert first == stage.input_version(spark, str(tmp_path))
    spark.range(4).write.parquet(str(tmp_path / "b.parquet"))
    assert first != stage.input_version(spark, str(tmp_path))


def test_signed_rank_tail_counts_all_sign_patterns(spark):
    import itertools

    from pyspark.sql import functions as F

    from panelcast.functions.pvalues import signed_rank_upper

    rows = [(n, w) for n in (1, 4, 7) for w in range(n * (n + 1) // 2 + 1)]
    got = spark.createDataFrame(rows, "n int, w int").select("n", "w", signed_rank_upper(F.col("n"), F.col("w")).alias("p")).collect()
    for r in got:
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product([0, 1], repeat=r.n)]
        assert abs(r.p - np.mean(np.array(sums) >= r.w)) < 1e-12


def _drawn(idents, n_boot, seed):
    """Resamples of a key as lists of row numbers."""
    place = sorted(range(len(idents)), key=lambda i: (_md5(seed, idents[i]), idents[i]))
    n = len(idents)
    word = lambda b, j: int(_md5(seed, b, j // 4)[j % 4 * 8 :][:8], 16)
    return [[place[word(b, j) % n] for j in range(n)] for b in range(1, n_boot + 1)]


def _keyed(rng, sizes, second):
    rows = [(k, f"e{i}", float(rng.integers(0, 12)), float(second(rng))) for k, n in sizes.items() for i in range(n)]
    return rows + [("b", "gap", None, 1.0), ("b", "gap2", 1.0, None)]


@pytest.mark.parametrize("task_rows", [1000, 20])
def test_row_bootstrap_of_regression_scores(spark, task_rows):
    rows = _keyed(np.random.default_rng(2), {"a": 11, "b": 40, "few": 9}, lambda r: r.integers(0, 5))
    rows += [("flat", f"e{i}", 1.0, 2.0) for i in range(25)]
    df = spark.createDataFrame(rows, "k string, e string, y double, p double").repartition(3)

    def spread(d, keys):
        return metrics.regression_metrics(d, keys, "y", "p")

    names = {resample.score_moments: ["r2", "mae", "rmse", "pearson"], resample.score_ranks: ["spearman"]}
    got = {}
    for score, own in names.items():
        out = resample.bootstrap_scores(df, ["k"], "e", ["y", "p"], score, spread, own, n_boot=30, seed=5, task_rows=task_rows)
        got.update({(r.k, r.metric): r for r in out.collect()})
    assert len(got) == 4 * 5
    for k in ("a", "b", "flat"):
        own = [r for r in rows if r[0] == k and None not in r]
        y, p = (np.array([r[c] for r in own]) for c in (2, 3))

        def scores(at, y=y, p=p):
            y, p = y[at], p[at]
            sse, flat = ((y - p) ** 2).sum(), y.std() < 1e-10 or p.std() < 1e-10
            r2 = float(sse == 0) if y.std() == 0 else 1 - sse / ((y - y.mean()) ** 2).sum()
            rho = 0.0 if flat else pd.Series(y).corr(pd.Series(p), method="pearson")
            rank = 0.0 if flat else pd.Series(y).rank().corr(pd.Series(p).rank())
            return {"r2": r2, "mae": np.abs(y - p).mean(), "rmse": np.sqrt(sse / len(y)), "pearson": rho, "spearman": rank}

        boots = [scores(at) for at in _drawn([r[1] for r in own], 30, 5)]
        for m, point in scores(list(range(len(own)))).items():
            v, r = np.array([b[m] for b in boots]), got[k, m]
            np.testing.assert_allclose([r.point, r["mean"], r.ci_lo, r.ci_hi, r.se], [point, v.mean(), *np.quantile(v, [0.025, 0.975]), v.std()], atol=1e-9, err_msg=f"{k} {m}")
    few = got["few", "r2"]
    assert [few.point, few.ci_lo, few.se] == [None, None, None]


@pytest.mark.parametrize("task_rows", [1000, 20])
def test_row_bootstrap_of_class_scores(spark, task_rows):
    rng = np.random.default_rng(3)
    rows = [("a", f"e{i}", float(i < 2), float(rng.integers(0, 4)) / 4) for i in range(12)]
    rows += [("b", f"e{i}", float(rng.random() < 0.4), float(rng.random())) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, e string, y double, prob double").repartition(2)

    def spread(d, keys):
        both = metrics.auroc(d, keys).join(metrics.auprc(d, keys), keys)
        return both.withColumn("auprc", F.when(F.col("auroc").isNotNull(), F.col("auprc")))

    out = resample.bootstrap_scores(df, ["k"], "e", ["y", "prob"], resample.score_classes, spread, ["auroc", "auprc"], n_boot=40, seed=5, task_rows=task_rows)
    got = {(r.k, r.metric): r for r in out.collect()}
    assert len(got) == 4
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        areas, steps = [], []
        for at in _drawn([r[1] for r in own], 40, 5):
            y, s = (np.array([own[i][c] for i in at]) for c in (2, 3))
            up, down = s[y == 1], s[y == 0]
            if len(up) and len(down):
                areas.append((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2)
                steps.append(sum((up == v).sum() / len(up) * (up >= v).sum() / (s >= v).sum() for v in np.unique(s)))
        for m, v in (("auroc", areas), ("auprc", steps)):
            r = got[k, m]
            np.testing.assert_allclose([r["mean"], r.ci_lo, r.ci_hi, r.se], [np.mean(v), *np.quantile(v, [0.025, 0.975]), np.std(v)], atol=1e-9)
        assert k == "b" or len(areas) < 40


@pytest.mark.parametrize("task_rows", [1000, 7])
def test_swapped_predictions(spark, task_rows):
    rng = np.random.default_rng(4)
    rows = [(k, f"e{i}", *map(float, rng.normal(0, 1, 3))) for k, n in (("a", 1), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("b", "gap", 1.0, None, 1.0)], "k string, e string, y double, a double, b double")
    got = {r.k: r for r in resample.paired_prediction_test(df, ["k"], "e", n_perm=150, seed=5, task_rows=task_rows).collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        y, a, b = (np.array([r[c] for r in own]) for c in (2, 3, 4))
        r2 = lambda p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()  # noqa: B023, E731
        g = (y - b) ** 2 - (y - a) ** 2
        bit = lambda i, p: int(_md5(5, p // 128, i)[p % 128 // 4], 16) >> (3 - p % 4) & 1
        sums = np.array([sum(x * (-1) ** bit(r[1], p) for r, x in zip(own, g, strict=True)) for p in range(150)])
        assert got[k].n == len(own)
        assert abs(got[k].p_value - ((np.abs(sums) >= abs(g.sum()) * (1 - 1e-12)).sum() + 1) / 151) < 1e-12
        assert got[k].observed_diff is None if k == "a" else abs(got[k].observed_diff - (r2(a) - r2(b))) < 1e-9


def test_words_of_many_draws_are_md5():
    for seed, boot, n in ((42, 1, 1), (7, 2000, 45), (42, 31, 41_003)):
        want = b"".join(hashlib.md5(f"{seed}|{boot}|{j}".encode()).digest() for j in range(-(-n // 4)))
        np.testing.assert_array_equal(resample._words(seed, boot, n), np.frombuffer(want, ">u4"))


def test_keys_of_a_task_share_the_words_of_its_draws(monkeypatch):
    rng, made, words = np.random.default_rng(2), [], resample._words
    monkeypatch.setattr(resample, "_words", lambda *a: made.append(a) or words(*a))
    few = {i: (rng.integers(0, 2, n).astype(float), rng.integers(0, 3, n) / 3) for i, n in enumerate((400, 400, 150))}
    got = resample._drawn_scores(few, resample.score_moments, range(1, 21), 9)
    assert len(made) == 20 and all(n == 400 for *_, n in made)
    for key, (y, p) in few.items():
        at = np.array([words(9, b, len(y))[: len(y)] % len(y) for b in range(1, 21)])
        want = np.sqrt(((y - p)[at] ** 2).mean(axis=1))
        np.testing.assert_allclose(np.concatenate([g["rmse"] for g in got[key]]), want)
