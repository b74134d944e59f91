import numpy as np
import pandas as pd
import pytest

from panelcast import spec
from panelcast.models import linear, mixed


def _data(n=120, p=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = x @ rng.normal(size=p) + 2 + rng.normal(size=n)
    a = np.column_stack([np.ones(n), x, y])
    return x, y, a.T @ a


def test_ridge_is_the_penalised_least_squares_solution():
    x, y, m = _data()
    for alpha, coef in zip([0.1, 10.0], linear.ridge_path(m, [0.1, 10.0])):
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(5), xc.T @ yc)
        assert np.allclose(coef[1:], want)
        assert np.isclose(coef[0], y.mean() - x.mean(0) @ want)


def test_elastic_net_meets_its_optimality_conditions():
    x, y, m = _data()
    alpha, l1 = 0.2, 0.5
    coef = linear.elastic_net_path(m, [alpha], [l1], tol=1e-12)[0]
    resid = y - coef[0] - x @ coef[1:]
    grad = x.T @ resid / len(y) - alpha * (1 - l1) * coef[1:]
    active = coef[1:] != 0
    assert np.allclose(grad[active], alpha * l1 * np.sign(coef[1:][active]), atol=1e-6)
    assert (np.abs(grad[~active]) <= alpha * l1 + 1e-6).all()


def test_validation_r2_from_products():
    x, y, m = _data()
    coef = linear.ridge_path(m, [1.0])
    yhat = coef[0][0] + x @ coef[0][1:]
    want = 1 - ((y - yhat) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.isclose(linear.r2_from_products(m, coef)[0], want)


def _panel(n=400, seed=3):
    rng = np.random.default_rng(seed)
    months = np.array([spec.VISIT_MONTHS[v] for v in spec.VISIT_ORDER], float)
    d = np.array([[9.0, 0.05], [0.05, 0.01]])
    rows = []
    for _ in range(n):
        b = rng.multivariate_normal([0, 0], d)
        seen = rng.random(5) < 0.8
        t = months[:5][seen]
        rows.append((t, 20 + b[0] + (0.3 + b[1]) * t + rng.normal(0, 2, len(t)), sum(1 << i for i in range(5) if seen[i])))
    return months, d, [r for r in rows if len(r[0])]


def _sums(rows):
    out = {}
    for t, y, p in rows:
        q = np.array([y.sum(), (t * y).sum()])
        out.setdefault(p, np.zeros(7))
        out[p] += [1, q[0], q[1], q[0] * q[0], q[0] * q[1], q[1] * q[1], (y * y).sum()]
    return list(out), np.array(list(out.values()))


def _reml(rows, d, s2):
    xtx, xty, yty, logdet = np.zeros((2, 2)), np.zeros(2), 0.0, 0.0
    for t, y, _ in rows:
        z = np.column_stack([np.ones(len(t)), t])
        v = z @ d @ z.T + s2 * np.eye(len(t))
        vi = np.linalg.inv(v)
        xtx += z.T @ vi @ z
        xty += z.T @ vi @ y
        yty += y @ vi @ y
        logdet += np.linalg.slogdet(v)[1]
    return -0.5 * (logdet + np.linalg.slogdet(xtx)[1] + yty - xty @ np.linalg.solve(xtx, xty))


def test_em_raises_the_restricted_likelihood_and_recovers_parameters():
    months, d_true, rows = _panel()
    patterns, sums = _sums(rows)
    trace = []
    beta, d, s2 = mixed.em_fit(patterns, sums, months, trace=trace)
    lik = [_reml(rows, dd, ss) for dd, ss in trace[:40]]
    assert all(b >= a - 1e-6 for a, b in zip(lik, lik[1:]))
    assert np.allclose(beta, [20, 0.3], atol=0.6)
    assert abs(s2 - 4) < 0.6
    assert abs(d[0, 0] - d_true[0, 0]) < 3 and abs(d[1, 1] - d_true[1, 1]) < 0.006


def test_pattern_predictions_are_blups():
    months, _, rows = _panel(60)
    patterns, sums = _sums(rows)
    beta, d, s2 = mixed.em_fit(patterns, sums, months)
    pdf = pd.DataFrame(sums, columns=mixed.SUMS).assign(pattern=patterns, task_key="k", seed=0, fold=0)
    lines = mixed._fit_key(pdf, {"k": 48}, months).set_index("pattern")
    for t, y, p in rows[:20]:
        z = np.column_stack([np.ones(len(t)), t])
        v = z @ d @ z.T + s2 * np.eye(len(t))
        b = d @ z.T @ np.linalg.solve(v, y - z @ beta)
        want = np.array([1, 48.0]) @ (beta + b)
        got = lines.loc[p, "p0"] + lines.loc[p, "p1"] * y.sum() + lines.loc[p, "p2"] * (t * y).sum()
        assert got == pytest.approx(want, rel=1e-6)
