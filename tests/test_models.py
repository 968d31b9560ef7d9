"""Cox and logistic models against plain loops."""

import math

import numpy as np
import pytest
from scoreloom.operators import models


def sample(n, seed, ties=7):
    rng = np.random.default_rng(seed)
    s, c = rng.normal(size=n), rng.normal(size=n)
    t = np.ceil(rng.exponential(np.exp(-0.6 * s + 0.3 * c)) * ties)
    return t, (rng.random(n) < 0.7).astype(int), s, c


def solve(gradient, size):
    b = np.zeros(size)
    for _ in range(60):
        g, h = gradient(b)
        b = b + np.linalg.solve(h, g)
    return b, np.linalg.inv(gradient(b)[1])


def plain_cox(t, e, x):
    """Efron's rule, event by event; residuals of every event against ranks."""
    order = sorted(set(t[e == 1]))

    def parts(b):
        w = np.exp(x @ b)
        for u in order:
            risk, dead = t >= u, (t == u) & (e == 1)
            d = dead.sum()
            means, spreads = [], []
            for k in range(d):
                v = w * risk - k / d * w * dead
                m = (v[:, None] * x).sum(0) / v.sum()
                means.append(m)
                spreads.append((v[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / v.sum() - np.outer(m, m))
            yield u, dead, np.array(means), np.sum(spreads, axis=0)

    def gradient(b):
        g, h = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        for _, dead, means, spread in parts(b):
            g += x[dead].sum(0) - means.sum(0)
            h += spread
        return g, h

    b, cov = solve(gradient, x.shape[1])
    residuals, times = [], []
    for u, dead, means, _ in parts(b):
        for row in x[dead]:
            residuals.append(row - means.mean(0))
            times.append(u)
    times = np.array(times)
    rank = np.array([(times < u).sum() + ((times == u).sum() + 1) / 2 for u in times])
    rank -= rank.mean()
    n = len(times)
    scaled = n * np.array(residuals) @ cov
    chi = (rank @ scaled[:, 0]) ** 2 / (n * cov[0, 0] * (rank @ rank))
    return b, cov, math.erfc(math.sqrt(chi / 2))


@pytest.mark.parametrize("rows", [20_000, 8])
def test_cox(spark, monkeypatch, rows):
    """With 8 rows to a range the scan goes over many ranges."""
    monkeypatch.setattr(models, "RANGE_ROWS", rows)
    data, want = [], {}
    for key, n in (("a", 90), (None, 61)):
        t, e, s, c = sample(n, n)
        data += [(key, float(a), int(b), float(x), float(y)) for a, b, x, y in zip(t, e, s, c)]
        z = (s - s.mean()) / s.std(ddof=1)
        want[key] = (plain_cox(t, e, np.column_stack([z, c])), plain_cox(t, e, z[:, None]), n, int(e.sum()))
    data += [("few", 1.0, 1, 1.0, 1.0), ("a", None, 1, None, 1.0), ("a", 1.0, 1, float("nan"), 1.0)]
    data += [("same", float(i), 1, 5.0, float(i)) for i in range(30)] + [("none", float(i), 0, float(i), 0.0) for i in range(30)]
    df = spark.createDataFrame(data, "k string, t double, e int, s double, c double")
    for covariates, at in ((("c",), 0), ((), 1)):
        got = {r["k"]: r for r in models.cox(df, "t", "e", "s", "k", covariates=covariates).collect()}
        assert {k: got[k]["reason"] for k in ("few", "same", "none")} == {"few": "too_few_rows", "same": "constant_score", "none": "too_few_events"}
        for k, w in want.items():
            b, cov, ph = w[at]
            r, se = got[k], math.sqrt(cov[0, 0])
            assert (r["n"], r["events"], r["reason"]) == (w[2], w[3], "")
            for x, y in ((r["coef"], b[0]), (r["hazard_ratio"], math.exp(b[0])), (r["ci_high"], math.exp(b[0] + 1.959963984540054 * se)), (r["p_value"], math.erfc(abs(b[0]) / se / math.sqrt(2))), (r["ph_p"], ph)):
                assert x == pytest.approx(y, rel=1e-8, abs=1e-12)
    assert models.cox(df.filter("k = 'no'"), "t", "e", "s", "k").count() == 0
    assert models.cox(df.filter("k = 'a'"), "t", "e", "s").first()["n"] == 90


def test_logistic(spark):
    rng = np.random.default_rng(5)
    s, c = rng.normal(size=200), rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-s + 0.5 * c - 0.2))).astype(int)
    data = [("a", int(v), float(a), float(b)) for v, a, b in zip(y, s, c)] + [("a", 2, 0.0, 0.0), ("b", 1, 1.0, 1.0)] + [("apart", int(i > 20), float(i > 20), 0.0) for i in range(40)]
    df = spark.createDataFrame(data, "k string, y int, s double, c double")
    full = np.append(s, 0.0)  # the score is standardised before rows with other labels go
    x = np.column_stack([(s - full.mean()) / full.std(ddof=1), c, np.ones(200)])

    def gradient(b):
        p = 1 / (1 + np.exp(-x @ b))
        return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x

    b, cov = solve(gradient, 3)
    got = {r["k"]: r for r in models.logistic(df, "y", "s", "k", covariates=("c",)).collect()}
    r, se = got["a"], math.sqrt(cov[0, 0])
    assert (r["n"], r["positives"], r["negatives"], r["reason"]) == (200, int(y.sum()), int(200 - y.sum()), "")
    for g, w in ((r["coef"], b[0]), (r["odds_ratio"], math.exp(b[0])), (r["ci_low"], math.exp(b[0] - 1.959963984540054 * se)), (r["p_value"], math.erfc(abs(b[0]) / se / math.sqrt(2)))):
        assert g == pytest.approx(w, rel=1e-8)
    assert got["b"]["reason"] == "too_few_rows" and got["apart"]["reason"] in ("not_converged", "singular") and got["apart"]["odds_ratio"] is None
