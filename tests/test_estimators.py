"""Tests and fits from sums over blocks, against direct computation on whole series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfold.operators import estimators as S
from larkfold.operators.blocks import pack


def table(spark, series, columns="k string, t long, x double"):
    return spark.createDataFrame([(k, t, *map(float, np.atleast_1d(v))) for k, x in series.items() for t, v in enumerate(x)][::-1], columns)


def plain_root(x):
    n, d = len(x), np.diff(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(p, skip):
        rows = range(skip + 1, n)
        a = np.array([[1, x[t - 1], *(d[t - 1 - i] for i in range(1, p + 1))] for t in rows])
        y = np.array([d[t - 1] for t in rows])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = float(((y - a @ beta) ** 2).sum())
        se = math.sqrt(rss / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        return len(y) * (math.log(2 * math.pi * rss / len(y)) + 1) + 2 * a.shape[1], beta[1] / se

    best = min((fit(p, most)[0], p) for p in range(most + 1))[1]
    return best, fit(best, best)[1]


def test_unit_root_of_blocks_equals_direct_regression(spark):
    rng = np.random.default_rng(1)
    ar = [0.0]
    for e in rng.normal(size=299):
        ar.append(0.6 * ar[-1] + e)
    series = {"walk": 100 + np.cumsum(rng.normal(size=250)), "ar": np.array(ar), "flat": np.full(40, 3.0), "short": np.arange(5.0)}
    got = {r["k"]: r for r in S.unit_root_test(table(spark, series), ["k"], ["t"], F.floor(F.col("t") / 70), "x", block=60).collect()}
    for k in ("walk", "ar"):
        lags, t = plain_root(series[k])
        assert (got[k]["lags"], got[k]["n"]) == (lags, len(series[k])) and got[k]["statistic"] == pytest.approx(t, rel=1e-6)
    assert got["walk"]["p"] > 0.1 > 0.001 > got["ar"]["p"]
    assert got["flat"]["p"] == got["short"]["p"] == 1.0 and got["flat"]["statistic"] is None
    assert S.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.002) and S.unit_root_p(-3.43) == pytest.approx(0.01, abs=0.001) and S.unit_root_p(-1.0) == pytest.approx(0.753, abs=0.002)


def plain_trace(v):
    v = v - v.mean(axis=0)
    d = np.diff(v, axis=0)
    now, lag, level = d[1:], d[:-1], v[1:-1]
    now, lag, level = (a - a.mean(axis=0) for a in (now, lag, level))
    rest = lambda a: a - lag @ np.linalg.lstsq(lag, a, rcond=None)[0]
    r0, rk = rest(now), rest(level)
    n = len(r0)
    s00, s0k, skk = r0.T @ r0 / n, r0.T @ rk / n, rk.T @ rk / n
    roots = np.sort(np.real(np.linalg.eigvals(np.linalg.inv(skk) @ s0k.T @ np.linalg.inv(s00) @ s0k)))[::-1]
    return [-n * np.log(1 - roots[i:]).sum() for i in (0, 1)]


def test_trace_of_blocks_equals_direct_one(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=240)) + 500
    series = {"tied": np.stack([2 * x + rng.normal(size=240), x], axis=1), "free": np.stack([np.cumsum(rng.normal(size=200)), np.cumsum(rng.normal(size=200))], axis=1), "short": np.ones((6, 2))}
    got = {r["k"]: r for r in S.trace_test(table(spark, series, "k string, t long, y double, x double"), ["k"], ["t"], F.floor(F.col("t") / 70), "y", "x", block=50).collect()}
    for k in ("tied", "free"):
        assert [got[k]["trace_0"], got[k]["trace_1"]] == pytest.approx(plain_trace(series[k]), rel=1e-6)
    assert got["tied"]["cointegrated"] and got["free"]["cointegrated"] == (plain_trace(series["free"])[0] > 15.4943) and got["short"]["trace_0"] == 0


@pytest.mark.parametrize("flow", [None, "f"])
def test_cross_impact_equals_direct_ridge(spark, flow):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(160, 3))
    r = np.zeros((160, 3))
    r[1:] = f[:-1] @ np.array([[0.01, 0, 0.02], [0, 0, 0], [0.005, 0.01, 0]]).T + rng.normal(size=(159, 3)) * 0.002
    p = 100 * np.exp(np.cumsum(r, axis=0))
    rows = [("abc"[j], t, float(p[t, j]), float(f[t, j])) for t in range(160) for j in range(3) if not (t == 80 and j == 1)]
    df = spark.createDataFrame(rows[::-1], "s string, t long, p double, f double")
    got = S.cross_impact(df, "s", "t", "p", F.floor(F.col("t") / 50), flow=flow, block=40)
    keep = [t for t in range(160) if t != 80]
    ret = np.diff(np.log(p[keep]), axis=0)
    x = f[keep][1:] if flow else ret
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.inv(z[:-1].T @ z[:-1] + 1e-3 * np.eye(3)) @ z[:-1].T @ ret[1:]
    assert got.symbols == ["a", "b", "c"] and got.matrix == pytest.approx(want.T, abs=1e-9) and got.flow == pytest.approx(z[-1])
    said = got.of("a")
    assert said["predicted"] == pytest.approx(want.T[0] @ z[-1]) and said["largest"] == pytest.approx(max(abs(want.T[0][1:])))
    assert S.cross_impact(df.where("t < 4"), "s", "t", "p", F.floor(F.col("t") / 50)) is None


def simulated(theta, until, seed):
    """Thinning."""
    rng = np.random.default_rng(seed)
    mu, a, b = np.array(theta[:2]), np.reshape(theta[2:6], (2, 2)), np.array(theta[6:8])
    t, r, out = 0.0, np.zeros(2), []
    while True:
        top = (mu + a @ r).sum()
        gap = rng.exponential(1 / top)
        t, r = t + gap, r * np.exp(-b * gap)
        if t > until:
            return out
        rate = mu + a @ r
        u = rng.random() * top
        if u < rate.sum():
            i = int(u >= rate[0])
            out.append((t, i))
            r[i] += 1


def plain_loss(events, theta):
    mu, a, b = np.array(theta[:2]), np.reshape(theta[2:6], (2, 2)), np.array(theta[6:8])
    total, end = 0.0, events[-1][0]
    for k, (t, i) in enumerate(events):
        r = np.zeros(2)
        for s, j in events[:k]:
            r[j] += math.exp(-b[j] * (t - s))
        total -= math.log(mu[i] + a[i] @ r)
        total += a[:, i].sum() * (1 - math.exp(-b[i] * (end - t))) / b[i]
    return total + mu.sum() * (end - events[0][0])


def test_hawkes_likelihood_gradient_and_fit(spark):
    truth = [0.3, 0.2, 0.5, 0.1, 0.3, 0.4, 1.2, 1.6]
    events = simulated(truth, 260, 5)
    other = simulated(truth, 40, 6)
    df = spark.createDataFrame([(k, t, i) for k, e in (("a", events), ("b", other)) for t, i in e][::-1], "k string, t double, side int")
    blocks = pack(df, ["k"], ["t"], F.floor(F.col("t") / 60), {"_t": "t", "_side": "side"}, 37)
    theta = np.array([0.25, 0.3, 0.4, 0.2, 0.1, 0.5, 1.0, 2.0])
    value, g = S.hawkes_loss(blocks, ["k"], theta)
    plain = lambda th: plain_loss(events, th) + plain_loss(other, th)
    assert value == pytest.approx(plain(theta))
    for i in range(8):
        h = np.where(np.arange(8) == i, 1e-5, 0)
        assert g[i] == pytest.approx((plain(theta + h) - plain(theta - h)) / 2e-5, rel=1e-3, abs=1e-3)
    fitted, low = S.fit_hawkes(df, ["k"], ["t"], F.floor(F.col("t") / 60), F.col("t"), F.col("side"), iterations=12)
    assert low < value and low <= plain(truth) + 0.5 and low == pytest.approx(plain(fitted))
    assert 0 < S.spectral_radius(fitted) < 1
