"""Hidden Markov models, Kalman filter and smoother, machines that accept, and expanding quantiles against plain loops, over small blocks."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfold.operators import hidden_markov as H
from larkfold.operators import kalman as K
from larkfold.operators import machines as M
from larkfold.operators.blocks import numbers, pack, with_entries
from larkfold.operators.prefix_quantiles import expanding_quantiles, kth
from larkfold.scratch import written

MODEL = H.HiddenMarkov(np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]), np.array([[0, 0], [3, 1], [-2, 4.0]]), np.array([np.eye(2) * s for s in (1, 0.5, 2)]))


def drawn(seed, n):
    rng = np.random.default_rng(seed)
    z = [int(rng.choice(3, p=MODEL.start))]
    for _ in range(n - 1):
        z.append(int(rng.choice(3, p=MODEL.transitions[z[-1]])))
    x = MODEL.means[z] + rng.normal(size=(n, 2))
    x[rng.random(n) < 0.05] = np.nan
    return np.array(z), x


def plain_forward_backward(m, x):
    e = np.exp(m.log_emissions(x))
    a, b, n = [m.start * e[0]], [np.ones(len(m.start))], len(x)
    log = math.log(a[0].sum())
    a[0] /= a[0].sum()
    for t in range(1, n):
        v = (a[-1] @ m.transitions) * e[t]
        log += math.log(v.sum())
        a.append(v / v.sum())
    for t in reversed(range(n - 1)):
        v = m.transitions @ (e[t + 1] * b[-1])
        b.append(v / v.sum())
    a, b = np.array(a), np.array(b[::-1])
    g = a * b
    xi = [a[t][:, None] * m.transitions * (e[t + 1] * b[t + 1])[None] for t in range(n - 1)]
    return a, g / g.sum(axis=1, keepdims=True), np.array([v / v.sum() for v in xi]), log


def plain_viterbi(m, x):
    e, a = m.log_emissions(x), np.log(m.transitions)
    d, back = np.log(m.start) + e[0], []
    for t in range(1, len(x)):
        s = d[:, None] + a
        back.append(s.argmax(axis=0))
        d = s.max(axis=0) + e[t]
    path = [int(d.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def table(spark, series):
    rows = [(k, t, None if math.isnan(u) else float(u), float(v)) for k, xs in series.items() for t, (u, v) in enumerate(xs)]
    return spark.createDataFrame(rows[::-1], "k string, t long, u double, v double")


def test_hidden_states_of_blocks_equal_one_walk(spark):
    series = {"a": drawn(1, 300)[1], "b": drawn(2, 41)[1], "c": drawn(3, 1)[1]}
    out = H.regimes(table(spark, series), ["k"], ["t"], F.floor(F.col("t") / 90), MODEL.transitions, MODEL.start, ["u", "v"], MODEL.log_emissions, ["t"], block=23).collect()
    have = {(r["k"], r["t"]): r for r in out}
    assert len(out) == 342
    for k, x in series.items():
        a, g, _, _ = plain_forward_backward(MODEL, x)
        path = plain_viterbi(MODEL, x)
        for t in range(len(x)):
            assert have[k, t]["filtered"] == pytest.approx(a[t], abs=1e-9)
            assert have[k, t]["smoothed"] == pytest.approx(g[t], abs=1e-9)
            assert have[k, t]["state"] == path[t]


def plain_update(m, series):
    start, xi, mass, total = 0.0, 0.0, 0.0, 0.0
    rows, weights = [], []
    for x in series.values():
        _, g, pairs, log = plain_forward_backward(m, x)
        start, xi, total = start + g[0], xi + pairs.sum(axis=0) if len(pairs) else xi, total + log
        seen = ~np.isnan(x).any(axis=1)
        rows.append(x[seen])
        weights.append(g[seen])
    x, g = np.concatenate(rows), np.concatenate(weights)
    mass = g.sum(axis=0)
    means = (g.T @ x) / mass[:, None]
    cov = [((g[:, k, None] * (x - means[k])).T @ (x - means[k])) / mass[k] + 1e-4 * np.eye(2) for k in range(len(mass))]
    return H.HiddenMarkov(start / start.sum(), xi / xi.sum(axis=1, keepdims=True), means, np.array(cov)), total


def test_em_equals_plain_updates_and_finds_the_states(spark):
    truth, series = {}, {}
    for k, seed, n in (("a", 4, 900), ("b", 5, 150), ("c", 6, 1)):
        truth[k], series[k] = drawn(seed, n)
    df = table(spark, series)
    from larkfold.operators.blocks import pack

    blocks = pack(df, ["k"], ["t"], F.floor(F.col("t") / 200), {"u": "u", "v": "v"}, 64)
    model = want = H.start_values(blocks, ["u", "v"], 3)
    for _ in range(2):
        model, log = H.em_step(blocks, ["k"], ["u", "v"], model)
        want, plain_log = plain_update(want, series)
        assert log == pytest.approx(plain_log)
        for f in ("start", "transitions", "means", "covariances"):
            assert getattr(model, f) == pytest.approx(getattr(want, f), abs=1e-7)
    fitted = H.fit(df, ["k"], ["t"], F.floor(F.col("t") / 200), ["u", "v"], states=3, iterations=25, block=256)
    order = [int(np.abs(fitted.means - m).sum(axis=1).argmin()) for m in MODEL.means]
    assert sorted(order) == [0, 1, 2] and np.abs(fitted.means[order] - MODEL.means).max() < 0.4
    path = H.regimes(df.where("k = 'a'"), ["k"], ["t"], F.floor(F.col("t") / 200), fitted.transitions, fitted.start, ["u", "v"], fitted.log_emissions, ["t"]).orderBy("t").collect()
    assert np.mean([order[z] == r["state"] for z, r in zip(truth["a"], path, strict=True)]) > 0.9


def test_labels_and_durations():
    m = H.HiddenMarkov(np.full(4, 0.25), np.full((4, 4), 0.1) + 0.6 * np.eye(4), np.array([[0.2, 1.0], [0.1, 2.0], [-0.1, 1.2], [-0.4, 9.0]]), np.array([np.eye(2)] * 4))
    assert m.labels() == ["bull_quiet", "bull_volatile", "bear_quiet", "crisis"]
    assert m.durations() == pytest.approx([1 / 0.3] * 4)


def test_hidden_states_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t long, u double, v double")
    assert H.regimes(df, ["k"], ["t"], F.col("t"), MODEL.transitions, MODEL.start, ["u", "v"], MODEL.log_emissions, ["t"]).count() == 0
    assert H.fit(df, ["k"], ["t"], F.col("t"), ["u", "v"], states=2, iterations=2).means.shape == (2, 2)


def prices(n, seed=1):
    rng = np.random.default_rng(seed)
    x = 50 + np.cumsum(rng.normal(size=n))
    x[rng.random(n) < 0.03] += 60
    x[n // 2 :] += 25
    return [None if rng.random() < 0.02 else float(v) for v in x]


@pytest.mark.parametrize(("states", "adapt"), [(1, True), (2, False), (2, True), (3, True)])
def test_kalman_of_blocks_equals_one_walk(spark, states, adapt):
    spec = K.KalmanSpec(states=states, process=0.05, noise=2.0, adapt=adapt)
    series = {"a": [None, *prices(300)], "b": prices(35, 2), "c": [None]}
    df = spark.createDataFrame([(k, t, v) for k, x in series.items() for t, v in enumerate(x)][::-1], "k string, t long, v double")
    out = {(r["k"], r["t"]): r for r in K.kalman(df, ["k"], ["t"], F.floor(F.col("t") / 100), "v", ["t"], spec, block=40).collect()}
    names = [c.split()[0] for c in K.FIELDS.split(", ")]
    seen = 0
    for k, x in series.items():
        for t, want in enumerate(K._rows(spec, np.array([math.nan if v is None else v for v in x]), None)):
            got = out[k, t]
            assert [got[n] for n in names] == [None if want is None or w != w else w for w in (want or [None] * len(names))]
            seen += bool(want and want[7])
    assert seen > 3  # outliers


def test_kalman_formulas():
    """Two states without a gate against the matrices written out."""
    spec = K.KalmanSpec(states=2, process=0.1, noise=3.0, gate=0, adapt=False)
    z = [v if v is not None else 50.0 for v in prices(60, 3)]
    f, q = np.array([[1.0, 1], [0, 1]]), 0.1 * np.eye(2)
    x, p = np.array([z[0], 0.0]), np.eye(2)
    rows = list(K._rows(spec, np.array(z), None))
    for t in range(1, len(z)):
        x, p = f @ x, f @ p @ f.T + q
        gain = p[:, :1] / (p[0, 0] + 3.0)
        x, p = x + gain[:, 0] * (z[t] - x[0]), (np.eye(2) - gain @ np.array([[1.0, 0]])) @ p
        assert rows[t][:2] == pytest.approx(tuple(x)) and rows[t][3] == pytest.approx(math.sqrt(p[0, 0]))


@pytest.mark.parametrize("states", [1, 2, 3])
def test_smoother_of_blocks_equals_one_walk(spark, states):
    spec = K.KalmanSpec(states=states, process=0.05, noise=2.0)
    z = [v for v in prices(130, 7)]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(z)], "k string, t long, v double")
    got = [r["level"] for r in K.smoothed(df, ["k"], ["t"], F.floor(F.col("t") / 50), "v", ["t"], spec, block=30).orderBy("t").collect()]
    f = K.Filter(K.KalmanSpec(states=states, process=0.05, noise=2.0, adapt=False), None)
    xs, ps = [], []
    for v in z:
        f.step(math.nan if v is None else v)
        xs.append(f.x.copy())
        ps.append(f.p.copy())
    s, want = xs[-1], [xs[-1][0]]
    for t in reversed(range(len(z) - 1)):
        ahead = f.f @ ps[t] @ f.f.T + f.process()
        s = xs[t] + ps[t] @ f.f.T @ np.linalg.inv(ahead) @ (s - f.f @ xs[t])
        want.append(s[0])
    assert got == pytest.approx(want[::-1], abs=1e-6)


def test_step_functions_equal_walks():
    rng = np.random.default_rng(0)
    for _ in range(60):
        share = float(rng.choice([0.05, 0.2, 0.5, 1.0, 1.5]))
        v = np.exp(rng.normal(size=rng.integers(1, 30)) * rng.choice([0.1, 0.5, 2])).round(2) + 0.01
        f = M.block_steps(v, share)
        assert f.edges == sorted(set(f.edges))
        for e in map(float, [*v, *np.exp(rng.normal(size=20) * 2), *f.edges[1:], *np.nextafter(f.edges[1:], 0)]):
            ok = M.walk_accepted(v, e, share)
            assert f(e) == (v[ok][-1] if ok.any() else e)


def test_validator_equals_one_walk(spark):
    rng = np.random.default_rng(5)
    rows, price = [], 100.0
    for i in range(600):
        price *= math.exp(rng.normal() * 0.02)
        if i in (200, 420):
            price *= 1.3  # never within reach of what was accepted before, for long
        bid = {0: None, 1: -1.0, 2: 0.0}.get(int(rng.integers(0, 60)), price * (1.5 if rng.random() < 0.05 else 1))
        ask = None if bid is None else bid + float(rng.choice([0.01, 0.02, 5.0, -0.5], p=[0.5, 0.4, 0.05, 0.05]))
        rows.append(("a" if i % 5 else "b", i, i * 1000 + (90_000 if i > 300 else 0), bid, ask))
    df = spark.createDataFrame(rows[::-1], "k string, event_id long, time_msc long, bid double, ask double")
    got = {r["event_id"]: (r["reason"], r["gap"]) for r in M.validate_ticks(df, ["k"], ["time_msc"], F.floor(F.col("time_msc") / 100_000), 1.0, 0.05, 20_000).collect()}
    last, at, want = {}, {}, {}
    for k, i, t, bid, ask in rows:
        if bid is None or bid <= 0 or ask <= 0:
            want[i] = ("non_positive", False)
        elif ask < bid:
            want[i] = ("crossed", False)
        elif ask - bid > 1.0:
            want[i] = ("wide_spread", False)
        elif k in last and abs((bid + ask) / 2 - last[k]) / last[k] > 0.05:
            want[i] = ("price_jump", False)
        else:
            want[i] = (None, k in at and t - at[k] > 20_000)
            last[k], at[k] = (bid + ask) / 2, t
    assert got == want and {r for r, _ in want.values()} == {None, "non_positive", "crossed", "wide_spread", "price_jump"}


def test_accepted_over_small_blocks(spark):
    rng = np.random.default_rng(8)
    x = (np.exp(np.cumsum(rng.normal(size=400) * 0.04)) * np.where(rng.random(400) < 0.1, 1.4, 1)).tolist()
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "k string, t long, v double")
    got = [r["accepted"] for r in M.accepted(df, ["k"], ["t"], F.floor(F.col("t") / 100), "v", ["t"], 0.1, block=17).orderBy("t").collect()]
    assert got == M.walk_accepted(np.array(x), None, 0.1).tolist() and 0 < sum(got) < 400


def test_run_lengths(spark):
    labels = "AABBBAFFFAAAB"
    df = spark.createDataFrame([("k", t, c) for t, c in enumerate(labels)], "k string, t long, c string")
    got = [r["n"] for r in M.run_lengths(df, ["k"], ["t"], F.floor(F.col("t") / 4), "c", "n", off="F").orderBy("t").collect()]
    assert got == [1, 2, 1, 2, 3, 1, 0, 0, 0, 1, 2, 3, 1]


def test_wavelet_matrix():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 37, 300)
    more = rng.integers(0, 4, 37)
    prefix = rng.integers(1, 301, 500)
    k = np.array([rng.integers(0, p + more.sum()) for p in prefix])
    value, deep = kth(a, 6, prefix, k, more)
    for p, i, v, d in zip(prefix, k, value, deep, strict=True):
        every = np.sort(np.concatenate([a[:p], np.repeat(np.arange(37), more)]))
        assert every[i] == v and d == i - np.searchsorted(every, v)


def test_expanding_quantiles_equal_plain_ones(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if rng.random() < 0.8 else "b", t, None if rng.random() < 0.1 else float(rng.choice([rng.normal(), 1.0]))) for t in range(700)]
    df = spark.createDataFrame(rows[::-1], "k string, t long, x double")
    got = {(r["k"], r["t"]): (r["q1"], r["q2"]) for r in expanding_quantiles(df, ["k"], ["t"], F.floor(F.col("t") / 150), "x", {"q1": 0.33, "q2": 0.8}, least=5, block=30).collect()}
    assert len(got) == 700
    before = {"a": [], "b": []}
    for k, t, x in rows:
        want = [float(np.quantile(before[k], q)) for q in (0.33, 0.8)] if len(before[k]) >= 5 else [None, None]
        assert list(got[k, t]) == [w if w is None else pytest.approx(w) for w in want]
        if x is not None:
            before[k].append(x)
    empty = spark.createDataFrame([], "k string, t long, x double")
    assert expanding_quantiles(empty, ["k"], ["t"], F.col("t"), "x", {"q": 0.5}).count() == 0


def test_halftrend(spark):
    rng = np.random.default_rng(9)
    c = 100 + np.cumsum(rng.normal(size=160))
    rows = [("a", datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(v + 1), float(v - 1), float(v)) for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double")
    got = M.halftrend(df, ["symbol"], ["day"], F.year("day"), width=0.5).orderBy("day").collect()
    for i, r in enumerate(got):
        if i < 100:
            assert r["trend"] == "FLAT" and r["strength"] == 0
            continue
        tr = [max(2.0, abs(c[j] + 1 - c[j - 1]), abs(c[j] - 1 - c[j - 1])) for j in range(i - 99, i + 1)]
        atr = sum(tr) / 100
        up, low = max(c[i - 1 : i + 1]) + 1 - 0.5 * atr, min(c[i - 1 : i + 1]) - 1 + 0.5 * atr
        trend = "UP" if c[i] > up else "DOWN" if c[i] < low else "FLAT"
        want = 0 if trend == "FLAT" else min(3, abs(c[i] - (up if trend == "UP" else low)) / atr)
        assert r["trend"] == trend and r["strength"] == pytest.approx(want)


@pytest.mark.parametrize("forgets", [True, False])
def test_machines_that_never_forget_walk_blocks_a_few_times(spark, forgets):
    """A sum never forgets: with a round a block, 20 blocks were walked 210 times."""
    walks = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(k, t, float(t + (k == "b"))) for k, n in (("a", 60), ("b", 7)) for t in range(n)], "k string, t long, v double")
    blocks = written(pack(df, ["k"], ["t"], F.floor(F.col("t") / 20), {"v": "v"}, 3), "blocks")

    def leave(row, entry):
        walks.add(1)
        return [numbers(row["v"]).sum() + (entry[0] if entry else 0.0)]

    got = {(r["k"], r["_b"]): r["entry"] for r in with_entries(blocks, ["k"], leave, forgets=forgets).collect()}
    assert got == {(k, b): [float(sum(t + (k == "b") for t in range(3 * b)))] if b else None for k, n in (("a", 20), ("b", 3)) for b in range(n)}
    assert walks.value <= 5 * 23
