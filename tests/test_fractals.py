"""Complexity measures against plain loops, over small blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfold.operators import fractals as C


def far(a, b):
    return max(abs(x - y) for x, y in zip(a, b, strict=True))


def plain_entropies(x, m=2, scale=0.2):
    tol = scale * float(np.std(x))
    t = {k: [x[i : i + k] for i in range(len(x) - k + 1)] for k in (m, m + 1)}
    if tol <= 0:
        return 0.0, 0.0
    share = [sum(far(a, b) <= tol for i, a in enumerate(t[k]) for j, b in enumerate(t[k]) if i != j) / (len(t[k]) * (len(t[k]) - 1)) for k in t]
    phi = [sum(math.log(sum(far(a, b) <= tol for b in t[k]) / len(t[k])) for a in t[k]) / len(t[k]) for k in t]
    return (max(-math.log(share[1] / share[0]), 0.0) if min(share) > 0 else 0.0), max(phi[0] - phi[1], 0.0)


def plain_hurst(p):
    r = [math.log(b / a) for a, b in zip(p, p[1:], strict=False)]
    xs, ys = [], []
    for w in sorted({int(v) for v in np.logspace(1, math.log10(len(p) // 2), num=15)}):
        ratios = []
        for s in range(len(r) // w):
            seg = np.array(r[s * w : s * w + w])
            path = np.cumsum(seg - seg.mean())
            if seg.std(ddof=1) > 1e-12:
                ratios.append((path.max() - path.min()) / seg.std(ddof=1))
        if ratios:
            xs.append(math.log(w))
            ys.append(math.log(sum(ratios) / len(ratios)))
    return min(max(float(np.polyfit(xs, ys, 1)[0]), 0.0), 1.0) if len(xs) >= 3 else 0.5


def plain_higuchi(x):
    xs, ys, n = [], [], len(x)
    for k in range(1, min(10, n // 4) + 1):
        each = []
        for m in range(k):
            sub = x[m::k]
            each.append(sum(abs(b - a) for a, b in zip(sub, sub[1:], strict=False)) * (n - 1) / (k * (len(sub) - 1) * k))
        if sum(each) > 0:
            xs.append(-math.log(k))
            ys.append(math.log(sum(each) / len(each)))
    return min(max(float(np.polyfit(xs, ys, 1)[0]), 1.0), 2.0) if len(xs) >= 3 else 1.5


def plain_entropy(p):
    r = [math.log(b / a) for a, b in zip(p, p[1:], strict=False)]
    counts, _ = np.histogram(r, bins=20)
    q = [c / len(r) for c in counts if c]
    return -sum(v * math.log2(v) for v in q) / math.log2(20)


def walk(n, seed):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(size=n) * 0.02)) * 50


def test_measures_of_blocks_equal_plain_loops(spark):
    series = {"a": walk(330, 1), "b": walk(60, 2), "c": np.full(45, 7.0), "d": walk(3, 3)}
    rows = [(k, t, None if k == "b" and t == 20 else float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows[::-1], "k string, t long, x double")
    measures = {
        "sampen": C.Measure("x", 30, C.sample_entropy(), pairs=True), "apen": C.Measure("x", 30, C.approximate_entropy(), pairs=True), "hurst": C.Measure("x", 120, C.hurst, least=40),
        "fd": C.Measure("x", 64, C.higuchi(), least=20), "entropy": C.Measure("x", 50, C.return_entropy(), least=20),
    }
    plain = {"sampen": lambda f: plain_entropies(f)[0], "apen": lambda f: plain_entropies(f)[1], "hurst": plain_hurst, "fd": plain_higuchi, "entropy": plain_entropy}
    got = {(r["k"], r["t"]): r for r in C.over_frames(df, ["k"], ["t"], F.floor(F.col("t") / 70), ["t"], measures, block=33).collect()}
    assert len(got) == len(rows)
    values = {k: [v for kk, _, v in rows if kk == k] for k in series}
    for (k, t), r in got.items():
        if t % 7 and t > 50:
            continue
        for name, m in measures.items():
            frame = values[k][max(0, t - m.length + 1) : t + 1]
            whole = len(frame) >= (m.least or m.length) and None not in frame
            if not whole:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(plain[name](np.array(frame)), abs=1e-9), (k, t, name)


def test_haar_of_a_frame():
    x = walk(100, 4)
    padded = list(x) + [x[-1]] * 28
    pairs = [(padded[2 * j] + padded[2 * j + 1]) / 2 for j in range(64)]
    one = x[None]
    assert C.haar("trend")(one)[0] == pytest.approx(pairs[99 // 2])
    assert C.haar("momentum")(one)[0] == pytest.approx((pairs[99 // 2] - pairs[95 // 2]) / 5)
    details = [(padded[2 * j] - padded[2 * j + 1]) / math.sqrt(2) for j in range(64)]
    assert C.haar("noise")(one)[0] == pytest.approx(np.std(details) / np.std(x))
    assert sum(C.haar(f"energy_{k}")(one)[0] for k in (1, 2, 3)) == pytest.approx(1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, t long, x double")
    assert C.over_frames(df, ["k"], ["t"], F.col("t"), ["t"], {"h": C.Measure("x", 120, C.hurst)}).count() == 0


def test_known_dimensions():
    t = np.arange(1000.0)[None]
    assert C.higuchi()(t)[0] == pytest.approx(1.0)
    noise = np.random.default_rng(1).normal(size=(1, 1000))
    assert C.higuchi()(noise)[0] > 1.9
    assert 0.4 < C.hurst(walk(1024, 5)[None])[0] < 0.7
