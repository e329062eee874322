"""Monte-Carlo paths against plain loops over the same draws, and lineage against a walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfold.operators import lineage
from larkfold.operators import monte_carlo as C
from larkfold.plans import estimates


def made(spark, series, spec, value="v"):
    df = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)][::-1], f"k string, t long, {value} double")
    known = {r["k"]: r for r in C.sizes(df, ["k"], ["t"], F.floor(F.col("t") / 50), value).collect()}
    rows = C.pieces(C.sizes(df, ["k"], ["t"], F.floor(F.col("t") / 50), value), ["k"], spec).collect()
    return C.equity_pieces(df, ["k"], ["t"], F.floor(F.col("t") / 50), value, spec), known, rows


def plain_paths(series, known, rows, spec):
    out = {}
    for r in sorted(rows, key=lambda r: r["_step"]):
        x = series[r["k"]]
        part = [x[(r["_from"] + i) % len(x)] for i in range(r["_take"])]
        out.setdefault((r["k"], r["_path"]), []).extend([2 * known[r["k"]]["_mean"] - v for v in part] if r["_mirror"] else part)
    return out


def plain_equity(results, capital):
    e, out, dead = capital, [], False
    for v in results:
        e += v
        dead = dead or e <= 0
        out.append(0.0 if dead else e)
    return out


@pytest.mark.parametrize(("method", "piece"), [("block", 4096), ("block", 7), ("antithetic", 5)])
def test_paths_equal_plain_loops(spark, monkeypatch, method, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rng = np.random.default_rng(1)
    smooth = np.convolve(rng.normal(size=130), np.ones(4) / 2, "valid") * 6 - 1
    series = {"a": smooth, "b": rng.normal(size=24) * 30 + 2, "c": rng.normal(size=5)}
    spec = C.PathSpec(method, paths=8, capital=100.0)
    got, known, rows = made(spark, series, spec)
    assert set(known) == {"a", "b"}
    paths = plain_paths(series, known, rows, spec)
    assert all(len(p) == len(series[k]) for (k, _), p in paths.items()) and len(paths) == 16
    equity = {k: plain_equity(p, 100.0) for k, p in paths.items()}
    for r in C.path_results(got, ["k"], spec).collect():
        e = equity[r["k"], r["path"]]
        peak, down = 100.0, 0.0
        raw = np.cumsum(paths[r["k"], r["path"]]) + 100.0
        for v, w in zip(e, raw, strict=True):
            peak = max(peak, w)
            down = max(down, (peak - v) / peak)
        assert r["final"] == pytest.approx(e[-1], abs=1e-9) and r["least"] == pytest.approx(min(100.0, *e), abs=1e-9) and r["max_drawdown"] == pytest.approx(down)
        p = paths[r["k"], r["path"]]
        assert r["profit_factor"] == pytest.approx(min(sum(v for v in p if v > 0) / -sum(v for v in p if v < 0), 10.0))
    assert any(e[-1] == 0 for e in equity.values())
    for r in C.curves(got, ["k"]).collect():
        at = [e[r["step"] - 1] for (k, _), e in equity.items() if k == r["k"]]
        assert [r["equity_p05"], r["equity_p50"], r["equity_p95"]] == pytest.approx(np.percentile(at, [5, 50, 95]).tolist())
    s = {r["k"]: r for r in C.summary(C.path_results(got, ["k"], spec), ["k"], spec).collect()}["b"]
    finals = np.array([e[-1] for (k, _), e in equity.items() if k == "b"])
    ret = finals - 100
    z = (ret - ret.mean()) / ret.std(ddof=1)
    assert s["final_p50"] == pytest.approx(np.percentile(finals, 50)) and s["ruin_probability"] == np.mean([min(100, *e) <= 50 for (k, _), e in equity.items() if k == "b"])
    assert s["skewness"] == pytest.approx((z**3).mean()) and s["shortfall_p05"] == pytest.approx(ret[ret <= np.percentile(ret, 5)].mean())


def test_block_lengths(spark):
    rng = np.random.default_rng(2)
    ar = [0.0]
    for e in rng.normal(size=299):
        ar.append(0.8 * ar[-1] + e)
    series = {"ar": np.array(ar), "flat": np.full(100, 2.0), "few": rng.normal(size=15)}
    _, known, _ = made(spark, series, C.PathSpec(paths=1))
    x = np.array(ar) - np.mean(ar)
    rho = float(x[:-1] @ x[1:] / (x @ x))
    assert known["ar"]["_length"] == int((300 * 2 * rho**2 / (1 - rho**2)) ** (1 / 3)) and known["flat"]["_length"] == 5 and known["few"]["_length"] == 3


def test_brownian_paths(spark):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=400) * 5 + 1}
    spec = C.PathSpec("gbm", paths=300, capital=1000.0)
    got, known, _ = made(spark, series, spec)
    finals = np.log([r["final"] / 1000 for r in C.path_results(got, ["k"], spec).collect()])
    mean, sd = series["a"].mean() / 1000, series["a"].std(ddof=1) / 1000
    assert finals.mean() == pytest.approx(400 * (mean - sd * sd / 2), abs=4 * sd * 20 / 300**0.5) and finals.std() == pytest.approx(sd * 20, rel=0.2)
    again = C.path_results(made(spark, series, spec)[0], ["k"], spec)
    assert sorted(r["final"] for r in again.collect()) == sorted(1000 * np.exp(finals)) or len(known) == 1


def test_no_paths_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t long, v double")
    assert C.equity_pieces(df, ["k"], ["t"], F.col("t"), "v", C.PathSpec()).count() == 0


def test_lineage_of_chains_joins_and_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(21)] + [("n3", "n9"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("n0", "n1"), (None, "q"), ("q", None)]
    known = {}
    for a, b in edges:
        if a and b:
            known.setdefault(a, set()).add(b)
    want = set()
    for a in known:
        depth, front, seen = 0, {a}, {}
        while front:
            depth += 1
            front = {b for f in front for b in known.get(f, ())} - seen.keys()
            seen |= dict.fromkeys(front, depth)
        want |= {(a, b, d, a in seen) for b, d in seen.items()}
    got = lineage.ancestors(spark.createDataFrame(edges, "child string, parent string"))
    assert {tuple(r) for r in got.select("artifact", "ancestor", "depth", "cyclic").collect()} == want
    assert lineage.ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_leaves_take_no_part_in_rounds(spark, monkeypatch):
    """Rounds doubled the pairs of all artifacts, though most of them are no one's ancestors."""
    edges = [(f"leaf{i}", f"mid{i % 7}") for i in range(200)] + [(f"mid{i}", "top" if i else "loop") for i in range(7)] + [("loop", "loop"), ("leaf0", "loop"), ("leaf0", "mid3")]
    doubled, seen = lineage._doubled, []
    monkeypatch.setattr(lineage, "_doubled", lambda e: seen.append({tuple(r) for r in e.collect()}) or doubled(e))
    got = {(r["artifact"], r["ancestor"]): (r["depth"], r["cyclic"]) for r in lineage.ancestors(spark.createDataFrame(edges, "child string, parent string")).collect()}
    want = {(f"leaf{i}", f"mid{i % 7}"): 1 for i in range(200)} | {(f"leaf{i}", "top" if i % 7 else "loop"): 2 for i in range(200)} | {(f"mid{i}", "top" if i else "loop"): 1 for i in range(7)}
    want |= {("leaf0", "mid3"): 1, ("leaf0", "loop"): 1, ("leaf0", "top"): 2, ("loop", "loop"): 1}
    assert got == {k: (d, k[0] == "loop") for k, d in want.items()}
    assert seen == [{("loop", "loop")}]


def test_keys_too_large_to_number_go_by_names(spark, sf, tmp_path):
    for t in ("lineitem", "orders", "customer", "supplier", "nation"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df = df.withColumn("o_orderkey", F.col("o_orderkey") + (1 << 60)) if t == "orders" else df.withColumn("l_orderkey", F.col("l_orderkey") + (1 << 60)) if t == "lineitem" else df
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    assert estimates._numbering(spark, sf)[1] > 0 and estimates._numbering(spark, str(tmp_path)) == (0, 0)
    rows = lambda d: sorted(tuple(r) for r in estimates.j17_closure(spark, d).select("kind", "of_kind", "depth", "pairs", "ancestors", "cyclic").collect())
    assert rows(str(tmp_path)) == rows(sf)
