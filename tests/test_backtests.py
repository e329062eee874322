import math
from datetime import date, timedelta
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from larkfold.operators import performance as P
from larkfold.operators import splits as X
from larkfold.operators.joins import prefixed, prefixed_join
from larkfold.plans.backtests import deviation
from larkfold.plans.builders import Step, build, resolve
from larkfold.sources import layouts

DAY = date(2024, 1, 1)
FIELDS = "book string, id int, entered date, exited date, pnl double, fee double, r double"


def report(spark, rows, **kw):
    df = spark.createDataFrame(rows, FIELDS)
    return {r.book: r for r in P.backtest_report(df, ["book"], ["exited", "id"], F.trunc("exited", "month"), 1000.0, **kw).collect()}


def test_report_equals_a_walk_over_the_trades(spark):
    moves = [((i * 7919) % 23 - 10) * 3.0 for i in range(120)]
    rows = [("a", i, DAY + timedelta(i // 2 - 1), DAY + timedelta(i // 2), m, 0.5, m / 10) for i, m in enumerate(moves)]
    got = report(spark, rows, trials=3)["a"]
    equity, peak, depths, under, most, wins, losses, best, worst = 1000.0, 1000.0, [], 0, 0, 0, 0, 0, 0
    by_day = {}
    for i, m in enumerate(moves):
        equity += m
        peak = max(peak, equity)
        depths.append((peak - equity) / peak)
        under = 0 if equity >= peak else under + 1
        most = max(most, under)
        wins, losses = (wins + 1, 0) if m > 0 else (0, losses + 1) if m < 0 else (0, 0)
        best, worst = max(best, wins), max(worst, losses)
        by_day[i // 2] = equity
    closes = list(by_day.values())
    returns = [b / a - 1 for a, b in zip(closes, closes[1:])]
    x = [r - P.daily_rate(0.05) for r in returns]
    assert (got.longest_drawdown, got.longest_wins, got.longest_losses, got.n_returns) == (most, best, worst, 59)
    assert got.max_drawdown_pct == pytest.approx(100 * max(depths)) and got.pain_index == pytest.approx(100 * mean(depths))
    assert got.sharpe == pytest.approx(mean(x) / stdev(x) * math.sqrt(252))
    assert got.sortino == pytest.approx(mean(x) / stdev([v for v in x if v < 0]) * math.sqrt(252))
    assert got.profit_factor == pytest.approx(sum(m for m in moves if m > 0) / -sum(m for m in moves if m < 0))
    assert got.avg_days_held == 1 and got.cost_pct == pytest.approx(100 * 60 / sum(m for m in moves if m > 0))
    assert "TOO_FEW_TRADES" in got.blocked_by and not got.approved


def test_report_without_losses_with_one_trade_and_without_rows(spark):
    rows = [("up", i, DAY, DAY + timedelta(i), 5.0, None, None) for i in range(3)] + [("one", 1, DAY, DAY, -4.0, 1.0, -1.0), ("none", 1, DAY, DAY, None, 1.0, 1.0)]
    got = report(spark, rows)
    assert set(got) == {"up", "one"}
    assert got["up"].profit_factor is None and got["up"].max_drawdown_pct == 0 and got["up"].burke is None and "LOW_PF" in got["up"].blocked_by
    assert got["one"].sharpe is None and got["one"].n_returns == 0 and got["one"].longest_losing_days == 1 and "NON_POSITIVE_NET_PROFIT" in got["one"].blocked_by
    assert report(spark, []) == {}


def test_gates_pass(spark):
    rows = [("good", i, DAY + timedelta(i), DAY + timedelta(i + 1), -1.0 if i % 3 == 2 else 3.0 + i % 5, 0.01, 0.5) for i in range(600)]
    got = report(spark, rows)["good"]
    assert got.approved and got.blocked_by == "" and 0.5 <= got.profitability_score <= 1


def folds(spark, n, rule):
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.col("id").alias("at"))
    out = {}
    for r in X.folds_by_rule(df, ["symbol"], ["at"], (F.col("at") / 7).cast("int"), rule).collect():
        out.setdefault((r.fold, r.part), []).append(r["at"])
    return {k: (min(v), max(v) + 1, len(v)) for k, v in out.items()}


def test_fold_rules(spark):
    tail = folds(spark, 103, X.reserved_tail(2, 0.2, 3))
    assert tail == {(0, "train"): (0, 77, 77), (0, "test"): (80, 90, 10), (1, "train"): (0, 90, 90), (1, "test"): (93, 103, 10)}
    start = folds(spark, 50, X.fixed_start(3, 20, 2))
    assert start[(0, "train")] == (0, 20, 20) and start[(0, "test")] == (22, 31, 9) and start[(2, "train")] == (0, 38, 38) and start[(2, "test")] == (40, 50, 10)
    assert folds(spark, 24, X.fixed_start(3, 20, 2)) == {} and folds(spark, 5, X.reserved_tail(2, 0.2, 3)) == {}
    segments = folds(spark, 100, X.expanding_segments(6, 4))
    assert segments == {(0, "train"): (0, 64, 64), (0, "test"): (64, 80, 16), (1, "train"): (0, 80, 80), (1, "test"): (80, 100, 20)}
    assert folds(spark, 95, X.expanding_segments(6, 4)) == {} and folds(spark, 200, X.expanding_segments(6, 6)) == {}


@pytest.mark.parametrize("n", [0, 9, 10, 11, 47])
@pytest.mark.parametrize("step", [1, 4, 15])
def test_sliding_windows(spark, n, step):
    want = {}
    for k in range(0, max((n - 10) // step + 1, 0) if n >= 10 else 0):
        want[(k, "train")], want[(k, "test")] = (k * step, k * step + 5, 5), (k * step + 7, k * step + 10, 3)
    assert folds(spark, n, X.sliding_windows(5, 3, step, 2)) == want


def test_prefixed_names_never_clash(spark):
    left, right = spark.createDataFrame([(1, 2, 3)], "k int, v int, x_v int"), spark.createDataFrame([(1, 5, 6)], "k int, V int, w int")
    assert prefixed(right, left.columns, "x", ("k",)).columns == ["k", "x_V", "w"] or prefixed(right, left.columns, "x", ("k",)).columns == ["k", "x_x_V", "w"]
    both = prefixed_join(left, right, ["k"], "x")
    assert len({c.lower() for c in both.columns}) == 5 and both.first()[:] == (1, 2, 3, 5, 6)


def test_builders(spark):
    assert resolve("larkfold.plans.backtests:deviation") is deviation
    for ref in ("larkfold.plans.backtests", "os:remove", "larkfold.nothing:f", "larkfold.plans.backtests:nothing", "larkfold.plans.backtests:STEPS"):
        with pytest.raises(ValueError, match=ref.split(":")[0]):
            resolve(ref)
    df = spark.createDataFrame([("s", DAY, 1.0)], "symbol string, day date, close double")
    here = "larkfold.plans.backtests:deviation"
    assert build(df, [Step(here, {"window": 2}, makes=("z_2",))]).columns == [*df.columns, "z_2"] and build(df, []) is df
    for step in (Step(here, {"size": 2}), Step(here, needs=("volume",)), Step(here, makes=("z_21",))):
        with pytest.raises(ValueError):
            build(df, [step])


def test_layouts(spark, tmp_path):
    root = f"file://{tmp_path}"
    old = spark.createDataFrame([("s", DAY, 1), ("s", DAY + timedelta(1), 2), ("t", DAY, 3), (None, DAY, 4)], "symbol string, date date, v int")
    layouts.save(old, root, "canonical_ticks")
    layouts.save(spark.createDataFrame([("s", DAY, 9)], "symbol string, date date, v int"), root, "canonical_ticks")
    got = lambda **kw: sorted(r.v for r in layouts.load(spark, root, "canonical_ticks", **kw).collect())
    assert got() == [2, 3, 4, 9] and got(symbol="s") == [2, 9] and got(symbol=["s", "t"], end="2024-01-01") == [3, 9] and got(start="2024-01-02") == [2]
    assert "PartitionFilters: [isnotnull(symbol" in layouts.load(spark, root, "canonical_ticks", symbol="s")._jdf.queryExecution().toString()
    assert layouts.location("/r/", "bars", symbol="s", timeframe="M5") == "/r/bars/symbol=s/timeframe=M5"
    for bad in ({"timeframe": "M5"}, {"symbol": "a/b"}, {"symbol": ".."}):
        with pytest.raises(ValueError):
            layouts.location("/r", "bars", **bad)
    with pytest.raises(ValueError):
        layouts.save(old, root, "bars")


def test_curve_shuffles_no_trades_twice(spark):
    """Peaks and runs that last over many buckets, and a plan that only broadcasts what buckets carry in."""
    moves = [5.0] * 7 + [-1.0] * 9 + [0.0, 0.0, 2.0, -3.0] + [1.0] * 12
    df = spark.createDataFrame([("a", i, DAY, DAY + timedelta(i), m, 0.0, 0.0) for i, m in enumerate(moves)], FIELDS).repartition(3)
    curve = P.equity_curve(df, ["book"], ["exited", "id"], F.floor(F.col("id") / 3), 100.0)
    assert "hashpartitioning" not in curve._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.equity, r.peak, r.streak, r.under) for r in curve.collect()}
    equity, peak, run, under, last = 100.0, 100.0, 0, 0, None
    for i, m in enumerate(moves):
        equity += m
        peak = max(peak, equity)
        sign = (m > 0) - (m < 0)
        run = run + 1 if sign == last else 1
        last, under = sign, 0 if equity >= peak else under + 1
        assert got[i] == (equity, peak, sign * run, under)
