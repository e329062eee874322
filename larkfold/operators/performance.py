"""The whole report of a backtest from its trades: return, risk, streaks, costs, scores and what stands against deployment."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.operators.quantiles import quantiles
from larkfold.scratch import written

#: Fixed values of the deployment check: (reason, column, bound, whether the column must be at least the bound).
GATES = (
    ("TOO_FEW_TRADES", "n_trades", 500, True), ("LOW_SHARPE", "sharpe", 1.0, True), ("HIGH_MDD", "max_drawdown_pct", 15.0, False), ("LOW_WIN_RATE", "win_rate_pct", 45.0, True),
    ("LOW_PF", "profit_factor", 1.2, True), ("LOW_EXPECTANCY_R", "expectancy_r", 0.10, True), ("LOW_PAYOFF", "payoff_ratio", 1.10, True),
    ("LOW_RETURN_TO_DRAWDOWN", "return_over_drawdown", 1.0, True), ("LOW_MONTHLY_CONSISTENCY", "profitable_month_pct", 55.0, True), ("HIGH_COST_LOAD", "cost_pct", 35.0, False), ("LOW_PROFITABILITY_SCORE", "profitability_score", 0.50, True),
)
#: Fixed values of the profitability score: (column, what is taken off, what it is divided by, weight); a share is cut to 0..1.
WEIGHTS = (("profit_factor", 0.0, 3.0, 0.25), ("expectancy_r", 0.0, 1.5, 0.20), ("return_over_drawdown", 0.0, 3.0, 0.20), ("win_rate_pct", 40.0, 30.0, 0.15), ("profitable_month_pct", 0.0, 100.0, 0.15))
#: Fixed values of the composite score: (column, its cap, weight).
COMPOSITE = (("sharpe_population", 4.0, 0.30), ("calmar", 5.0, 0.25), ("profit_factor", 5.0, 0.15), ("win_rate_pct", 100.0, 0.15), ("r_expectancy", 2.0, 0.15))
TRADING_DAYS, WORST = 252, 5


def daily_rate(annual: float) -> float:
    return (1 + annual) ** (1 / TRADING_DAYS) - 1


def expected_best(trials: int) -> float:
    """What the best Sharpe ratio of so many worthless trials is expected to be, in standard errors."""
    if trials < 2:
        return 0.0
    euler, normal = 0.5772156649, NormalDist()
    return (1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e))


def equity_curve(trades: DataFrame, keys: list[str], order: list[str], bucket: Column, capital: float) -> DataFrame:
    """Trades with ``equity`` after each, its ``peak`` (``capital`` at least), ``depth`` (share lost from the peak), ``streak`` (signed length of the run of
    wins or losses), ``under`` (trades since the last peak) and ``episode`` (ordinal of that peak); ``order`` must be total.

    Trades are shuffled once, to buckets, and written; what the buckets before carry in is one row a bucket and is broadcast."""
    own, c = trades.columns, F.col
    df = trades.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = [*keys, "_bucket"]
    sums = df.groupBy(*at).agg(F.sum("pnl").alias("_s"), F.count("*").alias("_n"))
    sums = sums.select(*at, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*at).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(sums), at).withColumns({"_sign": F.signum("pnl"), "_rn": c("_start") + F.row_number().over(w) - 1, "equity": capital + (c("_c") + F.coalesce(F.sum("pnl").over(so_far), F.lit(0)))})
    df = df.withColumns({"_top": F.max("equity").over(so_far), "_last": F.lag("_sign").over(w)})
    df = df.withColumns({"_record": F.max(F.when(c("equity") >= c("_top"), c("_rn"))).over(so_far), "_fresh": F.max(F.when(c("_last").isNotNull() & (c("_sign") != c("_last")), c("_rn"))).over(so_far)})
    local = written(df.select(*own, "_bucket", "equity", "_rn", "_sign", "_top", "_record", "_fresh"), "curve-buckets")
    ends = local.groupBy(*at).agg(
        F.max("_top").alias("_top"), F.max("_record").alias("_record"), F.max("_fresh").alias("_fresh"), F.min("_rn").alias("_from"), F.min_by("_sign", "_rn").alias("_first"), F.max_by("_sign", "_rn").alias("_final"),
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    ends = ends.withColumns({"_peak": F.greatest(F.max("_top").over(before), F.lit(capital)), "_goes_on": F.coalesce(F.lag("_final").over(by_bucket) == c("_first"), F.lit(False))})
    ends = ends.withColumns({"_episode": F.when(c("_top") >= c("_peak"), c("_record")), "_run": F.coalesce("_fresh", F.when(~c("_goes_on"), c("_from")))})
    # the start of the run that a bucket's first row is in, and the last peak of the buckets before
    ends = ends.withColumns({"_run_in": F.when(~c("_goes_on"), c("_from")).otherwise(F.last("_run", ignorenulls=True).over(before)), "_episode_in": F.coalesce(F.max("_episode").over(before), F.lit(-1))})
    carried = written(ends.select(*at, "_peak", "_run_in", "_episode_in"), "curve-carried")
    t = local.join(F.broadcast(carried), at).withColumn("peak", F.greatest("_peak", "_top"))
    episode = F.when(c("_top") >= c("_peak"), c("_record")).otherwise(c("_episode_in"))
    streak = (c("_sign") * (c("_rn") - F.coalesce("_fresh", "_run_in") + 1)).cast("long")
    return t.select(*own, "equity", "peak", ((c("peak") - c("equity")) / c("peak")).alias("depth"), streak.alias("streak"), episode.alias("episode"), (c("_rn") - episode).alias("under"))


def _waits(curve: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Mean days from the end of the trade entered before to the start of a trade (no less than 0): months hand on their last row."""
    c, at = F.col, [*keys, "_bucket"]
    entered = ["entered", *order]
    df = curve.select(*dict.fromkeys([*keys, "entered", "exited", *order]), F.trunc("entered", "month").alias("_bucket"))
    last = df.groupBy(*at).agg(F.max_by("exited", F.struct(*entered)).alias("_end"))
    last = last.select(*at, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_in"))  # one row a month
    df = df.join(F.broadcast(last), at)
    w = Window.partitionBy(*at).orderBy(*entered)
    end = F.when(F.row_number().over(w) == 1, c("_in")).otherwise(F.lag("exited").over(w))
    return df.select(*keys, F.greatest(F.datediff("entered", end), F.lit(0)).alias("_gap")).groupBy(*keys).agg(F.avg("_gap").alias("avg_days_between"))


def _days(curve: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row a day on which a trade ended: profit, last equity, return since the day before (null on the first), length of the run of losing days."""
    by_day = Window.partitionBy(*keys).orderBy("exited")  # one row a day
    d = curve.groupBy(*keys, "exited").agg(F.sum("pnl").alias("pnl"), F.max_by("equity", F.struct(*order)).alias("equity"))
    d = d.withColumns({"ret": F.try_divide("equity", F.lag("equity").over(by_day)) - 1, "_n": F.row_number().over(by_day)})
    last_good = F.coalesce(F.max(F.when(F.col("pnl") >= 0, F.col("_n"))).over(by_day.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return d.withColumn("losing", F.col("_n") - last_good).drop("_n")


def backtest_report(trades: DataFrame, keys: list[str], order: list[str], bucket: Column, capital: float = 10_000.0, risk_free: float = 0.05, trials: int = 1) -> DataFrame:
    """One row a key of trades ``(pnl, fee, r, entered, exited)``, dates of days; ``order`` is a total order by ``exited``, ``bucket`` what one task sorts.

    ``pnl`` is net of ``fee``. A ratio with a zero divisor is null. ``deflated_t`` is the Sharpe ratio less the best of ``trials`` worthless ones, in standard errors
    that know skew and kurtosis. ``blocked_by`` lists the gates that fail (a null figure fails its gate), '' if ``approved``. Null profits are no trades; a table without rows gives none.
    """
    trades = trades.where(F.col("pnl").isNotNull())
    curve = equity_curve(trades, keys, order, bucket, capital)
    p, win, loss = F.col("pnl"), F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    sums = curve.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count(win).alias("n_wins"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"), F.max(win).alias("largest_win"), F.max(loss).alias("largest_loss"), F.avg("r").alias("r_expectancy"), F.avg(p).alias("expectancy"),
        F.coalesce(F.sum("fee"), F.lit(0.0)).alias("fees"), F.avg(F.datediff("exited", "entered")).alias("avg_days_held"), (100 * F.max("depth")).alias("max_drawdown_pct"),
        (100 * F.avg(F.when(F.col("depth") > 0, F.col("depth")))).alias("avg_drawdown_pct"), F.sqrt(F.avg(F.pow(100 * F.col("depth"), F.lit(2)))).alias("ulcer_index"), (100 * F.avg("depth")).alias("pain_index"),
        F.max("under").alias("longest_drawdown"), F.max(F.greatest("streak", F.lit(0))).alias("longest_wins"), F.max(F.greatest(-F.col("streak"), F.lit(0))).alias("longest_losses"),
        F.greatest(F.datediff(F.max("exited"), F.min("entered")), F.lit(1)).alias("days"),
    )
    worst = Window.partitionBy(*keys).orderBy(F.desc("depth"), "episode")
    episodes = curve.where("depth > 0").groupBy(*keys, "episode").agg(F.max("depth").alias("depth")).withColumn("_i", F.row_number().over(worst)).where(F.col("_i") <= WORST)
    burke = episodes.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(100 * F.col("depth"), F.lit(2)))).alias("_worst"))
    days = _days(curve, keys, order)
    r, x = F.col("ret"), F.col("ret") - daily_rate(risk_free)
    down = F.when(x < 0, x)
    by_day = days.groupBy(*keys).agg(
        F.count(r).alias("n_returns"), F.avg(x).alias("_x"), F.stddev_samp(x).alias("_sd"), F.stddev_samp(down).alias("_down"), F.avg(r).alias("_m"), F.stddev_pop(r).alias("_pop"), F.skewness(r).alias("_skew"), (F.kurtosis(r) + 3).alias("_kurt"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_gains"), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("_losses"), F.max("losing").alias("longest_losing_days"),
    )
    tails = quantiles(days.where(r.isNotNull()), keys, "ret", {"_p95": 0.95, "_p05": 0.05}).select(*keys, F.abs(F.try_divide("_p95", "_p05")).alias("tail_ratio"))
    months = curve.groupBy(*keys, F.trunc("exited", "month").alias("_month")).agg(F.sum(p).alias("_pnl")).groupBy(*keys)
    months = months.agg(F.count("*").alias("months"), F.count_if(F.col("_pnl") > 0).alias("profitable_months"))
    gaps = _waits(curve, keys, order)
    out = sums.join(by_day, keys)
    for part in (months, burke, tails, gaps):
        out = out.join(part, keys, "left")
    return _judged(out, capital, risk_free, trials).drop("_worst", "_x", "_sd", "_down", "_m", "_pop", "_skew", "_kurt", "_gains", "_losses")


def _judged(out: DataFrame, capital: float, risk_free: float, trials: int) -> DataFrame:
    """Ratios, scores and gates from one row a key."""
    c, over, year = F.col, F.try_divide, math.sqrt(TRADING_DAYS)
    net = c("gross_profit") - c("gross_loss")
    out = out.withColumns({
        "net_profit": net, "final_equity": capital + net, "total_return_pct": 100 * net / capital, "win_rate_pct": 100 * c("n_wins") / c("n_trades"), "_years": c("days") / 365.25,
        "profit_factor": over("gross_profit", "gross_loss"), "payoff_ratio": over("avg_win", "avg_loss"), "expectancy_r": over("expectancy", "avg_loss"),
        "sharpe": over("_x", "_sd") * year, "sharpe_population": over(c("_m") - risk_free / TRADING_DAYS, c("_pop")) * year, "sortino": over("_x", "_down") * year, "information_ratio": over("_m", "_sd") * year,
        "omega": over("_gains", "_losses"), "gain_to_pain": over(c("_gains") - c("_losses"), c("_losses")), "profitable_month_pct": 100 * c("profitable_months") / c("months"),
        "cost_pct": F.coalesce(100 * over("fees", "gross_profit"), F.when(c("fees") > 0, 100.0).otherwise(0.0)),
    })
    ruined = c("final_equity") <= 0
    out = out.withColumns({
        "cagr_pct": F.when(~ruined, 100 * (F.pow(c("final_equity") / capital, 1 / c("_years")) - 1)), "return_over_drawdown": over("total_return_pct", "max_drawdown_pct"),
        "burke": over(c("total_return_pct") / c("_years"), c("_worst")), "ulcer_performance": over("total_return_pct", "ulcer_index"),
        "deflated_t": over((c("sharpe") - expected_best(trials)) * F.sqrt(c("days") - 1), F.sqrt(F.greatest(1 - c("_skew") * c("sharpe") + (c("_kurt") - 1) / 4 * c("sharpe") * c("sharpe"), F.lit(1e-10)))),
    }).withColumn("calmar", over("cagr_pct", "max_drawdown_pct"))
    unit = lambda v: F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    shares = sum((w * unit((c(n) - low) / span) for n, low, span, w in WEIGHTS), 0.05 * (1 - unit(c("cost_pct") / 60)))
    steady = 1 - c("longest_losses") / c("n_trades")
    composite = sum((w * unit(c(n) / cap) for n, cap, w in COMPOSITE), F.lit(0.0)) * steady
    out = out.withColumns({
        "profitability_score": F.when((c("n_trades") < 50) | (c("net_profit") <= 0) | (c("expectancy") <= 0), 0.0).otherwise(shares),
        "composite_score": F.when((c("n_trades") < 30) | (c("win_rate_pct") < 40) | (c("max_drawdown_pct") > 20), 0.0).otherwise(composite),
    })
    passed = lambda n, bound, least: F.coalesce(c(n) >= bound if least else c(n) <= bound, F.lit(False))
    failed = [F.when(~passed(n, bound, least), reason) for reason, n, bound, least in GATES]
    failed += [F.when(c("net_profit") <= 0, "NON_POSITIVE_NET_PROFIT"), F.when(c("expectancy") <= 0, "NEG_EXPECTANCY")]
    out = out.withColumn("blocked_by", F.concat_ws("|", *failed))
    return out.withColumn("approved", c("blocked_by") == "").drop("_years")
