"""Trade and return statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.operators.quantiles import quantiles
from larkfold.operators.series import ordinal


def trade_metrics(trades: DataFrame, by: list[str], pnl: str) -> DataFrame:
    """Win rate, mean win and loss, profit factor and expectancy by key."""
    p = F.col(pnl)
    won, lost = F.when(p > 0, p), F.when(p < 0, p)
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((p > 0).cast("int")).alias("win_rate"), F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss"),
        F.try_divide(F.coalesce(F.sum(won), F.lit(0.0)), -F.sum(lost)).alias("profit_factor"), F.avg(p).alias("expectancy"),
    )


def return_metrics(returns: DataFrame, by: list[str], ret: str, periods: float = 252.0) -> DataFrame:
    """Sharpe, Sortino, Omega, gain-to-pain and tail ratio of a column of returns, by key."""
    r = F.col(ret)
    down = F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0)))
    gains, losses = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    tails = quantiles(returns, by, ret, {"_p95": 0.95, "_p05": 0.05}).select(*by, F.try_divide("_p95", F.abs("_p05")).alias("tail_ratio"))
    return returns.where(r.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), (F.try_divide(F.avg(r), F.stddev_samp(r)) * periods**0.5).alias("sharpe"), (F.try_divide(F.avg(r), down) * periods**0.5).alias("sortino"),
        F.try_divide(gains, losses).alias("omega"), F.try_divide(F.sum(r), losses).alias("gain_to_pain"),
    ).join(tails, by)


def drawdowns(curve: DataFrame, keys: list[str], order: list[str], equity: str, bucket: Column) -> DataFrame:
    """Adds the running peak and the drawdown from it: the peak of a bucket's rows so far and of all buckets before."""
    df = curve.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, "_bucket").agg(F.max(equity).alias("_top")).select(*keys, "_bucket", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(tops, [*keys, "_bucket"]).withColumn("peak", F.greatest("_before", F.max(equity).over(inside)))
    return out.withColumn("drawdown", F.try_divide(equity, "peak") - 1).drop("_bucket", "_before")


def conformal_quantile(scores: DataFrame, by: list[str], score: str, bucket: Column, alpha: float) -> DataFrame:
    """The k-th smallest score, k = ceil((n + 1)(1 - alpha)) at most n, by ranks in two steps."""
    n = scores.groupBy(*by).agg(F.count("*").alias("n"))
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    ranked = ordinal(scores, by, [score], bucket).join(n, by)
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("_rn") + 1 == k, F.col(score))).alias("q_hat"))
