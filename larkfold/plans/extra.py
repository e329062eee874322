"""Queries: detectors, scoring, statistics and legacy technicals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkfold.operators import metrics
from larkfold.operators import statistics as S
from larkfold.operators.series import ema, frame, ordinal, rolling, running
from larkfold.plans.core import DAY_MS, tick_bucket
from larkfold.plans.dataset import diff
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, over_bars, picked, rows
from larkfold.sources.adapters import BARS_SQL, TICKS_SQL, daily_bars, table, ticks

TW = "PARTITION BY symbol ORDER BY time_msc, event_id"


def over_ticks(spark: SparkSession, d: str, columns, before: int = 0, after: int = 0) -> DataFrame:
    return rolling(ticks(spark, d), ["symbol"], ["time_msc", "event_id"], tick_bucket(), columns, before, after)


@query("k05_stochastic_d", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, close, max(high) OVER {rows(14)} AS hi, min(low) OVER {rows(14)} AS lo FROM bars), k AS (SELECT symbol, day, CASE WHEN hi - lo > 1e-12 THEN 100 * (close - lo) / (hi - lo) ELSE 50 END AS k FROM r)
 SELECT symbol, day, round(k, 5) AS stoch_k, round(avg(k) OVER {rows(3)}, 5) AS stoch_d FROM k""")  # fmt: skip
def k05(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        hi, lo = F.max("high").over(frame(w, 14)), F.min("low").over(frame(w, 14))
        return [{"stoch_k": F.when(hi - lo > 1e-12, 100 * (F.col("close") - lo) / (hi - lo)).otherwise(50.0)}, {"stoch_d": F.avg("stoch_k").over(frame(w, 3))}]

    return picked(over_bars(spark, d, columns, 17), "stoch_k", "stoch_d", places=5)


@query("k07_obv", f"""WITH {BARS_SQL}, s AS (SELECT symbol, day, coalesce(sign(close - lag(close) OVER ({W})), 0)::BIGINT * tick_count AS v FROM bars) SELECT symbol, day, CAST(sum(v) OVER ({W}) AS BIGINT) AS obv FROM s""")
def k07(spark: SparkSession, d: str) -> DataFrame:
    s = over_bars(spark, d, lambda w: {"v": F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0)).cast("long") * F.col("tick_count")}, 1)
    return running(s, KEYS, ORDER, bar_bucket(), {"obv": F.col("v")}).select("symbol", "day", "obv")


@query("k03_rsi_wilder", f"""WITH RECURSIVE {BARS_SQL}, c AS (SELECT symbol, day, row_number() OVER ({W}) AS i, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars),
 e AS (SELECT symbol, day, i, greatest(d, 0)::DOUBLE AS u, greatest(-d, 0)::DOUBLE AS v FROM c WHERE i = 1 UNION ALL SELECT c.symbol, c.day, c.i, e.u + (greatest(c.d, 0) - e.u) / 14, e.v + (greatest(-c.d, 0) - e.v) / 14 FROM e JOIN c ON c.symbol = e.symbol AND c.i = e.i + 1)
 SELECT symbol, day, round(CASE WHEN v <= 1e-12 THEN 100 ELSE 100 - 100 / (1 + u / v) END, 4) AS rsi_14 FROM e""")  # fmt: skip
def k03(spark: SparkSession, d: str) -> DataFrame:
    """Wilder's averages of gains and losses are two linear recurrences."""
    r = over_bars(spark, d, lambda w: {"d": F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))}, 1)
    r = ordinal(r, KEYS, ORDER, bar_bucket()).withColumns({"up": F.greatest("d", F.lit(0.0)), "down": F.greatest(-F.col("d"), F.lit(0.0))})
    e = ema(ema(r, KEYS, "up", 1 / 14, "u", block=700), KEYS, "down", 1 / 14, "v", block=700)
    return picked(e.withColumn("rsi_14", F.when(F.col("v") <= 1e-12, 100.0).otherwise(100 - 100 / (1 + F.col("u") / F.col("v")))), "rsi_14", places=4)


@query("k18_correlation_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def k18(spark: SparkSession, d: str) -> DataFrame:
    return S.correlation_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("corr", F.round("corr", 6))


@query("k19_granger")
def k19(spark: SparkSession, d: str) -> DataFrame:
    """F statistics from aggregated moments (no SQL)."""
    lags = 2
    r = over_bars(spark, d, lambda w: [{"y": F.log(F.col("close") / F.lag("close").over(w)), "x": F.log(F.col("open") / F.lag("open").over(w))}, {f"{v}_lag{k}": F.lag(v, k).over(w) for v in ("x", "y") for k in range(1, lags + 1)}], lags + 1)
    return S.granger(r, ["symbol"], "x", "y", lags).withColumn("f", F.round("f", 4))


@query("a24_monte_carlo")
def a24(spark: SparkSession, d: str) -> DataFrame:
    """Block bootstrap of returns (random, but the same on each run)."""
    r = over_bars(spark, d, lambda w: {"r": (F.col("close") / F.lag("close").over(w) - 1) / 100}, 1).where("r is not null").select("symbol", "day", "r")
    p = S.bootstrap_paths(r, "symbol", "r", paths=200)
    return p.groupBy("symbol").agg(F.count("*").alias("paths"), F.round(F.percentile("final", F.lit(0.05)), 6).alias("final_p05"), F.round(F.avg("max_drawdown"), 6).alias("drawdown_mean"))


@query("k26_isotonic_calibration")
def k26(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") / 51).alias("s"), (F.col("l_linestatus") == "F").alias("y"))
    return S.isotonic(p, ["k"], "s", "y", bins=50).withColumn("calibrated", F.round("calibrated", 6))


@query("st19_kalman_level", f"""WITH RECURSIVE {TICKS_SQL}, r AS (SELECT symbol, event_id, bid, row_number() OVER (PARTITION BY symbol ORDER BY time_msc, event_id) AS i FROM ticks),
 k AS (SELECT symbol, event_id, i, bid AS level, 25.0::DOUBLE AS p FROM r WHERE i = 1
  UNION ALL SELECT r.symbol, r.event_id, r.i, level + (p + 1) / (p + 26) * (bid - level), (1 - (p + 1) / (p + 26)) * (p + 1) FROM k JOIN r ON r.symbol = k.symbol AND r.i = k.i + 1)
 SELECT event_id, round(level, 6) AS level, round(p, 6) AS variance FROM k""")  # fmt: skip
def st19(spark: SparkSession, d: str) -> DataFrame:
    """The filter over each symbol's whole series."""
    t = ticks(spark, d).select("symbol", "time_msc", "event_id", "bid")
    return S.kalman_level(t, ["symbol"], ["time_msc", "event_id"], tick_bucket(), "bid", 1.0, 25.0).select("event_id", F.round("level", 6).alias("level"), F.round("variance", 6).alias("variance"))


@query("e01_absorption", f"""WITH {BARS_SQL}, z AS (SELECT *, count(*) OVER {rows(30)} AS n, avg(tick_count) OVER {rows(30)} AS m, stddev_pop(tick_count) OVER {rows(30)} AS s FROM bars)
 SELECT symbol, day, CASE WHEN n >= 10 AND s > 0 AND (tick_count - m) / s > 1 AND abs(close - open) / open * 100 < 20 THEN CASE WHEN close >= open THEN 'buy' ELSE 'sell' END END AS side,
 round(CASE WHEN n >= 10 AND s > 0 THEN least(1, greatest((tick_count - m) / s, 0) / 4) END, 6) AS strength FROM z""")  # fmt: skip
def e01(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f = frame(w, 30)
        v = F.col("tick_count")
        z = F.when(F.count("*").over(f) >= 10, F.try_divide(v - F.avg(v).over(f), F.stddev_pop(v).over(f)))
        still = F.abs(F.col("close") - F.col("open")) / F.col("open") * 100 < 20
        return [
            {"z": z},
            {"side": F.when((F.col("z") > 1) & still, F.when(F.col("close") >= F.col("open"), "buy").otherwise("sell")), "strength": F.least(F.lit(1.0), F.greatest("z", F.lit(0.0)) / 4)},
            {"strength": F.when(F.col("z").isNotNull(), F.col("strength"))},
        ]

    return over_bars(spark, d, columns, 30).select("symbol", "day", "side", F.round("strength", 6).alias("strength"))


@query("e03_tick_rule_flow", f"""WITH {TICKS_SQL}, s AS (SELECT event_id, symbol, time_msc, CASE WHEN bid > lag(bid) OVER ({TW}) THEN 1 WHEN bid < lag(bid) OVER ({TW}) THEN -1 ELSE 0 END AS delta FROM ticks)
 SELECT event_id, CAST(sum(delta) OVER ({TW}) AS BIGINT) AS cum_delta, round(avg(delta) OVER ({TW} ROWS 19 PRECEDING), 6) AS mean_delta_20 FROM s""")  # fmt: skip
def e03(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        return [{"delta": F.coalesce(F.signum(F.col("bid") - F.lag("bid").over(w)), F.lit(0)).cast("long")}, {"mean_delta_20": F.round(F.avg("delta").over(frame(w, 20)), 6)}]

    t = over_ticks(spark, d, columns, 20)
    return running(t, ["symbol"], ["time_msc", "event_id"], tick_bucket(), {"cum_delta": F.col("delta")}).select("event_id", "cum_delta", "mean_delta_20")


@query("e06_hidden_orders", f"""WITH {TICKS_SQL}, l AS (SELECT *, round(bid / 5) * 5 AS level FROM ticks), w AS (SELECT event_id, count(*) OVER p AS fills, sum(1 + flags % 3) OVER p AS volume FROM l WINDOW p AS (PARTITION BY symbol, level ORDER BY time_msc, event_id))
 SELECT event_id, fills >= 5 AND volume / 2.0 > 4 AS hidden FROM w""")  # fmt: skip
def e06(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d).withColumn("level", F.round(F.col("bid") / 5) * 5)
    r = running(t, ["symbol", "level"], ["time_msc", "event_id"], tick_bucket(), {"fills": F.lit(1).cast("long"), "volume": (1 + F.col("flags") % 3).cast("long")})
    return r.select("event_id", ((F.col("fills") >= 5) & (F.col("volume") / 2.0 > 4)).alias("hidden"))


@query("e09_tick_rate_anomaly", f"""WITH {TICKS_SQL}, g AS (SELECT event_id, symbol, time_msc, (time_msc - lag(time_msc) OVER ({TW}))::DOUBLE AS gap FROM ticks),
 f AS (SELECT event_id, avg(gap) OVER ({TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS late, avg(gap) OVER p AS early, stddev_pop(gap) OVER p AS s, count(gap) OVER p AS n FROM g WINDOW p AS ({TW} ROWS BETWEEN 99 PRECEDING AND 20 PRECEDING))
 SELECT event_id, n >= 50 AND s > 0 AND abs(late - early) / s > 0.4 AS anomaly FROM f""")  # fmt: skip
def e09(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        p = w.rowsBetween(-99, -20)
        g = F.col("gap")
        z = F.try_divide(F.abs(F.avg(g).over(frame(w, 20)) - F.avg(g).over(p)), F.stddev_pop(g).over(p))
        return [{"gap": (F.col("time_msc") - F.lag("time_msc").over(w)).cast("double")}, {"anomaly": F.coalesce((F.count(g).over(p) >= 50) & (z > 0.4), F.lit(False))}]

    return over_ticks(spark, d, columns, 100).select("event_id", "anomaly")


@query("e16_native_bar_features", f"""WITH {BARS_SQL}, x AS (SELECT symbol, day, row_number() OVER ({W}) AS i, close, regr_slope(close, epoch(day) / 86400) OVER {rows(21)} AS slope, max(high) OVER {rows(21)} AS hi, min(low) OVER {rows(21)} AS lo, max(high) OVER {rows(6)} AS hs, min(low) OVER {rows(6)} AS ls FROM bars)
 SELECT symbol, day, round(CASE WHEN i > 20 THEN slope END, 3) AS slope_20, round(CASE WHEN i > 20 THEN hi / close - 1 END, 6) AS to_high, round(CASE WHEN i > 20 AND hi > lo THEN 1 - least((hs - ls) / (hi - lo), 1) END, 6) AS compression FROM x""")  # fmt: skip
def e16(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f, g = frame(w, 21), frame(w, 6)
        hi, lo = F.max("high").over(f), F.min("low").over(f)
        seen = F.col("_rn") >= 20
        return {
            "slope_20": F.when(seen, F.regr_slope(F.col("close"), F.unix_date("day")).over(f)), "to_high": F.when(seen, hi / F.col("close") - 1),
            "compression": F.when(seen & (hi > lo), 1 - F.least((F.max("high").over(g) - F.min("low").over(g)) / (hi - lo), F.lit(1.0))),
        }

    return over_bars(spark, d, columns, 21).select("symbol", "day", F.round("slope_20", 3).alias("slope_20"), F.round("to_high", 6).alias("to_high"), F.round("compression", 6).alias("compression"))


@query("e19_source_coverage", f"""WITH {TICKS_SQL}, x AS (SELECT symbol, time_msc // {DAY_MS} AS day, count(DISTINCT broker) AS n, min(broker) AS b FROM ticks GROUP BY ALL)
 SELECT symbol, count(*) AS days, sum((n = 2)::INT)::BIGINT AS both_days, sum((n = 1 AND b = 'a')::INT)::BIGINT AS a_only, sum((n = 1 AND b = 'b')::INT)::BIGINT AS b_only FROM x GROUP BY symbol""")  # fmt: skip
def e19(spark: SparkSession, d: str) -> DataFrame:
    x = ticks(spark, d).groupBy("symbol", tick_bucket().alias("day")).agg(F.min("broker").alias("lo"), F.max("broker").alias("hi"))
    n = lambda c: F.sum(c.cast("long"))
    one = F.col("lo") == F.col("hi")
    return x.groupBy("symbol").agg(F.count("*").alias("days"), n(~one).alias("both_days"), n(one & (F.col("lo") == "a")).alias("a_only"), n(one & (F.col("lo") == "b")).alias("b_only"))


@query("a25_journal_by_session", """SELECT l_linestatus AS session, l_returnflag AS regime, count(*) AS n, round(avg((l_discount > 0.05)::INT), 6) AS win_rate, round(sum(l_extendedprice * (l_discount - 0.05)), 2) AS pnl FROM lineitem GROUP BY 1, 2""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_linestatus").alias("session"), F.col("l_returnflag").alias("regime")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("win_rate"), F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 2).alias("pnl")
    )


@query("w28_worst_drawdowns", f"""WITH {BARS_SQL}, p AS (SELECT symbol, day, close, max(close) OVER ({W}) AS peak FROM bars), e AS (SELECT symbol, peak, min(close / peak - 1) AS depth, count(*) AS length FROM p WHERE close < peak GROUP BY symbol, peak)
 SELECT symbol, round(peak, 2) AS peak, round(depth, 6) AS depth, length FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY depth, peak) <= 3""")  # fmt: skip
def w28_worst(spark: SparkSession, d: str) -> DataFrame:
    """The deepest episodes: an episode is the rows under one peak."""
    p = metrics.drawdowns(daily_bars(spark, d), KEYS, ORDER, "close", bar_bucket()).where("close < peak")
    e = p.groupBy("symbol", "peak").agg(F.min("drawdown").alias("depth"), F.count("*").alias("length"))
    top = e.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "peak"))).where("i <= 3")
    return top.select("symbol", F.round("peak", 2).alias("peak"), F.round("depth", 6).alias("depth"), "length")


@query("k28_pinball_loss", f"""WITH {BARS_SQL}, p AS (SELECT symbol, close - lag(close) OVER ({W}) AS e FROM bars) SELECT symbol, round(avg(greatest(0.9 * e, -0.1 * e)), 4) AS loss_90 FROM p WHERE e IS NOT NULL GROUP BY symbol""")
def k28(spark: SparkSession, d: str) -> DataFrame:
    p = over_bars(spark, d, lambda w: {"e": F.col("close") - F.lag("close").over(w)}, 1).where("e is not null")
    return p.groupBy("symbol").agg(F.round(F.avg(F.greatest(0.9 * F.col("e"), -0.1 * F.col("e"))), 4).alias("loss_90"))


@query("k24_risk_parity", f"""WITH {BARS_SQL}, r AS (SELECT symbol, close / lag(close) OVER ({W}) - 1 AS r FROM bars), v AS (SELECT symbol, 1 / stddev_samp(r) AS iv FROM r GROUP BY symbol) SELECT symbol, round(iv / sum(iv) OVER (), 6) AS weight FROM v""")
def k24(spark: SparkSession, d: str) -> DataFrame:
    r = over_bars(spark, d, lambda w: {"r": F.col("close") / F.lag("close").over(w) - 1}, 1)
    v = r.groupBy("symbol").agg((1 / F.stddev_samp("r")).alias("iv"))  # one row a symbol from here
    return v.select("symbol", F.round(F.col("iv") / F.sum("iv").over(Window.partitionBy()), 6).alias("weight"))


@query("p10_intraday_window", f"""WITH {TICKS_SQL} SELECT symbol, time_msc // {DAY_MS} AS day, count(*) AS n FROM ticks WHERE time_msc % {DAY_MS} >= 25200000 AND time_msc % {DAY_MS} < 57600000 GROUP BY ALL""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("time_msc") % DAY_MS
    return ticks(spark, d).where((at >= 25_200_000) & (at < 57_600_000)).groupBy("symbol", tick_bucket().alias("day")).agg(F.count("*").alias("n"))


@query("x04_dataset_diff", """SELECT 'only_old' AS side, count(*) AS n FROM (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)
 UNION ALL SELECT 'only_new', count(*) FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders)""")  # fmt: skip
def x04(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return diff(o, o.where("o_orderkey % 7 <> 0"))
