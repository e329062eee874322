"""Queries: feature families, microstructure, structure and regime detectors, sizing and scheduling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkfold.functions.columns import finite_or_null
from larkfold.operators import bars as B
from larkfold.operators import joins, merge
from larkfold.operators.clean import fill_forward
from larkfold.operators.indicators import true_range
from larkfold.operators.series import ema, frame, full, islands, linear_recurrence, ordinal, rolling, running
from larkfold.plans.core import DAY_MS, HOUR, HOURLY_SQL, MONTHISH, hourly, tick_bucket
from larkfold.plans.extra import TW, over_ticks
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, guard, over_bars, picked, rows
from larkfold.sources.adapters import BARS_SQL, TICKS_SQL, daily_bars, table, ticks

RET = f"ret AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM bars)"


def ret(w):
    C = F.col("close")
    return {"r": C / F.lag(C).over(w) - 1}


@query("k02_bollinger", f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, close, {guard("avg(close)", 20)} AS m, {guard("stddev_pop(close)", 20)} AS s FROM bars)
 SELECT symbol, day, round(m + 2 * s, 4) AS upper, round(m - 2 * s, 4) AS lower, round(CASE WHEN s > 1e-9 THEN (close - m + 2 * s) / (4 * s) WHEN s IS NOT NULL THEN 0.5 END, 5) AS pct_b FROM b""")  # fmt: skip
def k02(spark: SparkSession, d: str) -> DataFrame:
    C = F.col("close")

    def columns(w):
        m, s = F.col("m"), F.col("s")
        return [
            {"m": full(F.avg, C, w, 20), "s": full(F.stddev_pop, C, w, 20)},
            {"upper": m + 2 * s, "lower": m - 2 * s, "pct_b": F.when(s > 1e-9, (C - m + 2 * s) / (4 * s)).when(s.isNotNull(), 0.5)},
        ]

    return over_bars(spark, d, columns, 20).select("symbol", "day", F.round("upper", 4).alias("upper"), F.round("lower", 4).alias("lower"), F.round("pct_b", 5).alias("pct_b"))


@query("w08_variance_ratio", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, ln(close / lag(close) OVER ({W})) AS r, ln(close / lag(close, 4) OVER ({W})) AS r4 FROM bars),
 v AS (SELECT symbol, day, count(r4) OVER {rows(60)} AS n, var_pop(r) OVER {rows(60)} AS v1, var_pop(r4) OVER {rows(60)} AS v4 FROM r) SELECT symbol, day, round(CASE WHEN n >= 60 AND v1 > 1e-12 THEN v4 / (4 * v1) END, 5) AS vr_4 FROM v""")  # fmt: skip
def w08(spark: SparkSession, d: str) -> DataFrame:
    C = F.col("close")

    def columns(w):
        f = frame(w, 60)
        return [
            {"r": F.log(C / F.lag(C).over(w)), "r4": F.log(C / F.lag(C, 4).over(w))},
            {"vr_4": F.when((F.count("r4").over(f) >= 60) & (F.var_pop("r").over(f) > 1e-12), F.var_pop("r4").over(f) / (4 * F.var_pop("r").over(f)))},
        ]

    return picked(over_bars(spark, d, columns, 64), "vr_4", places=5)


@query("w14_daily_range_ratio", f"""WITH {TICKS_SQL}, r AS (SELECT symbol, time_msc // {DAY_MS} AS day, max(bid) - min(bid) AS rng FROM ticks GROUP BY ALL), a AS (SELECT symbol, day, rng, avg(rng) OVER p AS adr, count(*) OVER p AS n FROM r WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
 SELECT symbol, day, round(CASE WHEN n > 0 AND adr > 1e-9 THEN rng / adr END, 5) AS adr_ratio FROM a""")  # fmt: skip
def w14(spark: SparkSession, d: str) -> DataFrame:
    r = ticks(spark, d).groupBy("symbol", tick_bucket().alias("day")).agg((F.max("bid") - F.min("bid")).alias("rng"))

    def columns(w):
        adr = F.avg("rng").over(w.rowsBetween(-20, -1))
        return {"adr_ratio": F.when(adr > 1e-9, F.col("rng") / adr)}

    return rolling(r, ["symbol"], ["day"], F.floor(F.col("day") / 365), columns, 20).select("symbol", "day", F.round("adr_ratio", 5).alias("adr_ratio"))


@query("w20_nearest_recent_level", f"""WITH {BARS_SQL}, {RET}, e AS (SELECT symbol, day, list(low) OVER ({W} ROWS 9 PRECEDING) AS levels FROM ret WHERE r > 0.5)
 SELECT b.symbol, b.day, round(list_min(list_transform(e.levels, lambda v: abs(v - b.close))), 4) AS distance FROM bars b ASOF LEFT JOIN e ON b.symbol = e.symbol AND b.day >= e.day""")  # fmt: skip
def w20(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest of the last ten displacement lows: frames over the events alone, then as-of to the bars."""
    C = F.col("close")
    b = over_bars(spark, d, ret, 1).withColumn("t", F.unix_date("day").cast("long"))
    e = rolling(b.where("r > 0.5"), KEYS, ["t"], bar_bucket(), lambda w: {"levels": F.collect_list("low").over(frame(w, 10))}, 10)
    j = joins.asof(b, e.select("symbol", "t", "levels"), ["symbol"], "t", ["levels"], 400)
    return j.select("symbol", "day", F.round(F.array_min(F.transform("levels", lambda v: F.abs(v - C))), 4).alias("distance"))


@query("w21_permutation_entropy", f"""WITH {BARS_SQL}, p AS (SELECT symbol, day, CASE WHEN lag(close, 2) OVER ({W}) IS NOT NULL THEN (lag(close, 2) OVER ({W}) < lag(close) OVER ({W}))::INT * 4 + (lag(close) OVER ({W}) < close)::INT * 2 + (lag(close, 2) OVER ({W}) < close)::INT END AS k FROM bars),
 c AS (SELECT symbol, day, count(k) OVER {rows(30)} AS n, {", ".join(f"count(CASE WHEN k = {i} THEN 1 END) OVER {rows(30)} AS c{i}" for i in range(8))} FROM p)
 SELECT symbol, day, round(CASE WHEN n >= 30 THEN ({" + ".join(f"CASE WHEN c{i} > 0 THEN -c{i} / n * ln(c{i} / n) ELSE 0 END" for i in range(8))}) / ln(6) END, 5) AS perm_entropy FROM c""")  # fmt: skip
def w21(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of order-3 patterns: the pattern of three closes is three comparisons."""

    C = F.col("close")

    def columns(w):
        f = frame(w, 30)
        a, b, n = F.lag(C, 2).over(w), F.lag(C).over(w), F.col("n")
        bit = lambda c, v: c.cast("int") * v
        part = lambda i: F.when(F.col(f"c{i}") > 0, -F.col(f"c{i}") / n * F.log(F.col(f"c{i}") / n)).otherwise(0.0)
        return [
            {"k": F.when(a.isNotNull(), bit(a < b, 4) + bit(b < C, 2) + bit(a < C, 1))},
            {"n": F.count("k").over(f), **{f"c{i}": F.count(F.when(F.col("k") == i, 1)).over(f) for i in range(8)}},
            {"perm_entropy": F.when(n >= 30, sum((part(i) for i in range(8)), F.lit(0.0)) / math.log(6))},
        ]

    return picked(over_bars(spark, d, columns, 32), "perm_entropy", places=5)


@query("w22_efficiency_ratio", f"""WITH {BARS_SQL}, s AS (SELECT symbol, day, abs(close - lag(close, 10) OVER ({W})) AS net, abs(close - lag(close) OVER ({W})) AS step FROM bars), t AS (SELECT symbol, day, net, sum(step) OVER {rows(10)} AS path FROM s) SELECT symbol, day, round(CASE WHEN net IS NOT NULL AND path > 1e-9 THEN net / path END, 6) AS efficiency FROM t""")
def w22(spark: SparkSession, d: str) -> DataFrame:
    C = F.col("close")

    def columns(w):
        return [
            {"net": F.abs(C - F.lag(C, 10).over(w)), "step": F.abs(C - F.lag(C).over(w))},
            {"path": F.sum("step").over(frame(w, 10))},
            {"efficiency": F.when(F.col("path") > 1e-9, F.col("net") / F.col("path"))},
        ]

    return picked(over_bars(spark, d, columns, 11), "efficiency")


@query("w26_tensor_windows", f"""WITH {BARS_SQL}, t AS (SELECT symbol, day, list(close) OVER {rows(8)} AS c, list(tick_count) OVER {rows(8)} AS n FROM bars) SELECT symbol, day, c[1] AS first_close, c[8] AS last_close, list_sum(n)::BIGINT AS ticks FROM t WHERE len(c) = 8""")
def w26(spark: SparkSession, d: str) -> DataFrame:
    """Lookback tensors: arrays of rows of features, complete ones only."""
    C, N = F.col("close"), F.col("tick_count")
    t = over_bars(spark, d, lambda w: {"x": F.collect_list(F.array(C, N.cast("double"))).over(frame(w, 8))}, 8).where(F.size("x") == 8)
    ticks_ = F.aggregate("x", F.lit(0.0), lambda s, v: s + v[1]).cast("long")
    return t.select("symbol", "day", F.col("x")[0][0].alias("first_close"), F.col("x")[7][0].alias("last_close"), ticks_.alias("ticks"))


@query("w30_tick_feature_rollups", f"""WITH {TICKS_SQL}, g AS (SELECT symbol, time_msc // {HOUR} * {HOUR} AS bar, count(*) AS n, sum((flags & 32 > 0)::INT) - sum((flags & 64 > 0)::INT) AS ofi FROM ticks GROUP BY ALL)
 SELECT symbol, bar, round(avg(ofi) OVER (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING), 6) AS ofi_5, round(n / avg(n) OVER (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING), 6) AS tick_ratio_20 FROM g""")  # fmt: skip
def w30(spark: SparkSession, d: str) -> DataFrame:
    m = B.microstructure(ticks(spark, d), HOUR).withColumn("ofi", F.col("buys") - F.col("sells"))
    out = rolling(m, ["symbol"], ["bar"], F.floor(F.col("bar") / MONTHISH), lambda w: {"ofi_5": F.avg("ofi").over(frame(w, 5)), "tick_ratio_20": F.col("ticks") / F.avg("ticks").over(frame(w, 20))}, 20)
    return out.select("symbol", "bar", F.round("ofi_5", 6).alias("ofi_5"), F.round("tick_ratio_20", 6).alias("tick_ratio_20"))


@query("f05_disagreement", f"""WITH {TICKS_SQL}, x AS (SELECT symbol, time_msc // {HOUR} AS bucket, arg_max(CASE WHEN broker = 'a' THEN bid END, CASE WHEN broker = 'a' THEN (time_msc, event_id) END) AS a, arg_max(CASE WHEN broker = 'b' THEN bid END, CASE WHEN broker = 'b' THEN (time_msc, event_id) END) AS b FROM ticks GROUP BY ALL),
 y AS (SELECT symbol, bucket, (a - b) / ((a + b) / 2) * 1e4 AS bps FROM x) SELECT symbol, bucket, round(bps, 5) AS divergence_bps, round(CASE WHEN count(bps) OVER p >= 10 AND stddev_samp(bps) OVER p > 1e-9 THEN (bps - avg(bps) OVER p) / stddev_samp(bps) OVER p END, 5) AS divergence_z FROM y
 WINDOW p AS (PARTITION BY symbol ORDER BY bucket ROWS 59 PRECEDING)""")  # fmt: skip
def f05(spark: SparkSession, d: str) -> DataFrame:
    b = merge.last_per_bucket(ticks(spark, d), HOUR)
    b = b.withColumn("bps", F.try_divide(F.col("a_bid") - F.col("b_bid"), (F.col("a_bid") + F.col("b_bid")) / 2) * 1e4)

    def columns(w):
        f = frame(w, 60)
        s = F.stddev_samp("bps").over(f)
        return {"divergence_z": F.when((F.count("bps").over(f) >= 10) & (s > 1e-9), (F.col("bps") - F.avg("bps").over(f)) / s)}

    out = rolling(b, ["symbol"], ["bucket"], F.floor(F.col("bucket") / 480), columns, 60)
    return out.select("symbol", "bucket", F.round("bps", 5).alias("divergence_bps"), F.round("divergence_z", 5).alias("divergence_z"))


@query("f06_event_shape", f"""WITH {TICKS_SQL}, g AS (SELECT event_id, symbol, time_msc, (time_msc - lag(time_msc) OVER ({TW}))::DOUBLE / 1000 AS gap, bid - lag(bid) OVER ({TW}) AS step, abs(bid - lag(bid, 10) OVER ({TW})) AS net FROM ticks),
 s AS (SELECT event_id, net, avg(gap) OVER f AS m, stddev_samp(gap) OVER f AS s, count(gap) OVER f AS n, sum(abs(step)) OVER ({TW} ROWS 9 PRECEDING) AS path FROM g WINDOW f AS ({TW} ROWS 29 PRECEDING))
 SELECT event_id, round(CASE WHEN n >= 30 THEN (s - m) / (s + m) END, 5) AS burstiness, round(CASE WHEN net IS NOT NULL AND path > 1e-9 THEN net / path END, 6) AS path_efficiency FROM s""")  # fmt: skip
def f06(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f = frame(w, 30)
        m, s = F.avg("gap").over(f), F.stddev_samp("gap").over(f)
        return [
            {"gap": (F.col("time_msc") - F.lag("time_msc").over(w)) / 1000, "step": F.abs(F.col("bid") - F.lag("bid").over(w)), "net": F.abs(F.col("bid") - F.lag("bid", 10).over(w))},
            {"burstiness": F.when(F.count("gap").over(f) >= 30, (s - m) / (s + m)), "path": F.sum("step").over(frame(w, 10))},
            {"path_efficiency": F.when(F.col("path") > 1e-9, F.col("net") / F.col("path"))},
        ]

    return over_ticks(spark, d, columns, 31).select("event_id", F.round("burstiness", 5).alias("burstiness"), F.round("path_efficiency", 6).alias("path_efficiency"))


@query("l07_three_class_labels", f"WITH {BARS_SQL} SELECT symbol, day, CASE WHEN lead(close, 3) OVER ({W}) IS NULL THEN NULL WHEN lead(close, 3) OVER ({W}) / close - 1 > 0.05 THEN 2 WHEN lead(close, 3) OVER ({W}) / close - 1 < -0.05 THEN 0 ELSE 1 END AS label FROM bars")
def l07(spark: SparkSession, d: str) -> DataFrame:
    C = F.col("close")

    def columns(w):
        r = F.lead(C, 3).over(w) / C - 1
        return {"label": F.when(r.isNotNull(), F.when(r > 0.05, 2).when(r < -0.05, 0).otherwise(1))}

    return over_bars(spark, d, columns, 0, 3).select("symbol", "day", "label")


@query("n02_zscore_on_training_prefix", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, close, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), s AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s FROM r WHERE i <= floor(n * 0.7) GROUP BY symbol)
 SELECT r.symbol, day, round((close - m) / s, 5) AS z FROM r JOIN s ON r.symbol = s.symbol""")  # fmt: skip
def n02(spark: SparkSession, d: str) -> DataFrame:
    C = F.col("close")
    b = daily_bars(spark, d)
    r = ordinal(b, KEYS, ORDER, bar_bucket()).join(b.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")
    s = r.where(F.col("_rn") + 1 <= F.floor(F.col("n") * 0.7)).groupBy("symbol").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s"))
    return picked(r.join(s, "symbol").withColumn("z", (C - F.col("m")) / F.col("s")), "z", places=5)


@query("e04_level_clusters", """WITH p AS (SELECT event_type AS symbol, value, value - lag(value) OVER (PARTITION BY event_type ORDER BY value) AS gap FROM events), c AS (SELECT symbol, value, sum(CASE WHEN gap > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY value) AS k FROM p)
 SELECT symbol, round(avg(value), 5) AS level, count(*) AS touches FROM c GROUP BY symbol, k HAVING count(*) >= 3""")  # fmt: skip
def e04(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of touches in sorted price: a new one starts after a gap. Cluster numbers are running sums over price ranges."""
    t = ticks(spark, d).select("symbol", "bid", "event_id")
    price = F.floor(F.col("bid") / 20)
    g = rolling(t, ["symbol"], ["bid", "event_id"], price, lambda w: {"new": F.coalesce((F.col("bid") - F.lag("bid").over(w) > 0.5).cast("long"), F.lit(0))}, 1)
    c = running(g, ["symbol"], ["bid", "event_id"], price, {"k": F.col("new")})
    return c.groupBy("symbol", "k").agg(F.round(F.avg("bid"), 5).alias("level"), F.count("*").alias("touches")).where("touches >= 3").drop("k")


@query("e10_hour_of_day_anomaly", f"""WITH {HOURLY_SQL}, z AS (SELECT symbol, bar, tick_count AS v, avg(tick_count) OVER p AS m, stddev_pop(tick_count) OVER p AS s, count(*) OVER p AS n FROM hourly WINDOW p AS (PARTITION BY symbol, bar // {HOUR} % 24 ORDER BY bar ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
 SELECT symbol, bar, n >= 10 AND s > 0 AND abs(v - m) / s > 2 AS anomaly FROM z""")  # fmt: skip
def e10(spark: SparkSession, d: str) -> DataFrame:
    N = F.col("tick_count")
    h = hourly(spark, d).select("symbol", "bar", "tick_count", (F.floor(F.col("bar") / HOUR) % 24).alias("hour"))

    def columns(w):
        p = w.rowsBetween(-30, -1)
        z = F.try_divide(F.abs(N - F.avg(N).over(p)), F.stddev_pop(N).over(p))
        return {"anomaly": F.coalesce((F.count("*").over(p) >= 10) & (z > 2), F.lit(False))}

    return rolling(h, ["symbol", "hour"], ["bar"], F.floor(F.col("bar") / MONTHISH), columns, 30).select("symbol", "bar", "anomaly")


@query("e12_market_anomalies", f"""WITH {BARS_SQL}, t AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(day) OVER ({W}) AS pd, avg(high - low) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS atr, avg(tick_count) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS av FROM bars)
 SELECT symbol, day, coalesce(day - pd > 3, false) AS stale, coalesce(abs(close - pc) > 2 * atr, false) AS jump, coalesce(tick_count > 3 * av, false) AS volume FROM t""")  # fmt: skip
def e12(spark: SparkSession, d: str) -> DataFrame:
    C, H, L, N = F.col("close"), F.col("high"), F.col("low"), F.col("tick_count")

    def columns(w):
        p = w.rowsBetween(-14, -1)
        no = F.lit(False)
        return {
            "stale": F.coalesce(F.date_diff("day", F.lag("day").over(w)) > 3, no), "jump": F.coalesce(F.abs(C - F.lag(C).over(w)) > 2 * F.avg(H - L).over(p), no),
            "volume": F.coalesce(N > 3 * F.avg(N).over(p), no),
        }

    return over_bars(spark, d, columns, 14).select("symbol", "day", "stale", "jump", "volume")


@query("e17_native_regimes", f"""WITH {BARS_SQL}, {RET}, f AS (SELECT symbol, day, row_number() OVER ({W}) AS i, stddev_samp(r) OVER {rows(10)} AS vs, stddev_samp(r) OVER {rows(40)} AS vl, max(high) OVER {rows(10)} - min(low) OVER {rows(10)} AS rs, max(high) OVER {rows(40)} - min(low) OVER {rows(40)} AS rl FROM ret)
 SELECT symbol, day, CASE WHEN i <= 40 THEN 'warmup' WHEN vs / vl > 1.2 THEN 'expansion' WHEN 1 - rs / rl > 0.3 AND vs / vl < 0.9 THEN 'compression' ELSE 'range' END AS regime FROM f""")  # fmt: skip
def e17(spark: SparkSession, d: str) -> DataFrame:
    H, L = F.col("high"), F.col("low")

    def columns(w):
        s, k = frame(w, 10), frame(w, 40)
        ratio = F.try_divide(F.stddev_samp("r").over(s), F.stddev_samp("r").over(k))
        squeeze = 1 - F.try_divide(F.max(H).over(s) - F.min(L).over(s), F.max(H).over(k) - F.min(L).over(k))
        return [ret(w), {"regime": F.when(F.col("_rn") < 40, "warmup").when(ratio > 1.2, "expansion").when((squeeze > 0.3) & (ratio < 0.9), "compression").otherwise("range")}]

    return over_bars(spark, d, columns, 41).select("symbol", "day", "regime")


@query("k04_macd", f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT symbol, day, close, row_number() OVER ({W}) AS i FROM bars),
 e AS (SELECT symbol, day, i, close AS a, close AS b, 0.0::DOUBLE AS s FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.day, r.i, e.a + 2.0::DOUBLE / 13 * (r.close - e.a), e.b + 2.0::DOUBLE / 27 * (r.close - e.b),
   e.s + 0.2::DOUBLE * ((e.a + 2.0::DOUBLE / 13 * (r.close - e.a)) - (e.b + 2.0::DOUBLE / 27 * (r.close - e.b)) - e.s) FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1)
 SELECT symbol, day, round(a - b, 3) AS macd, round(s, 3) AS signal FROM e""")  # fmt: skip
def k04(spark: SparkSession, d: str) -> DataFrame:
    r = ordinal(daily_bars(spark, d), KEYS, ORDER, bar_bucket())
    e = ema(ema(r, KEYS, "close", 2 / 13, "fast", block=800), KEYS, "close", 2 / 27, "slow", block=800).withColumn("macd", F.col("fast") - F.col("slow"))
    return picked(ema(e, KEYS, "macd", 0.2, "signal", block=800), "macd", "signal", places=3)


@query("k09_chaikin_williams", f"""WITH {BARS_SQL}, m AS (SELECT symbol, day, close, CASE WHEN high - low > 1e-12 THEN ((close - low) - (high - close)) / (high - low) * tick_count ELSE 0 END AS mfv, tick_count, max(high) OVER {rows(14)} AS hi, min(low) OVER {rows(14)} AS lo FROM bars)
 SELECT symbol, day, round(sum(mfv) OVER {rows(20)} / sum(tick_count) OVER {rows(20)}, 5) AS cmf_20, round(CASE WHEN hi - lo > 1e-12 THEN (close - hi) / (hi - lo) * 100 ELSE -50 END, 5) AS williams FROM m""")  # fmt: skip
def k09(spark: SparkSession, d: str) -> DataFrame:
    C, H, L, N = F.col("close"), F.col("high"), F.col("low"), F.col("tick_count")

    def columns(w):
        hi, lo = F.max(H).over(frame(w, 14)), F.min(L).over(frame(w, 14))
        return [
            {"mfv": F.when(H - L > 1e-12, ((C - L) - (H - C)) / (H - L) * N).otherwise(0.0), "williams": F.when(hi - lo > 1e-12, (C - hi) / (hi - lo) * 100).otherwise(-50.0)},
            {"cmf_20": F.sum("mfv").over(frame(w, 20)) / F.sum(N).over(frame(w, 20))},
        ]

    return picked(over_bars(spark, d, columns, 20), "cmf_20", "williams", places=5)


@query("k15_path_signature", f"""WITH {BARS_SQL}, p AS (SELECT symbol, day, ln(close) AS x, ln(tick_count + 1) AS y FROM bars), i AS (SELECT symbol, day, x - first_value(x) OVER ({W}) AS x0, y - first_value(y) OVER ({W}) AS y0, x - lag(x) OVER ({W}) AS dx, y - lag(y) OVER ({W}) AS dy FROM p)
 SELECT symbol, round(arg_max(x0, day), 5) AS sig_x, round(arg_max(y0, day), 5) AS sig_y, round(0.5 * sum((x0 - dx / 2) * dy - (y0 - dy / 2) * dx), 4) AS levy_area FROM i GROUP BY symbol""")  # fmt: skip
def k15(spark: SparkSession, d: str) -> DataFrame:
    """Level-1 terms and the Levy area of (log price, log volume): sums of products of increments with running positions."""
    C, N = F.col("close"), F.col("tick_count")
    step = over_bars(spark, d, lambda w: [{"x": F.log(C), "y": F.log(N + 1)}, {"dx": F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0)), "dy": F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))}], 1)
    at = running(step, KEYS, ORDER, bar_bucket(), {"x0": F.col("dx"), "y0": F.col("dy")})
    area = (F.col("x0") - F.col("dx") / 2) * F.col("dy") - (F.col("y0") - F.col("dy") / 2) * F.col("dx")
    return at.groupBy("symbol").agg(F.round(F.max_by("x0", "day"), 5).alias("sig_x"), F.round(F.max_by("y0", "day"), 5).alias("sig_y"), F.round(0.5 * F.sum(area), 4).alias("levy_area"))


@query("k16_liquidity_measures", f"""WITH {TICKS_SQL}, s AS (SELECT event_id, symbol, time_msc, sqrt(bid) - lag(sqrt(bid)) OVER ({TW}) AS dp, CASE WHEN flags & 32 > 0 THEN 1 + flags % 5 ELSE -(1 + flags % 5) END AS q FROM ticks), l AS (SELECT *, lag(dp) OVER ({TW}) AS pdp FROM s)
 SELECT event_id, round(CASE WHEN count(dp) OVER f >= 50 THEN regr_slope(dp, q) OVER f END, 3) AS kyle_lambda, round(CASE WHEN count(dp) OVER f >= 50 THEN avg(abs(dp) / abs(q)) OVER f END, 5) AS amihud,
 round(CASE WHEN count(pdp) OVER f >= 50 THEN 2 * sqrt(greatest(-covar_samp(dp, pdp) OVER f, 0)) END, 4) AS roll_spread FROM l WINDOW f AS ({TW} ROWS 49 PRECEDING)""")  # fmt: skip
def k16(spark: SparkSession, d: str) -> DataFrame:
    """Kyle's lambda, Amihud's illiquidity and Roll's spread of root prices over the last 50 ticks."""

    def columns(w):
        f = frame(w, 50)
        dp, q, p = F.col("dp"), F.col("q"), F.col("pdp")
        size = 1 + F.col("flags") % 5
        return [
            {"dp": F.sqrt("bid") - F.lag(F.sqrt("bid")).over(w), "q": F.when(F.col("flags").bitwiseAND(32) > 0, size).otherwise(-size)},
            {"pdp": F.lag("dp").over(w)},
            {
                "kyle_lambda": F.when(F.count(dp).over(f) >= 50, F.regr_slope(dp, q).over(f)), "amihud": F.when(F.count(dp).over(f) >= 50, F.avg(F.abs(dp) / F.abs(q)).over(f)),
                "roll_spread": F.when(F.count(p).over(f) >= 50, 2 * F.sqrt(F.greatest(-F.covar_samp(dp, p).over(f), F.lit(0.0)))),
            },
        ]

    out = over_ticks(spark, d, columns, 52)
    return out.select("event_id", F.round("kyle_lambda", 3).alias("kyle_lambda"), F.round("amihud", 5).alias("amihud"), F.round("roll_spread", 4).alias("roll_spread"))


@query("st07_vpin", f"""WITH {TICKS_SQL}, v AS (SELECT *, (1 + flags % 5) AS q, CASE WHEN flags & 32 > 0 THEN 1 ELSE -1 END AS s FROM ticks), c AS (SELECT symbol, q, s, (sum(q) OVER ({TW}) - q) // 100 AS vb FROM v), b AS (SELECT symbol, vb::BIGINT AS vb, abs(sum(q * s)) / sum(q) AS imb FROM c GROUP BY ALL)
 SELECT symbol, vb AS volume_bucket, round(avg(imb) OVER (PARTITION BY symbol ORDER BY vb ROWS 9 PRECEDING), 6) AS vpin FROM b""")  # fmt: skip
def st07(spark: SparkSession, d: str) -> DataFrame:
    """Volume buckets by running volume (two steps), imbalance of a bucket, mean of the last ten."""
    q, s = 1 + F.col("flags") % 5, F.when(F.col("flags").bitwiseAND(32) > 0, 1).otherwise(-1)
    t = ticks(spark, d).withColumns({"q": q.cast("long"), "s": s})
    t = running(t, ["symbol"], ["time_msc", "event_id"], tick_bucket(), {"cum": F.col("q")}).withColumn("vb", F.floor((F.col("cum") - F.col("q")) / 100))
    b = t.groupBy("symbol", "vb").agg((F.abs(F.sum(F.col("q") * F.col("s"))) / F.sum("q")).alias("imb"))
    out = rolling(b, ["symbol"], ["vb"], F.floor(F.col("vb") / 1000), lambda w: {"vpin": F.avg("imb").over(frame(w, 10))}, 10)
    return out.select("symbol", F.col("vb").alias("volume_bucket"), F.round("vpin", 6).alias("vpin"))


@query("st07_hawkes_intensity", f"""WITH {TICKS_SQL} SELECT e.event_id, round(0.1 + coalesce(sum(0.5 * exp((p.time_msc - e.time_msc) / {HOUR}.0)), 0), 6) AS intensity
 FROM ticks e LEFT JOIN ticks p ON p.symbol = e.symbol AND (p.time_msc < e.time_msc OR (p.time_msc = e.time_msc AND p.event_id < e.event_id)) GROUP BY e.event_id""")  # fmt: skip
def st07_hawkes(spark: SparkSession, d: str) -> DataFrame:
    """Self-exciting intensity at each tick, over the whole series."""
    return hawkes(ticks(spark, d).select("symbol", "time_msc", "event_id"), 0.5, 1.0).select("event_id", F.round("intensity", 6).alias("intensity"))


def hawkes(t: DataFrame, alpha: float, beta: float, base: float = 0.1) -> DataFrame:
    """base + sum of alpha * exp(-beta * hours since) over the earlier ticks: a recurrence whose decay is the gap's, scanned by blocks."""
    order = ["time_msc", "event_id"]
    t = rolling(t, ["symbol"], order, tick_bucket(), lambda w: {"_gap": F.col("time_msc") - F.lag("time_msc").over(w)}, before=1, keep_ordinal=True)
    t = t.withColumns({"_decay_by": F.exp(-beta * F.coalesce("_gap", F.lit(0)) / HOUR), "_x": F.lit(alpha)})
    return linear_recurrence(t, ["symbol"], "_x", "_decay_by", "_z").withColumn("intensity", base + F.col("_z") - alpha).drop("_gap", "_decay_by", "_x", "_z", "_rn")


@query("st11_swings", f"""WITH {BARS_SQL}, x AS (SELECT symbol, day, high, low, max(high) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hb, max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ha, min(low) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS lb, min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS la, lead(day, 2) OVER ({W}) AS known_on, row_number() OVER ({W}) AS i FROM bars)
 SELECT symbol, day, known_on, coalesce(i > 2 AND high > hb AND high > ha, false) AS swing_high, coalesce(i > 2 AND low < lb AND low < la, false) AS swing_low FROM x WHERE known_on IS NOT NULL""")  # fmt: skip
def st11(spark: SparkSession, d: str) -> DataFrame:
    """Fractal swings of two bars each side, with the day on which they are known."""

    H, L = F.col("high"), F.col("low")

    def columns(w):
        b, a = w.rowsBetween(-2, -1), w.rowsBetween(1, 2)
        seen = F.col("_rn") >= 2
        return {
            "known_on": F.lead("day", 2).over(w), "swing_high": F.coalesce(seen & (H > F.max(H).over(b)) & (H > F.max(H).over(a)), F.lit(False)),
            "swing_low": F.coalesce(seen & (L < F.min(L).over(b)) & (L < F.min(L).over(a)), F.lit(False)),
        }

    return over_bars(spark, d, columns, 2, 2).where("known_on is not null").select("symbol", "day", "known_on", "swing_high", "swing_low")


@query("st11_fair_value_gaps", f"""WITH {BARS_SQL}, x AS (SELECT symbol, day, low, high, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2 FROM bars) SELECT symbol, day, CASE WHEN low > h2 THEN 'up' ELSE 'down' END AS side, round(CASE WHEN low > h2 THEN low - h2 ELSE l2 - high END, 4) AS size FROM x WHERE low > h2 OR high < l2""")
def st11_fvg(spark: SparkSession, d: str) -> DataFrame:
    H, L = F.col("high"), F.col("low")
    x = over_bars(spark, d, lambda w: {"h2": F.lag(H, 2).over(w), "l2": F.lag(L, 2).over(w)}, 2).where("low > h2 or high < l2")
    up = L > F.col("h2")
    return x.select("symbol", "day", F.when(up, "up").otherwise("down").alias("side"), F.round(F.when(up, L - F.col("h2")).otherwise(F.col("l2") - H), 4).alias("size"))


@query("st13_session_calendar", f"""WITH {BARS_SQL} SELECT DISTINCT day, day = last_day(day) AS month_end, day = last_day(day) AND month(day) % 3 = 0 AS quarter_end, isodow(day)::INTEGER AS weekday, ((day(day) - 1) // 7 + 1)::INTEGER AS week_of_month, isodow(day) = 5 AND day(day) <= 7 AS first_friday FROM bars""")
def st13(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("day")
    end = day == F.last_day(day)
    weekday = F.weekday(day) + 1
    return daily_bars(spark, d).select(
        "day", end.alias("month_end"), (end & (F.month(day) % 3 == 0)).alias("quarter_end"), weekday.alias("weekday"),
        (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int").alias("week_of_month"), ((weekday == 5) & (F.dayofmonth(day) <= 7)).alias("first_friday"),
    ).distinct()


@query("st14_cross_asset", f"""WITH {BARS_SQL}, a AS (SELECT day, max(CASE WHEN symbol = '1-URGENT' THEN close END) AS x, max(CASE WHEN symbol = '2-HIGH' THEN close END) AS y FROM bars GROUP BY day), j AS (SELECT day, ln(x / lag(x) OVER (ORDER BY day)) AS rx, ln(y / lag(y) OVER (ORDER BY day)) AS ry FROM a WHERE x IS NOT NULL AND y IS NOT NULL)
 SELECT day, round(CASE WHEN count(rx) OVER f >= 30 THEN corr(rx, ry) OVER f END, 5) AS corr_30, round(CASE WHEN count(rx) OVER f >= 30 THEN covar_samp(rx, ry) OVER f / var_samp(ry) OVER f END, 5) AS beta_30 FROM j WINDOW f AS (ORDER BY day ROWS 29 PRECEDING)""")  # fmt: skip
def st14(spark: SparkSession, d: str) -> DataFrame:
    j = joins.align(daily_bars(spark, d), "day", "symbol", ["close"], ["1-URGENT", "2-HIGH"]).withColumn("pair", F.lit("x"))

    def columns(w):
        f = frame(w, 30)
        x, y = F.col("rx"), F.col("ry")
        enough, cov = F.count(x).over(f) >= 30, F.covar_samp(x, y).over(f)
        return [
            {"rx": F.log(F.col("close_0") / F.lag("close_0").over(w)), "ry": F.log(F.col("close_1") / F.lag("close_1").over(w))},
            {"corr_30": F.when(enough, F.try_divide(cov, F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f))), "beta_30": F.when(enough, F.try_divide(cov, F.var_samp(y).over(f)))},
        ]

    return picked(rolling(j, ["pair"], ["day"], bar_bucket(), columns, 31), "corr_30", "beta_30", places=5, keys=("day",))


@query("p07_dataset_clean", f"""WITH {BARS_SQL}, d AS (SELECT symbol, day, CASE WHEN tick_count % 3 = 0 THEN NULL ELSE close END AS c FROM bars), f AS (SELECT symbol, day, last_value(c IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS c FROM d) SELECT * FROM f WHERE c IS NOT NULL""")
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Infinities to null, forward fill (never backward), rows that stay empty dropped."""
    C, N = F.col("close"), F.col("tick_count")
    dirty = daily_bars(spark, d).select("symbol", "day", F.when(N % 3 == 0, F.lit(float("inf"))).otherwise(C).alias("c")).withColumn("c", finite_or_null("c"))
    return fill_forward(dirty, KEYS, ORDER, bar_bucket(), ["c"]).where("c is not null")


@query("g03_coverage", f"""WITH {TICKS_SQL}, g AS (SELECT symbol, time_msc - lag(time_msc) OVER ({TW}) AS gap FROM ticks) SELECT symbol, count(*) AS n, sum(CASE WHEN gap > 5400000 THEN 1 ELSE 0 END)::BIGINT AS wide_gaps, max(gap) AS widest FROM g GROUP BY symbol""")
def g03(spark: SparkSession, d: str) -> DataFrame:
    g = over_ticks(spark, d, lambda w: {"gap": F.col("time_msc") - F.lag("time_msc").over(w)}, 1)
    return g.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gap") > 5_400_000, 1).otherwise(0)).cast("long").alias("wide_gaps"), F.max("gap").alias("widest"))


@query("a08_daily_qa", f"""WITH {TICKS_SQL} SELECT symbol, time_msc // {DAY_MS} AS day, count(*) AS n, count(DISTINCT time_msc // {HOUR}) AS hours, sum((broker = 'a')::INT)::BIGINT AS from_a, sum((time_msc // {HOUR} % 24 BETWEEN 7 AND 15)::INT)::BIGINT AS london FROM ticks GROUP BY ALL""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    by_hour = ticks(spark, d).groupBy("symbol", F.floor(F.col("time_msc") / HOUR).alias("h")).agg(F.count("*").alias("n"), n(F.col("broker") == "a").alias("a"))
    day = F.floor(F.col("h") / 24)
    return by_hour.groupBy("symbol", day.alias("day")).agg(
        F.sum("n").alias("n"), F.count("*").alias("hours"), F.sum("a").alias("from_a"), F.coalesce(F.sum(F.when((F.col("h") % 24).between(7, 15), F.col("n"))), F.lit(0)).alias("london")
    )


@query("k22_almgren_chriss", " UNION ALL ".join(f"SELECT {j} AS step, round(10000 * sinh(0.3 * {10 - j}) / sinh(3.0), 4) AS holding" for j in range(11)))
def k22(spark: SparkSession, d: str) -> DataFrame:
    """Optimal liquidation of 10,000 units in ten steps, kappa 0.3: a closed form over a sequence."""
    return spark.range(11).select(F.col("id").cast("int").alias("step"), F.round(10000 * F.sinh(0.3 * (10 - F.col("id"))) / math.sinh(3.0), 4).alias("holding"))


@query("k23_kelly", """WITH t AS (SELECT l_suppkey, l_discount - 0.05 AS p FROM lineitem), s AS (SELECT l_suppkey, avg((p > 0)::INT) AS w, avg(CASE WHEN p > 0 THEN p END) AS a, -avg(CASE WHEN p < 0 THEN p END) AS b FROM t GROUP BY 1)
 SELECT l_suppkey, round(greatest(0, least(0.25, w - (1 - w) / (a / b))), 6) AS kelly FROM s""")  # fmt: skip
def k23(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_discount") - 0.05
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg((p > 0).cast("int")).alias("w"), F.avg(F.when(p > 0, p)).alias("a"), (-F.avg(F.when(p < 0, p))).alias("b"))
    k = F.col("w") - (1 - F.col("w")) / (F.col("a") / F.col("b"))
    return s.select("l_suppkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.25), k)), 6).alias("kelly"))


@query("k31_voters", f"""WITH {BARS_SQL}, m AS (SELECT symbol, day, close, avg(close) OVER {rows(5)} AS fast, avg(close) OVER {rows(30)} AS slow, max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi, min(low) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo FROM bars)
 SELECT symbol, day, round(0.5 * sign(fast - slow) + 0.3 * sign(close - fast) + 0.2 * (coalesce(close > hi, false)::INT - coalesce(close < lo, false)::INT), 6) AS vote FROM m""")  # fmt: skip
def k31(spark: SparkSession, d: str) -> DataFrame:
    """A weighted vote of a moving-average stack, the position to it and a breakout."""

    C, H, L = F.col("close"), F.col("high"), F.col("low")

    def columns(w):
        fast, slow, p = F.avg(C).over(frame(w, 5)), F.avg(C).over(frame(w, 30)), w.rowsBetween(-20, -1)
        bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return {"vote": 0.5 * F.signum(fast - slow) + 0.3 * F.signum(C - fast) + 0.2 * (bit(C > F.max(H).over(p)) - bit(C < F.min(L).over(p)))}

    return picked(over_bars(spark, d, columns, 30), "vote")


@query("k11_atr_bands", f"""WITH {BARS_SQL}, p AS (SELECT *, CASE WHEN lag(close) OVER ({W}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr FROM bars)
 SELECT symbol, day, round(avg(close) OVER {rows(20)} + 1.5 * avg(tr) OVER {rows(20)}, 7) AS upper, round(avg(close) OVER {rows(20)} - 1.5 * avg(tr) OVER {rows(20)}, 7) AS lower FROM p""")  # fmt: skip
def k11(spark: SparkSession, d: str) -> DataFrame:
    C = F.col("close")

    def columns(w):
        m, a = F.avg(C).over(frame(w, 20)), F.avg("tr").over(frame(w, 20))
        return [{"tr": true_range(w)}, {"upper": m + 1.5 * a, "lower": m - 1.5 * a}]

    return picked(over_bars(spark, d, columns, 21), "upper", "lower", places=7)


@query("q_session_runs", f"""WITH {TICKS_SQL}, c AS (SELECT event_id, symbol, time_msc, broker, CASE WHEN broker = lag(broker) OVER (PARTITION BY symbol, time_msc // {DAY_MS} ORDER BY time_msc, event_id) THEN 0 ELSE 1 END AS n FROM ticks), r AS (SELECT *, sum(n) OVER (PARTITION BY symbol, time_msc // {DAY_MS} ORDER BY time_msc, event_id) AS k FROM c)
 SELECT symbol, time_msc // {DAY_MS} AS day, max(len) AS longest, count(*) AS runs FROM (SELECT symbol, time_msc // {DAY_MS} * {DAY_MS} AS time_msc, k, count(*) AS len FROM r GROUP BY ALL) GROUP BY ALL""")  # fmt: skip
def q_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one source inside a day: islands over a day's window."""
    w = Window.partitionBy("symbol", "day").orderBy("time_msc", "event_id")
    t = ticks(spark, d).withColumn("day", tick_bucket()).withColumn("same", F.col("broker") == F.lag("broker").over(w))
    r = t.withColumn("k", islands(~F.coalesce("same", F.lit(False)), w)).groupBy("symbol", "day", "k").agg(F.count("*").alias("len"))
    return r.groupBy("symbol", "day").agg(F.max("len").alias("longest"), F.count("*").alias("runs"))
