"""Queries: windows, features, labels, splits and indicators over bars and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkfold.functions.columns import clamp01, safe_ratio
from larkfold.operators import labels as L
from larkfold.operators import metrics
from larkfold.operators import splits as X
from larkfold.operators.clean import fill_forward
from larkfold.operators.series import ema, frame, full, islands, ordinal, rolling, running
from larkfold.plans.core import tick_bucket
from larkfold.plans.registry import query
from larkfold.sources.adapters import BARS_SQL, TICKS_SQL, daily_bars, table, ticks

KEYS, ORDER = ["symbol"], ["day"]


def bar_bucket() -> Column:
    """Years: what one task ranks of a daily series."""
    return F.year("day")


def over_bars(spark: SparkSession, d: str, columns, before: int = 0, after: int = 0, **kw) -> DataFrame:
    return rolling(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), columns, before, after, **kw)


def picked(df: DataFrame, *names: str, places: int = 6, keys: tuple[str, ...] = ("symbol", "day")) -> DataFrame:
    return df.select(*keys, *[F.round(n, places).alias(n) for n in names])


def _sql(cte: str, *cols: str, base: str = BARS_SQL, places: int = 6, source: str = "x") -> str:
    return f"WITH {base}, {cte} SELECT symbol, day, " + ", ".join(f"round({c}, {places}) AS {c}" for c in cols) + f" FROM {source}"


W = "PARTITION BY symbol ORDER BY day"


def rows(n: int) -> str:
    return f"({W} ROWS {n - 1} PRECEDING)"


def guard(expr: str, n: int, col: str = "close") -> str:
    return f"CASE WHEN count({col}) OVER {rows(n)} >= {n} THEN {expr} OVER {rows(n)} END"


@query("w01_lags", _sql(f"x AS (SELECT symbol, day, lag(close) OVER ({W}) AS lag1, lead(close) OVER ({W}) AS lead1, close - lag(close) OVER ({W}) AS diff, close / lag(close, 3) OVER ({W}) - 1 AS ret_3 FROM bars)", "lag1", "lead1", "diff", "ret_3"))
def w01(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return picked(
        over_bars(spark, d, lambda w: {"lag1": F.lag(c).over(w), "lead1": F.lead(c).over(w), "diff": c - F.lag(c).over(w), "ret_3": c / F.lag(c, 3).over(w) - 1}, 3, 1),
        "lag1", "lead1", "diff", "ret_3",
    )


@query("w02_rolling_20", _sql(f"x AS (SELECT symbol, day, {guard('avg(close)', 20)} AS mean_20, {guard('stddev_samp(close)', 20)} AS std_20, {guard('quantile_cont(close, 0.5)', 20)} AS median_20, {guard('sum(tick_count)', 20)}::DOUBLE AS ticks_20 FROM bars)", "mean_20", "std_20", "median_20", "ticks_20", places=4))
def w02(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return picked(
        over_bars(spark, d, lambda w: {"mean_20": full(F.avg, c, w, 20), "std_20": full(F.stddev_samp, c, w, 20), "median_20": full(lambda x: F.percentile(x, F.lit(0.5)), c, w, 20), "ticks_20": full(F.sum, F.col("tick_count"), w, 20).cast("double")}, 20),
        "mean_20", "std_20", "median_20", "ticks_20", places=4,
    )


@query("w04_liquidity_sweep", f"""WITH {BARS_SQL}, x AS (SELECT symbol, day, high, low, close, max(high) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hi, min(low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lo FROM bars)
 SELECT symbol, day, CASE WHEN high > hi AND close < hi THEN 1 ELSE 0 END AS sweep_high, CASE WHEN low < lo AND close > lo THEN 1 ELSE 0 END AS sweep_low FROM x""")  # fmt: skip
def w04(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        p = w.rowsBetween(-10, -1)
        return [
            {"hi": F.max("high").over(p), "lo": F.min("low").over(p)},
            {"sweep_high": F.when((F.col("high") > F.col("hi")) & (F.col("close") < F.col("hi")), 1).otherwise(0), "sweep_low": F.when((F.col("low") < F.col("lo")) & (F.col("close") > F.col("lo")), 1).otherwise(0)},
        ]

    return over_bars(spark, d, columns, 10).select("symbol", "day", "sweep_high", "sweep_low")


@query("w05_rolling_beta", _sql(f"""r AS (SELECT symbol, day, ln(close / lag(close) OVER ({W})) AS r, ln(open / lag(open) OVER ({W})) AS q FROM bars),
 x AS (SELECT symbol, day, CASE WHEN count(r) OVER {rows(20)} >= 10 THEN covar_samp(r, q) OVER {rows(20)} / var_samp(q) OVER {rows(20)} END AS beta,
 CASE WHEN count(r) OVER {rows(20)} >= 10 THEN corr(r, q) OVER {rows(20)} END AS corr FROM r)""", "beta", "corr", places=5))  # fmt: skip
def w05(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f = frame(w, 20)
        r, q = F.col("r"), F.col("q")
        enough = F.count(r).over(f) >= 10
        cov = F.covar_samp(r, q).over(f)
        return [
            {"r": F.log(F.col("close") / F.lag("close").over(w)), "q": F.log(F.col("open") / F.lag("open").over(w))},
            {"beta": F.when(enough, F.try_divide(cov, F.var_samp(q).over(f))), "corr": F.when(enough, F.try_divide(cov, F.stddev_samp(r).over(f) * F.stddev_samp(q).over(f)))},
        ]

    return picked(over_bars(spark, d, columns, 21), "beta", "corr", places=5)


@query("w06_slope_autocorrelation", _sql(f"""r AS (SELECT symbol, day, close, row_number() OVER ({W}) AS i, lag(close) OVER ({W}) AS p FROM bars),
 x AS (SELECT symbol, day, CASE WHEN i >= 20 THEN regr_slope(close, i) OVER {rows(20)} END AS slope_20, CASE WHEN i > 20 THEN corr(close, p) OVER {rows(20)} END AS autocorr_20 FROM r)""", "slope_20", "autocorr_20", places=4))  # fmt: skip
def w06(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f = frame(w, 20)
        c, p = F.col("close"), F.col("p")
        i = F.col("_rn") + 1
        ac = F.try_divide(F.covar_samp(c, p).over(f), F.stddev_samp(F.when(p.isNotNull(), c)).over(f) * F.stddev_samp(p).over(f))
        return [{"p": F.lag(c).over(w)}, {"slope_20": F.when(i >= 20, F.regr_slope(c, i).over(f)), "autocorr_20": F.when(i > 20, ac)}]

    return picked(over_bars(spark, d, columns, 21), "slope_20", "autocorr_20", places=4)


@query("w07_moments", _sql(f"""r AS (SELECT symbol, day, close / lag(close) OVER ({W}) - 1 AS r FROM bars),
 m AS (SELECT symbol, day, count(r) OVER {rows(20)} AS n, avg(r) OVER {rows(20)} AS m1, avg(r * r) OVER {rows(20)} AS m2, avg(r * r * r) OVER {rows(20)} AS m3 FROM r),
 x AS (SELECT symbol, day, CASE WHEN n >= 20 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (pow(greatest(m2 - m1 * m1, 0), 1.5) + 1e-9) END AS skew_20 FROM m)""", "skew_20", places=4))  # fmt: skip
def w07(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f = frame(w, 20)
        r, m1, m2, m3 = (F.col(c) for c in ("r", "m1", "m2", "m3"))
        return [
            {"r": F.col("close") / F.lag("close").over(w) - 1},
            {"n": F.count(r).over(f), "m1": F.avg(r).over(f), "m2": F.avg(r * r).over(f), "m3": F.avg(r * r * r).over(f)},
            {"skew_20": F.when(F.col("n") >= 20, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (F.pow(F.greatest(m2 - m1 * m1, F.lit(0.0)), 1.5) + 1e-9))},
        ]

    return picked(over_bars(spark, d, columns, 21), "skew_20", places=4)


@query("w09_seasonal_expanding", f"""WITH {TICKS_SQL} SELECT event_id, round(avg(bid) OVER w, 9) AS hour_mean, count(*) OVER w AS hour_n FROM ticks
 WINDOW w AS (PARTITION BY symbol, time_msc // 3600000 % 24 ORDER BY time_msc, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def w09(spark: SparkSession, d: str) -> DataFrame:
    """Mean of all earlier ticks of the same hour of day: running sums by (symbol, hour), less the row itself."""
    t = ticks(spark, d).withColumn("hour", F.floor(F.col("time_msc") / 3_600_000) % 24)
    s = running(t, ["symbol", "hour"], ["time_msc", "event_id"], tick_bucket(), {"s": F.col("bid"), "n": F.lit(1).cast("long")})
    n = F.col("n") - 1
    return s.select("event_id", F.round(F.when(n > 0, (F.col("s") - F.col("bid")) / n), 9).alias("hour_mean"), n.alias("hour_n"))


@query("w11_fraction_above", _sql(f"""c AS (SELECT symbol, day, close, list(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l FROM bars),
 x AS (SELECT symbol, day, CASE WHEN len(l) = 20 THEN len(list_filter(l, lambda v: v > close)) / 20 END AS above_20 FROM c)""", "above_20"))  # fmt: skip
def w11(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        past = F.collect_list("close").over(w.rowsBetween(-20, -1))
        return [{"past": past}, {"above_20": F.when(F.size("past") == 20, F.size(F.filter("past", lambda v: v > F.col("close"))) / 20)}]

    return picked(over_bars(spark, d, columns, 20), "above_20")


@query("w15_fibonacci_distance", _sql(f"""r AS (SELECT symbol, day, close, max(high) OVER {rows(50)} AS hi, min(low) OVER {rows(50)} AS lo, count(*) OVER {rows(50)} AS n FROM bars),
 x AS (SELECT symbol, day, CASE WHEN n >= 50 AND hi > lo THEN least({", ".join(f"abs(close - (hi - {q} * (hi - lo)))" for q in (0.236, 0.382, 0.5, 0.618, 0.786))}) / (hi - lo) END AS fib_distance FROM r)""", "fib_distance"))  # fmt: skip
def w15(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        hi, lo = F.col("hi"), F.col("lo")
        near = F.least(*[F.abs(F.col("close") - (hi - q * (hi - lo))) for q in (0.236, 0.382, 0.5, 0.618, 0.786)])
        return [{"hi": full(F.max, F.col("high"), w, 50), "lo": full(F.min, F.col("low"), w, 50)}, {"fib_distance": F.when(hi > lo, near / (hi - lo))}]

    return picked(over_bars(spark, d, columns, 50), "fib_distance")


@query("w17_streaks", f"""WITH {BARS_SQL}, c AS (SELECT symbol, day, sign(close - lag(close) OVER ({W})) AS s FROM bars), r AS (SELECT *, sum(CASE WHEN s = lag(s) OVER ({W}) THEN 0 ELSE 1 END) OVER ({W}) AS run FROM (SELECT *, lag(s) OVER ({W}) AS p FROM c)),
 q AS (SELECT symbol, day, s, row_number() OVER (PARTITION BY symbol, run ORDER BY day) AS k FROM r) SELECT symbol, day, CAST(coalesce(s, 0) * k AS BIGINT) AS streak FROM q""".replace("sum(CASE WHEN s = lag(s) OVER (PARTITION BY symbol ORDER BY day) THEN 0 ELSE 1 END)", "sum(CASE WHEN s = p THEN 0 ELSE 1 END)"))  # fmt: skip
def w17(spark: SparkSession, d: str) -> DataFrame:
    """Signed length of the run of rises or falls: the distance from the last row that starts a run, however far back."""
    s = F.col("s")

    def columns(w):
        return [{"s": F.signum(F.col("close") - F.lag("close").over(w))}, {"start": F.when(~F.coalesce(s == F.lag(s).over(w), F.lit(False)), F.col("_rn"))}]

    runs = fill_forward(over_bars(spark, d, columns, 2, keep_ordinal=True), KEYS, ORDER, bar_bucket(), ["start"])
    return runs.select("symbol", "day", (F.coalesce(s, F.lit(0)) * (F.col("_rn") - F.col("start") + 1)).cast("long").alias("streak"))


@query("w18_bars_since_event", f"""WITH {BARS_SQL}, c AS (SELECT symbol, day, row_number() OVER ({W}) AS i, tick_count >= 3 AS ev FROM bars)
 SELECT symbol, day, i - max(CASE WHEN ev THEN i END) OVER ({W}) AS bars_since FROM c""")  # fmt: skip
def w18(spark: SparkSession, d: str) -> DataFrame:
    r = ordinal(daily_bars(spark, d), KEYS, ORDER, bar_bucket()).withColumn("at", F.when(F.col("tick_count") >= 3, F.col("_rn")))
    return fill_forward(r, KEYS, ORDER, bar_bucket(), ["at"]).select("symbol", "day", (F.col("_rn") - F.col("at")).alias("bars_since"))


@query("w21_sign_entropy", _sql(f"""c AS (SELECT symbol, day, sign(close - lag(close) OVER ({W})) AS s FROM bars), n AS (SELECT symbol, day, count(s) OVER {rows(30)} AS n, {", ".join(f"count(CASE WHEN s = {v} THEN 1 END) OVER {rows(30)} AS n{i}" for i, v in enumerate((-1, 0, 1)))} FROM c),
 x AS (SELECT symbol, day, CASE WHEN n >= 30 THEN {" + ".join(f"CASE WHEN n{i} > 0 THEN -n{i} / n * log2(n{i} / n) ELSE 0 END" for i in range(3))} END AS entropy_30 FROM n)""", "entropy_30"))  # fmt: skip
def w21(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        f = frame(w, 30)
        s, n = F.col("s"), F.col("n")
        part = lambda k: F.when(F.col(k) > 0, -F.col(k) / n * F.log2(F.col(k) / n)).otherwise(0.0)
        return [
            {"s": F.signum(F.col("close") - F.lag("close").over(w))},
            {"n": F.count(s).over(f), **{f"n{i}": F.count(F.when(s == v, 1)).over(f) for i, v in enumerate((-1, 0, 1))}},
            {"entropy_30": F.when(n >= 30, part("n0") + part("n1") + part("n2"))},
        ]

    return picked(over_bars(spark, d, columns, 31), "entropy_30")


@query("w23_ema_20", f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT symbol, day, close, row_number() OVER ({W}) AS i FROM bars),
 e AS (SELECT symbol, day, i, close AS y FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.day, r.i, e.y + 2.0::DOUBLE / 21 * (r.close - e.y) FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1)
 SELECT symbol, day, round(y, 4) AS ema_20 FROM e""")  # fmt: skip
def w23(spark: SparkSession, d: str) -> DataFrame:
    """The recursive average, scanned by blocks."""
    r = ordinal(daily_bars(spark, d), KEYS, ORDER, bar_bucket())
    return picked(ema(r, KEYS, "close", 2 / 21, "ema_20", block=500), "ema_20", places=4)


@query("w28_drawdown", _sql(f"x AS (SELECT symbol, day, max(close) OVER ({W}) AS peak, close / max(close) OVER ({W}) - 1 AS drawdown FROM bars)", "peak", "drawdown"))
def w28(spark: SparkSession, d: str) -> DataFrame:
    return picked(metrics.drawdowns(daily_bars(spark, d), KEYS, ORDER, "close", bar_bucket()), "peak", "drawdown")


@query("w29_zscore", _sql(f"x AS (SELECT symbol, day, CASE WHEN count(*) OVER {rows(60)} >= 60 AND stddev_samp(close) OVER {rows(60)} > 1e-12 THEN (close - avg(close) OVER {rows(60)}) / stddev_samp(close) OVER {rows(60)} END AS z_60 FROM bars)", "z_60", places=5))
def w29(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return picked(over_bars(spark, d, lambda w: {"z_60": safe_ratio(c - full(F.avg, c, w, 60), full(F.stddev_samp, c, w, 60))}, 60), "z_60", places=5)


@query("f08_multiscale", _sql(f"""r AS (SELECT symbol, day, close, ln(close / lag(close) OVER ({W})) AS r FROM bars),
 m AS (SELECT symbol, day, {", ".join(f"sum(r) OVER {rows(k)} AS s{k}, stddev_samp(r) OVER {rows(k)} AS v{k}, count(r) OVER {rows(k)} AS n{k}" for k in (5, 15, 60))} FROM r),
 x AS (SELECT symbol, day, CASE WHEN n60 >= 60 THEN (sign(s5) + sign(s15) + sign(s60)) / 3 END AS alignment, CASE WHEN n60 >= 60 AND v60 > 1e-12 THEN v5 / v60 END AS vol_ratio FROM m)""", "alignment", "vol_ratio", places=5))  # fmt: skip
def f08(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        r = F.col("r")
        wide = {f"{k}{n}": f(r).over(frame(w, n)) for n in (5, 15, 60) for k, f in (("s", F.sum), ("v", F.stddev_samp), ("n", F.count))}
        enough = F.col("n60") >= 60
        return [
            {"r": F.log(F.col("close") / F.lag("close").over(w))},
            wide,
            {"alignment": F.when(enough, (F.signum("s5") + F.signum("s15") + F.signum("s60")) / 3), "vol_ratio": F.when(enough, safe_ratio("v5", "v60"))},
        ]

    return picked(over_bars(spark, d, columns, 61), "alignment", "vol_ratio", places=5)


@query("f10_scalping_features", _sql(f"""p AS (SELECT *, lag(close) OVER ({W}) AS pc FROM bars), t AS (SELECT symbol, day, close, pc, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p),
 x AS (SELECT symbol, day, close / pc - 1 AS ret_1, tr AS true_range, {guard("avg(tr)", 14, "tr")} AS atr_14 FROM t)""", "ret_1", "true_range", "atr_14"))  # fmt: skip
def f10(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        h, lo, pc = F.col("high"), F.col("low"), F.col("pc")
        return [
            {"pc": F.lag("close").over(w)},
            {"ret_1": F.col("close") / pc - 1, "true_range": F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc))},
            {"atr_14": full(F.avg, F.col("true_range"), w, 14)},
        ]

    return picked(over_bars(spark, d, columns, 15), "ret_1", "true_range", "atr_14")


@query("f14_candles", f"""WITH {BARS_SQL}, p AS (SELECT *, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl, lag(open) OVER ({W}) AS po, lag(close) OVER ({W}) AS pc FROM bars)
 SELECT symbol, day, coalesce((high <= ph AND low >= pl)::INT, 0) AS inside, coalesce((high > ph AND low < pl)::INT, 0) AS outside, (high > low AND abs(close - open) < 0.1 * (high - low))::INT AS doji,
 coalesce((pc < po AND close > open AND open <= pc AND close >= po)::INT, 0) AS engulf_up FROM p""")  # fmt: skip
def f14(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
        po, ph, pl, pc = (F.lag(x).over(w) for x in ("open", "high", "low", "close"))
        bit = lambda x: F.coalesce(x.cast("int"), F.lit(0))
        return {
            "inside": bit((h <= ph) & (lo >= pl)), "outside": bit((h > ph) & (lo < pl)), "doji": bit((h > lo) & (F.abs(c - o) < 0.1 * (h - lo))),
            "engulf_up": bit((pc < po) & (c > o) & (o <= pc) & (c >= po)),
        }

    return over_bars(spark, d, columns, 1).select("symbol", "day", "inside", "outside", "doji", "engulf_up")


@query("l01_future_return", f"WITH {BARS_SQL} SELECT symbol, day, round(lead(close, 5) OVER ({W}) / close - 1, 6) AS fwd_ret_5, CAST(sign(lead(close, 5) OVER ({W}) / close - 1) AS INTEGER) AS direction_5 FROM bars")
def l01(spark: SparkSession, d: str) -> DataFrame:
    out = over_bars(spark, d, lambda w: [{"fwd_ret_5": L.future_return("close", 5, w)}, {"direction_5": L.direction("fwd_ret_5")}], 0, 5)
    return out.select("symbol", "day", F.round("fwd_ret_5", 6).alias("fwd_ret_5"), "direction_5")


@query("l03_triple_barrier", f"""WITH {BARS_SQL}, f AS (SELECT symbol, day, close, {", ".join(f"lead(high, {k}) OVER ({W}) AS h{k}, lead(low, {k}) OVER ({W}) AS l{k}" for k in range(1, 6))} FROM bars)
 SELECT symbol, day, CASE WHEN h5 IS NULL THEN NULL {" ".join(f"WHEN h{k} >= close * 1.3 THEN 1 WHEN l{k} <= close * 0.7 THEN -1" for k in range(1, 6))} ELSE 0 END AS label,
 CASE WHEN h5 IS NULL THEN NULL {" ".join(f"WHEN h{k} >= close * 1.3 OR l{k} <= close * 0.7 THEN {k}" for k in range(1, 6))} ELSE 5 END AS bars_held FROM f""")  # fmt: skip
def l03(spark: SparkSession, d: str) -> DataFrame:
    out = over_bars(spark, d, lambda w: [{"_f": L.triple_barrier("close", "high", "low", 5, 0.3, 0.3, w)}, {"label": F.col("_f.label"), "bars_held": F.col("_f.held")}], 0, 5)
    return out.select("symbol", "day", "label", "bars_held")


@query("a12_label_diagnostics", f"""WITH {BARS_SQL}, f AS (SELECT {", ".join(f"sign(lead(close, {h}) OVER ({W}) / close - 1) AS d{h}" for h in (1, 5, 20))} FROM bars), u AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, d{h} AS s FROM f" for h in (1, 5, 20))})
 SELECT horizon, count(s) AS n, round(avg((s > 0)::INT), 6) AS up_share, round(greatest(avg((s > 0)::INT), avg((s < 0)::INT)), 6) AS dominant FROM u WHERE s IS NOT NULL GROUP BY horizon""")  # fmt: skip
def a12(spark: SparkSession, d: str) -> DataFrame:
    out = over_bars(spark, d, lambda w: {f"d{h}": F.signum(L.future_return("close", h, w)) for h in (1, 5, 20)}, 0, 20)
    u = out.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"d{h}").alias("s")) for h in (1, 5, 20)])).alias("x")).select("x.*").where("s is not null")
    up, down = F.avg((F.col("s") > 0).cast("int")), F.avg((F.col("s") < 0).cast("int"))
    return u.groupBy("horizon").agg(F.count("s").alias("n"), F.round(up, 6).alias("up_share"), F.round(F.greatest(up, down), 6).alias("dominant"))


@query("n01_robust_scaler", """WITH s AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(least(greatest((l_extendedprice - m) / iqr, -1.5), 1.5), 6) AS scaled FROM lineitem, s""")  # fmt: skip
def n01(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    out = X.robust_scale(li, ["l_extendedprice"], clip=1.5)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round("l_extendedprice_scaled", 6).alias("scaled"))


@query("x01_temporal_holdout", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
 SELECT symbol, split, count(*) AS rows, min(day) AS first, max(day) AS last FROM (SELECT *, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + 10 THEN 'embargo' WHEN i < floor(n * 0.85) THEN 'valid' WHEN i < floor(n * 0.85) + 10 THEN 'embargo' ELSE 'test' END AS split FROM r) GROUP BY ALL""")  # fmt: skip
def x01(spark: SparkSession, d: str) -> DataFrame:
    s = X.holdout(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), 0.7, 0.15, embargo=10)
    return s.groupBy("symbol", "split").agg(F.count("*").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("x02_walk_forward", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 f AS (SELECT *, k, floor(n * 0.6) + k * floor(n * (1 - 0.6) / 5) AS a, floor(n * (1 - 0.6) / 5) AS step, greatest(floor(n * 0.02), 10) AS gap FROM r, range(0, 5) t(k))
 SELECT symbol, k::INTEGER AS fold, CASE WHEN i < a - gap THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(day) AS first, max(day) AS last FROM f WHERE a - gap >= 1 AND (i < a - gap OR (i >= a AND i < a + step)) GROUP BY ALL""")  # fmt: skip
def x02(spark: SparkSession, d: str) -> DataFrame:
    s = X.walk_forward(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), folds=5, train=0.6, gap=0.02, embargo=10)
    return s.groupBy("symbol", "fold", "part").agg(F.count("*").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("e15_cusum", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, row_number() OVER ({W}) AS i, close / 100000 - 1.5 AS v FROM bars), c AS (SELECT *, sum(v) OVER ({W}) AS s FROM r)
 SELECT symbol, day, round(s - least(0, min(s) OVER ({W})), 8) AS cusum FROM c""")  # fmt: skip
def e15(spark: SparkSession, d: str) -> DataFrame:
    """Reflected sum S = max(0, S + x) as running sum less its running minimum, both in two steps."""
    r = running(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), {"s": F.col("close") / 100000 - 1.5})
    low = metrics.drawdowns(r.withColumn("neg", -F.col("s")), KEYS, ORDER, "neg", bar_bucket())
    return low.select("symbol", "day", F.round(F.col("s") - F.least(F.lit(0.0), -F.col("peak")), 8).alias("cusum"))


@query("e11_tail_events", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, close / lag(close) OVER ({W}) - 1 AS r, tick_count FROM bars),
 z AS (SELECT *, count(r) OVER p AS n, avg(r) OVER p AS m, stddev_pop(r) OVER p AS s, avg(tick_count) OVER p AS vm, stddev_pop(tick_count) OVER p AS vs FROM r WINDOW p AS ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
 SELECT symbol, day, CASE WHEN n >= 30 AND s > 0 AND abs(r - m) / s > 2 THEN 'return' WHEN n >= 30 AND vs > 0 AND (tick_count - vm) / vs > 2 THEN 'volume' ELSE 'none' END AS tail FROM z""")  # fmt: skip
def e11(spark: SparkSession, d: str) -> DataFrame:
    def columns(w):
        p = w.rowsBetween(-50, -1)
        r, v = F.col("r"), F.col("tick_count")
        z = lambda x: F.try_divide(x - F.avg(x).over(p), F.stddev_pop(x).over(p))
        return [
            {"r": F.col("close") / F.lag("close").over(w) - 1},
            {"n": F.count(r).over(p), "zr": F.abs(z(r)), "zv": z(v)},
            {"tail": F.when((F.col("n") >= 30) & (F.col("zr") > 2), "return").when((F.col("n") >= 30) & (F.col("zv") > 2), "volume").otherwise("none")},
        ]

    return over_bars(spark, d, columns, 51).select("symbol", "day", "tail")


@query("a21_return_metrics", f"""WITH {BARS_SQL}, r AS (SELECT symbol, close / lag(close) OVER ({W}) - 1 AS r FROM bars)
 SELECT symbol, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe, round(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(252), 5) AS sortino,
 round(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / -sum(CASE WHEN r < 0 THEN r ELSE 0 END), 5) AS omega, round(quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)), 5) AS tail_ratio FROM r WHERE r IS NOT NULL GROUP BY symbol""")  # fmt: skip
def a21(spark: SparkSession, d: str) -> DataFrame:
    r = over_bars(spark, d, lambda w: {"r": F.col("close") / F.lag("close").over(w) - 1}, 1)
    m = metrics.return_metrics(r, ["symbol"], "r")
    return m.select("symbol", "n", *[F.round(c, 5).alias(c) for c in ("sharpe", "sortino", "omega", "tail_ratio")])


@query("k27_conformal_quantile", """WITH s AS (SELECT event_type AS symbol, abs(value - 100) AS s, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 100)) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT symbol, n, s AS q_hat FROM s WHERE i = least(ceil((n + 1) * 0.9), n)""")  # fmt: skip
def k27(spark: SparkSession, d: str) -> DataFrame:
    s = ticks(spark, d).select("symbol", F.abs(F.col("bid") - 100).alias("s"))
    return metrics.conformal_quantile(s, ["symbol"], "s", F.floor(F.col("s") / 10), 0.1)


@query("q_participation", """SELECT user_id, event_type, round(greatest(0, least(1, (CASE WHEN count(*) = 1 THEN 0.15 WHEN count(*) = 2 THEN 0.55 ELSE 1 END - 0.35 * avg((value > 100)::INT)) * greatest(0, least(1, avg(value) / 100)))), 6) AS participation FROM events GROUP BY ALL""")
def q_participation(spark: SparkSession, d: str) -> DataFrame:
    """State-layer participation score as a row expression over group statistics. Values have two decimals, so scores tie
    between two sixth digits; they are rounded as scaled doubles, not by their shortest decimal as ``F.round`` does."""
    n = F.count("*")
    base = F.when(n == 1, 0.15).when(n == 2, 0.55).otherwise(1.0)
    score = clamp01((base - 0.35 * F.avg((F.col("value") > 100).cast("int"))) * clamp01(F.avg("value") / 100))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg((F.floor(score * 1e6 + 0.5) / 1e6).alias("participation"))

