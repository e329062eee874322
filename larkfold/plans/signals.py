"""Queries: barriers with excursions, directional index and regimes, channels, flow imbalance, votes over time frames, cross-asset features, the cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkfold.operators import bars as B
from larkfold.operators import clean
from larkfold.operators import technicals as T
from larkfold.operators.clean import fill_forward
from larkfold.operators.indicators import true_range
from larkfold.operators.joins import asof
from larkfold.operators.series import ema, frame, full, linear_recurrences, rolling
from larkfold.plans.core import HOUR, HOURLY_SQL, hourly, tick_bucket
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, guard, over_bars, picked, rows
from larkfold.sources.adapters import BARS_SQL, DAY_MS, TICKS_SQL, daily_bars, table, ticks

RET = f"close / lag(close) OVER ({W}) - 1"

# labels

_AHEAD = ", ".join(f"lead(high, {k}) OVER ({W}) AS h{k}, lead(low, {k}) OVER ({W}) AS l{k}" for k in range(1, 6))
_HIT = "CASE " + " ".join(f"WHEN h{k} >= close * (1 + b) OR l{k} <= close * (1 - b) THEN {k}" for k in range(1, 6)) + " ELSE 5 END"


@query("l03_triple_barrier_excursions", f"""WITH {BARS_SQL}, r AS (SELECT *, {RET} AS r FROM bars), v AS (SELECT *, CASE WHEN count(r) OVER {rows(10)} >= 5 THEN stddev_samp(r) OVER {rows(10)} END AS vol, {_AHEAD} FROM r),
 f AS (SELECT *, greatest(coalesce(0.2 * vol * sqrt(5), 0), 0.005) AS b FROM v), k AS (SELECT *, {_HIT} AS k FROM f)
 SELECT symbol, day, CASE WHEN h5 IS NULL THEN NULL {" ".join(f"WHEN k = {k} AND h{k} >= close * (1 + b) THEN 1 WHEN k = {k} AND l{k} <= close * (1 - b) THEN -1" for k in range(1, 6))} ELSE 0 END AS label,
 CASE WHEN h5 IS NOT NULL THEN round((close - list_min(list_slice([close, l1, l2, l3, l4, l5], 1, k + 1))) / close, 8) END AS mae, CASE WHEN h5 IS NOT NULL THEN round((list_max(list_slice([close, h1, h2, h3, h4, h5], 1, k + 1)) - close) / close, 8) END AS mfe FROM k""")  # fmt: skip
def l03(spark: SparkSession, d: str) -> DataFrame:
    """Barriers scaled by volatility (0.2 deviations of ten returns times the root of the horizon, 50 basis points at least), with excursions."""

    def columns(w):
        wide = F.greatest(F.coalesce(0.2 * full(F.stddev_samp, F.col("r"), w, 10, least=5) * 5**0.5, F.lit(0.0)), F.lit(0.005))
        return [{"r": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1}, {"b": wide}, {"x": T.barrier_with_excursions("close", "high", "low", 5, F.col("b"), F.col("b"), w)}]

    out = over_bars(spark, d, columns, 11, 5)
    return out.select("symbol", "day", "x.label", F.round("x.mae", 8).alias("mae"), F.round("x.mfe", 8).alias("mfe"))


_TR0 = f"greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), abs(high - close)), coalesce(abs(low - lag(close) OVER ({W})), abs(low - close)))"


@query("l05_bar_close_labels", f"""WITH {BARS_SQL}, t AS (SELECT *, {_TR0} AS tr, {", ".join(f"lead(close, {k}) OVER ({W}) AS c{k}" for k in range(1, 6))} FROM bars),
 a AS (SELECT *, greatest(coalesce(CASE WHEN count(*) OVER {rows(14)} >= 14 THEN avg(tr) OVER {rows(14)} END, 0), 1e-10) AS atr FROM t)
 SELECT symbol, day, CASE WHEN c5 IS NULL THEN 1 {" ".join(f"WHEN c{k} >= close + 0.5 * atr THEN 2 WHEN c{k} <= close - 0.4 * atr THEN 0" for k in range(1, 6))} ELSE 1 END AS label FROM a""")  # fmt: skip
def l05(spark: SparkSession, d: str) -> DataFrame:
    """2, 0 or 1 by the close that first passes a barrier of mean true ranges; bars without a horizon ahead are 1."""

    def columns(w):
        p = F.coalesce(F.lag("close").over(w), F.col("close"))
        ahead = F.collect_list("close").over(w.rowsBetween(1, 5))
        hit = F.transform(ahead, lambda c: F.when(c >= F.col("close") + 0.5 * F.col("atr"), 2).when(c <= F.col("close") - 0.4 * F.col("atr"), 0))
        return [
            {"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))},
            {"atr": F.greatest(F.coalesce(full(F.avg, F.col("tr"), w, 14), F.lit(0.0)), F.lit(1e-10))},
            {"label": F.when(F.size(ahead) == 5, F.coalesce(F.get(F.array_compact(hit), F.lit(0)), F.lit(1))).otherwise(1)},
        ]

    return over_bars(spark, d, columns, 15, 5).select("symbol", "day", "label")


# directional index, channels, regimes

_DM = f"""m AS (SELECT *, row_number() OVER ({W}) - 1 AS i, high - lag(high) OVER ({W}) AS u, lag(low) OVER ({W}) - low AS dn, CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN {_TR0} ELSE 0 END AS tr FROM bars),
 p AS (SELECT *, CASE WHEN u > dn AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0 END AS down FROM m),
 s AS (SELECT symbol, day, i, tr AS st, up AS su, down AS sd FROM p WHERE i = 0
  UNION ALL SELECT p.symbol, p.day, p.i, st * f + tr, su * f + up, sd * f + down FROM (SELECT *, CASE WHEN i + 1 <= 14 THEN 1.0 ELSE 1 - 1.0::DOUBLE / 14 END AS f FROM s) s JOIN p ON p.symbol = s.symbol AND p.i = s.i + 1),
 x AS (SELECT symbol, day, i, CASE WHEN st > 0 AND su + sd > 0 THEN 100 * abs(su - sd) / (su + sd) ELSE 0 END AS dx FROM s),
 g AS (SELECT symbol, i, dx / 14 AS acc FROM x WHERE i = 15 UNION ALL SELECT x.symbol, x.i, CASE WHEN x.i - 15 < 14 THEN acc + dx / 14 ELSE acc * (1 - 1.0::DOUBLE / 14) + dx / 14 END FROM g JOIN x ON x.symbol = g.symbol AND x.i = g.i + 1),
 adx AS (SELECT x.symbol, x.day, x.i, CASE WHEN x.i < 27 THEN 0 WHEN x.i - 15 < 14 THEN acc * 14 / (x.i - 14) ELSE acc END AS adx FROM x LEFT JOIN g ON x.symbol = g.symbol AND x.i = g.i)"""


@query("k06_adx", f"WITH RECURSIVE {BARS_SQL}, {_DM} SELECT symbol, day, round(adx, 5) AS adx FROM adx")
def k06(spark: SparkSession, d: str) -> DataFrame:
    return picked(T.directional_index(daily_bars(spark, d), KEYS, ORDER, bar_bucket()), "adx", places=5)


@query("e14_regimes", f"""WITH RECURSIVE {BARS_SQL}, {_DM}, a AS (SELECT symbol, day, i, avg(tr) OVER {rows(14)} AS atr FROM m),
 q AS (SELECT *, avg((o.atr < a.atr)::INT) AS share FROM a JOIN a o USING (symbol) WHERE false GROUP BY ALL),
 n AS (SELECT a.symbol, a.day, avg((o.atr < a.atr)::INT) AS share FROM a JOIN a o ON o.symbol = a.symbol AND o.i BETWEEN a.i - 100 AND a.i - 15 GROUP BY a.symbol, a.day)
 SELECT b.symbol, b.day, CASE WHEN x.i < 27 THEN 'unknown' WHEN coalesce(share, 0.5) > 0.95 THEN 'crisis' WHEN coalesce(share, 0.5) > 0.8 THEN 'volatile' WHEN adx > 25 AND close > lag(close, 19) OVER (PARTITION BY b.symbol ORDER BY b.day) THEN 'trend_up' WHEN adx > 25 THEN 'trend_down' ELSE 'range' END AS regime
 FROM bars b JOIN adx x ON x.symbol = b.symbol AND x.day = b.day LEFT JOIN n ON n.symbol = b.symbol AND n.day = b.day""".replace(" q AS (SELECT *, avg((o.atr < a.atr)::INT) AS share FROM a JOIN a o USING (symbol) WHERE false GROUP BY ALL),\n", ""))  # fmt: skip
def e14(spark: SparkSession, d: str) -> DataFrame:
    """Crisis and volatile by the rank of the mean true range among those 15 to 100 bars back, else trends by the directional index and the 20-bar change."""
    b = T.directional_index(daily_bars(spark, d), KEYS, ORDER, bar_bucket())

    def columns(w):
        past = F.collect_list("atr").over(w.rowsBetween(-100, -15))
        return [
            {"tr": F.when(F.lag("close").over(w).isNotNull(), true_range(w)).otherwise(0.0), "back": F.lag("close", 19).over(w)},
            {"atr": F.avg("tr").over(frame(w, 14))},
            {"share": F.coalesce(F.try_divide(F.size(F.filter(past, lambda a: a < F.col("atr"))), F.size(past)), F.lit(0.5))},
        ]

    out = rolling(b, KEYS, ORDER, bar_bucket(), columns, 115, keep_ordinal=True)
    regime = (
        F.when(F.col("_rn") < 27, "unknown").when(F.col("share") > 0.95, "crisis").when(F.col("share") > 0.8, "volatile")
        .when((F.col("adx") > 25) & (F.col("close") > F.col("back")), "trend_up").when(F.col("adx") > 25, "trend_down").otherwise("range")
    )
    return out.select("symbol", "day", regime.alias("regime"))


_RAW = "greatest(-0.999, least(0.999, 2 * ({} - lo) / (hi - lo) - 1))"


@query("k09_keltner_fisher", f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT *, row_number() OVER ({W}) AS i, {_TR0} AS tr, (high + low) / 2 AS med FROM bars),
 e AS (SELECT symbol, i, close AS y FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.i, e.y + 2.0::DOUBLE / 21 * (r.close - e.y) FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1),
 f AS (SELECT *, avg(tr) OVER {rows(14)} AS atr, max(med) OVER {rows(9)} AS hi, min(med) OVER {rows(9)} AS lo, lag(med) OVER ({W}) AS pm FROM r)
 SELECT f.symbol, f.day, round(y + 1.5 * atr, 3) AS kc_upper, round(y - 1.5 * atr, 3) AS kc_lower, round(CASE WHEN atr > 0 THEN (close - y + 1.5 * atr) / (3 * atr) ELSE 0.5 END, 5) AS kc_percentile,
 round(CASE WHEN f.i >= 9 AND hi > lo THEN 0.5 * ln((1 + {_RAW.format("med")}) / (1 - {_RAW.format("med")})) ELSE 0 END, 5) AS fisher, round(CASE WHEN f.i >= 9 AND hi > lo THEN 0.5 * ln((1 + {_RAW.format("pm")}) / (1 - {_RAW.format("pm")})) ELSE 0 END, 5) AS fisher_signal
 FROM f JOIN e ON e.symbol = f.symbol AND e.i = f.i""")  # fmt: skip
def k09(spark: SparkSession, d: str) -> DataFrame:
    """Keltner channel of an exponential mean and 1.5 mean true ranges, Fisher transform of the median price in its range of nine bars."""

    def columns(w):
        p = F.coalesce(F.lag("close").over(w), F.col("close"))
        f = frame(w, 9)
        return [
            {"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)), "med": (F.col("high") + F.col("low")) / 2},
            {"atr": F.avg("tr").over(frame(w, 14)), "hi": F.max("med").over(f), "lo": F.min("med").over(f), "pm": F.lag("med").over(w)},
        ]

    out = ema(over_bars(spark, d, columns, 15, keep_ordinal=True), KEYS, "close", 2 / 21, "y")
    fits = (F.col("_rn") >= 8) & (F.col("hi") > F.col("lo"))

    def fisher(c):
        x = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), 2 * F.try_divide(F.col(c) - F.col("lo"), F.col("hi") - F.col("lo")) - 1))
        return F.when(fits, 0.5 * F.log((1 + x) / (1 - x))).otherwise(0.0)

    y, a = F.col("y"), 1.5 * F.col("atr")
    out = out.withColumns({"kc_upper": y + a, "kc_lower": y - a, "kc_percentile": F.coalesce(F.try_divide(F.col("close") - y + a, 2 * a), F.lit(0.5)), "fisher": fisher("med"), "fisher_signal": fisher("pm")})
    return out.select("symbol", "day", *[F.round(c, n).alias(c) for c, n in (("kc_upper", 3), ("kc_lower", 3), ("kc_percentile", 5), ("fisher", 5), ("fisher_signal", 5))])


UNITS = {"day": 0.5, "week": 0.3, "month": 0.2}


@query("k12_timeframe_vote", f"""WITH {BARS_SQL}, u AS ({" UNION ALL ".join(f"SELECT symbol, '{u}' AS unit, {w}::DOUBLE AS weight, date_trunc('{u}', day)::DATE AS t0, arg_max(close, day) AS close FROM bars GROUP BY ALL" for u, w in UNITS.items())}),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol, unit ORDER BY t0 DESC) AS k FROM u), s AS (SELECT symbol, unit, max(weight) AS weight, arg_min(close, k) AS last, avg(close) AS mean, regr_slope(close, -k) AS slope, count(*) AS n FROM r WHERE k <= 20 GROUP BY ALL),
 v AS (SELECT *, CASE WHEN n < 20 THEN 'FLAT' WHEN last > mean AND slope > 0 THEN 'LONG' WHEN last < mean AND slope < 0 THEN 'SHORT' ELSE 'FLAT' END AS trend FROM s)
 SELECT symbol, count(*) FILTER (trend = 'LONG') AS longs, count(*) FILTER (trend = 'SHORT') AS shorts, CASE WHEN longs > shorts THEN 'LONG' WHEN shorts > longs THEN 'SHORT' ELSE 'FLAT' END AS dominant,
  round(sum(CASE WHEN trend = dominant THEN weight ELSE 0 END), 6) AS alignment FROM (SELECT *, CASE WHEN l > s THEN 'LONG' WHEN s > l THEN 'SHORT' ELSE 'FLAT' END AS dominant FROM (SELECT *, count(*) FILTER (trend = 'LONG') OVER (PARTITION BY symbol) AS l, count(*) FILTER (trend = 'SHORT') OVER (PARTITION BY symbol) AS s FROM v)) GROUP BY symbol""".replace(
    "CASE WHEN longs > shorts THEN 'LONG' WHEN shorts > longs THEN 'SHORT' ELSE 'FLAT' END AS dominant,\n", "max(dominant) AS dominant,\n"))
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Each time frame votes by its last close against the mean and slope of its last 20; the votes of the winning side are weighed."""
    b = daily_bars(spark, d)
    frames = [b.groupBy("symbol", F.lit(u).alias("unit"), F.lit(w).alias("weight"), F.trunc("day", u).alias("at") if u != "day" else F.col("day").alias("at")).agg(F.max_by("close", "day").alias("close")) for u, w in UNITS.items()]
    u = frames[0].unionByName(frames[1]).unionByName(frames[2])
    # the last 20 of each by an aggregate: an array of 20 rows at most, merged on the map side
    last = u.withColumn("year", F.year("at")).groupBy("symbol", "unit", "weight", "year").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("at", "close")))), 1, 20).alias("x"))
    last = last.groupBy("symbol", "unit", "weight").agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("x")))), 1, 20).alias("x"))
    one = last.select("symbol", "unit", "weight", F.size("x").alias("n"), F.posexplode("x").alias("k", "v"))
    s = one.groupBy("symbol", "unit", "weight", "n").agg(F.min_by("v.close", "k").alias("last"), F.avg("v.close").alias("mean"), F.regr_slope(F.col("v.close"), -F.col("k")).alias("slope"))
    trend = F.when(F.col("n") < 20, "FLAT").when((F.col("last") > F.col("mean")) & (F.col("slope") > 0), "LONG").when((F.col("last") < F.col("mean")) & (F.col("slope") < 0), "SHORT").otherwise("FLAT")
    of = lambda t: F.sum((trend == t).cast("long"))
    weight = lambda t: F.sum(F.when(trend == t, F.col("weight")).otherwise(0.0))
    g = s.groupBy("symbol").agg(of("LONG").alias("longs"), of("SHORT").alias("shorts"), *[weight(t).alias(t) for t in ("LONG", "SHORT", "FLAT")])
    dominant = F.when(F.col("longs") > F.col("shorts"), "LONG").when(F.col("shorts") > F.col("longs"), "SHORT").otherwise("FLAT")
    return g.select("symbol", "longs", "shorts", dominant.alias("dominant"), F.round(F.when(dominant == "LONG", F.col("LONG")).when(dominant == "SHORT", F.col("SHORT")).otherwise(F.col("FLAT")), 6).alias("alignment"))


@query("w19_bars_since_visit", f"""WITH {BARS_SQL}, r AS (SELECT *, row_number() OVER ({W}) AS i, CAST(floor(ln(close) / ln(1.05) + 0.5) AS BIGINT) AS z FROM bars),
 l AS (SELECT a.symbol, a.day, a.i, a.close, b.z, max(b.i) AS j FROM r a JOIN r b ON a.symbol = b.symbol AND b.i < a.i AND b.z BETWEEN a.z - 2 AND a.z + 2 GROUP BY ALL),
 m AS (SELECT l.symbol, l.day, min(l.i - l.j) AS ago FROM l JOIN r ON r.symbol = l.symbol AND r.i = l.j WHERE abs(r.close - l.close) <= l.close * 0.05 GROUP BY ALL)
 SELECT r.symbol, r.day, least(coalesce(ago, 999), 500)::BIGINT AS bars_since FROM r LEFT JOIN m ON m.symbol = r.symbol AND m.day = r.day""")  # fmt: skip
def w19(spark: SparkSession, d: str) -> DataFrame:
    b = daily_bars(spark, d).select("symbol", "day", "close")
    return T.since_visited(b, KEYS, ORDER, bar_bucket(), "close", 0.05).select("symbol", "day", F.least("bars_since", F.lit(500)).alias("bars_since"))


# flow

_FLOW_SQL = f"""{TICKS_SQL}, g AS (SELECT symbol, time_msc // {HOUR} AS bar, sum((flags & 32 > 0)::INT) AS buys, sum((flags & 64 > 0)::INT) AS sells, arg_max(bid, (time_msc, event_id)) AS close FROM ticks GROUP BY ALL)"""
_BW = "PARTITION BY symbol ORDER BY bar"


def flow(spark: SparkSession, d: str) -> DataFrame:
    side = lambda bit: F.sum((F.col("flags").bitwiseAND(bit) > 0).cast("long"))
    t = ticks(spark, d).withColumn("bar", F.floor(F.col("time_msc") / HOUR))
    return t.groupBy("symbol", "bar").agg(side(32).alias("buys"), side(64).alias("sells"), F.max_by("bid", F.struct("time_msc", "event_id")).alias("close"))


def flow_bucket():
    """Months: what one task ranks of an hourly series."""
    return F.floor(F.col("bar") / 720)


@query("e02_volume_imbalance", f"""WITH {_FLOW_SQL}, k AS (SELECT *, (buys - sells) / (buys + sells) AS imb FROM g WHERE buys + sells > 0),
 z AS (SELECT *, count(*) OVER ({_BW} ROWS 49 PRECEDING) AS n, avg(imb) OVER ({_BW} ROWS 49 PRECEDING) AS m, stddev_pop(imb) OVER ({_BW} ROWS 49 PRECEDING) AS s FROM k),
 st AS (SELECT symbol, bar, imb, CASE WHEN n >= 5 THEN m ELSE imb END AS mean, CASE WHEN n >= 5 AND s > 1e-12 THEN (imb - m) / s ELSE 0 END AS z FROM z)
 SELECT g.symbol, g.bar, round(imb, 6) AS imbalance, round(mean, 6) AS rolling_imbalance, round(z, 5) AS z, coalesce(round(abs(z), 5) > 2, false) AS extreme FROM g ASOF LEFT JOIN st ON st.symbol = g.symbol AND g.bar >= st.bar""")  # fmt: skip
def e02(spark: SparkSession, d: str) -> DataFrame:
    """Bars without volume keep the state of the bar before."""
    g = flow(spark, d)
    total = F.col("buys") + F.col("sells")

    def columns(w):
        f, x = frame(w, 50), F.col("imbalance")
        s, enough = F.stddev_pop(x).over(f), F.count(x).over(f) >= 5
        return {"rolling_imbalance": F.when(enough, F.avg(x).over(f)).otherwise(x), "z": F.when(enough & (s > 1e-12), (x - F.avg(x).over(f)) / s).otherwise(0.0)}

    some = rolling(g.where(total > 0).withColumn("imbalance", (F.col("buys") - F.col("sells")) / total), KEYS, ["bar"], flow_bucket(), columns, 50)
    names = ["imbalance", "rolling_imbalance", "z"]
    out = fill_forward(g.join(some.select("symbol", "bar", *names), ["symbol", "bar"], "left"), KEYS, ["bar"], flow_bucket(), names)
    return out.select("symbol", "bar", F.round("imbalance", 6).alias("imbalance"), F.round("rolling_imbalance", 6).alias("rolling_imbalance"), F.round("z", 5).alias("z"), F.coalesce(F.round(F.abs("z"), 5) > 2, F.lit(False)).alias("extreme"))


@query("e07_stealth_flow", f"""WITH {_FLOW_SQL}, k AS (SELECT *, (buys - sells) / greatest(buys + sells, 1) AS imb, close - lag(close) OVER ({_BW}) AS dp FROM g),
 m AS (SELECT symbol, bar, count(*) OVER ({_BW}) AS n, avg(imb) OVER ({_BW} ROWS 9 PRECEDING) AS i, avg(dp) OVER ({_BW} ROWS 9 PRECEDING) AS p FROM k)
 SELECT symbol, bar, CASE WHEN i > 0 THEN 1 ELSE -1 END AS direction, round(least(1, abs(i)), 6) AS intensity, round(least(1, abs(i) / 0.1 * 0.5), 6) AS confidence FROM m WHERE n >= 20 AND ((i > 0.1 AND p <= 0) OR (i < -0.1 AND p >= 0))""")  # fmt: skip
def e07(spark: SparkSession, d: str) -> DataFrame:
    """Volume leans one way over ten bars while the price doesn't follow."""

    def columns(w):
        f = frame(w, 10)
        return [
            {"imb": (F.col("buys") - F.col("sells")) / F.greatest(F.col("buys") + F.col("sells"), F.lit(1)), "dp": F.col("close") - F.lag("close").over(w)},
            {"i": F.avg("imb").over(f), "p": F.avg("dp").over(f)},
        ]

    out = rolling(flow(spark, d), KEYS, ["bar"], flow_bucket(), columns, 11, keep_ordinal=True)
    i, p = F.col("i"), F.col("p")
    out = out.where((F.col("_rn") >= 19) & (((i > 0.1) & (p <= 0)) | ((i < -0.1) & (p >= 0))))
    return out.select("symbol", "bar", F.when(i > 0, 1).otherwise(-1).alias("direction"), F.round(F.least(F.lit(1.0), F.abs(i)), 6).alias("intensity"), F.round(F.least(F.lit(1.0), F.abs(i) / 0.1 * 0.5), 6).alias("confidence"))


@query("e13_correlation_bias", f"""WITH {BARS_SQL}, p AS (SELECT a.day, a.close AS gold, b.close AS dxy FROM bars a JOIN bars b ON a.day = b.day WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH'),
 r AS (SELECT day, gold / lag(gold) OVER (ORDER BY day) - 1 AS g, dxy / lag(dxy) OVER (ORDER BY day) - 1 AS d, row_number() OVER (ORDER BY day) - 1 AS n FROM p),
 c AS (SELECT *, CASE WHEN n < 5 THEN -0.6 ELSE coalesce(covar_samp(g, d) OVER w / nullif(stddev_samp(g) OVER w * stddev_samp(d) OVER w, 0), 0) END AS corr, sum(d) OVER (ORDER BY day ROWS 4 PRECEDING) AS s5, sum(d) OVER (ORDER BY day ROWS 9 PRECEDING) AS s10 FROM r WINDOW w AS (ORDER BY day ROWS 19 PRECEDING)),
 t AS (SELECT *, CASE WHEN n >= 5 AND s5 > 0.001 THEN 'UP' WHEN n >= 5 AND s5 < -0.001 THEN 'DOWN' ELSE 'NEUTRAL' END AS trend FROM c)
 SELECT day, round(corr, 5) AS correlation, trend, round(CASE WHEN n >= 10 THEN s10 ELSE 0 END, 6) AS momentum, CASE WHEN trend = 'DOWN' AND corr <= -0.2 THEN 'BUY' WHEN trend = 'UP' AND corr <= -0.2 THEN 'SELL' ELSE 'NEUTRAL' END AS bias FROM t""")  # fmt: skip
def e13(spark: SparkSession, d: str) -> DataFrame:
    """Rolling correlation of two assets' returns, the peer's trend and momentum, and the bias they give."""
    b = daily_bars(spark, d)
    both = b.where("symbol in ('1-URGENT', '2-HIGH')").groupBy("day").agg(F.max(F.when(F.col("symbol") == "1-URGENT", F.col("close"))).alias("gold"), F.max(F.when(F.col("symbol") == "2-HIGH", F.col("close"))).alias("dxy"))
    both = both.where("gold is not null and dxy is not null").withColumn("pair", F.lit(0))

    def columns(w):
        f = frame(w, 20)
        return [
            {"g": F.try_divide("gold", F.lag("gold").over(w)) - 1, "x": F.try_divide("dxy", F.lag("dxy").over(w)) - 1},
            {"corr": F.coalesce(F.try_divide(F.covar_samp("g", "x").over(f), F.stddev_samp("g").over(f) * F.stddev_samp("x").over(f)), F.lit(0.0)), "s5": F.sum("x").over(frame(w, 5)), "s10": F.sum("x").over(frame(w, 10))},
        ]

    out = rolling(both, ["pair"], ORDER, bar_bucket(), columns, 21, keep_ordinal=True)
    n = F.col("_rn")
    out = out.withColumns({"corr": F.when(n < 5, -0.6).otherwise(F.col("corr")), "trend": F.when((n >= 5) & (F.col("s5") > 0.001), "UP").when((n >= 5) & (F.col("s5") < -0.001), "DOWN").otherwise("NEUTRAL")})
    tied = F.col("corr") <= -0.2
    bias = F.when((F.col("trend") == "DOWN") & tied, "BUY").when((F.col("trend") == "UP") & tied, "SELL").otherwise("NEUTRAL")
    return out.select("day", F.round("corr", 5).alias("correlation"), "trend", F.round(F.when(n >= 10, F.col("s10")).otherwise(0.0), 6).alias("momentum"), bias.alias("bias"))


# cross-asset features

ASSETS = {"2-HIGH": "dxy", "3-MEDIUM": "silver", "0-NONE": "vix"}
_CROSS = {"ret_1": "(close - lag(close) OVER (W)) / (lag(close) OVER (W) + 1e-10)", "ret_5": "(close - lag(close, 5) OVER (W)) / (lag(close, 5) OVER (W) + 1e-10)",
          "zscore_50": "CASE WHEN count(*) OVER (W ROWS 49 PRECEDING) >= 50 THEN (close - avg(close) OVER (W ROWS 49 PRECEDING)) / (stddev_samp(close) OVER (W ROWS 49 PRECEDING) + 1e-10) END"}


@query("f11_cross_asset_block", f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT *, row_number() OVER ({W}) AS i FROM bars), e AS (SELECT symbol, i, close AS num, 1.0::DOUBLE AS den FROM r WHERE i = 1
  UNION ALL SELECT r.symbol, r.i, num * (1 - 2.0::DOUBLE / 15) + r.close, den * (1 - 2.0::DOUBLE / 15) + 1 FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1),
 f AS (SELECT r.symbol, r.day, {", ".join(f"{v.replace('W ROWS', f'{W} ROWS').replace('(W)', f'({W})')} AS {k}" for k, v in _CROSS.items())}, num / den AS ema_14 FROM (SELECT r.symbol, r.day, r.close, num, den FROM r JOIN e ON e.symbol = r.symbol AND e.i = r.i) r),
 {", ".join(f"{a} AS (SELECT day, ret_1, ret_5, zscore_50, ema_14 FROM f WHERE symbol = '{s}')" for s, a in ASSETS.items())}, base AS (SELECT day FROM bars WHERE symbol = '1-URGENT')
 SELECT base.day, {", ".join(f"round(coalesce({a}.{c}, 0), 5) AS {a}_{c}" for a in ASSETS.values() for c in (*_CROSS, "ema_14"))}, round(coalesce(silver.ret_1 - dxy.ret_1, 0), 5) AS silver_dxy_spread, coalesce(vix.zscore_50 > 1.5, false)::INT::DOUBLE AS vix_spike
 FROM base {" ".join(f"ASOF LEFT JOIN {a} ON base.day >= {a}.day" for a in ASSETS.values())}""")  # fmt: skip
def f11(spark: SparkSession, d: str) -> DataFrame:
    """Features of other assets at the last of their bars at or before each bar; an asset that isn't there is all zeros."""

    def columns(w):
        back = lambda k: (F.col("close") - F.lag("close", k).over(w)) / (F.lag("close", k).over(w) + 1e-10)
        return {"ret_1": back(1), "ret_5": back(5), "zscore_50": (F.col("close") - full(F.avg, F.col("close"), w, 50)) / (full(F.stddev_samp, F.col("close"), w, 50) + 1e-10)}

    b = over_bars(spark, d, columns, 50, keep_ordinal=True).withColumns({"x": F.col("close").cast("double"), "one": F.lit(1.0)})
    fade = 1 - 2 / 15  # the mean of all values so far with falling weights: sums of values and of weights
    b = linear_recurrences(b, KEYS, {"num": "x", "den": "one"}, fade).withColumn("ema_14", F.col("num") / F.col("den"))
    names = [*_CROSS, "ema_14"]
    b = b.select("symbol", F.unix_date("day").cast("long").alias("t"), *names)
    out = b.where("symbol = '1-URGENT'").select("t").withColumn("grid", F.lit(0))
    for symbol, asset in ASSETS.items():
        other = b.where(F.col("symbol") == symbol).select("t", F.lit(0).alias("grid"), *[F.col(c).alias(f"{asset}_{c}") for c in names])
        out = asof(out, other, ["grid"], "t", [f"{asset}_{c}" for c in names], 365).drop("t_matched")
    out = out.withColumns({"silver_dxy_spread": F.col("silver_ret_1") - F.col("dxy_ret_1"), "vix_spike": (F.col("vix_zscore_50") > 1.5).cast("int").cast("double")})
    made = [c for c in out.columns if c not in ("t", "grid")]
    return out.select(F.date_from_unix_date(F.col("t").cast("int")).alias("day"), *[F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in made])


@query("f03_spread_quality", f"""WITH {HOURLY_SQL}, c AS (SELECT symbol, time_msc // {HOUR} * {HOUR} AS bar, sum((flags & 1 > 0)::INT) AS conflicts FROM ticks GROUP BY ALL)
 SELECT h.symbol, h.bar, round(spread_mean / greatest(close, 1e-10), 8) AS relative_spread, round(conflicts / greatest(tick_count, 1), 6) AS conflict_ratio, source_count AS broker_diversity FROM hourly h JOIN c ON c.symbol = h.symbol AND c.bar = h.bar""")  # fmt: skip
def f03(spark: SparkSession, d: str) -> DataFrame:
    c = ticks(spark, d).groupBy("symbol", B.floor_to("time_msc", HOUR).alias("bar")).agg(F.sum((F.col("flags").bitwiseAND(1) > 0).cast("long")).alias("conflicts"))
    h = hourly(spark, d).join(c, ["symbol", "bar"])
    return h.select(
        "symbol", "bar", F.round(F.col("spread_mean") / F.greatest("close", F.lit(1e-10)), 8).alias("relative_spread"),
        F.round(F.col("conflicts") / F.greatest("tick_count", F.lit(1)), 6).alias("conflict_ratio"), F.col("source_count").alias("broker_diversity"),
    )


# cleaning

_DIRTY = f"""{TICKS_SQL}, d0 AS (SELECT symbol, time_msc, event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -bid WHEN event_id % 7 < 5 THEN 100 ELSE bid END AS bid,
  CASE WHEN event_id % 23 = 0 THEN bid * 0.5 WHEN event_id % 29 = 0 THEN bid * 1.5 WHEN event_id % 7 < 5 THEN 100.04 ELSE ask END AS ask FROM ticks),
 d AS (SELECT symbol, time_msc, bid, ask FROM d0 UNION ALL SELECT symbol, time_msc, bid, ask FROM d0 WHERE event_id % 31 = 0)"""


def faulty(spark: SparkSession, d: str) -> DataFrame:
    """Ticks with planted faults, frozen stretches and repeated rows."""
    e, bid = F.col("event_id"), F.col("bid")
    t = ticks(spark, d).select(
        "symbol", "time_msc", "event_id", F.when(e % 17 == 0, None).when(e % 19 == 0, -bid).when(e % 7 < 5, 100.0).otherwise(bid).alias("bid"),
        F.when(e % 23 == 0, bid * 0.5).when(e % 29 == 0, bid * 1.5).when(e % 7 < 5, 100.04).otherwise(F.col("ask")).alias("ask"),
    )
    return t.unionByName(t.where(e % 31 == 0)).drop("event_id")


@query("p02_clean_ticks", f"""WITH {_DIRTY}, u AS (SELECT DISTINCT * FROM d), c AS (SELECT *, CASE WHEN bid IS NULL OR ask IS NULL OR bid <= 0 OR ask <= 0 OR bid > ask THEN 'invalid_price' WHEN (ask - bid) / ((bid + ask) / 2) > 0.01 THEN 'spread' END AS bad FROM u),
 s AS (SELECT *, (bid + ask) / 2 AS mid, row_number() OVER w AS i, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY time_msc, bid, ask ROWS 19 PRECEDING) >= 20 THEN quantile_cont((bid + ask) / 2, 0.5) OVER (PARTITION BY symbol ORDER BY time_msc, bid, ask ROWS 19 PRECEDING) END AS med FROM c WHERE bad IS NULL WINDOW w AS (PARTITION BY symbol ORDER BY time_msc, bid, ask)),
 k AS (SELECT *, NOT (i <= 20 OR med IS NULL OR abs(mid - med) / med <= 0.6) AS spike FROM s), q AS (SELECT *, CASE WHEN bid = lag(bid) OVER w AND ask = lag(ask) OVER w THEN 0 ELSE 1 END AS new FROM k WHERE NOT spike WINDOW w AS (PARTITION BY symbol ORDER BY time_msc, bid, ask)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY time_msc, bid, ask) AS run FROM q), f AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) > 4 AS stale FROM r)
 SELECT 'input' AS stage, count(*) AS n FROM d UNION ALL SELECT 'duplicates', (SELECT count(*) FROM d) - count(*) FROM u UNION ALL SELECT b, count(bad) FROM (VALUES ('invalid_price'), ('spread')) v(b) LEFT JOIN c ON bad = b GROUP BY b
 UNION ALL SELECT 'price_spike', count(*) FROM k WHERE spike UNION ALL SELECT 'stale', count(*) FROM f WHERE stale UNION ALL SELECT 'output', count(*) FROM f WHERE NOT stale""")  # fmt: skip
def p02(spark: SparkSession, d: str) -> DataFrame:
    """The stages of the cleaning in order, with what each removes."""
    return clean.cleaning_counts(clean.cleaning_stages(faulty(spark, d), ["symbol"], ["time_msc", "bid", "ask"], tick_bucket(), max_jump=0.6, stale_limit=4))


# state

@query("s20_checkpoint_upsert", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event, max(epoch_us(ts) // 1000) AS last_msc, count(*) AS rows_total FROM events GROUP BY ALL""")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint row a key, kept by its latest batch, with running totals: two batches merged by an aggregate."""
    e = ticks(spark, d).select("user_id", F.col("symbol").alias("event_type"), "event_id", "time_msc")
    row = lambda b: b.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("time_msc", "event_id")).alias("last_event"), F.max("time_msc").alias("last_msc"), F.count("*").alias("rows_total"))
    old, new = row(e.where("event_id % 2 = 0")), row(e.where("event_id % 2 = 1"))
    merged = old.unionByName(new).groupBy("user_id", "event_type")
    return merged.agg(F.max_by("last_event", F.struct("last_msc", "last_event")).alias("last_event"), F.max("last_msc").alias("last_msc"), F.sum("rows_total").alias("rows_total"))


@query("st06_carry_forward", f"""WITH {TICKS_SQL}, g AS (SELECT symbol, bucket, arg_max(bid, (time_msc, event_id)) AS bid, max(time_msc) AS t FROM (SELECT *, time_msc // {HOUR} AS bucket FROM ticks) GROUP BY ALL),
 s AS (SELECT symbol, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM g GROUP BY symbol)
 SELECT s.symbol, s.bucket, CASE WHEN (s.bucket + 1) * {HOUR} - g.t <= {3 * HOUR} THEN g.bid END AS bid, CASE WHEN g.bucket = s.bucket THEN 'fresh' WHEN (s.bucket + 1) * {HOUR} - g.t <= {3 * HOUR} THEN 'carried' ELSE 'stale' END AS status
 FROM s ASOF LEFT JOIN g ON g.symbol = s.symbol AND s.bucket >= g.bucket""")  # fmt: skip
def st06(spark: SparkSession, d: str) -> DataFrame:
    """ST06: a snapshot for every slot: fresh, carried forward from before, or stale beyond three hours."""
    t = ticks(spark, d).withColumn("bucket", F.floor(F.col("time_msc") / HOUR))
    g = t.groupBy("symbol", "bucket").agg(F.max_by("bid", F.struct("time_msc", "event_id")).alias("bid"), F.max("time_msc").alias("t"))
    # slots are made from each day's span, so no symbol's grid is one row's sequence
    days = g.groupBy("symbol").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / 24), F.floor(F.col("b") / 24))))
    slots = days.select("symbol", F.explode(F.sequence(F.greatest("a", F.col("day") * 24), F.least("b", F.col("day") * 24 + 23))).alias("bucket"))
    m = asof(slots, g, ["symbol"], "bucket", ["bid", "t"], 24)
    near = (F.col("bucket") + 1) * HOUR - F.col("t") <= 3 * HOUR
    return m.select("symbol", "bucket", F.when(near, F.col("bid")).alias("bid"), F.when(F.col("bucket_matched") == F.col("bucket"), "fresh").when(near, "carried").otherwise("stale").alias("status"))


@query("k30_weighted_votes", """WITH v AS (SELECT user_id, (event_type = 'purchase')::INT - (event_type = 'click')::INT AS vote, 1 + event_id % 5 AS weight, (SELECT max(epoch_us(ts)) FROM events) / 3600e6 - epoch_us(ts) / 3600e6 AS hours FROM events)
 SELECT user_id, round(sum(weight * exp(-hours / 240) * vote) / sum(weight * exp(-hours / 240)), 6) AS score, CASE WHEN abs(sum(weight * exp(-hours / 240) * vote) / sum(weight * exp(-hours / 240))) < 1e-9 THEN 'HOLD' WHEN sum(weight * exp(-hours / 240) * vote) > 0 THEN 'LONG' ELSE 'SHORT' END AS decision FROM v GROUP BY user_id""")  # fmt: skip
def k30(spark: SparkSession, d: str) -> DataFrame:
    """Votes weighed by their module and by their age."""
    e = table(spark, d, "events")
    newest = e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now"))
    v = e.join(F.broadcast(newest)).select(  # one row
        "user_id", ((F.col("event_type") == "purchase").cast("int") - (F.col("event_type") == "click").cast("int")).alias("vote"),
        ((1 + F.col("event_id") % 5) * F.exp(-(F.col("now") - F.unix_micros(F.col("ts").cast("timestamp"))) / 3600e6 / 240)).alias("w"),
    )
    score = F.try_divide(F.sum(F.col("w") * F.col("vote")), F.sum("w"))
    return v.groupBy("user_id").agg(score.alias("s")).select("user_id", F.round("s", 6).alias("score"), F.when(F.abs("s") < 1e-9, "HOLD").when(F.col("s") > 0, "LONG").otherwise("SHORT").alias("decision"))


@query("p11_coverage_filter", f"""WITH {BARS_SQL} SELECT symbol, count(*) AS n, min(day) AS first, max(day) AS last, count(*) FILTER (gap > 7) AS wide_gaps FROM (SELECT *, day - lag(day) OVER ({W}) AS gap FROM bars WHERE upper(symbol) IN ('1-URGENT', '5-LOW') AND day >= DATE '1994-01-01' AND day < DATE '1997-01-01') GROUP BY symbol""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """The rows of some series inside a half-open range, and their gaps."""
    b = daily_bars(spark, d).where(F.upper("symbol").isin("1-URGENT", "5-LOW") & (F.col("day") >= F.lit("1994-01-01").cast("date")) & (F.col("day") < F.lit("1997-01-01").cast("date")))
    out = rolling(b, KEYS, ORDER, bar_bucket(), lambda w: {"gap": F.datediff("day", F.lag("day").over(w))}, 1)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.count_if(F.col("gap") > 7).alias("wide_gaps"))


@query("a22_performance", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, close, max(close) OVER ({W}) AS peak, first_value(close) OVER ({W}) AS c0 FROM bars), u AS (SELECT *, max(CASE WHEN close >= peak THEN day END) OVER ({W}) AS at_peak FROM r)
 SELECT symbol, round(pow(arg_max(close, day) / max(c0), 365.0 / (max(day) - min(day))) - 1, 6) AS cagr, round(min(close / peak - 1), 6) AS max_drawdown, max(day - at_peak)::INT AS longest_drawdown_days, round(avg((close < peak)::INT), 6) AS time_under_water,
  round((pow(arg_max(close, day) / max(c0), 365.0 / (max(day) - min(day))) - 1) / -min(close / peak - 1), 5) AS calmar, round(sqrt(avg(pow(100 * (close / peak - 1), 2))), 5) AS ulcer FROM u GROUP BY symbol""")  # fmt: skip
def a22(spark: SparkSession, d: str) -> DataFrame:
    """Growth, drawdown depth and length, time under water, Calmar and Ulcer."""
    from larkfold.operators.metrics import drawdowns

    b = drawdowns(daily_bars(spark, d), KEYS, ORDER, "close", bar_bucket()).withColumn("at_peak", F.when(F.col("close") >= F.col("peak"), F.col("day")))
    b = fill_forward(b, KEYS, ORDER, bar_bucket(), ["at_peak"])
    cagr = F.pow(F.max_by("close", "day") / F.min_by("close", "day"), 365.0 / F.datediff(F.max("day"), F.min("day"))) - 1
    worst = F.min("drawdown")
    g = b.groupBy("symbol").agg(
        cagr.alias("cagr"), worst.alias("max_drawdown"), F.max(F.datediff("day", "at_peak")).alias("longest_drawdown_days"), F.avg((F.col("close") < F.col("peak")).cast("int")).alias("time_under_water"),
        F.try_divide(cagr, -worst).alias("calmar"), F.sqrt(F.avg(F.pow(100 * F.col("drawdown"), F.lit(2)))).alias("ulcer"),
    )
    return g.select("symbol", "longest_drawdown_days", *[F.round(c, n).alias(c) for c, n in (("cagr", 6), ("max_drawdown", 6), ("time_under_water", 6), ("calmar", 5), ("ulcer", 5))])
