"""Queries: bar quality, cointegration, decay of importance, stress, blackout windows, sweeps, lineage, exported tapes, and streams with joins, duplicates and exported state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import merge
from larkfold.operators.ranges import within
from larkfold.operators.series import frame, rolling
from larkfold.plans.core import HOUR, tick_bucket
from larkfold.plans.merging import MERGE_SQL, RULES, quotes
from larkfold.plans.more import stream_path
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, over_bars, picked, rows
from larkfold.sources.adapters import BARS_SQL, DAY_MS, TICKS_SQL, daily_bars, table, ticks
from larkfold.streaming import engine


@query("a06_bar_quality", f"""WITH RECURSIVE {MERGE_SQL} SELECT symbol, bucket * {HOUR} // {DAY_MS} AS day, count(*) AS n, round(avg(q), 5) AS quality_mean, round(max(q), 5) AS quality_max, round(avg(conflict::INT), 6) AS conflict_ratio,
 round(avg(two::INT), 6) AS dual_ratio, round(max(CASE WHEN two THEN abs(mid_a - mid_b) ELSE 0 END), 6) AS mid_diff_max FROM m GROUP BY ALL""")  # fmt: skip
def a06(spark: SparkSession, d: str) -> DataFrame:
    """Means and maxima of the merged feed's quality by symbol and day."""
    m = merge.merge_sources(merge.last_per_bucket(quotes(spark, d), HOUR), RULES)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return m.groupBy("symbol", F.floor(F.col("bucket") * HOUR / DAY_MS).alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg("quality_score"), 5).alias("quality_mean"), F.round(F.max("quality_score"), 5).alias("quality_max"), share(F.col("conflict_flag")).alias("conflict_ratio"),
        share(F.col("source_secondary") != "").alias("dual_ratio"), F.round(F.max("mid_diff"), 6).alias("mid_diff_max"),
    )


_ALIGNED = f"""{BARS_SQL}, p AS (SELECT a.day, ln(a.close) AS y, ln(b.close) AS x FROM bars a JOIN bars b ON a.day = b.day WHERE a.symbol = '1-URGENT' AND b.symbol = '5-LOW')"""


@query("k13_cointegration", f"""WITH {_ALIGNED}, h AS (SELECT regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS n FROM p), s AS (SELECT day, y - beta * x - alpha AS s FROM p, h),
 l AS (SELECT s - lag(s) OVER (ORDER BY day) AS ds, lag(s) OVER (ORDER BY day) AS s0 FROM s), r AS (SELECT regr_slope(ds, s0) AS lam, regr_count(ds, s0) AS m, regr_sxx(ds, s0) AS sxx, regr_syy(ds, s0) AS syy, regr_sxy(ds, s0) AS sxy FROM l)
 SELECT n, round(beta, 6) AS hedge_ratio, round(alpha, 6) AS intercept, round(CASE WHEN lam < 0 THEN -ln(2) / lam END, 5) AS half_life, round(lam / sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx), 4) AS adf_t FROM h, r""")  # fmt: skip
def k13(spark: SparkSession, d: str) -> DataFrame:
    """Hedge ratio of two series by least squares, half-life of their spread and the Dickey-Fuller statistic (no lags)."""
    b = daily_bars(spark, d)
    pick = lambda s: F.max(F.when(F.col("symbol") == s, F.log("close")))
    p = b.where("symbol in ('1-URGENT', '5-LOW')").groupBy("day").agg(pick("1-URGENT").alias("y"), pick("5-LOW").alias("x")).where("y is not null and x is not null").withColumn("pair", F.lit(0))
    h = p.groupBy("pair").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.count("*").alias("n"))
    s = p.join(h, "pair").withColumn("s", F.col("y") - F.col("beta") * F.col("x") - F.col("alpha"))
    s = rolling(s.select("pair", "day", "s"), ["pair"], ORDER, bar_bucket(), lambda w: {"ds": F.col("s") - F.lag("s").over(w), "s0": F.lag("s").over(w)}, 1)
    r = s.groupBy("pair").agg(F.regr_slope("ds", "s0").alias("l"), F.regr_count("ds", "s0").alias("m"), *[getattr(F, f"regr_{k}")("ds", "s0").alias(k) for k in ("sxx", "syy", "sxy")])
    t = F.col("l") / F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("m") - 2) / F.col("sxx"))
    return h.join(r, "pair").select(
        "n", F.round("beta", 6).alias("hedge_ratio"), F.round("alpha", 6).alias("intercept"), F.round(F.when(F.col("l") < 0, -F.log(F.lit(2.0)) / F.col("l")), 5).alias("half_life"), F.round(t, 4).alias("adf_t")
    )


@query("k20_importance_half_life", f"""WITH {BARS_SQL}, m AS (SELECT symbol, (year(day) - 1992) * 12 + month(day) AS t, avg((high - low) / close) AS importance FROM bars GROUP BY ALL)
 SELECT symbol, count(*) AS months, round(regr_slope(ln(importance), t), 8) AS slope, CASE WHEN regr_slope(ln(importance), t) < 0 THEN 'decaying' ELSE 'stable' END AS status FROM m WHERE importance > 0 GROUP BY symbol""")
def k20(spark: SparkSession, d: str) -> DataFrame:
    """Log-linear decay of a monthly importance series; the half-life is ln 2 over the slope's size."""
    t = (F.year("day") - 1992) * 12 + F.month("day")
    m = daily_bars(spark, d).groupBy("symbol", t.alias("t")).agg(F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("importance")).where("importance > 0")
    slope = F.regr_slope(F.log("importance"), F.col("t"))
    return m.groupBy("symbol").agg(F.count("*").alias("months"), F.round(slope, 8).alias("slope"), F.when(slope < 0, "decaying").otherwise("stable").alias("status"))


@query("k25_stress", f"""WITH {TICKS_SQL}, h AS (SELECT *, (time_msc // 60000) % 1440 AS mod_ FROM ticks WHERE NOT (event_id % 97 BETWEEN 3 AND 6)),
 c AS (SELECT event_id, time_msc + CASE WHEN event_id % 11 = 0 THEN 250 ELSE 0 END AS time_msc, CASE WHEN mod_ BETWEEN 780 AND 789 THEN 1 - 0.05 * (1 - abs(mod_ - 784.5) / 5) ELSE 1 END AS f, CASE WHEN mod_ BETWEEN 1320 AND 1379 THEN 10 ELSE 1 END AS w, bid, ask FROM h)
 SELECT event_id, time_msc, round(f * ((bid + ask) / 2 - w * (ask - bid) / 2), 6) AS bid, round(f * ((bid + ask) / 2 + w * (ask - bid) / 2), 6) AS ask FROM c""")  # fmt: skip
def k25(spark: SparkSession, d: str) -> DataFrame:
    """A daily flash crash of ten minutes, an hour of tenfold spreads, late ticks and holes, all by the clock or the id, so reruns agree."""
    e, minute = F.col("event_id"), F.floor(F.col("time_msc") / 60_000) % 1440
    crash = F.when(minute.between(780, 789), 1 - 0.05 * (1 - F.abs(minute - 784.5) / 5)).otherwise(1.0)
    wide = F.when(minute.between(1320, 1379), 10).otherwise(1)
    mid, half = (F.col("bid") + F.col("ask")) / 2, wide * (F.col("ask") - F.col("bid")) / 2
    t = ticks(spark, d).where(~(e % 97).between(3, 6))
    return t.select("event_id", (F.col("time_msc") + F.when(e % 11 == 0, 250).otherwise(0)).alias("time_msc"), F.round(crash * (mid - half), 6).alias("bid"), F.round(crash * (mid + half), 6).alias("ask"))


@query("k29_blackout_windows", f"""WITH {TICKS_SQL}, n AS (SELECT event_id, time_msc FROM ticks WHERE symbol = 'signup' AND bid > 150) SELECT t.event_id, EXISTS (SELECT 1 FROM n WHERE t.time_msc BETWEEN n.time_msc - 1800000 AND n.time_msc + 900000) AS blackout,
 CASE month(make_timestamp(t.time_msc * 1000)) WHEN 1 THEN 0.8 WHEN 9 THEN 0.7 WHEN 12 THEN 0.3 ELSE 0.0 END::DOUBLE AS seasonality FROM ticks t""")  # fmt: skip
def k29(spark: SparkSession, d: str) -> DataFrame:
    """No trades half an hour before and a quarter after a release (counts of releases within both), and a seasonality table by month."""
    t = ticks(spark, d).select(F.lit(0).alias("all"), "event_id", "time_msc", F.when((F.col("symbol") == "signup") & (F.col("bid") > 150), True).alias("_news"))
    t = within(t, ["all"], "time_msc", 900_001, {"_past": ("count", F.col("_news"))})
    t = within(t, ["all"], "time_msc", 1_800_001, {"_next": ("count", F.col("_news"))}, ahead=True)
    hit = F.col("time_msc").isNotNull() & (F.col("_past") + F.col("_next") > 0)
    month = F.month(F.timestamp_millis("time_msc"))
    table_ = F.create_map(*[F.lit(x) for kv in ((1, 0.8), (9, 0.7), (12, 0.3)) for x in kv])
    return t.select("event_id", hit.alias("blackout"), F.coalesce(F.try_element_at(table_, month), F.lit(0.0)).alias("seasonality"))


@query("e05_sweeps", f"""WITH {BARS_SQL}, z AS (SELECT *, lag(close) OVER ({W}) AS pc, max(high) OVER p AS top, min(low) OVER p AS bottom, avg(tick_count) OVER p AS vol, count(*) OVER p AS n FROM bars WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, CASE WHEN pc < top AND high > top AND close < top THEN 'bear' WHEN pc > bottom AND low < bottom AND close > bottom THEN 'bull' END AS side FROM z WHERE n = 20)
 SELECT symbol, day, side, round(0.4 * least(1, tick_count / vol / 3) + 0.3 * least(1, (CASE side WHEN 'bear' THEN (high - top) / top ELSE (bottom - low) / bottom END) * 100 / 10) + 0.3, 6) AS confidence FROM s WHERE side IS NOT NULL""")  # fmt: skip
def e05(spark: SparkSession, d: str) -> DataFrame:
    """A bar that passes the extreme of the 20 before and closes back inside."""
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    top, bottom, before = F.col("top"), F.col("bottom"), F.col("pc")

    def columns(w):
        p = w.rowsBetween(-20, -1)
        return {"pc": F.lag("close").over(w), "top": F.max("high").over(p), "bottom": F.min("low").over(p), "vol": F.avg("tick_count").over(p), "n": F.count("*").over(p)}

    side = F.when((before < top) & (high > top) & (close < top), "bear").when((before > bottom) & (low < bottom) & (close > bottom), "bull")
    out = over_bars(spark, d, columns, 20).where("n = 20").withColumn("side", side).where("side is not null")
    size = F.when(F.col("side") == "bear", F.try_divide(high - top, top)).otherwise(F.try_divide(bottom - low, bottom))
    one = F.lit(1.0)
    return picked(out.withColumn("confidence", 0.4 * F.least(one, F.col("tick_count") / F.col("vol") / 3) + 0.3 * F.least(one, size * 10) + 0.3), "confidence", keys=("symbol", "day", "side"))


@query("j17_lineage", """WITH RECURSIVE e AS (SELECT DISTINCT 'order:' || o_orderkey AS child, 'customer:' || o_custkey AS parent FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
 r AS (SELECT child AS artifact, parent AS root, 1 AS depth FROM e UNION ALL SELECT artifact, e.parent, depth + 1 FROM r JOIN e ON r.root = e.child) SELECT root, depth::INTEGER AS depth, count(*) AS artifacts FROM r WHERE root LIKE 'region:%' GROUP BY ALL""")  # fmt: skip
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Lineage edges followed to their roots, a join a level; paths that have ended travel along no more."""
    edge = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(f"{a}:"), F.col(x)).alias("child"), F.concat(F.lit(f"{b}:"), F.col(y)).alias("parent")).distinct()
    e = edge("orders", "order", "o_orderkey", "customer", "o_custkey").union(edge("customer", "customer", "c_custkey", "nation", "c_nationkey")).union(edge("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    level = e.select(F.col("child").alias("artifact"), F.col("parent").alias("root"), F.lit(1).alias("depth"))
    out = level
    for depth in (2, 3):  # the declared levels of the lineage
        level = level.join(e.withColumnRenamed("child", "root"), "root").select("artifact", F.col("parent").alias("root"), F.lit(depth).alias("depth"))
        out = out.union(level)
    return out.where(F.col("root").startswith("region:")).groupBy("root", "depth").agg(F.count("*").alias("artifacts"))


@query("s21_signal_tape", f"""WITH {TICKS_SQL} SELECT symbol, count(*) AS n, min(time_msc) AS first, max(time_msc) AS last, sum((flags & 32 > 0)::INT - (flags & 64 > 0)::INT)::BIGINT AS net, true AS verified FROM ticks GROUP BY symbol""")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """A tape of signals exported to Parquet by day, read back and held against what was written."""
    side = lambda bit: (F.col("flags").bitwiseAND(bit) > 0).cast("int")
    tape = ticks(spark, d).select("symbol", "time_msc", (side(32) - side(64)).alias("signal"), F.floor(F.col("time_msc") / DAY_MS).alias("day"))
    path = f"{stream_path(spark)}/tape"
    tape.repartition("day").write.partitionBy("day").parquet(path)
    sums = lambda t: t.groupBy("symbol").agg(F.count("*").alias("n"), F.min("time_msc").alias("first"), F.max("time_msc").alias("last"), F.sum("signal").alias("net"))
    back, was = sums(spark.read.parquet(path)), sums(tape).withColumnsRenamed({c: f"was_{c}" for c in ("n", "first", "last", "net")})
    same = F.lit(True)
    for c in ("n", "first", "last", "net"):
        same = same & (F.col(c) == F.col(f"was_{c}"))
    return back.join(was, "symbol").select("symbol", "n", "first", "last", "net", same.alias("verified"))


@query("st05_stream_join", """SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND v.ts BETWEEN p.ts - INTERVAL 12 HOURS AND p.ts""")
def st05(spark: SparkSession, d: str) -> DataFrame:
    """ST05: a purchase waits for the views before it: two streams joined inside a time range, which bounds the state of both."""
    e = engine.read_events(spark, d)
    kind = lambda k, p: e.where(F.col("event_type") == k).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("time").alias(f"{p}_time")).withWatermark(f"{p}_time", "1 day")
    near = F.expr("purchase_user = view_user and view_time between purchase_time - interval 12 hours and purchase_time")
    joined = kind("purchase", "purchase").join(kind("view", "view"), near).select("purchase_id", "view_id")
    return engine.run_available(joined, stream_path(spark), "append")


@query("st17_collector", f"""WITH {TICKS_SQL} SELECT symbol, time_msc // {DAY_MS} AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ticks GROUP BY ALL""")
def st17(spark: SparkSession, d: str) -> DataFrame:
    """ST17: polled twice, each tick kept once within the watermark, flushed batch by batch."""
    e = engine.read_events(spark, d).select("event_id", "event_type", "time", "time_msc")
    once = engine.deduplicated(e.union(e), late="60 days")
    out = engine.run_available(once, stream_path(spark), "append")
    return out.groupBy(F.col("event_type").alias("symbol"), F.floor(F.col("time_msc") / DAY_MS).alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("st15_state_export", """SELECT event_type, count(*) AS n, max(epoch_us(ts) // 1000) AS last_ms, max(value) AS high, min(value) AS low FROM events GROUP BY event_type""")
def st15(spark: SparkSession, d: str) -> DataFrame:
    """ST15: the state that a stateful stream leaves in its checkpoint, read back as a table."""
    path = stream_path(spark)
    engine.run_available(engine.features(engine.read_events(spark, d)), path, "update")
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    v = F.col("value.groupState")
    return state.select(F.col("key.event_type").alias("event_type"), v["n"].alias("n"), v["last_ms"].alias("last_ms"), v["high"].alias("high"), v["low"].alias("low"))
