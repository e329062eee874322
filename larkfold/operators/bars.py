"""Ticks to bars, bar aggregates, volume profiles and gap handling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.functions.columns import ieee_log, ieee_ratio
from larkfold.operators.series import rolling

FLAG_BUY, FLAG_SELL = 32, 64


def floor_to(ms: str, step: int) -> Column:
    return F.floor(F.col(ms) / step) * step


def build_bars(ticks: DataFrame, step_ms: int, tick_id: str = "event_id", ieee: bool = False) -> DataFrame:
    """Bars of the mid price with spread and source statistics and realised volatility: one lag, one aggregate, both shuffled on (symbol, bar).

    A price of 0 has no logarithm and divides nothing (null); with ``ieee`` its logarithm is -infinity, and ratios are infinite or NaN."""
    log, ratio = (ieee_log, ieee_ratio) if ieee else (F.log, F.try_divide)
    mid = (F.col("bid") + F.col("ask")) / 2
    t = ticks.withColumns({"bar": floor_to("time_msc", step_ms), "mid": mid, "spread": F.col("ask") - F.col("bid")})
    w = Window.partitionBy("symbol", "bar").orderBy("time_msc", tick_id)
    t = t.withColumn("_d", log(F.col("mid")) - log(F.lag("mid").over(w)))
    o = F.struct("time_msc", tick_id)
    bars = t.groupBy("symbol", "bar").agg(
        F.min_by("mid", o).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", o).alias("close"),
        F.count("*").alias("tick_count"), F.min_by("bid", o).alias("bid_open"), F.max_by("ask", o).alias("ask_close"),
        F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"), F.min("spread").alias("spread_min"),
        F.countDistinct("broker").alias("source_count"), F.sqrt(F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0))).alias("realized_vol"),
    )
    return bars.withColumn("mid_return", ratio("close", "open") - 1)


def calendar_bars(bars: DataFrame, unit: str) -> DataFrame:
    """Daily bars to weeks or months."""
    return bars.groupBy("symbol", F.date_trunc(unit, F.col("day").cast("timestamp_ntz")).cast("date").alias("period")).agg(
        F.min_by("open", "day").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "day").alias("close"), F.sum("tick_count").alias("tick_count")
    )


def microstructure(ticks: DataFrame, step_ms: int = 300_000, ieee: bool = False) -> DataFrame:
    """Order-flow statistics of a bar: volumes by side bits, imbalance, tick rate, spread in basis points, summed squared returns. ``ieee``: as in ``build_bars``."""
    log, ratio = (ieee_log, ieee_ratio) if ieee else (F.log, F.try_divide)
    mid = (F.col("bid") + F.col("ask")) / 2
    t = ticks.withColumns({"bar": floor_to("time_msc", step_ms), "mid": mid})
    w = Window.partitionBy("symbol", "bar").orderBy("time_msc", "event_id")
    side = lambda bit: F.sum((F.col("flags").bitwiseAND(bit) > 0).cast("long"))
    bps = ratio(F.col("ask") - F.col("bid"), F.col("mid")) * 1e4
    t = t.withColumn("_d", log(F.col("mid")) - log(F.lag("mid").over(w)))
    out = t.groupBy("symbol", "bar").agg(
        F.count("*").alias("ticks"), side(FLAG_BUY).alias("buys"), side(FLAG_SELL).alias("sells"), F.avg(bps).alias("spread_bps_mean"), F.stddev_pop(bps).alias("spread_bps_std"),
        F.max(bps).alias("spread_bps_max"), F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("rv"),
    )
    total = F.col("buys") + F.col("sells")
    return out.withColumns({"imbalance": F.when(total > 0, (F.col("buys") - F.col("sells")) / total), "tick_rate": F.col("ticks") / (step_ms / 1000)})


def volume_profile(trades: DataFrame, key: str, price: str, volume: str, step: float, share: float = 0.7) -> DataFrame:
    """Point of control and value area by key. Bins are summed in Spark; the value area grows from the fullest bin
    to its larger neighbour (the upper one on ties) over one key's bins."""
    bins = trades.groupBy(key, F.floor(F.col(price) / step).cast("long").alias("bin")).agg(F.sum(volume).alias("v"))

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("bin", ignore_index=True)
        b, v = p["bin"].tolist(), p["v"].tolist()
        poc = max(range(len(v)), key=lambda i: (v[i], -i))
        lo = hi = poc
        got, want = v[poc], share * sum(v)
        while got < want and (lo > 0 or hi < len(v) - 1):
            up = v[hi + 1] if hi < len(v) - 1 else -1.0
            down = v[lo - 1] if lo > 0 else -1.0
            if up >= down:
                hi, got = hi + 1, got + up
            else:
                lo, got = lo - 1, got + down
        return pd.DataFrame({key: [pdf[key].iloc[0]], "poc": [b[poc]], "val": [b[lo]], "vah": [b[hi]], "total": [float(sum(v))]})

    kind = dict(trades.dtypes)[key]
    return bins.groupBy(key).applyInPandas(area, f"{key} {kind}, poc long, val long, vah long, total double")


def market_closed(ms: Column) -> Column:
    """Weekend of a currency market: Friday 22:00 to Sunday 22:00 UTC."""
    h, d = F.floor(ms / 3_600_000) % 24, (F.floor(ms / 86_400_000) + 3) % 7 + 1
    return ((d == 5) & (h >= 22)) | (d == 6) | ((d == 7) & (h < 22))


def gaps(bars: DataFrame, step_ms: int, time: str = "bar") -> DataFrame:
    """Stretches of missing open-market slots between consecutive bars of a symbol: (symbol, start, end, missing)."""
    bucket = F.floor(F.col(time) / (step_ms * 100_000))
    out = rolling(bars, ["symbol"], [time], bucket, lambda w: {"_prev": F.lag(time).over(w)}, before=1)
    out = out.where(F.col(time) - F.col("_prev") > step_ms)
    slots = F.sequence(F.col("_prev") + step_ms, F.col(time) - step_ms, F.lit(step_ms).cast("long"))
    out = out.withColumn("missing", F.size(F.filter(slots, lambda s: ~market_closed(s))).cast("long"))
    return out.where("missing > 0").select("symbol", (F.col("_prev") + step_ms).alias("start"), F.col(time).alias("end"), "missing")


def fill_gaps(bars: DataFrame, step_ms: int, limit_ms: int = 86_400_000, time: str = "bar") -> DataFrame:
    """Flat bars at the last close in the missing open-market slots of gaps up to ``limit_ms``; ``filled`` tells them."""
    bucket = F.floor(F.col(time) / (step_ms * 100_000))
    out = rolling(bars, ["symbol"], [time], bucket, lambda w: {"_prev": F.lag(time).over(w), "_close": F.lag("close").over(w)}, before=1)
    hole = out.where((F.col(time) - F.col("_prev") > step_ms) & (F.col(time) - F.col("_prev") <= limit_ms))
    slot = F.explode(F.sequence(F.col("_prev") + step_ms, F.col(time) - step_ms, F.lit(step_ms).cast("long")))
    new = hole.select("symbol", slot.alias(time), *[F.col("_close").alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("tick_count"), F.lit(True).alias("filled"))
    old = bars.select("symbol", time, "open", "high", "low", "close", F.col("tick_count").cast("long").alias("tick_count"), F.lit(False).alias("filled"))
    return old.unionByName(new.where(~market_closed(F.col(time))))


def gap_flags(bars: DataFrame, step_ms: int, weekend_ms: int = 40 * 3_600_000, time: str = "bar") -> DataFrame:
    """Bits for the gap before a bar: 1 gap, 2 weekend, 4 session, 8 missing bars, 16 not a multiple of the step."""
    bucket = F.floor(F.col(time) / (step_ms * 100_000))
    d = F.col(time) - F.col("_prev")
    flag = lambda cond, bit: F.when(cond, bit).otherwise(0)
    bits = flag(d > step_ms, 1) + flag(d > weekend_ms, 2) + flag((d > step_ms) & (d <= weekend_ms), 4) + flag(F.floor(d / step_ms) > 1, 8) + flag(d % step_ms > 0.1 * step_ms, 16)
    out = rolling(bars, ["symbol"], [time], bucket, lambda w: {"_prev": F.lag(time).over(w)}, before=1)
    return out.withColumn("gap_flags", F.coalesce(bits, F.lit(0)).cast("int")).drop("_prev")
