"""Technical measures that need recurrences or searches in their own past: directional index, channels, visits of price zones, barriers with excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from larkfold.operators.indicators import true_range
from larkfold.operators.joins import asof
from larkfold.operators.series import linear_recurrence, linear_recurrences, ordinal, rolling


def directional_index(bars: DataFrame, keys: list[str], order: list[str], bucket: Column, n: int = 14, out: str = "adx") -> DataFrame:
    """Adds Wilder's average directional index; 0 while a series has fewer than 2 n bars.

    The sums of true ranges and moves start as plain sums of the first n and lose an n-th of themselves from then on, the index starts
    as a plain mean: linear recurrences, whose decay depends on the ordinal."""
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    plain = F.lit(0.0)

    def columns(w: WindowSpec):
        return [
            {"_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w), "_tr": F.coalesce(true_range(w), plain)},
            {"_tr": F.when(F.col("_ph").isNull(), 0.0).otherwise(F.col("_tr")), "_up": F.coalesce(F.when((up > down) & (up > 0), up), plain), "_down": F.coalesce(F.when((down > up) & (down > 0), down), plain)},
        ]

    df = rolling(bars, keys, order, bucket, columns, before=1, keep_ordinal=True)
    df = df.withColumn("_fade", F.when(F.col("_rn") <= n, 1.0).otherwise(1 - 1 / n))  # bar 0 has no range, bars 1 to n are the first n
    df = linear_recurrences(df, keys, {f"{c}_sum": c for c in ("_tr", "_up", "_down")}, "_fade")
    one, two = (F.try_divide(F.lit(100.0) * F.col(f"{c}_sum"), "_tr_sum") for c in ("_up", "_down"))
    strength = F.coalesce(F.try_divide(F.lit(100.0) * F.abs(one - two), one + two), plain)
    at = F.col("_rn") - n - 1  # the number of the index value
    df = df.withColumns({"_dx": F.when(at >= 0, strength / n).otherwise(0.0), "_fade": F.when(at < n, 1.0).otherwise(1 - 1 / n)})
    df = linear_recurrence(df, keys, "_dx", "_fade", "_adx")
    mean = F.when(at < n, F.col("_adx") * n / (at + 1)).otherwise(F.col("_adx"))
    return df.withColumn(out, F.when(F.col("_rn") >= 2 * n - 1, mean).otherwise(0.0)).select(*bars.columns, out)


def since_visited(bars: DataFrame, keys: list[str], order: list[str], bucket: Column, price: str, share: float, most: int = 999, block: int = 4096) -> DataFrame:
    """Adds ``bars_since``: bars since the price was within a share of what it is now, by zones of that width on a log scale: of the last bar in its
    zone and in two zones on either side the latest that is near enough counts; ``most`` if none is. Five as-of joins by zone, in one."""
    rows = ordinal(bars, keys, order, bucket).withColumn("_zone", F.floor(F.log(price) / F.log1p(F.lit(share)) + 0.5).cast("long"))
    asked = rows.withColumn("_near", F.explode(F.sequence(F.col("_zone") - 2, F.col("_zone") + 2))).drop("_zone")
    held = rows.select(*keys, F.col("_zone").alias("_near"), "_rn", F.col(price).alias("_then"))
    met = asof(asked, held, [*keys, "_near"], "_rn", ["_then"], block, strict=True)
    ago = F.when(F.abs(F.col("_then") - F.col(price)) <= F.col(price) * share, F.col("_rn") - F.col("_rn_matched"))
    return met.groupBy(*bars.columns).agg(F.coalesce(F.min(ago), F.lit(most)).cast("long").alias("bars_since"))


def barrier_with_excursions(price: str, high: str, low: str, horizon: int, up: Column, down: Column, w: WindowSpec) -> Column:
    """struct(label, mae, mfe) over the next ``horizon`` bars: 1 or -1 by the barrier (shares of the price above and below) reached first, the upper one if
    both are in one bar, 0 if none is; the largest moves against and for it as shares of the price, up to the bar that decides. Null without enough bars ahead."""
    ahead = F.collect_list(F.struct(F.col(high).alias("h"), F.col(low).alias("l"))).over(w.rowsBetween(1, horizon))
    p = F.col(price)
    hit = F.transform(ahead, lambda b: F.when(b["h"] >= p * (1 + up), 1).when(b["l"] <= p * (1 - down), -1).otherwise(0))
    first = F.array_position(F.transform(hit, lambda x: x != 0), F.lit(True)).cast("int")
    upto = F.slice(ahead, 1, F.when(first > 0, first).otherwise(horizon))
    best, worst = F.array_max(F.transform(upto, lambda b: b["h"])), F.array_min(F.transform(upto, lambda b: b["l"]))
    out = F.struct(
        F.when(first > 0, F.get(hit, first - 1)).otherwise(0).alias("label"),
        ((p - F.least(p, worst)) / p).alias("mae"), ((F.greatest(p, best) - p) / p).alias("mfe"),
    )
    return F.when((F.size(ahead) == horizon) & (p > 0), out)
