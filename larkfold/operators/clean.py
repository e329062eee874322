"""Cleaning of ticks and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.operators.series import frame, islands, rolling


def valid_quote(max_spread: float = 0.01) -> Column:
    """bid and ask positive, not crossed, spread within a share of the mid."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return F.coalesce((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") <= F.col("ask")) & (F.try_divide(F.col("ask") - F.col("bid"), mid) <= max_spread), F.lit(False))


def clean_report(ticks: DataFrame, max_spread: float = 0.01) -> DataFrame:
    """Rows each check removes, in one pass: a row counts at the first check it fails."""
    mid = (F.col("bid") + F.col("ask")) / 2
    failed = (
        F.when(F.col("bid").isNull() | F.col("ask").isNull(), "null").when((F.col("bid") <= 0) | (F.col("ask") <= 0), "non_positive")
        .when(F.col("bid") > F.col("ask"), "crossed").when(F.try_divide(F.col("ask") - F.col("bid"), mid) > max_spread, "wide").otherwise("kept")
    )
    return ticks.groupBy(failed.alias("stage")).agg(F.count("*").alias("n"))


def drop_spikes(ticks: DataFrame, keys: list[str], order: list[str], bucket: Column, n: int = 20, limit: float = 0.02) -> DataFrame:
    """Drops rows whose mid is further than ``limit`` from the median of the last n rows; the first n rows of a series stay."""
    mid = (F.col("bid") + F.col("ask")) / 2

    def columns(w):
        return {"_med": F.percentile(mid, F.lit(0.5)).over(frame(w, n))}

    out = rolling(ticks, keys, order, bucket, columns, before=n, keep_ordinal=True)
    return out.where((F.col("_rn") < n) | (F.try_divide(F.abs(mid - F.col("_med")), "_med") <= limit)).drop("_med", "_rn")


def stale_runs(ticks: DataFrame, keys: list[str], order: list[str], bucket: Column, limit: int) -> DataFrame:
    """Drops runs of more than ``limit`` equal quotes, whole. Only a row with ``limit`` equal neighbours on one stretch is in such a run,
    so frames of that reach decide it."""
    same = (F.col("bid") == F.col("_pb")) & (F.col("ask") == F.col("_pa"))

    def columns(w):
        run = islands(~F.coalesce(same, F.lit(False)), w)
        return [
            {"_pb": F.lag("bid").over(w), "_pa": F.lag("ask").over(w)},
            {"_run": run},
            {"_len": F.count("*").over(Window.partitionBy(*keys, "_b", "_run"))},
        ]

    return rolling(ticks, keys, order, bucket, columns, before=limit + 1, after=limit + 1).where(F.col("_len") <= limit).drop("_pb", "_pa", "_run", "_len")


def repair_bars(bars: DataFrame) -> DataFrame:
    """Drops bars with non-positive or non-finite prices or without ticks; makes high and low the extremes."""
    ohlc = [F.col(c) for c in ("open", "high", "low", "close")]
    sound = F.lit(True)
    for c in ohlc:
        sound = sound & (c > 0) & ~F.isnan(c) & (c != F.lit(float("inf")))
    return bars.where(F.coalesce(sound & (F.col("tick_count") > 0), F.lit(False))).withColumns({"high": F.greatest(*ohlc), "low": F.least(*ohlc)})


def dedup(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row a key: the last (or first) by ``order``. An aggregate, so copies meet on the map side and a hot key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def fill_forward(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str]) -> DataFrame:
    """Last value that isn't null, however far back: inside a bucket by a window, across buckets by one row a bucket."""
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "_bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_e_{c}") for c in columns])
    ins = ends.select(*keys, "_bucket", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_i_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(ins, [*keys, "_bucket"]).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_i_{c}")) for c in columns})
    return out.drop("_bucket", *[f"_i_{c}" for c in columns])


def cleaning_stages(ticks: DataFrame, keys: list[str], order: list[str], bucket: Column, max_spread: float = 0.01, max_jump: float = 0.02, stale_limit: int = 50) -> DataFrame:
    """Every distinct row with the stage that removes it (null: it stays) and ``copies``, how often it came. Stages, each on what those before it left:
    repeated rows, prices that are null, not positive or crossed, spread, mid further than ``max_jump`` from the median of the last 20 (of a
    series the first 20 are exempt), and whole runs of more than ``stale_limit`` equal quotes."""
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = ticks.groupBy(*ticks.columns).agg(F.count("*").alias("copies"))
    bad = F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") <= 0) | (F.col("bid") > F.col("ask"))
    rows = rows.withColumn("stage", F.when(bad, "invalid_price").when(F.try_divide(F.col("ask") - F.col("bid"), mid) > max_spread, "spread"))
    out = rows.where("stage is not null")
    jump = F.try_divide(F.abs(mid - F.col("_med")), "_med") > max_jump

    def medians(w):
        f = frame(w, 20)
        return {"_med": F.when(F.count("*").over(f) >= 20, F.percentile(mid, F.lit(0.5)).over(f))}

    left = rolling(rows.where("stage is null"), keys, order, bucket, medians, before=20, keep_ordinal=True)
    left = left.withColumn("stage", F.when((F.col("_rn") >= 20) & F.coalesce(jump, F.lit(False)), "price_spike")).drop("_med", "_rn")
    fresh = left.where("stage is null")
    kept = stale_runs(fresh, keys, order, bucket, stale_limit)
    stale = fresh.join(kept.select(*ticks.columns), ticks.columns, "left_anti").withColumn("stage", F.lit("stale"))
    return out.unionByName(left.where("stage is not null")).unionByName(stale).unionByName(kept)


def cleaning_counts(stages: DataFrame) -> DataFrame:
    """(stage, n): rows that came, that each stage removed, and that stay."""
    removed = ("invalid_price", "spread", "price_spike", "stale")
    n = stages.agg(
        F.sum("copies").alias("input"), (F.sum("copies") - F.count("*")).alias("duplicates"), *[F.count_if(F.col("stage") == s).alias(s) for s in removed], F.count_if(F.col("stage").isNull()).alias("output")
    )
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in n.columns])).alias("x")).select("x.*")
