"""Exact quantiles and ranks by key without a key's values in one task.

Equal values meet first (a count for each value, made on the map side), the values of a key are cut to ranges by an approximate
sketch of fixed size, ranges are counted, and only the range that holds a wanted rank is walked in order. The cuts are written: a sketch
depends on the order in which its parts meet, so made again for the walk it would cut elsewhere than for the sums. Keys may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.scratch import written

#: Ranges a key's values are cut to, and the error of the sketch that cuts them (1 / ACCURACY of the rows). They balance the work; results don't depend on them.
RANGES, ACCURACY = 256, 10_000


def joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
    return df.join(other.withColumnsRenamed({k: f"_k_{k}" for k in by}), same).drop(*[f"_k_{k}" for k in by])


def ranges(df: DataFrame, by: list[str], value: str, n: int = RANGES) -> DataFrame:
    """Adds ``_range``: the number of the range of its key that a value is in, rising with the value; nulls come last, in range ``n``. ``n`` - 1 bounds a key."""
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(ACCURACY))
    bounds = written(df.groupBy(*by).agg(cuts.alias("_cuts")), "cuts")
    place = F.when(F.col(value).isNull(), F.lit(n)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    return joined(df, bounds, by).withColumn("_range", place).drop("_cuts")


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], nearest: bool = False, nulls: bool = False) -> DataFrame:
    """(by, n, least, most, distinct, and each named quantile) of the values that aren't null: interpolated between the ranks around (n - 1) q, or of the nearest rank. With ``nulls``, nulls have ranks too, after all values."""
    if not by:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, points, nearest, nulls).drop("_all")
    v = F.col(value)
    counted = written((df if nulls else df.where(v.isNotNull())).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_c")), "counts")  # read for the cuts, for the sums and for the walk
    placed = ranges(counted, by, "_v")
    sums = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"), F.count("_v").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    of_key = Window.partitionBy(*by)
    sums = sums.withColumns({"n": F.sum("_s").over(of_key), "_before": F.coalesce(F.sum("_s").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    at: dict[str, Column] = {}
    for name, q in points.items():
        p = (F.col("n") - 1) * q
        at |= {f"{name}|0": F.floor(p + 0.5) if nearest else F.floor(p), f"{name}|1": F.floor(p + 0.5) if nearest else F.ceil(p)}
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_s"))
    wanted = F.lit(False)
    for r in at.values():
        wanted = wanted | inside(r)
    keys = [*by, "_range"]
    walk = joined(placed, sums.where(wanted).select(*keys, "n", "_before"), keys)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    walk = walk.withColumn("_upto", upto)
    found = walk.groupBy(*by).agg(*[F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), F.col("_v"))).alias(k) for k, r in at.items()])
    whole = sums.groupBy(*by).agg(F.sum("_s").alias("n"), F.min("_lo").alias("least"), F.max("_hi").alias("most"), F.sum("_d").alias("distinct"))
    out = joined(whole, found, by)
    share = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    mixed = {name: F.col(f"`{name}|0`") + (F.lit(0.0) if nearest else share(q) * (F.col(f"`{name}|1`") - F.col(f"`{name}|0`"))) for name, q in points.items()}
    return out.select(*by, "n", "least", "most", "distinct", *[c.alias(k) for k, c in mixed.items()])


def ranked(df: DataFrame, by: list[str], score: str, name: str = "place") -> DataFrame:
    """Adds the rank of a row in its key by falling score, ties alike with the best: counts of ranges, then ranks inside a range."""
    df = ranges(df.withColumn("_s", -F.col(score)), by, "_s")
    keys = [*by, "_range"]
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return joined(df, starts, keys).withColumn(name, F.col("_start") + F.rank().over(Window.partitionBy(*keys).orderBy("_s"))).drop("_s", "_range", "_start")
