"""Time joins: as-of backward, forward and nearest, and interval joins, all shuffled on (key, time block)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    time: str,
    values: list[str],
    block: int,
    direction: str = "backward",
    strict: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Each left row with ``values`` of the last right row at or before it (after it for ``forward``), nulls if there is none.

    ``time`` is an integer column of both sides. Rows meet in blocks of ``block`` time units; a block without a match takes the
    last row of the blocks before, found over one row a block. So a hot key is spread over its blocks. Of
    right rows at one time the greatest by values counts.
    """
    sign = 1 if direction == "backward" else -1
    names = [prefix + v for v in values]
    pack = F.struct(F.col(time).alias("_at"), *[F.col(v) for v in values])
    own = left.columns
    left = left.withColumns({"_t": F.col(time) * sign, "_side": F.lit(0 if strict else 1)}).withColumn("_r", F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType))
    r = right.select(*by, (F.col(time) * sign).alias("_t"), F.lit(1 if strict else 0).alias("_side"), pack.alias("_r"))
    both = left.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("_t") / block))
    last = both.groupBy(*by, "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_b", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    inside = Window.partitionBy(*by, "_b").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_r", ignorenulls=True).over(inside), F.col("_in"))
    out = both.join(carried, [*by, "_b"]).withColumn("_m", found).where("_left")
    return out.select(*own, F.col("_m._at").alias(f"{prefix}{time}_matched"), *[F.col(f"_m.{v}").alias(n) for v, n in zip(values, names, strict=True)])


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], block: int) -> DataFrame:
    """The right row nearest in time; the one before wins a tie."""
    back = asof(left, right, by, time, values, block, prefix="_p_")
    both = asof(back, right, by, time, values, block, direction="forward", prefix="_n_")
    to_back, to_next = F.col(time) - F.col(f"_p_{time}_matched"), F.col(f"_n_{time}_matched") - F.col(time)
    first = to_next.isNull() | (to_back <= to_next)
    return both.select(
        *left.columns,
        F.when(first, F.col(f"_p_{time}_matched")).otherwise(F.col(f"_n_{time}_matched")).alias(f"{time}_matched"),
        *[F.when(first, F.col(f"_p_{v}")).otherwise(F.col(f"_n_{v}")).alias(v) for v in values],
    )


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, cell: int, how: str = "inner") -> DataFrame:
    """Points with the spans [start, end) that hold them: an equi-join on time cells, each span copied to the cells it touches."""
    p = points.withColumn("_cell", F.floor(F.col(time) / cell))
    s = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    on: list[Column] = [p[k] == s[k] for k in [*by, "_cell"]] + [p[time] >= s[start], p[time] < s[end]]
    j = p.join(s, on, how)
    return j.select(*[p[c] for c in points.columns], *[s[c] for c in spans.columns if c not in by])


def align(bars: DataFrame, time: str, symbol: str, values: list[str], symbols: list[str]) -> DataFrame:
    """One row for each time at which all ``symbols`` have a bar, with their values side by side. One shuffle for any number of symbols."""
    aggs = [F.max(F.when(F.col(symbol) == s, F.col(v))).alias(f"{v}_{i}") for i, s in enumerate(symbols) for v in values]
    return (
        bars.where(F.col(symbol).isin(symbols)).groupBy(time).agg(F.countDistinct(symbol).alias("_n"), *aggs).where(F.col("_n") == len(symbols)).drop("_n")
    )


def prefixed(addition: DataFrame, existing: list[str], prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``addition`` whose names ``existing`` has too (case aside, as SQL sees them) get ``prefix_``, again until the name is free; ``keep`` stay as join keys."""
    taken = {c.lower() for c in existing} | {c.lower() for c in addition.columns}
    renamed = {}
    for c in addition.columns:
        if c in keep or c.lower() not in {e.lower() for e in existing}:
            continue
        name = f"{prefix}_{c}"
        while name.lower() in taken:
            name = f"{prefix}_{name}"
        taken.add(name.lower())
        renamed[c] = name
    return addition.withColumnsRenamed(renamed)


def prefixed_join(left: DataFrame, right: DataFrame, keys: list[str], prefix: str, how: str = "left") -> DataFrame:
    """A join by equal names in which columns of the right side never clash with those of the left."""
    return left.join(prefixed(right, left.columns, prefix, tuple(keys)), keys, how)
