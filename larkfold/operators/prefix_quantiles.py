"""Exact quantiles of all rows before each row of a series, without a walk of the series.

The n values of a series get their place in time p and their rank r. Both are cut into blocks of B >= sqrt(n), so that cells
of (time block, rank block) are at most n. What lies before a time block is known by rank block from the cells' counts; a task that has that
and the ranks of one time block finds for each of its rows which rank block holds the wanted order statistic, and
how deep in it. A second task for each pair of a rank block and a time block that asks it has the rank block's values (at most B) and finds them.
Both searches are one descent of a wavelet matrix for all rows of the task at once.

Defined cases: nulls and NaN aren't counted but get a quantile of what is before them; with fewer than ``least`` values before, null; equal
values are told apart by time; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.operators.blocks import kinds
from larkfold.operators.series import ordinal, running
from larkfold.scratch import written

#: Least number of values in a block of time or rank, and parts in which a rank block's values are dealt to the time blocks that ask it.
LEAST, PARTS = 65_536, 32


def kth(a: np.ndarray, bits: int, prefix: np.ndarray, k: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By query: the k-th smallest of a[:prefix] (0-based), and how many of that value come before the k-th.

    ``more[v]`` further elements of value v count in every prefix. A level of the wavelet matrix a bit, all queries together."""
    extra = np.concatenate([[0], np.cumsum(more if more is not None else np.zeros(1, int))])
    extra = np.concatenate([extra, np.full(max(0, (1 << bits) + 1 - len(extra)), extra[-1])])
    k, value, lo, hi = k.copy(), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), prefix.astype(np.int64)
    for bit in reversed(range(bits)):
        zero = ((a >> bit) & 1) == 0
        rank = np.concatenate([[0], np.cumsum(zero)])
        lo0, hi0 = rank[lo], rank[hi]
        left = hi0 - lo0 + extra[value + (1 << bit)] - extra[value]
        right = k >= left
        k = np.where(right, k - left, k)
        lo, hi = np.where(right, rank[-1] + lo - lo0, lo0), np.where(right, rank[-1] + hi - hi0, hi0)
        value = value + (right.astype(np.int64) << bit)
        a = np.concatenate([a[zero], a[~zero]])
    return value, k


def expanding_quantiles(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, quantiles: dict[str, float], least: int = 1, block: int = LEAST) -> DataFrame:
    """Adds a column for each quantile (linear between order statistics) of the values of the rows before."""
    x = F.col(value).cast("double")
    there = x.isNotNull() & ~F.isnan(x)
    rows = ordinal(df, keys, order, bucket, "_t")
    rows = running(rows, keys, ["_t"], (F.col("_t") / LEAST).cast("long"), {"_m": there.cast("long")}).withColumn("_m", F.col("_m") - there.cast("long"))
    rows = written(rows, "quantile-rows")
    points = rows.where(there).select(*keys, x.alias("_x"), F.col("_m").alias("_p"))
    placed = written(points.repartitionByRange(*keys, "_x", "_p").withColumn("_range", F.spark_partition_id()), "quantile-points")
    most = placed.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    b = max(block, math.isqrt(most) + 1)
    part = lambda c: (F.col(c) / b).cast("long")
    points = written(ordinal(placed, keys, ["_x", "_p"], F.col("_range"), "_r").select(*keys, "_x", "_p", "_r", part("_p").alias("_tb"), part("_r").alias("_vb")), "quantile-ranks")

    # counts by rank block of what is before each time block: a cell's running count holds until the rank block's next cell
    cells = points.groupBy(*keys, "_tb", "_vb").agg(F.count("*").alias("_n"))
    last = points.groupBy(*keys).agg(F.max("_tb").alias("_last"))
    w = Window.partitionBy(*keys, "_vb").orderBy("_tb")
    upto = cells.join(last, keys).select(*keys, "_vb", F.sum("_n").over(w).alias("_before"), (F.col("_tb") + 1).alias("_a"), F.coalesce(F.lead("_tb").over(w), F.col("_last")).alias("_z"))
    starts = upto.where("_a <= _z").select(*keys, F.explode(F.sequence("_a", "_z")).alias("_tb"), "_vb", "_before")
    starts = starts.toDF(*starts.columns)  # names of their own beside those of ``points``

    named = list(quantiles.items())
    own = kinds(points, keys)

    def locate(inside: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        inside = inside.sort_values("_p", ignore_index=True)
        ranges = int(max(inside["_vb"].max(), before["_vb"].max() if len(before) else 0)) + 1
        more = np.zeros(ranges, np.int64)
        more[before["_vb"].to_numpy(np.int64)] = before["_before"].to_numpy(np.int64)
        m = inside["_p"].to_numpy(np.int64) + 1  # rows so far, this one included
        out = []
        for i, (_, q) in enumerate(named):
            h = q * (m - 1)
            low = np.floor(h).astype(np.int64)
            for side, k in enumerate((low, np.minimum(low + 1, m - 1))):
                vb, deep = kth(inside["_vb"].to_numpy(np.int64), max(1, (ranges - 1).bit_length()), np.arange(1, len(m) + 1), k, more)
                out.append(pd.DataFrame({"_m": m, "_which": 2 * i + side, "_vb": vb, "_k": deep}))
        out = pd.concat(out, ignore_index=True)
        return out.assign(_tb=inside["_tb"][0], **{c: inside[c][0] for c in keys})[[*keys, "_tb", "_vb", "_m", "_which", "_k"]]

    asked = points.drop("_x", "_r").groupBy(*keys, "_tb").cogroup(starts.groupBy(*keys, "_tb")).applyInPandas(locate, f"{own}, _tb long, _vb long, _m long, _which int, _k long")
    asked = written(asked, "quantile-asked")

    # a rank block's values go to each time block that asks it, dealt in parts
    deal = (F.col("_r") % PARTS).cast("int").alias("_part")
    pairs = asked.select(*keys, "_tb", "_vb").distinct().select(*keys, F.col("_tb").alias("_by"), "_vb", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    dealt = points.select(*keys, "_x", "_p", "_r", "_tb", "_vb", deal).join(pairs, [*keys, "_vb", "_part"]).where("_tb <= _by").select(*keys, F.col("_by").alias("_tb"), "_vb", "_p", "_r", "_x")
    dealt = dealt.toDF(*dealt.columns)

    def find(ask: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("_r", ignore_index=True)
        when = np.argsort(values["_p"].to_numpy(), kind="stable")  # local ranks in order of time
        prefix = np.searchsorted(values["_p"].to_numpy()[when], ask["_m"].to_numpy())
        at, _ = kth(when.astype(np.int64), max(1, int(len(when) - 1).bit_length()), prefix, ask["_k"].to_numpy(np.int64))
        return ask.assign(_x=values["_x"].to_numpy()[at])[[*keys, "_m", "_which", "_x"]]

    found = asked.groupBy(*keys, "_tb", "_vb").cogroup(dealt.groupBy(*keys, "_tb", "_vb")).applyInPandas(find, f"{own}, _m long, _which int, _x double")
    each = [F.max(F.when(F.col("_which") == i, F.col("_x"))).alias(f"_{i}") for i in range(2 * len(named))]
    wide = found.groupBy(*keys, "_m").agg(*each)
    share = lambda q: q * (F.col("_m") - 1) - F.floor(q * (F.col("_m") - 1))
    made = {n: F.when(F.col("_m") >= least, F.col(f"_{2 * i}") + share(q) * (F.col(f"_{2 * i + 1}") - F.col(f"_{2 * i}"))) for i, (n, q) in enumerate(named)}
    out = rows.join(wide, [*keys, "_m"], "left").withColumns(made)
    return out.select(*df.columns, *quantiles)
