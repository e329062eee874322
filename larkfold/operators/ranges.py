"""Aggregates over the rows within a fixed time of a row, and the first row that passes a price: work in proportion to the rows, however dense they are.

A join of rows with their frames makes rows times frame, and a RANGE frame that slides is summed anew for each row. Here time is cut to blocks as wide as
the frame: a frame is a tail of one block and a head of the next, and both grow as a window walks its block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERGE = {"count": (F.count, lambda a, b: a + b), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def within(df: DataFrame, keys: list[str], time: str, width: int, made: dict[str, tuple[str, Column]], ahead: bool = False) -> DataFrame:
    """Adds aggregates ``{name: (count, sum, max or min; column)}`` over the rows of a key in (t - width, t], or in [t, t + width) with ``ahead``.

    ``time`` is an integer column. Nothing is subtracted, so a NaN or a huge value only counts where it lies in the frame. Rows without a time are each other's frame, as in SQL.
    """
    t = F.col(time).cast("long") * (-1 if ahead else 1)
    own = df.columns
    home = F.floor(t / width)
    homes = [F.struct(home.alias("b"), t.alias("t"), F.lit(True).alias("own")), F.when(t.isNotNull(), F.struct((home + 1).alias("b"), (t + width).alias("t"), F.lit(False).alias("own")))]
    rows = df.withColumns({f"_v{i}": c for i, (_, c) in enumerate(made.values())}).withColumn("_h", F.explode(F.array_compact(F.array(*homes))))
    rows = rows.select(*[F.when(F.col("_h.own"), F.col(c)).alias(c) if c not in keys else F.col(c) for c in own], *[f"_v{i}" for i in range(len(made))], F.col("_h.b").alias("_b"), F.col("_h.t").alias("_t"), F.col("_h.own").alias("_own"))
    cell = Window.partitionBy(*keys, "_b")
    head = cell.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    tail = cell.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    parts = {}
    for i, (kind, _) in enumerate(made.values()):
        agg = MERGE[kind][0]
        parts |= {f"_head{i}": agg(F.when(F.col("_own"), F.col(f"_v{i}"))).over(head), f"_tail{i}": agg(F.when(~F.col("_own"), F.col(f"_v{i}"))).over(tail)}
    rows = rows.withColumns(parts).where("_own")
    return rows.select(*own, *[MERGE[kind][1](F.col(f"_head{i}"), F.col(f"_tail{i}")).alias(name) for i, (name, (kind, _)) in enumerate(made.items())])


def first_touch(entries: DataFrame, ticks: DataFrame, by: str, time: str, price: str, entry: str, width: int, up: Column, down: Column) -> DataFrame:
    """(entry, up_at, down_at): the first time after an entry, less than ``width`` later, at which a price is at least ``up``, and at most ``down``.

    Ticks of one time travel as their highest and lowest price. A block of ``width`` and the next meet its entries; each of them walks a tree of maxima up and
    down, a step a level. Nulls touch nothing, NaN is above all numbers.
    """
    at = F.col(time)
    levels = ticks.where(F.col(by).isNotNull() & at.isNotNull() & F.col(price).isNotNull()).groupBy(F.col(by).alias("_k"), at.alias("_t")).agg(F.max(price).alias("_hi"), F.min(price).alias("_lo"))
    home = F.floor(F.col("_t") / width)
    levels = levels.withColumn("_b", F.explode(F.array(home, home - 1)))
    asks = entries.select(F.col(by).alias("_k"), F.floor(at / width).alias("_b"), F.col(entry).alias("_e"), at.alias("_t"), up.cast("double").alias("_up"), down.cast("double").alias("_down"))

    def touch(e: pa.Table, p: pa.Table) -> pa.Table:
        t0, t = e["_t"].to_numpy(), p["_t"].to_numpy()
        order = np.argsort(t)
        t = t[order]
        made = [e["_e"]]
        for bound, level, turn in (("_up", "_hi", False), ("_down", "_lo", True)):
            known = e[bound].is_valid().to_numpy()
            x, wanted = _ordered(p[level].to_numpy()[order]), _ordered(e[bound].fill_null(0.0).to_numpy())
            found = np.full(len(t0), len(t))
            if len(t) and known.any():
                found[known] = _first(~x if turn else x, np.searchsorted(t, t0[known], "right"), ~wanted[known] if turn else wanted[known])
            hit = found < len(t)
            hit[hit] = t[found[hit]] < t0[hit] + width
            made.append(pa.array(np.where(hit, t[np.minimum(found, max(len(t) - 1, 0))] if len(t) else 0, 0), pa.int64(), mask=~hit))
        return pa.Table.from_arrays(made, names=[entry, "up_at", "down_at"])

    kind = dict(entries.dtypes)[entry]
    return asks.groupBy("_k", "_b").cogroup(levels.groupBy("_k", "_b")).applyInArrow(touch, f"`{entry}` {kind}, up_at long, down_at long")


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order: NaN greatest, both zeros alike."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
    return np.where(np.isnan(x), np.int64(2**63 - 1), bits)


def _first(x: np.ndarray, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each start and wanted value the first place from start on at which x is no less; len(x) if there is none."""
    none = np.iinfo(np.int64).min
    tree = [x]
    while len(tree[-1]) > 1:
        v = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], none)
        tree.append(np.maximum(v[::2], v[1::2]))
    i, level = start.astype(np.int64), np.full(len(start), -1)
    for k, v in enumerate(tree):  # up: what lies right of the path to the root, nearest first
        look = np.flatnonzero((level < 0) & ((i % 2 == 1) | (k == len(tree) - 1)))
        hit = (i[look] < len(v)) & (v[np.minimum(i[look], len(v) - 1)] >= wanted[look])
        level[look[hit]] = k
        i[look[~hit]] += 1
        i[level < 0] >>= 1
    for k in range(len(tree) - 2, -1, -1):  # down: the left child if it has one
        go = np.flatnonzero(level > k)
        left = 2 * i[go]
        i[go] = np.where(tree[k][left] >= wanted[go], left, left + 1)
    return np.where(level >= 0, i, len(x))
