"""State machines whose next step depends on what they accepted, over long series without a walk of a whole series.

``accepted`` marks the values within a share of the last accepted one. What a block does to the value that enters it is a step
function: the first value of the block that it accepts decides how the block goes on, and nearly all paths soon run into the
same one. A block is summed up as that function, a few pieces long, found from its last row to its first; the functions of a
series are applied in order to what enters, one row a block; a second walk of each block then knows its entry.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.blocks import BLOCK, each_block, element, kinds, numbers, pack
from larkfold.operators.clean import fill_forward
from larkfold.operators.series import ordinal, rolling
from larkfold.scratch import written


class Steps:
    """A step function on the positive numbers: ``values[i]`` from ``edges[i]`` to before ``edges[i + 1]``. NaN stands for what enters itself."""

    def __init__(self, edges: list[float] | None = None, values: list[float] | None = None) -> None:
        self.edges, self.values = edges or [0.0], values or [float("nan")]

    def __call__(self, x: float) -> float:
        v = self.values[bisect_right(self.edges, x) - 1]
        return x if v != v else v

    def paint(self, lo: float, hi: float, value: float) -> None:
        """From now on ``value`` from lo to before hi."""
        i, j = bisect_right(self.edges, lo) - 1, bisect_right(self.edges, hi) - 1
        edges, values = [lo, hi], [value, self.values[j]]
        if self.edges[j] == hi:
            j -= 1
            values[1] = self.values[j + 1]
            edges, values, j = [lo], [value], j
        if self.edges[i] < lo:
            edges, values = [self.edges[i], *edges], [self.values[i], *values]
        self.edges[i : j + 1], self.values[i : j + 1] = edges, values
        self._merge(max(i - 1, 0), i + 4)

    def _merge(self, a: int, b: int) -> None:
        """Neighbours of one value become one piece."""
        i = max(a, 1)
        while i < min(b, len(self.edges)):
            u, v = self.values[i - 1], self.values[i]
            if u == v or (u != u and v != v):
                del self.edges[i], self.values[i]
                b -= 1
            else:
                i += 1


def accepts(last: float, x: float, share: float) -> bool:
    return abs(x - last) / last <= share


def entries_accepting(x: float, share: float) -> tuple[float, float]:
    """The last accepted values with which x is accepted: from the first number to before the second, exact to the last bit."""
    lo, hi = x / (1 + share), (x / (1 - share) if share < 1 else float("inf"))
    while accepts(np.nextafter(lo, 0), x, share) and np.nextafter(lo, 0) > 0:
        lo = float(np.nextafter(lo, 0))
    while not accepts(lo, x, share):
        lo = float(np.nextafter(lo, np.inf))
    if hi == float("inf"):
        return lo, hi
    while not accepts(hi, x, share):
        hi = float(np.nextafter(hi, 0))
    while accepts(hi, x, share):
        hi = float(np.nextafter(hi, np.inf))
    return lo, hi


def block_steps(values: np.ndarray, share: float) -> Steps:
    """What a block makes of the last accepted value that enters it."""
    after = Steps()
    for x in reversed(values.tolist()):
        after.paint(*entries_accepting(x, share), after(x))
    return after


def walk_accepted(values: np.ndarray, entry: float | None, share: float) -> np.ndarray:
    out, last = np.zeros(len(values), bool), entry
    for i, x in enumerate(values.tolist()):
        if last is None or accepts(last, x, share):
            out[i], last = True, x
    return out


def accepted(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, ids: list[str], share: float, block: int = BLOCK) -> DataFrame:
    """(keys, ids, accepted) of rows with a positive value: the first of a series, and each within ``share`` of the last accepted one before it."""
    rows = df.where(F.col(value) > 0)
    blocks = written(pack(rows, keys, order, bucket, {**{i: i for i in ids}, "_v": value}, block), "accepted-blocks")

    def steps(row: dict) -> dict:
        v = numbers(row["_v"])
        f = block_steps(v, share)
        start = float("nan")
        if row["_first"] == 0:
            start = v[np.flatnonzero(walk_accepted(v, None, share))[-1]]
        return {k: [row[k]] for k in [*keys, "_b"]} | {"edges": np.array([f.edges]), "values": np.array([f.values]), "start": [start]}

    ends = each_block(blocks, steps, f"{kinds(blocks, keys)}, _b long, edges array<double>, values array<double>, start double")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)  # one row a block
        entry = [None, *pdf["start"][:1]]
        for e, v in zip(pdf["edges"][1:], pdf["values"][1:], strict=True):
            entry.append(Steps(list(e), [float("nan") if x is None else x for x in v])(entry[-1]))
        return pdf[[*keys, "_b"]].assign(entry=entry[: len(pdf)])

    carried = ends.groupBy(*keys).applyInPandas(carry, f"{kinds(blocks, keys)}, _b long, entry double")

    def mark(row: dict) -> dict:
        v = numbers(row["_v"])
        entry = row["entry"] if row["_b"] else None
        return {k: [row[k]] * len(v) for k in keys} | {i: row[i] for i in ids} | {"accepted": walk_accepted(v, entry, share)}

    return each_block(blocks.join(carried, [*keys, "_b"]), mark, f"{kinds(blocks, keys)}, {kinds(blocks, ids, element)}, accepted boolean")


def validate_ticks(ticks: DataFrame, keys: list[str], order: list[str], bucket: Column, max_spread: float, max_jump: float, max_gap_ms: int, identity: str = "event_id", time: str = "time_msc") -> DataFrame:
    """Adds ``reason`` (null: accepted) and ``gap`` (more than the limit since the accepted tick before) to ticks with ``bid`` and ``ask``.

    Reasons in order: non-positive price (a null price too), crossed, spread too wide, and a jump of the mid from the last accepted tick's. Rows are told apart by ``identity``."""
    bid, ask = F.col("bid"), F.col("ask")
    bad = F.when(~F.coalesce((bid > 0) & (ask > 0), F.lit(False)), "non_positive").when(ask < bid, "crossed").when(ask - bid > max_spread, "wide_spread")
    judged = ticks.withColumns({"reason": bad, "_mid": (bid + ask) / 2})
    marks = accepted(judged.where("reason is null"), keys, order, bucket, "_mid", [identity], max_jump)
    marked = judged.join(marks.select(identity, "accepted"), identity, "left")
    marked = marked.withColumn("reason", F.when(F.col("accepted") == False, "price_jump").otherwise(F.col("reason"))).drop("accepted")  # noqa: E712
    # the time of the accepted tick before: carried forward over what was rejected
    timed = marked.withColumn("_at", F.when(F.col("reason").isNull(), F.col(time)))
    before = rolling(timed, keys, order, bucket, lambda w: {"_seen": F.lag("_at").over(w)}, before=1)
    before = fill_forward(before, keys, order, bucket, ["_seen"])
    gap = F.col("reason").isNull() & F.coalesce(F.col(time) - F.col("_seen") > max_gap_ms, F.lit(False))
    return before.withColumn("gap", gap).drop("_mid", "_at", "_seen")


def halftrend(bars: DataFrame, keys: list[str], order: list[str], bucket: Column, amplitude: int = 2, period: int = 100, width: float = 1.5) -> DataFrame:
    """Adds ``trend`` (UP, DOWN, FLAT), the bands, and ``strength`` (at most 3) of the close beyond them; FLAT until ``period`` bars have a true range."""
    close = F.col("close")

    def columns(w):
        last = w.rowsBetween(-(amplitude - 1), 0)
        spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
        return [
            {"_pc": F.lag("close").over(w)},
            {"_tr": F.when(F.col("_pc").isNotNull(), spread)},
            {"_n": F.count("_tr").over(w.rowsBetween(-(period - 1), 0)), "_atr": F.avg("_tr").over(w.rowsBetween(-(period - 1), 0)), "_hi": F.max("high").over(last), "_lo": F.min("low").over(last)},
        ]

    df = rolling(bars, keys, order, bucket, columns, before=period + 1)
    ready = F.col("_n") >= max(period, amplitude)
    df = df.withColumns({"atr": F.when(ready, F.col("_atr")), "upper": F.when(ready, F.col("_hi") - F.col("_atr") * width), "lower": F.when(ready, F.col("_lo") + F.col("_atr") * width)})
    trend = F.when(close > F.col("upper"), "UP").when(close < F.col("lower"), "DOWN").otherwise("FLAT")
    beyond = F.when(F.col("trend") == "UP", close - F.col("upper")).when(F.col("trend") == "DOWN", F.col("lower") - close)
    df = df.withColumn("trend", trend).withColumn("strength", F.coalesce(F.when(beyond.isNotNull(), F.least(F.try_divide(F.abs(beyond), F.col("atr")), F.lit(3.0))), F.lit(0.0)))
    return df.drop("_pc", "_tr", "_n", "_atr", "_hi", "_lo")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], bucket: Column, label: str, out: str, off: str | None = None) -> DataFrame:
    """Adds how many rows in a row have had the label, this one included; 0 where it is ``off``. The start of a run is carried forward, however far back."""
    df = ordinal(df, keys, order, bucket).withColumn("_at", F.col("_rn"))
    df = rolling(df.drop("_rn"), keys, order, bucket, lambda w: {"_start": F.when(~F.lag(label).over(w).eqNullSafe(F.col(label)) | F.lag("_at").over(w).isNull(), F.col("_at"))}, before=1)
    df = fill_forward(df, keys, order, bucket, ["_start"])
    length = F.col("_at") - F.col("_start") + 1
    return df.withColumn(out, F.when(F.col(label) == off, 0).otherwise(length) if off is not None else length).drop("_at", "_start")


