"""Bar indicators as window expressions, by name. Frames take what rows there are, as the batch engine's do."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from larkfold.operators.series import frame, rolling

EPS = 1e-12

Maker = Callable[[WindowSpec, int], Column]
INDICATORS: dict[str, tuple[Maker, int]] = {}


def indicator(name: str, period: int) -> Callable[[Maker], Maker]:
    def register(f: Maker) -> Maker:
        INDICATORS[name] = (f, period)
        return f

    return register


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(F.abs(b) > EPS, a / b).otherwise(F.lit(empty))


def true_range(w: WindowSpec) -> Column:
    H, L = F.col("high"), F.col("low")
    p = F.lag("close").over(w)
    return F.greatest(H - L, F.abs(H - p), F.abs(L - p))


def _tr(w: WindowSpec, n: int) -> Column:
    """Mean true range. ``_tr`` is made once for all indicators."""
    return F.avg("_tr").over(frame(w, n))


def _span(w: WindowSpec, n: int) -> tuple[Column, Column]:
    f = frame(w, n)
    return F.max("high").over(f), F.min("low").over(f)


@indicator("sma", 20)
def sma(w, n):
    C = F.col("close")
    return ratio(C - F.avg(C).over(frame(w, n)), _tr(w, 14))


@indicator("momentum", 10)
def momentum(w, n):
    C = F.col("close")
    return F.coalesce(C / F.lag(C, n).over(w) - 1, F.lit(0.0))


@indicator("acceleration", 5)
def acceleration(w, n):
    C = F.col("close")
    return F.coalesce((C / F.lag(C, n).over(w) - 1) - (F.lag(C, n).over(w) / F.lag(C, 2 * n).over(w) - 1), F.lit(0.0))


@indicator("linear_slope", 20)
def linear_slope(w, n):
    C = F.col("close")
    f = frame(w, n)
    return ratio(F.coalesce(F.regr_slope(C, F.col("_rn")).over(f), F.lit(0.0)), F.avg(C).over(f))


@indicator("stochastic_k", 14)
def stochastic_k(w, n):
    C = F.col("close")
    hi, lo = _span(w, n)
    return ratio(C - lo, hi - lo, 0.5)


@indicator("williams_r", 14)
def williams_r(w, n):
    C = F.col("close")
    hi, lo = _span(w, n)
    return ratio(C - hi, hi - lo, -0.5)


@indicator("rolling_stddev", 20)
def rolling_stddev(w, n):
    return F.coalesce(F.stddev_pop("_r").over(frame(w, n)), F.lit(0.0))


@indicator("realized_vol", 20)
def realized_vol(w, n):
    return rolling_stddev(w, n) * math.sqrt(252 * 24)


@indicator("compression_ratio", 20)
def compression_ratio(w, n):
    (h1, l1), (h2, l2) = _span(w, max(n // 2, 1)), _span(w, n)
    return F.when(h2 - l2 > EPS, 1 - (h1 - l1) / (h2 - l2)).otherwise(0.0)


@indicator("expansion_ratio", 20)
def expansion_ratio(w, n):
    return ratio(F.col("_tr"), _tr(w, n))


@indicator("range_body_ratio", 1)
def range_body_ratio(w, n):
    C, O, H, L = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    return ratio(H - L, F.abs(C - O), 10.0)


@indicator("high_low_range", 14)
def high_low_range(w, n):
    H, L = F.col("high"), F.col("low")
    return ratio(H - L, _tr(w, n))


@indicator("garman_klass_vol", 20)
def garman_klass_vol(w, n):
    C, O, H, L = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    term = 0.5 * F.pow(F.log(H / L), 2) - (2 * math.log(2) - 1) * F.pow(F.log(C / O), 2)
    return F.sqrt(F.greatest(F.avg(term).over(frame(w, n)), F.lit(0.0)))


@indicator("parkinson_vol", 20)
def parkinson_vol(w, n):
    H, L = F.col("high"), F.col("low")
    return F.sqrt(F.avg(F.pow(F.log(H / L), 2)).over(frame(w, n)) / (4 * math.log(2)))


@indicator("dist_rolling_high", 20)
def dist_rolling_high(w, n):
    C = F.col("close")
    hi, lo = _span(w, n)
    return ratio(C - hi, hi - lo)


@indicator("dist_rolling_low", 20)
def dist_rolling_low(w, n):
    C = F.col("close")
    hi, lo = _span(w, n)
    return ratio(C - lo, hi - lo)


@indicator("breakout_proximity", 20)
def breakout_proximity(w, n):
    C = F.col("close")
    hi, lo = _span(w, n)
    return F.when(hi - lo > EPS, 1 - F.least(hi - C, C - lo) / (hi - lo)).otherwise(0.0)


@indicator("mean_distance", 20)
def mean_distance(w, n):
    C = F.col("close")
    return ratio(C - F.avg(C).over(frame(w, n)), _tr(w, 14))


@indicator("overlap_ratio", 1)
def overlap_ratio(w, n):
    H, L = F.col("high"), F.col("low")
    ph, pl = F.lag(H).over(w), F.lag(L).over(w)
    both = F.least(H, ph) - F.greatest(L, pl)
    return F.coalesce(ratio(F.greatest(both, F.lit(0.0)), F.greatest(H, ph) - F.least(L, pl)), F.lit(0.0))


@indicator("bar_position", 1)
def bar_position(w, n):
    C, H, L = F.col("close"), F.col("high"), F.col("low")
    return ratio(C - L, H - L, 0.5)


@indicator("midline_distance", 20)
def midline_distance(w, n):
    C = F.col("close")
    hi, lo = _span(w, n)
    return ratio(C - (hi + lo) / 2, _tr(w, 14))


@indicator("pivot_distance", 20)
def pivot_distance(w, n):
    C, H, L = F.col("close"), F.col("high"), F.col("low")
    return ratio(C - F.lag((H + L + C) / 3).over(w), _tr(w, 14))


@indicator("abnormal_range", 20)
def abnormal_range(w, n):
    return (F.col("_tr") > 3 * _tr(w, n)).cast("double")


@indicator("volume_rank", 20)
def volume_rank(w, n):
    """Share of the frame's bars with no more ticks than this one."""
    V = F.col("tick_count")
    return F.size(F.filter(F.collect_list(V).over(frame(w, n)), lambda v: v <= V)) / F.count(V).over(frame(w, n))


@indicator("inside_bar", 1)
def inside_bar(w, n):
    H, L = F.col("high"), F.col("low")
    return F.coalesce(((H <= F.lag(H).over(w)) & (L >= F.lag(L).over(w))).cast("double"), F.lit(0.0))


@indicator("outside_bar", 1)
def outside_bar(w, n):
    H, L = F.col("high"), F.col("low")
    return F.coalesce(((H > F.lag(H).over(w)) & (L < F.lag(L).over(w))).cast("double"), F.lit(0.0))


@indicator("pin_bar_bullish", 1)
def pin_bar_bullish(w, n):
    C, O, H, L = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    body, low = F.abs(C - O), F.least(O, C) - L
    return ((low > 2 * body) & (H - F.greatest(O, C) < body)).cast("double")


@indicator("pin_bar_bearish", 1)
def pin_bar_bearish(w, n):
    C, O, H, L = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    body, up = F.abs(C - O), H - F.greatest(O, C)
    return ((up > 2 * body) & (F.least(O, C) - L < body)).cast("double")


@indicator("doji", 1)
def doji(w, n):
    C, O, H, L = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    return ((H - L > EPS) & (F.abs(C - O) < 0.1 * (H - L))).cast("double")


@indicator("squeeze", 20)
def squeeze(w, n):
    """1 where the Bollinger band is inside the Keltner band."""
    C = F.col("close")
    f = frame(w, n)
    return F.coalesce((2 * F.stddev_pop(C).over(f) < 1.5 * _tr(w, n)).cast("double"), F.lit(0.0))


def compute(bars: DataFrame, keys: list[str], order: list[str], bucket: Column, names: dict[str, int | None]) -> DataFrame:
    """Adds indicators (name: period, None for its default) over shared frames, in one window pass."""
    C = F.col("close")
    periods = {k: p or INDICATORS[k][1] for k, p in names.items()}
    reach = 2 * max([14, *periods.values()]) + 1

    def columns(w):
        return [{"_tr": true_range(w), "_r": F.log(C / F.lag(C).over(w))}, {k: INDICATORS[k][0](w, p) for k, p in periods.items()}]

    return rolling(bars, keys, order, bucket, columns, before=reach).drop("_tr", "_r")


OPS = ("gt", "lt", "crosses_above", "crosses_below", "between", "outside")


def condition(spec: dict, w: WindowSpec) -> Column:
    """A condition ``{left, op, right, high?, negate?}`` as a column; ``right`` is a number or a column name."""
    x = F.col(spec["left"])
    side = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    y, op = side(spec["right"]), spec["op"]
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    if op in ("crosses_above", "crosses_below"):
        px = F.lag(x).over(w)
        py = F.lag(y).over(w) if isinstance(spec["right"], str) else y
        out = (x > y) & (px <= py) if op == "crosses_above" else (x < y) & (px >= py)
    elif op in ("between", "outside"):
        inside = (x >= y) & (x <= side(spec["high"]))
        out = inside if op == "between" else ~inside
    else:
        out = x > y if op == "gt" else x < y
    out = F.coalesce(out, F.lit(False))
    return ~out if spec.get("negate") else out


def match(conditions: list[dict], at_least: int, w: WindowSpec) -> Column:
    """True where at least so many of the conditions hold."""
    return sum((condition(c, w).cast("int") for c in conditions), F.lit(0)) >= at_least
