"""Indicators that rest on recurrences (exponential means, Wilder's range and strength, adaptive mean) or on runs, and the patterns built on them.

All exponential means start at the first bar; Wilder's range is the plain mean of the true ranges until its period is full. A series is walked in blocks
joined by their ends (``series.recurrences``), frames take what rows there are, and a run's start is carried over buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from larkfold.operators.clean import fill_forward
from larkfold.operators.indicators import true_range
from larkfold.operators.series import frame, recurrences, rolling

EPS = 1e-8
FAST, SLOW, SIGNAL = 2 / 3, 2 / 31, 0.2  # fixed values: the adaptive mean's fastest and slowest weight, the signal's weight

Made = dict[str, Column]
#: name: (maker, period, what it needs of the recurrences). A maker gives the steps of columns that end in the indicator, from the window and the period.
STUDIES: dict[str, tuple[Callable[[WindowSpec, int], list[Made]], int, tuple[str, ...]]] = {}
#: name: (column whose rises and falls are counted, period, the indicator from the signed length of the run).
RUNS: dict[str, tuple[str, int, Callable[[Column, int], Column]]] = {}


def study(name: str, period: int, *needs: str):
    """Registers an indicator. ``needs`` name recurrences as ``atr:14`` or ``ema:n`` (n: the indicator's own period)."""

    def register(f):
        def steps(w: WindowSpec, n: int) -> list[Made]:
            made = f(w, n)
            *first, last = made if isinstance(made, list) else [made]
            return [*first, {name: last}]

        STUDIES[name] = (steps, period, needs)
        return f

    return register


def _by(a: Column, b: Column) -> Column:
    return a / F.when(b > EPS, b).otherwise(1.0)


def _cut(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").cast("double")


def _back(c: Column, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(c, k).over(w)


def _before(w: WindowSpec, n: int, skip: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the n rows that end ``skip`` rows back."""
    f = w.rowsBetween(-(n + skip - 1), -skip)
    return F.max(F.col("high")).over(f), F.min(F.col("low")).over(f)


def _rank(c: Column, w: WindowSpec, n: int) -> Column:
    """Share of the last n values that are below this one."""
    seen = F.collect_list(c).over(frame(w, n))
    return F.size(F.filter(seen, lambda v: v < c)) / F.size(seen)


def _deviation(w: WindowSpec, n: int) -> Column:
    return F.coalesce(F.stddev_samp("_r").over(frame(w, n)), F.lit(0.0))


def _slope(w: WindowSpec, n: int) -> Column:
    """Least-squares slope of the last n closes; null until there are n."""
    f = frame(w, n)
    return F.when(F.count(F.col("close")).over(f) >= n, F.regr_slope(F.col("close"), F.col("_rn")).over(f))


@study("ema", 20, "ema:n", "atr:20")
def ema(w, n):
    return _by(F.col("close") - F.col(f"_ema_{n}"), F.col("_atr_20"))


@study("dema", 20, "ema2:n", "atr:14")
def dema(w, n):
    return _by(F.col("close") - (2 * F.col(f"_ema_{n}") - F.col(f"_ema2_{n}")), F.col("_atr_14"))


@study("tema", 20, "ema3:n", "atr:14")
def tema(w, n):
    return _by(F.col("close") - (3 * F.col(f"_ema_{n}") - 3 * F.col(f"_ema2_{n}") + F.col(f"_ema3_{n}")), F.col("_atr_14"))


@study("kama", 20, "kama:n", "atr:14")
def kama(w, n):
    return _by(F.col("close") - F.col(f"_kama_{n}"), F.col("_atr_14"))


@study("macd_line", 12, "ema:12", "ema:26", "atr:14")
def macd_line(w, n):
    return _by(F.col("_ema_12") - F.col("_ema_26"), F.col("_atr_14"))


@study("macd_signal", 12, "signal:12", "atr:14")
def macd_signal(w, n):
    return _by(F.col("_signal_12"), F.col("_atr_14"))


@study("macd_histogram", 12, "signal:12", "atr:14")
def macd_histogram(w, n):
    return _by(F.col("_ema_12") - F.col("_ema_26") - F.col("_signal_12"), F.col("_atr_14"))


@study("rsi", 14, "rsi:n")
def rsi(w, n):
    up, down = F.col(f"_up_{n}"), F.col(f"_down_{n}")
    strength = F.when(down > EPS, up / F.when(down > EPS, down)).otherwise(100.0)
    return F.when(F.col("_rn") <= n, 0.5).otherwise(1 - 1 / (1 + strength))


@study("atr_rank", 14, "atr:n")
def atr_rank(w, n):
    return _rank(F.col(f"_atr_{n}"), w, max(5 * n, 50))


@study("keltner_width", 20, "ema:n", "atr:n")
def keltner_width(w, n):
    return F.when(F.col(f"_ema_{n}") > EPS, 4 * F.col(f"_atr_{n}") / F.col(f"_ema_{n}")).otherwise(0.0)


@study("wma", 20, "atr:20")
def wma(w, n):
    seen = F.collect_list(F.col("close")).over(frame(w, n))
    total = F.aggregate(F.transform(seen, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return _by(F.col("close") - total / (F.size(seen) * (F.size(seen) + 1) / 2), F.col("_atr_20"))


@study("cci", 20)
def cci(w, n):
    f, typical = frame(w, n), (F.col("high") + F.col("low") + F.col("close")) / 3
    seen, mean = F.collect_list(typical).over(f), F.avg(typical).over(f)
    off = F.aggregate(F.transform(f"_seen_{n}", lambda v: F.abs(v - F.col(f"_mean_{n}"))), F.lit(0.0), lambda a, v: a + v) / F.size(f"_seen_{n}")
    return [{f"_seen_{n}": seen, f"_mean_{n}": mean}, {f"_off_{n}": off}, _cut(F.when(F.col(f"_off_{n}") > EPS, (typical - F.col(f"_mean_{n}")) / (1.5 * F.when(F.col(f"_off_{n}") > EPS, F.col(f"_off_{n}")))).otherwise(0.0), -1, 1)]


@study("trend_strength", 20)
def trend_strength(w, n):
    return sum((F.coalesce(F.signum(_slope(w, p)), F.lit(0.0)) for p in (n, 2 * n, 4 * n)), F.lit(0.0)) / 3


@study("range_percentile", 50)
def range_percentile(w, n):
    return _rank(F.col("high") - F.col("low"), w, n)


@study("volume_climax", 20)
def volume_climax(w, n):
    return _flag(_rank(F.col("tick_count"), w, n) > 0.95)


@study("vol_change", 20)
def vol_change(w, n):
    p = _back(F.col(f"_sd_{n}"), w)
    return [{f"_sd_{n}": _deviation(w, n)}, F.coalesce(F.when(p > EPS, F.col(f"_sd_{n}") / F.when(p > EPS, p) - 1), F.lit(0.0))]


@study("bollinger_width", 20)
def bollinger_width(w, n):
    mean = F.avg(F.col("close")).over(frame(w, n))
    return F.when(mean > EPS, 4 * _deviation(w, n) * F.col("close") / mean).otherwise(0.0)


@study("vol_of_vol", 20)
def vol_of_vol(w, n):
    f = frame(w, n)
    mean = F.avg(f"_sd_{n}").over(f)
    return [{f"_sd_{n}": _deviation(w, n)}, F.when(mean > EPS, F.coalesce(F.stddev_samp(f"_sd_{n}").over(f), F.lit(0.0)) / mean).otherwise(0.0)]


@study("squeeze_fire", 20, "atr:n")
def squeeze_fire(w, n):
    sd, a = F.col(f"_sd_{n}"), F.col(f"_atr_{n}")
    return [{f"_sd_{n}": _deviation(w, n)}, _flag((_back(sd, w) * 2 < _back(a, w) * 1.5) & (sd * 2 > a * 1.5))]


@study("channel_position", 50)
def channel_position(w, n):
    f = frame(w, n)
    off = F.col("close") - F.avg(F.col("close")).over(f) - _slope(w, n) * (n - 1) / 2
    spread = F.sqrt(F.greatest(F.var_pop(F.col("close")).over(f) - F.pow(_slope(w, n), F.lit(2)) * ((n * n - 1) / 12), F.lit(0.0)))
    return F.coalesce(F.when(spread > EPS, _cut(off / F.when(spread > EPS, spread), -1, 1)), F.lit(0.0))


def _touches(side: Column, w: WindowSpec, n: int) -> Column:
    near = F.collect_list(side).over(w.rowsBetween(-(n - 1), -1))
    return _cut(F.size(F.filter(near, lambda v: F.abs(v - side) < F.col("_atr_14") / 2)) / max(0.3 * n, 1.0), 0, 1)


@study("support_strength", 50, "atr:14")
def support_strength(w, n):
    return _touches(F.col("low"), w, n)


@study("resistance_strength", 50, "atr:14")
def resistance_strength(w, n):
    return _touches(F.col("high"), w, n)


@study("local_extrema_count", 20)
def local_extrema_count(w, n):
    top = (_back(F.col("high"), w) > _back(F.col("high"), w, 2)) & (_back(F.col("high"), w) > F.col("high"))
    low = (_back(F.col("low"), w) < _back(F.col("low"), w, 2)) & (_back(F.col("low"), w) < F.col("low"))
    return [{"_turns": _flag(top) + _flag(low)}, F.sum("_turns").over(frame(w, n - 2))]


@study("breakout_attempt", 20)
def breakout_attempt(w, n):
    hi, lo = _before(w, n, 1)
    near = F.least(hi - F.col("close"), F.col("close") - lo) / F.when(hi - lo >= EPS, hi - lo)
    return F.coalesce(_cut(1 - 5 * near, 0, 1), F.lit(0.0))


@study("breakout_failure", 20)
def breakout_failure(w, n):
    hi, lo = _before(w, n, 2)
    return _flag(((_back(F.col("high"), w) > hi) | (_back(F.col("low"), w) < lo)) & F.col("close").between(lo, hi))


@study("failed_breakout_reversal", 20)
def failed_breakout_reversal(w, n):
    hi, lo = _before(w, n, 3)
    up, down, middle = F.greatest(_back(F.col("high"), w), _back(F.col("high"), w, 2)) > hi, F.least(_back(F.col("low"), w), _back(F.col("low"), w, 2)) < lo, (hi + lo) / 2
    return _flag((up & (F.col("close") < middle)) | (down & (F.col("close") > middle)))


@study("exhaustion_signal", 10, "atr:n")
def exhaustion_signal(w, n):
    return _flag((F.col("_rn") > 0) & (F.col("high") - F.col("low") > 2.5 * F.col(f"_atr_{n}")) & (F.abs(F.col("close") - F.col("open")) < 0.3 * (F.col("high") - F.col("low"))))


@study("compression_to_expansion", 20, "atr:n")
def compression_to_expansion(w, n):
    a, p = F.col(f"_atr_{n}"), _back(F.col(f"_atr_{n}"), w)
    return _flag((p > EPS) & (_back(F.col("high") - F.col("low"), w) < 0.6 * p) & (a > EPS) & (F.col("high") - F.col("low") > 1.5 * a))


@study("reversal_impulse", 5, "atr:14")
def reversal_impulse(w, n):
    move = F.col("close") - _back(F.col("close"), w)
    return F.when(F.coalesce(move * (_back(F.col("close"), w) - _back(F.col("close"), w, 2)) < 0, F.lit(False)), _cut(_by(move, F.col("_atr_14")), -1, 1)).otherwise(0.0)


@study("mean_reversion_setup", 20, "atr:14")
def mean_reversion_setup(w, n):
    off = _by(F.col("close") - F.avg(F.col("close")).over(frame(w, n)), F.col("_atr_14"))
    return _flag((F.abs(off) > 2) & (off * (F.col("close") - _back(F.col("close"), w)) < 0))


@study("engulfing_bullish", 1)
def engulfing_bullish(w, n):
    po, pc = _back(F.col("open"), w), _back(F.col("close"), w)
    return _flag((pc < po) & (F.col("close") > F.col("open")) & (F.col("close") > po) & (F.col("open") < pc))


@study("engulfing_bearish", 1)
def engulfing_bearish(w, n):
    po, pc = _back(F.col("open"), w), _back(F.col("close"), w)
    return _flag((pc > po) & (F.col("close") < F.col("open")) & (F.col("close") < po) & (F.col("open") > pc))


@study("three_bar_reversal", 1)
def three_bar_reversal(w, n):
    fell, rose = (lambda k: _back(F.col("close"), w, k) < _back(F.col("open"), w, k)), (lambda k: _back(F.col("close"), w, k) > _back(F.col("open"), w, k))
    return _flag(fell(2) & fell(1) & (F.col("close") > F.col("open")) & (F.col("close") > _back(F.col("high"), w))) - _flag(rose(2) & rose(1) & (F.col("close") < F.col("open")) & (F.col("close") < _back(F.col("low"), w)))


@study("momentum_divergence", 20)
def momentum_divergence(w, n):
    hi, lo = _before(w, n, 1)
    now, then = (F.col("close") - _back(F.col("close"), w, n)) / F.greatest(_back(F.col("close"), w, n), F.lit(1.0)), (_back(F.col("close"), w, n) - _back(F.col("close"), w, 2 * n)) / F.greatest(_back(F.col("close"), w, 2 * n), F.lit(1.0))
    then = F.coalesce(then, F.lit(0.0))
    return F.when((F.col("high") > hi) & (now < then), -1.0).when((F.col("low") < lo) & (now > then), 1.0).otherwise(0.0)


def _share_of_steps(step: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.col("_rn") >= n, _cut(F.sum(_flag(step)).over(frame(w, n)) / max(n - 1, 1), 0, 1)).otherwise(0.0)


@study("range_contraction", 10)
def range_contraction(w, n):
    return [{"_step": F.col("high") - F.col("low") - _back(F.col("high") - F.col("low"), w)}, _share_of_steps(F.col("_step") < 0, w, n)]


@study("range_expansion", 10)
def range_expansion(w, n):
    return [{"_step": F.col("high") - F.col("low") - _back(F.col("high") - F.col("low"), w)}, _share_of_steps(F.col("_step") > 0, w, n)]


@study("higher_low_setup", 10)
def higher_low_setup(w, n):
    return _flag((F.col("_rn") >= 3) & (F.col("low") > _back(F.col("low"), w, 2)) & (F.col("close") > _back(F.col("close"), w)))


@study("lower_high_setup", 10)
def lower_high_setup(w, n):
    return _flag((F.col("_rn") >= 3) & (F.col("high") < _back(F.col("high"), w, 2)) & (F.col("close") < _back(F.col("close"), w)))


RUNS["directional_persistence"] = ("close", 10, lambda run, n: _cut(run / max(n / 2, 1.0), -1, 1))
RUNS["persistence_chain"] = ("close", 10, lambda run, n: _cut(run / max(float(n), 1.0), -1, 1))
RUNS["higher_high_count"] = ("high", 10, lambda run, n: F.greatest(run, F.lit(0)).cast("double"))
RUNS["lower_low_count"] = ("low", 10, lambda run, n: F.greatest(-run, F.lit(0)).cast("double"))


def _levels(needs: Iterable[tuple[str, int]]) -> list[dict[str, tuple[Column, Column]]]:
    """Recurrences y = decay * y + x as {name: (x, decay)}, those of a level over columns of the levels before."""
    i, levels = F.col("_rn"), [{}, {}, {}]

    def mean(at: int, name: str, value: Column, alpha: float) -> None:
        levels[at][name] = (F.when(i == 0, value).otherwise(alpha * value), F.lit(1 - alpha))

    for kind, n in needs:
        if kind in ("ema", "ema2", "ema3"):
            value = F.col("close")
            for at, name in enumerate(("ema", "ema2", "ema3")[: int(kind[3:] or 1)]):
                mean(at, f"_{name}_{n}", value, 2 / (n + 1))
                value = F.col(f"_{name}_{n}")
        elif kind == "signal":
            mean(0, "_ema_12", F.col("close"), 2 / 13)
            mean(0, "_ema_26", F.col("close"), 2 / 27)
            mean(1, "_signal_12", F.col("_ema_12") - F.col("_ema_26"), SIGNAL)
        elif kind == "atr":
            levels[0][f"_atr_{n}"] = (F.when(i < n, F.col("_tr") / (i + 1)).otherwise(F.col("_tr") / n), F.when(i < n, i / (i + 1)).otherwise(1 - 1 / n))
        elif kind == "rsi":
            for name, move in ((f"_up_{n}", F.greatest(F.col("_move"), F.lit(0.0))), (f"_down_{n}", F.greatest(-F.col("_move"), F.lit(0.0)))):
                levels[0][name] = (F.when(i < n, move).otherwise(move / n), F.when(i < n, 1.0).when(i == n, 1 / n).otherwise((n - 1) / n))
        elif kind == "kama":
            weight = F.pow(F.col(f"_straight_{n}") * (FAST - SLOW) + SLOW, F.lit(2))
            levels[0][f"_kama_{n}"] = (F.when(i < n, F.col("close")).otherwise(weight * F.col("close")), F.when(i < n, 0.0).otherwise(1 - weight))
    return [level for level in levels if level]


def study_bars(bars: DataFrame, keys: list[str], order: list[str], bucket: Column, names: dict[str, int | None]) -> DataFrame:
    """Adds indicators (name: period, None for its default) of ``STUDIES`` and ``RUNS`` to bars with open, high, low, close and tick_count.

    A series of one bar, or flat bars, give an indicator's neutral value, no null; bars with nulls should be repaired before.
    """
    if unknown := [n for n in names if n not in STUDIES and n not in RUNS]:
        raise ValueError(f"unknown indicators: {', '.join(unknown)}")
    period = {k: p or (STUDIES if k in STUDIES else RUNS)[k][1] for k, p in names.items()}
    needs = sorted({(kind, period[k] if n == "n" else int(n)) for k in names if k in STUDIES for kind, n in (x.split(":") for x in STUDIES[k][2])})
    straight = [n for kind, n in needs if kind == "kama"]
    runs = sorted({RUNS[k][0] for k in names if k in RUNS})

    def base(w):
        p = _back(F.col("close"), w)
        path = {f"_straight_{n}": F.when(F.sum(F.abs("_move")).over(frame(w, n)) > EPS, F.abs(F.col("close") - _back(F.col("close"), w, n)) / F.sum(F.abs("_move")).over(frame(w, n))).otherwise(0.0) for n in straight}
        signs = {f"_sign_{c}": F.coalesce(F.signum(F.col(c) - F.lag(c).over(w)), F.lit(0.0)) for c in runs}
        starts = {f"_start_{c}": F.when(~F.coalesce(F.col(f"_sign_{c}") == F.lag(f"_sign_{c}").over(w), F.lit(False)), F.col("_rn")) for c in runs}
        return [{"_tr": true_range(w), "_r": F.when(p > 0, F.log(F.col("close") / F.when(p > 0, p))), "_move": F.coalesce(F.col("close") - p, F.lit(0.0)), **signs}, {**path, **starts}]

    df = rolling(bars, keys, order, bucket, base, max([3, *(n + 1 for n in straight)]), keep_ordinal=True)
    for level in _levels(needs):
        df = recurrences(df, keys, level)
    if runs:
        df = fill_forward(df, keys, order, bucket, [f"_start_{c}" for c in runs])
        length = {c: (F.col(f"_sign_{c}") * (F.col("_rn") - F.col(f"_start_{c}") + 1)).cast("long") for c in runs}
        df = df.withColumns({k: RUNS[k][2](length[RUNS[k][0]], period[k]) for k in names if k in RUNS})
    studies = [k for k in names if k in STUDIES]

    def columns(w):
        steps = [STUDIES[k][0](w, period[k]) for k in studies]
        return [{c: v for made in steps if len(made) > i for c, v in made[i].items()} for i in range(max(map(len, steps)))]

    if studies:
        df = rolling(df, keys, order, bucket, columns, max(5 * max(period[k] for k in studies), 50) + 4)
    return df.select(*bars.columns, *names)
