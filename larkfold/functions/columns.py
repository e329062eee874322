"""Column expressions shared by the feature families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num: Column | str, den: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """num / den where the denominator isn't about zero, else null; clipped if bounds are given."""
    out = F.when(F.abs(_c(den)) > TINY, _c(num) / _c(den))
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def finite_or_null(x: Column | str) -> Column:
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ieee_log(x: Column | str) -> Column:
    """Logarithm of a double that is -infinity at 0 and NaN below, where Spark's is null."""
    c = _c(x)
    return F.when(c > 0, F.log(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def ieee_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den of doubles; at a divisor of 0 infinite with the sign of num, or NaN."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d != 0, n / d).when(d == 0, n * F.lit(float("inf")))


def clamp01(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def hour_of(ms: Column | str) -> Column:
    return F.floor(_c(ms) / 3_600_000) % 24


def weekday_of(ms: Column | str) -> Column:
    """Monday 1 to Sunday 7 (1970-01-01 was a Thursday)."""
    return (F.floor(_c(ms) / 86_400_000) + 3) % 7 + 1


def session_flags(ms: Column | str) -> dict[str, Column]:
    """Trading sessions by UTC hour, half-open."""
    h = hour_of(ms)
    spans = {"asia": (0, 8), "london": (7, 16), "ny": (13, 22), "overlap": (13, 16)}
    return {f"session_{k}": ((h >= a) & (h < b)).cast("int") for k, (a, b) in spans.items()}


def session_code(ms: Column | str) -> Column:
    """The most specific session: weekend, overlap, ny, london, asia, else off."""
    h, d = hour_of(ms), weekday_of(ms)
    closed = ((d == 5) & (h >= 22)) | (d == 6) | ((d == 7) & (h < 22))
    return (
        F.when(closed, "weekend_closed").when((h >= 13) & (h < 16), "overlap").when((h >= 13) & (h < 22), "ny")
        .when((h >= 7) & (h < 16), "london").when(h < 8, "asia").otherwise("off")
    )


def time_features(ms: Column | str) -> dict[str, Column]:
    minute_of_day = F.floor(_c(ms) / 60_000) % 1440
    turn, week = minute_of_day / 1440 * 2 * F.pi(), weekday_of(ms) / 7 * 2 * F.pi()
    return {
        "hour": hour_of(ms), "minute": F.floor(_c(ms) / 60_000) % 60, "weekday": weekday_of(ms),
        "time_sin": F.sin(turn), "time_cos": F.cos(turn), "weekday_sin": F.sin(week), "weekday_cos": F.cos(week),
    }
