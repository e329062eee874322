"""Temporal splits and scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.quantiles import quantiles
from larkfold.operators.series import ordinal


def holdout(df: DataFrame, keys: list[str], order: list[str], bucket: Column, train: float, valid: float, embargo: int = 0) -> DataFrame:
    """Adds ``split``: train, valid and test by time, each later part preceded by ``embargo`` rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    i, a, b = F.col("_rn"), F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + valid))
    split = F.when(i < a, "train").when(i < a + embargo, "embargo").when(i < b, "valid").when(i < b + embargo, "embargo").otherwise("test")
    return ordinal(df, keys, order, bucket).join(n, keys).withColumn("split", split).drop("_rn", "_n")


def walk_forward(df: DataFrame, keys: list[str], order: list[str], bucket: Column, folds: int = 5, train: float = 0.6, gap: float = 0.02, embargo: int = 0) -> DataFrame:
    """A copy of a row for each fold that uses it, with ``fold`` and ``part``. The last 1 - ``train`` of a series are dealt to ``folds`` tests one
    after the other; a fold trains on everything before its test but a gap (a share of the series, ``embargo`` rows at least). Folds without a train row drop out."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    i, step, apart = F.col("_rn"), F.floor(F.col("_n") * (1 - train) / folds), F.greatest(F.floor(F.col("_n") * gap), F.lit(embargo))

    def part(k: int) -> Column:
        start = F.floor(F.col("_n") * train) + k * step
        inside = F.when(start - apart < 1, None).when(i < start - apart, "train").when((i >= start) & (i < start + step), "test")
        return F.when(inside.isNotNull(), F.struct(F.lit(k).alias("fold"), inside.alias("part")))

    out = ordinal(df, keys, order, bucket).join(n, keys).withColumn("_f", F.explode(F.array_compact(F.array(*[part(k) for k in range(folds)]))))
    return out.select("*", "_f.fold", "_f.part").drop("_rn", "_f", "_n")


def folds_by_rule(df: DataFrame, keys: list[str], order: list[str], bucket: Column, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """A copy of a row for each fold that uses it, with ``fold`` and ``part``. ``rule`` gives, from a series' rows n and a row's ordinal i, an array of
    (fold, train_from, train_to, test_from, test_to) that holds every fold the row may be in; ends are exclusive. Rows in no part drop out."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = ordinal(df, keys, order, bucket).join(n, keys).withColumn("_f", F.explode(rule(F.col("_n"), F.col("_rn"))))
    i, f = F.col("_rn"), F.col("_f")
    part = F.when((i >= f.train_from) & (i < f.train_to), "train").when((i >= f.test_from) & (i < f.test_to), "test")
    return out.withColumns({"fold": f.fold.cast("int"), "part": part}).where(F.col("part").isNotNull()).drop("_rn", "_n", "_f")


def _fold(fold: Column, train_from: Column, train_to: Column, test_from: Column, test_to: Column) -> Column:
    of = {"fold": fold, "train_from": train_from, "train_to": train_to, "test_from": test_from, "test_to": test_to}
    return F.struct(*[c.cast("long").alias(k) for k, c in of.items()])


def _numbered(folds: int, make: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), make)


def reserved_tail(folds: int, share: float, embargo: int) -> Callable[[Column, Column], Column]:
    """The newest rows are tests: ``folds`` of them, ``share`` of the rows together, each after ``embargo`` rows that neither part has. Series too short for a test row or a train row have no folds."""

    def rule(n: Column, i: Column) -> Column:
        size = F.floor(n * share / folds)
        first = n - folds * (size + embargo)
        made = _numbered(folds, lambda k: _fold(k, F.lit(0), first + k * (size + embargo), first + (k + 1) * (size + embargo) - size, first + (k + 1) * (size + embargo)))
        return F.when((size >= 1) & (first >= 1), made)

    return rule


def fixed_start(folds: int, least_train: int, embargo: int) -> Callable[[Column, Column], Column]:
    """The first test follows ``least_train`` rows and the embargo; the rest is dealt in equal steps, the last test takes what is over. Series with fewer rows than folds behind the first embargo have none."""

    def rule(n: Column, i: Column) -> Column:
        free = n - least_train - embargo
        step = F.greatest(F.floor(free / folds), F.lit(1))
        start = lambda k: least_train + k * step + embargo
        return F.when(free >= folds, _numbered(folds, lambda k: _fold(k, F.lit(0), start(k) - embargo, start(k), F.when(k == folds - 1, n).otherwise(F.least(n, start(k) + step)))))

    return rule


def sliding_windows(train: int, test: int, step: int, embargo: int = 0) -> Callable[[Column, Column], Column]:
    """Train and test windows of fixed lengths that move on by ``step`` rows while they fit: as many as the series has room for. A row is
    given only the windows that reach it, so a long series makes no long arrays."""
    span = train + embargo + test

    def rule(n: Column, i: Column) -> Column:
        first, last = F.greatest(F.ceil((i - span + 1) / step), F.lit(0)), F.least(F.floor(i / step), F.floor((n - span) / step))
        made = F.transform(F.sequence(first, last, F.lit(1).cast("long")), lambda k: _fold(k, k * step, k * step + train, k * step + train + embargo, k * step + span))
        return F.when((n >= span) & (last >= first), made)

    return rule


def expanding_segments(segments: int, train_segments: int, least: int = 8) -> Callable[[Column, Column], Column]:
    """The series in equal segments (of twice ``least`` rows or more, or there are no folds): each after the first ``train_segments`` is a test of everything before it; the last takes what is over."""

    def rule(n: Column, i: Column) -> Column:
        size = F.floor(n / segments)
        end = lambda s: F.when(s == segments - 1, n).otherwise(size * (s + 1))
        return F.when((n >= segments * 2 * least) & F.lit(0 < train_segments < segments), _numbered(segments - train_segments, lambda k: _fold(k, F.lit(0), size * (k + train_segments), size * (k + train_segments), end(k + train_segments))))

    return rule


def robust_scale(df: DataFrame, columns: list[str], clip: float = 5.0) -> DataFrame:
    """Adds ``<column>_scaled``: distance from the median in interquartile ranges, clipped; 0 for null. One row of statistics reaches the driver."""
    out = {}
    for c in columns:
        stats = quantiles(df, [], c, {"lo": 0.25, "mid": 0.5, "hi": 0.75}).first()
        lo, mid, hi = (stats["lo"], stats["mid"], stats["hi"]) if stats and stats["mid"] is not None else (0.0, 0.0, 0.0)
        scale = hi - lo if hi > lo else 1.0
        z = (F.col(c) - mid) / scale
        out[f"{c}_scaled"] = F.coalesce(F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)), F.lit(0.0))
    return df.withColumns(out)
