"""Monte-Carlo equity paths of long series of results, without a series or a path in one task.

Random numbers are functions of (seed, key, path, block), so any task can draw any piece of any path, and draw it again after a
loss. A path is a row for each piece of up to ``PIECE`` steps: where its block starts in the series (which is a circle), and
from there the results, fetched by a join with the packed series. Pieces are summed up, the sums are run along each path (one row
a piece), and a second pass gives every piece its equity. Percentiles over paths are by step.

Defined cases: series of fewer than ``LEAST`` results have no paths; null results are left out; once equity is 0 or less it is 0 from then on; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.operators.blocks import each_block, kinds, numbers, pack
from larkfold.operators.series import rolling
from larkfold.scratch import written

PIECE, LEAST = 512, 10


@dataclass(frozen=True)
class PathSpec:
    """``method``: block (a circular block bootstrap), antithetic (the second half of the paths mirrors the first around the mean) or gbm (geometric Brownian motion with the
    mean and deviation of results over capital). ``worse``: what losses are multiplied by; ``ruin``: the share of capital lost that is ruin."""

    method: str = "block"
    paths: int = 200
    seed: int = 42
    capital: float = 10_000.0
    worse: float = 1.0
    ruin: float = 0.5


def block_length(n: Column, variance: Column, covariance: Column) -> Column:
    """By the first autocorrelation: (2 n rho^2 / (1 - rho^2))^(1/3), between 3 and a third of the series; a twentieth of it where there is little."""
    rho = F.try_divide(covariance, variance)
    plain = F.greatest(F.lit(3), F.floor(n / 20))
    best = F.pow(n * 2 * rho * rho / F.greatest(1 - rho * rho, F.lit(0.01)), F.lit(1 / 3))
    length = F.when((variance < 1e-12) | (F.abs(rho) < 0.05), plain).otherwise(F.greatest(F.lit(3), F.least(F.floor(best), F.floor(n / 3))))
    return F.when(n < 20, F.greatest(F.lit(3), F.floor(n / 5))).otherwise(length).cast("long")


def sizes(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """(keys, _n, _mean, _sd, _length) of each series long enough."""
    lagged = rolling(df, keys, order, bucket, lambda w: {"_past": F.lag(value).over(w)}, before=1)
    x, p = F.col(value), F.col("_past")
    sums = lagged.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.stddev_samp(value).alias("_sd"),
        F.sum(x * p).alias("_xp"), F.sum(F.when(p.isNotNull(), x)).alias("_sx"), F.sum(p).alias("_sp"),
    )
    n, m = F.col("_n"), F.col("_mean")
    covariance = (F.col("_xp") - m * (F.col("_sx") + F.col("_sp")) + (n - 1) * m * m) / n
    return sums.where(n >= LEAST).select(*keys, "_n", "_mean", "_sd", block_length(n, F.col("_var"), covariance).alias("_length"))


def pieces(known: DataFrame, keys: list[str], spec: PathSpec) -> DataFrame:
    """(keys, _path, _step, _take, _from, _mirror, _group): a row a block of a path, or a part of up to ``PIECE`` steps of one. ``_from`` is where it starts in the
    series, ``_mirror`` whether it is mirrored, ``_group`` the first step of the piece it belongs to: as many blocks as fit."""
    half = -(-spec.paths // 2)
    path = F.col("_path")
    drawn = path % half if spec.method == "antithetic" else path
    out = known.withColumn("_path", F.explode(F.sequence(F.lit(0), F.lit(spec.paths - 1))))
    n, length = F.col("_n"), (F.col("_n") if spec.method == "gbm" else F.col("_length"))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / length))))
    of_block = F.least(length, n - F.col("_k") * length)
    out = out.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((of_block - 1) / PIECE))))
    start = F.pmod(F.xxhash64(F.lit(spec.seed), *keys, drawn, "_k"), n)
    step = F.col("_k") * length + F.col("_c") * PIECE
    fit = F.floor(F.lit(PIECE) / length)
    group = F.when(fit > 0, F.floor(F.col("_k") / F.greatest(fit, F.lit(1))) * fit * length).otherwise(step).cast("long")
    mirror = (path >= half) if spec.method == "antithetic" else F.lit(False)
    return out.select(*keys, "_n", "_mean", "_sd", "_path", step.alias("_step"), F.least(F.lit(PIECE), of_block - F.col("_c") * PIECE).cast("int").alias("_take"), F.pmod(start + F.col("_c") * PIECE, n).alias("_from"), mirror.alias("_mirror"), group.alias("_group"))


def _fetched(rows: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _path, _step, _mean, _mirror, _r) of pieces: the results of their blocks in order, each up to three runs of a packed block (the series is a circle)."""
    n, runs, at, left = F.col("_n"), [], F.col("_from"), F.col("_take").cast("long")
    for i in range(3):
        run = F.least(left, (F.floor(at / PIECE) + 1) * PIECE - at, n - at)
        runs.append(F.struct(F.lit(i).alias("i"), at.alias("a"), run.alias("l")))
        at, left = (at + run) % n, left - run
    each = rows.withColumn("_run", F.explode(F.filter(F.array(*runs), lambda r: r["l"] > 0)))
    each = each.withColumn("_b", F.floor(F.col("_run.a") / PIECE).cast("long"))
    met = each.join(series.select(*keys, "_b", "_x"), [*keys, "_b"])
    part = F.slice("_x", (F.col("_run.a") % PIECE + 1).cast("int"), F.col("_run.l").cast("int"))
    parts = met.groupBy(*keys, "_path", F.col("_group")).agg(F.array_sort(F.collect_list(F.struct("_step", F.col("_run.i").alias("i"), part.alias("p"))))["p"].alias("_p"), F.first("_mean").alias("_mean"), F.first("_mirror").alias("_mirror"))
    return parts.select(*keys, "_path", F.col("_group").alias("_step"), "_mean", "_mirror", F.flatten("_p").alias("_r"))


def equity_pieces(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, spec: PathSpec) -> DataFrame:
    """(keys, _path, _step, _equity, and the piece's greatest drawdown, least and last equity, and sums of gains and losses)."""
    x = F.col(value).cast("double")
    df = df.where(x.isNotNull()).withColumn(value, F.when(x < 0, x * spec.worse).otherwise(x))
    known = written(sizes(df, keys, order, bucket, value), "path-sizes")
    rows = pieces(known, keys, spec)
    own = kinds(rows, keys)
    if spec.method == "gbm":
        drawn = rows.withColumn("_key", F.xxhash64(F.lit(spec.seed), *keys, "_path"))

        def draw(row: dict) -> dict:
            mean, sd = row["_mean"] / spec.capital, max((row["_sd"] or 0.0) / spec.capital, 1e-6)
            z = np.random.Generator(np.random.Philox(key=np.array([row["_key"] & (2**64 - 1), row["_step"]], np.uint64))).standard_normal(row["_take"])
            return {k: [row[k]] for k in keys} | {"_path": [row["_path"]], "_step": [row["_step"]], "_r": (mean - sd * sd / 2 + sd * z)[None]}

        results = each_block(drawn, draw, f"{own}, _path int, _step long, _r array<double>")
    else:
        series = pack(df, keys, order, bucket, {"_x": value}, PIECE)
        fetched = _fetched(rows, series, keys)
        turned = F.when(F.col("_mirror"), F.transform("_r", lambda v: 2 * F.col("_mean") - v)).otherwise(F.col("_r"))
        results = fetched.select(*keys, "_path", "_step", turned.alias("_r"))
    results = written(results, "path-pieces")
    growth = spec.method == "gbm"

    def sums(row: dict) -> dict:
        c = np.cumsum(numbers(row["_r"]))
        return {k: [row[k]] for k in keys} | {"_path": [row["_path"]], "_step": [row["_step"]], "_total": [c[-1]], "_low": [c.min()], "_high": [c.max()]}

    ends = each_block(results, sums, f"{own}, _path int, _step long, _total double, _low double, _high double")
    w = Window.partitionBy(*keys, "_path").orderBy("_step")  # one row a piece
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    least, most = F.min(F.col("_before") + F.col("_low")).over(before), F.max(F.col("_before") + F.col("_high")).over(before)
    ends = ends.withColumns({"_peak": F.greatest(F.coalesce(most, F.lit(0.0)), F.lit(0.0)), "_ruined": F.lit(False) if growth else F.coalesce(least <= -spec.capital, F.lit(False))})

    def equity(row: dict) -> dict:
        r = numbers(row["_r"])
        c = row["_before"] + np.cumsum(r)
        e = spec.capital * np.exp(c) if growth else spec.capital + c
        peak = np.maximum.accumulate(np.concatenate([[spec.capital * np.exp(row["_peak"]) if growth else spec.capital + row["_peak"]], e]))[1:]
        dead = np.logical_or.accumulate(e <= 0) | row["_ruined"]
        e = np.where(dead, 0.0, e)
        down = np.where(peak > 0, (peak - e) / np.where(peak > 0, peak, 1.0), 0.0)
        made = {"_drawdown": [down.max()], "_least": [e.min()], "_last": [e[-1]], "_gain": [r[r > 0].sum()], "_loss": [-r[r < 0].sum()]}
        return {k: [row[k]] for k in keys} | {"_path": [row["_path"]], "_step": [row["_step"]], "_equity": e[None]} | made

    joined = results.join(ends.select(*keys, "_path", "_step", "_before", "_peak", "_ruined"), [*keys, "_path", "_step"])
    return each_block(joined, equity, f"{own}, _path int, _step long, _equity array<double>, _drawdown double, _least double, _last double, _gain double, _loss double")


def path_results(made: DataFrame, keys: list[str], spec: PathSpec) -> DataFrame:
    """(keys, path, final, max_drawdown, least, profit_factor) of each path."""
    rows = made.groupBy(*keys, F.col("_path").alias("path")).agg(
        F.max_by("_last", "_step").alias("final"), F.max("_drawdown").alias("max_drawdown"), F.least(F.min("_least"), F.lit(spec.capital)).alias("least"), F.sum("_gain").alias("_g"), F.sum("_loss").alias("_l")
    )
    factor = F.when(F.col("_l") == 0, F.when(F.col("_g") > 0, 10.0).otherwise(0.0)).otherwise(F.least(F.col("_g") / F.col("_l"), F.lit(10.0)))
    return rows.withColumn("profit_factor", factor).drop("_g", "_l")


def summary(paths: DataFrame, keys: list[str], spec: PathSpec) -> DataFrame:
    """Percentiles, ruin, profit, expected shortfall and shape of the paths' results by key; drawdowns and returns in percent."""
    ret = (F.col("final") / spec.capital - 1) * 100
    p = paths.withColumns({"_r": ret, "_d": F.col("max_drawdown") * 100})
    at = lambda c, q: F.percentile(c, F.lit(q))
    base = p.groupBy(*keys).agg(
        F.count("*").alias("paths"), *[at(c, q).alias(f"{n}_p{int(q * 100):02d}") for c, n in (("final", "final"), ("_d", "drawdown"), ("profit_factor", "profit_factor")) for q in (0.05, 0.5, 0.95)],
        F.max("_d").alias("drawdown_worst"), F.avg((F.col("least") <= spec.capital * (1 - spec.ruin)).cast("double")).alias("ruin_probability"), F.avg((F.col("final") > spec.capital).cast("double")).alias("profit_probability"),
        F.avg("_r").alias("return_mean"), F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("return_std"), at("_r", 0.05).alias("_cut"),
    )
    z = F.when(F.col("return_std") > 0, (F.col("_r") - F.col("return_mean")) / F.col("return_std"))
    shape = p.join(base.select(*keys, "_cut", "return_mean", "return_std"), keys).groupBy(*keys).agg(
        F.avg(F.when(F.col("_r") <= F.col("_cut"), F.col("_r"))).alias("shortfall_p05"), F.coalesce(F.avg(z * z * z), F.lit(0.0)).alias("skewness"), F.coalesce(F.avg(z * z * z * z), F.lit(3.0)).alias("kurtosis")
    )
    return base.drop("_cut").join(shape, keys)


def curves(made: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(keys, step, equity_pXX): percentiles over paths after each step."""
    steps = made.select(*keys, "_step", F.posexplode("_equity").alias("_i", "_e")).groupBy(*keys, (F.col("_step") + F.col("_i") + 1).alias("step"))
    return steps.agg(F.percentile("_e", F.array(*[F.lit(s) for s in shares])).alias("_p")).select(*keys, "step", *[F.col("_p")[i].alias(f"equity_p{int(s * 100):02d}") for i, s in enumerate(shares)])
