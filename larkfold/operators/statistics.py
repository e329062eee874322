"""Statistics over groups: drawdown episodes, Monte-Carlo paths, Granger causality, Kalman filter, isotonic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.series import BLOCK, linear_recurrence, ordinal


def bootstrap_paths(returns: DataFrame, by: str, ret: str, paths: int, block: int = 10, seed: int = 1, chunk: int = 100) -> DataFrame:
    """Block bootstrap of each key's returns: (key, path, final, max_drawdown). Paths are dealt to tasks in chunks; each chunk has its
    own seed, so reruns agree. A key's returns (one number a bar) are what each of its tasks reads."""
    starts = returns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("day", ret))).alias("s")).select(by, F.transform("s", lambda x: x[ret]).alias("r"))
    chunks = starts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((paths - 1) // chunk))))

    def draw(batches):
        for pdf in batches:
            out = []
            for key, r, c in zip(pdf[by], pdf["r"], pdf["chunk"], strict=True):
                r = np.asarray(r, float)
                rng = np.random.default_rng([seed, int(c)])
                for p in range(c * chunk, min(paths, (c + 1) * chunk)):
                    at = rng.integers(0, max(1, len(r) - block + 1), -(-len(r) // block))
                    path = np.concatenate([r[a : a + block] for a in at])[: len(r)]
                    equity = np.cumprod(1 + path)
                    out.append((key, p, float(equity[-1]), float((equity / np.maximum.accumulate(equity) - 1).min())))
            yield pd.DataFrame(out, columns=[by, "path", "final", "max_drawdown"])

    kind = dict(returns.dtypes)[by]
    return chunks.repartition(F.col(by), F.col("chunk")).mapInPandas(draw, f"{by} {kind}, path int, final double, max_drawdown double")


def granger(pairs: DataFrame, by: list[str], x: str, y: str, lags: int) -> DataFrame:
    """F statistic of y on the past of x beyond its own past, by key, from sums of products only.

    The normal equations of both regressions are sums over rows, so they are aggregated in Spark (partial sums first); each key's system of
    1 + 2 ``lags`` unknowns is solved on one row. Needs columns ``{y}_lag{k}`` and ``{x}_lag{k}``.
    """
    terms = [F.lit(1.0), *[F.col(f"{y}_lag{k}") for k in range(1, lags + 1)], *[F.col(f"{x}_lag{k}") for k in range(1, lags + 1)]]
    whole = pairs.na.drop(subset=[y, *[f"{v}_lag{k}" for v in (x, y) for k in range(1, lags + 1)]])
    m = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(t * F.col(y)).alias(f"b{i}") for i, t in enumerate(terms)]
    moments = whole.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
                b = np.array([r[f"b{i}"] for i in range(m)])
                rss = [r["yy"] - b[:k] @ np.linalg.lstsq(a[:k, :k], b[:k], rcond=None)[0] for k in (lags + 1, m)]
                free = r["n"] - m
                f = (rss[0] - rss[1]) / lags / (rss[1] / free) if free > 0 and rss[1] > 0 else None
                out.append((*[r[k] for k in by], r["n"], f))
            yield pd.DataFrame(out, columns=[*by, "n", "f"])

    kinds = dict(pairs.dtypes)
    return moments.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in by) + ", n long, f double")


def isotonic(points: DataFrame, by: list[str], score: str, outcome: str, bins: int = 1000) -> DataFrame:
    """Calibration by pooling adjacent violators: (key, bin, calibrated), over ``bins`` equal bins of a score in [0, 1].

    Outcomes are summed by bin in Spark; what one key's pooling reads is at most ``bins`` rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    sums = points.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("w"), F.avg(F.col(outcome).cast("double")).alias("v"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        stack: list[list[float]] = []
        for w, v in zip(pdf["w"], pdf["v"], strict=True):
            stack.append([v, w, 1])
            while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
                v2, w2, n2 = stack.pop()
                v1, w1, n1 = stack.pop()
                stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
        return pdf.assign(calibrated=[v for v, _, n in stack for _ in range(n)])[[*by, "bin", "w", "calibrated"]]

    kinds = dict(points.dtypes)
    return sums.groupBy(*by).applyInPandas(pool, ", ".join(f"{k} {kinds[k]}" for k in by) + ", bin int, w long, calibrated double")


def kalman_gains(process: float, noise: float, start: float) -> list[tuple[float, float]]:
    """(gain, variance) of a local-level filter by ordinal, until they don't change any more. They depend on no observation."""
    p, out = start, [(1.0, start)]
    while len(out) < 2 or out[-1] != out[-2]:
        gain = (p + process) / (p + process + noise)
        p = (1 - gain) * (p + process)
        out.append((gain, p))
        if len(out) == 100_000:
            break
    return out


def kalman_level(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, process: float, noise: float, block: int = BLOCK) -> DataFrame:
    """Local-level Kalman filter of a series: adds ``level`` and ``variance``. The level starts at the first value with the noise's variance.
    With the gain a function of the ordinal, the level is a linear recurrence, scanned by blocks."""
    steps = kalman_gains(process, noise, noise)
    at = F.least(F.col("_rn"), F.lit(len(steps) - 1)).cast("int")
    pick = lambda i: F.get(F.lit([s[i] for s in steps]), at)
    df = ordinal(df, keys, order, bucket).withColumns({"_gain": pick(0), "variance": pick(1)})
    df = df.withColumns({"_x": F.col("_gain") * F.col(value), "_keep": 1 - F.col("_gain")})
    return linear_recurrence(df, keys, "_x", "_keep", "level", block).drop("_x", "_keep", "_gain", "_rn")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")
