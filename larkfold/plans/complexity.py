"""Queries: entropies, Hurst exponent, fractal dimension and Haar trend of the last bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import fractals as C
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, over_bars, picked, rows
from larkfold.sources.adapters import BARS_SQL, daily_bars


def returns(spark: SparkSession, d: str) -> DataFrame:
    return over_bars(spark, d, lambda w: {"ret": F.log(F.col("close") / F.lag("close").over(w)), "span": F.log(F.col("high") / F.col("low"))}, 1).select("symbol", "day", "ret", "span")


def _match(v: str, m: int) -> str:
    near = " AND ".join(f"abs({v}[i + {k}] - {v}[j + {k}]) <= tol_{v}" for k in range(m))
    return f"list_transform(range(1, {32 - m}), lambda i: list_sum(list_transform(range(1, {32 - m}), lambda j: ({near})::INT)))"


@query("w21_entropies", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, ln(close / lag(close) OVER ({W})) AS ret, ln(high / low) AS span FROM bars),
 f AS (SELECT symbol, day, list(ret) OVER {rows(30)} AS a, count(ret) OVER {rows(30)} AS n, list(span) OVER {rows(30)} AS b, count(span) OVER {rows(30)} AS k, 0.2::DOUBLE * stddev_pop(ret) OVER {rows(30)} AS tol_a, 0.2::DOUBLE * stddev_pop(span) OVER {rows(30)} AS tol_b FROM r),
 c AS (SELECT *, CASE WHEN n = 30 THEN (list_sum({_match("a", 2)}) - 29) / (29 * 28)::DOUBLE END AS m2, CASE WHEN n = 30 THEN (list_sum({_match("a", 3)}) - 28) / (28 * 27)::DOUBLE END AS m3,
  CASE WHEN k = 30 THEN list_avg(list_transform({_match("b", 2)}, lambda x: ln(x / 29::DOUBLE))) - list_avg(list_transform({_match("b", 3)}, lambda x: ln(x / 28::DOUBLE))) END AS phi FROM f)
 SELECT symbol, day, round(CASE WHEN n < 30 THEN NULL WHEN tol_a > 0 AND m2 > 0 AND m3 > 0 THEN greatest(-ln(m3 / m2), 0) ELSE 0 END, 6) AS sample_entropy_30,
 round(CASE WHEN k < 30 THEN NULL WHEN tol_b > 0 THEN greatest(phi, 0) ELSE 0 END, 6) AS approximate_entropy_30 FROM c""")  # fmt: skip
def w21_entropies(spark: SparkSession, d: str) -> DataFrame:
    """Sample entropy of returns and approximate entropy of ranges over the last 30 bars."""
    measures = {"sample_entropy_30": C.Measure("ret", 30, C.sample_entropy(), pairs=True), "approximate_entropy_30": C.Measure("span", 30, C.approximate_entropy(), pairs=True)}
    return picked(C.over_frames(returns(spark, d), KEYS, ORDER, bar_bucket(), ["day"], measures, block=700), *measures)


@query("k08_hurst")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """Rescaled-range exponent of the last 256 closes, from 100 on (no SQL; a test holds it against a plain loop)."""
    return picked(C.over_frames(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), ["day"], {"hurst": C.Measure("close", 256, C.hurst, least=100)}), "hurst")


_STRIDES = "list_transform(range(1, least(10, n // 4) + 1), lambda k: list_avg(list_transform(range(1, k + 1), lambda m: list_sum(list_transform(range(1, (n - m) // k + 1), lambda j: abs(l[m + j * k] - l[m + (j - 1) * k]))) * (n - 1) / (k * ((n - m) // k) * k)::DOUBLE)))"


@query("k10_fractal_dimension", f"""WITH {BARS_SQL}, f AS (SELECT symbol, day, list(close) OVER {rows(128)} AS l, count(*) OVER {rows(128)} AS n FROM bars),
 c AS (SELECT symbol, day, unnest({_STRIDES}) AS v, unnest(range(1, least(10, n // 4) + 1)) AS k FROM f WHERE n >= 64),
 s AS (SELECT symbol, day, CASE WHEN count(*) >= 3 THEN least(greatest(regr_slope(ln(v), -ln(k)), 1), 2) ELSE 1.5 END AS d FROM c WHERE v > 0 GROUP BY ALL)
 SELECT f.symbol, f.day, round(CASE WHEN n >= 64 THEN coalesce(d, 1.5) END, 6) AS fractal_dimension FROM f LEFT JOIN s USING (symbol, day)""")  # fmt: skip
def k10_fractal(spark: SparkSession, d: str) -> DataFrame:
    """Higuchi dimension of the last 128 closes, from 64 on."""
    return picked(C.over_frames(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), ["day"], {"fractal_dimension": C.Measure("close", 128, C.higuchi(), least=64)}, block=1000), "fractal_dimension")


@query("k10_price_entropy", f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, ln(close / lag(close) OVER ({W})) AS ret, row_number() OVER ({W}) AS i FROM bars),
 f AS (SELECT symbol, day, i, list(ret) OVER {rows(99)} AS l, min(ret) OVER {rows(99)} AS lo, max(ret) OVER {rows(99)} AS hi FROM r), u AS (SELECT symbol, day, lo, hi, unnest(list_filter(l, lambda x: x IS NOT NULL)) AS x FROM f WHERE i >= 50),
 b AS (SELECT symbol, day, CASE WHEN hi > lo THEN least(floor((x - lo) * (20 / (hi - lo))), 19) ELSE 10 END AS bin, count(*) AS c FROM u GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY symbol, day) AS p FROM b),
 e AS (SELECT symbol, day, -sum(p * log2(p)) / log2(20) AS e FROM p GROUP BY ALL) SELECT f.symbol, f.day, round(e, 6) AS price_entropy FROM f LEFT JOIN e USING (symbol, day)""")  # fmt: skip
def k10_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the histogram of returns of the last 100 closes, from 50 on."""
    return picked(C.over_frames(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), ["day"], {"price_entropy": C.Measure("close", 100, C.return_entropy(), least=50)}, block=1000), "price_entropy")


_PAIR = "(p[2 * (({i} - 1) // 2) + 1] + p[2 * (({i} - 1) // 2) + 2]) / 2"


@query("k10_haar", f"""WITH {BARS_SQL}, f AS (SELECT symbol, day, close, list(close) OVER {rows(256)} AS l, count(*) OVER {rows(256)} AS n, stddev_pop(close) OVER {rows(256)} AS sd, stddev_pop(close) OVER {rows(20)} AS sd20 FROM bars),
 g AS (SELECT *, (2 ** ceil(log2(n)))::BIGINT AS size, list_concat(l, list_transform(range(0, (2 ** ceil(log2(n)))::BIGINT - n), lambda i: close)) AS p FROM f WHERE n >= 32),
 h AS (SELECT symbol, day, sd, sd20, {_PAIR.format(i="n")} AS trend, ({_PAIR.format(i="n")} - {_PAIR.format(i="(n - 4)")}) / 5 AS momentum,
  list_stddev_pop(list_transform(range(0, size // 2), lambda j: (p[2 * j + 1] - p[2 * j + 2]) / sqrt(2))) AS noise FROM g)
 SELECT f.symbol, f.day, round(trend, 3) AS wavelet_trend, round(momentum, 4) AS wavelet_momentum, round(CASE WHEN noise IS NOT NULL THEN least(noise / CASE WHEN h.sd > 0 THEN h.sd ELSE 1 END, 2) END, 5) AS wavelet_noise_ratio, round(abs(momentum) / (h.sd20 + 1e-10), 5) AS wavelet_strength
 FROM f LEFT JOIN h USING (symbol, day)""")  # fmt: skip
def k10_haar(spark: SparkSession, d: str) -> DataFrame:
    """Trend without the finest details, its slope, noise and strength, of the last 256 closes, from 32 on."""
    names = {"trend": ("wavelet_trend", 3), "momentum": ("wavelet_momentum", 4), "noise": ("wavelet_noise_ratio", 5), "strength": ("wavelet_strength", 5)}
    out = C.over_frames(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), ["day"], {k: C.Measure("close", 256, C.haar(k), least=32) for k in names}, block=1000)
    return out.select("symbol", "day", *[F.round(k, places).alias(name) for k, (name, places) in names.items()])
