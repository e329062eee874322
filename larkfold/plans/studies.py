"""Queries: indicators that rest on recurrences and runs, and the patterns built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkfold.operators.studies import FAST, SIGNAL, SLOW, study_bars
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, picked, rows
from larkfold.sources.adapters import BARS_SQL, daily_bars

MEANS = ("ema", "dema", "tema", "kama", "macd_line", "macd_signal", "macd_histogram", "rsi", "atr_rank", "keltner_width")
TRENDS = ("wma", "cci", "trend_strength", "range_percentile", "volume_climax", "vol_change", "bollinger_width", "vol_of_vol", "channel_position", "support_strength", "resistance_strength", "local_extrema_count", "range_contraction", "range_expansion", "momentum_divergence")
PATTERNS = (
    "squeeze_fire", "breakout_attempt", "breakout_failure", "failed_breakout_reversal", "exhaustion_signal", "compression_to_expansion", "reversal_impulse", "mean_reversion_setup", "engulfing_bullish", "engulfing_bearish", "three_bar_reversal",
    "higher_low_setup", "lower_high_setup", "directional_persistence", "persistence_chain", "higher_high_count", "lower_low_count",
)


def _lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({W})"


def _wilder(p: int) -> str:
    return f"CASE WHEN t.i < {p} THEN (e.atr{p} * t.i + t.tr) / (t.i + 1) ELSE e.atr{p} + (t.tr - e.atr{p}) / {p} END AS atr{p}"


def _mean(name: str, value: str, alpha: float) -> str:
    return f"e.{name} + {alpha!r} * ({value} - e.{name}) AS {name}"


_E20, _E12, _E26 = ("(e.{0} + {1!r} * (t.close - e.{0}))".format(n, a) for n, a in (("ema20", 2 / 21), ("ema12", 2 / 13), ("ema26", 2 / 27)))
_EE = f"(e.ee20 + {2 / 21!r} * ({_E20} - e.ee20))"
_SEEN = f"t AS (SELECT *, row_number() OVER ({W}) - 1 AS i, greatest(high - low, coalesce(abs(high - {_lag('close')}), 0), coalesce(abs(low - {_lag('close')}), 0)) AS tr, coalesce(close - {_lag('close')}, 0) AS move, ln(close / {_lag('close')}) AS lr FROM bars)"
#: All recurrences of the default periods, walked row by row.
WALK_SQL = f"""WITH RECURSIVE {BARS_SQL}, {_SEEN}, t2 AS (SELECT *, coalesce(abs(close - {_lag("close", 20)}) / nullif(sum(abs(move)) OVER {rows(20)}, 0), 0) AS straight FROM t),
 e AS (SELECT symbol, i, close AS ema20, close AS ee20, close AS eee20, close AS ema12, close AS ema26, 0.0::DOUBLE AS sig, tr AS atr10, tr AS atr14, tr AS atr20, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, close AS kama FROM t2 WHERE i = 0
 UNION ALL SELECT t.symbol, t.i, {_E20}, {_EE}, e.eee20 + {2 / 21!r} * ({_EE} - e.eee20), {_E12}, {_E26}, {_mean("sig", f"({_E12} - {_E26})", SIGNAL)}, {_wilder(10)}, {_wilder(14)}, {_wilder(20)},
  CASE WHEN t.i < 14 THEN e.up + greatest(t.move, 0) WHEN t.i = 14 THEN (e.up + greatest(t.move, 0)) / 14 ELSE (13 * e.up + greatest(t.move, 0)) / 14 END, CASE WHEN t.i < 14 THEN e.down + greatest(-t.move, 0) WHEN t.i = 14 THEN (e.down + greatest(-t.move, 0)) / 14 ELSE (13 * e.down + greatest(-t.move, 0)) / 14 END,
  CASE WHEN t.i < 20 THEN t.close ELSE e.kama + pow(t.straight * {FAST - SLOW!r} + {SLOW!r}, 2) * (t.close - e.kama) END FROM e JOIN t2 t ON t.symbol = e.symbol AND t.i = e.i + 1),
 b AS (SELECT * FROM t JOIN e USING (symbol, i))"""


def _shown(names: tuple[str, ...], places: int = 5) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


def _some(p: int) -> str:
    """Wilder's range, or 1 where bars are flat."""
    return f"CASE WHEN atr{p} > 1e-8 THEN atr{p} ELSE 1 END"


@query("ib_exponential_means", f"""{WALK_SQL}, c AS (SELECT *, list(atr14) OVER {rows(70)} AS seen FROM b),
 x AS (SELECT symbol, day, (close - ema20) / ({_some(20)}) AS ema, (close - 2 * ema20 + ee20) / ({_some(14)}) AS dema, (close - 3 * ema20 + 3 * ee20 - eee20) / ({_some(14)}) AS tema, (close - kama) / ({_some(14)}) AS kama, (ema12 - ema26) / ({_some(14)}) AS macd_line, sig / ({_some(14)}) AS macd_signal,
  (ema12 - ema26 - sig) / ({_some(14)}) AS macd_histogram, CASE WHEN i <= 14 THEN 0.5 ELSE 1 - 1 / (1 + CASE WHEN down > 1e-8 THEN up / down ELSE 100 END) END AS rsi, len(list_filter(seen, lambda v: v < atr14)) / len(seen) AS atr_rank, 4 * atr20 / ema20 AS keltner_width FROM c)
 SELECT symbol, day, {_shown(MEANS)} FROM x""")  # fmt: skip
def ib_means(spark: SparkSession, d: str) -> DataFrame:
    """Appendix B: exponential means once, twice and thrice, the adaptive mean, MACD, Wilder's strength and range."""
    return picked(study_bars(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), dict.fromkeys(MEANS)), *MEANS, places=5)


def _line(n: int) -> str:
    return f"CASE WHEN count(*) OVER {rows(n)} >= {n} THEN regr_slope(close, i) OVER {rows(n)} END"


_STEPS = "CASE WHEN i >= 10 THEN least(sum(({})::INT) OVER " + rows(10) + " / 9.0, 1) ELSE 0 END"
_PRIOR = f"({W} ROWS BETWEEN {{}} PRECEDING AND {{}} PRECEDING)"


@query("ib_trends_and_levels", f"""{WALK_SQL}, c AS (SELECT *, (high + low + close) / 3 AS tp, high - low AS span, {_lag("high - low")} AS pspan, CASE WHEN i >= 2 THEN coalesce(stddev_samp(lr) OVER {rows(20)}, 0) ELSE 0 END AS sd, list(close) OVER {rows(20)} AS cs,
  list(tick_count) OVER {rows(20)} AS vs, list(high - low) OVER {rows(50)} AS ss, list(low) OVER {_PRIOR.format(49, 1)} AS ls, list(high) OVER {_PRIOR.format(49, 1)} AS hs, avg(close) OVER {rows(50)} AS m50, var_pop(close) OVER {rows(50)} AS v50,
  {_line(20)} AS s20, {_line(40)} AS s40, {_line(80)} AS s80, {_line(50)} AS s50, max(high) OVER {_PRIOR.format(20, 1)} AS ph, min(low) OVER {_PRIOR.format(20, 1)} AS pl, (close - {_lag("close", 20)}) / greatest({_lag("close", 20)}, 1) AS now,
  coalesce(({_lag("close", 20)} - {_lag("close", 40)}) / greatest({_lag("close", 40)}, 1), 0) AS past,
  coalesce(({_lag("high")} > {_lag("high", 2)} AND {_lag("high")} > high)::INT, 0) + coalesce(({_lag("low")} < {_lag("low", 2)} AND {_lag("low")} < low)::INT, 0) AS turns FROM b),
 c2 AS (SELECT *, avg(tp) OVER {rows(20)} AS mtp, list(tp) OVER {rows(20)} AS tps, {_lag("sd")} AS psd, sqrt(greatest(v50 - s50 * s50 * (50 * 50 - 1) / 12.0, 0)) AS wide FROM c),
 c3 AS (SELECT *, list_avg(list_transform(tps, lambda v: abs(v - mtp))) AS mad, len(cs) AS m FROM c2),
 x AS (SELECT symbol, day, (close - list_sum(list_transform(range(1, m + 1), lambda k: k * cs[k])) / (m * (m + 1) / 2)) / ({_some(20)}) AS wma, CASE WHEN mad > 1e-8 THEN least(greatest((tp - mtp) / (1.5 * mad), -1), 1) ELSE 0 END AS cci,
  (coalesce(sign(s20), 0) + coalesce(sign(s40), 0) + coalesce(sign(s80), 0)) / 3.0 AS trend_strength, len(list_filter(ss, lambda v: v < span)) / len(ss) AS range_percentile, (len(list_filter(vs, lambda v: v < tick_count)) / len(vs) > 0.95)::INT::DOUBLE AS volume_climax,
  CASE WHEN psd > 1e-8 THEN sd / psd - 1 ELSE 0 END AS vol_change, 4 * sd * close / avg(close) OVER {rows(20)} AS bollinger_width, CASE WHEN avg(sd) OVER {rows(20)} > 1e-8 THEN coalesce(stddev_samp(sd) OVER {rows(20)}, 0) / avg(sd) OVER {rows(20)} ELSE 0 END AS vol_of_vol,
  CASE WHEN wide > 1e-8 THEN least(greatest((close - m50 - s50 * 49 / 2) / wide, -1), 1) ELSE 0 END AS channel_position, least(coalesce(len(list_filter(ls, lambda v: abs(v - low) < atr14 / 2)), 0) / 15.0, 1) AS support_strength,
  least(coalesce(len(list_filter(hs, lambda v: abs(v - high) < atr14 / 2)), 0) / 15.0, 1) AS resistance_strength, (sum(turns) OVER {rows(18)})::DOUBLE AS local_extrema_count, {_STEPS.format("span < pspan")} AS range_contraction, {_STEPS.format("span > pspan")} AS range_expansion,
  CASE WHEN i >= 20 AND high > ph AND now < past THEN -1.0 WHEN i >= 20 AND low < pl AND now > past THEN 1.0 ELSE 0 END AS momentum_divergence FROM c3)
 SELECT symbol, day, {_shown(TRENDS)} FROM x""")  # fmt: skip
def ib_trends(spark: SparkSession, d: str) -> DataFrame:
    """Appendix B: weighted mean, channel, slopes, ranks, volatility of volatility, support and resistance, divergence."""
    return picked(study_bars(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), dict.fromkeys(TRENDS)), *TRENDS, places=5)


def _is(c: str) -> str:
    return f"coalesce(({c}), false)::INT::DOUBLE"


def _run(c: str) -> str:
    return f"s{c} * row_number() OVER (PARTITION BY symbol, r{c} ORDER BY i)"


@query("ib_patterns_and_runs", f"""{WALK_SQL}, c AS (SELECT *, {_lag("close")} AS c1, {_lag("close", 2)} AS c2, {_lag("open")} AS o1, {_lag("open", 2)} AS o2, {_lag("high")} AS h1, {_lag("high", 2)} AS h2, {_lag("low")} AS l1, {_lag("low", 2)} AS l2, {_lag("atr20")} AS a1, high - low AS span,
  CASE WHEN i >= 2 THEN coalesce(stddev_samp(lr) OVER {rows(20)}, 0) ELSE 0 END AS sd, avg(close) OVER {rows(20)} AS ma, {", ".join(f"max(high) OVER {_PRIOR.format(19 + k, k)} AS hi{k}, min(low) OVER {_PRIOR.format(19 + k, k)} AS lo{k}" for k in (1, 2, 3))},
  {", ".join(f"coalesce(sign({c} - {_lag(c)}), 0) AS s{c}" for c in ("close", "high", "low"))} FROM b), c0 AS (SELECT *, {_lag("sd")} AS sd1, {", ".join(f"{_lag(f's{c}')} AS p{c}" for c in ("close", "high", "low"))} FROM c),
 r AS (SELECT *, {", ".join(f"sum(CASE WHEN s{c} = p{c} THEN 0 ELSE 1 END) OVER ({W}) AS r{c}" for c in ("close", "high", "low"))}, (close - ma) / ({_some(14)}) AS off FROM c0), n AS (SELECT *, {_run("close")} AS nc, {_run("high")} AS nh, {_run("low")} AS nl FROM r),
 x AS (SELECT symbol, day, {_is("sd1 * 2 < a1 * 1.5 AND sd * 2 > atr20 * 1.5")} AS squeeze_fire, CASE WHEN hi1 - lo1 >= 1e-8 THEN least(greatest(1 - 5 * least(hi1 - close, close - lo1) / (hi1 - lo1), 0), 1) ELSE 0 END AS breakout_attempt,
  {_is("(h1 > hi2 OR l1 < lo2) AND close BETWEEN lo2 AND hi2")} AS breakout_failure, {_is("((h1 > hi3 OR h2 > hi3) AND close < (hi3 + lo3) / 2) OR ((l1 < lo3 OR l2 < lo3) AND close > (hi3 + lo3) / 2)")} AS failed_breakout_reversal,
  {_is("i > 0 AND span > 2.5 * atr10 AND abs(close - open) < 0.3 * span")} AS exhaustion_signal, {_is("a1 > 1e-8 AND h1 - l1 < 0.6 * a1 AND span > 1.5 * atr20")} AS compression_to_expansion,
  CASE WHEN (close - c1) * (c1 - c2) < 0 THEN least(greatest((close - c1) / ({_some(14)}), -1), 1) ELSE 0 END AS reversal_impulse, {_is("abs(off) > 2 AND off * (close - c1) < 0")} AS mean_reversion_setup, {_is("c1 < o1 AND close > open AND close > o1 AND open < c1")} AS engulfing_bullish,
  {_is("c1 > o1 AND close < open AND close < o1 AND open > c1")} AS engulfing_bearish, {_is("c2 < o2 AND c1 < o1 AND close > open AND close > h1")} - {_is("c2 > o2 AND c1 > o1 AND close < open AND close < l1")} AS three_bar_reversal,
  {_is("i >= 3 AND low > l2 AND close > c1")} AS higher_low_setup, {_is("i >= 3 AND high < h2 AND close < c1")} AS lower_high_setup, least(greatest(nc / 5.0, -1), 1) AS directional_persistence, least(greatest(nc / 10.0, -1), 1) AS persistence_chain,
  greatest(nh, 0)::DOUBLE AS higher_high_count, greatest(-nl, 0)::DOUBLE AS lower_low_count FROM n)
 SELECT symbol, day, {_shown(PATTERNS)} FROM x""")  # fmt: skip
def ib_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Appendix B: breakouts and their failures, reversals, engulfing bars, squeezes, and runs however long."""
    return picked(study_bars(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), dict.fromkeys(PATTERNS)), *PATTERNS, places=5)
