"""Queries: hidden Markov regimes, Kalman filter and smoother, validators and trends that depend on their own past, expanding quantiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import hidden_markov as H
from larkfold.operators import kalman as K
from larkfold.operators import machines as M
from larkfold.operators.prefix_quantiles import expanding_quantiles
from larkfold.operators.series import ema, frame, ordinal, rolling
from larkfold.operators.technicals import directional_index
from larkfold.plans.core import tick_bucket
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, over_bars, picked, rows
from larkfold.plans.signals import _DM as ADX_SQL
from larkfold.scratch import written
from larkfold.sources.adapters import BARS_SQL, TICKS_SQL, daily_bars, ticks

# ---- hidden Markov models --------------------------------------------------------------------------------------------


def return_and_range(spark: SparkSession, d: str) -> DataFrame:
    """Log return and log range of daily bars; null for the first bar of a series."""
    return over_bars(spark, d, lambda w: {"ret": F.log(F.col("close") / F.lag("close").over(w)), "span": F.log1p(F.col("high") / F.col("low") - 1)}, 1)


#: A model of calm, rising and stormy days for the queries with SQL.
DAYS = H.HiddenMarkov(np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.06, 0.04], [0.1, 0.85, 0.05], [0.05, 0.15, 0.8]]),
                      np.array([[0.0, 0.1], [0.4, 0.4], [-0.2, 0.8]]), np.array([np.diag(v) for v in ([0.5, 0.05], [0.8, 0.2], [1.0, 0.5])]))


def _log_e(k: int) -> str:
    """SQL of the logarithm of state k's emission, 0 without an observation."""
    m, c = DAYS.means[k], np.diag(DAYS.covariances[k])
    const = -0.5 * (2 * np.log(2 * np.pi) + np.log(c).sum())
    return f"coalesce({float(const)!r}::DOUBLE - 0.5::DOUBLE * ((ret - {float(m[0])!r}::DOUBLE) ** 2 / {float(c[0])!r}::DOUBLE + (span - {float(m[1])!r}::DOUBLE) ** 2 / {float(c[1])!r}::DOUBLE), 0)"


def _enter(combine: str) -> list[str]:
    """SQL of the three states' values before emission: sums of f * A, or the greatest of f + ln A."""
    a = DAYS.transitions
    if combine == "sum":
        return [" + ".join(f"f.p[{i + 1}] * {float(a[i, j])!r}::DOUBLE" for i in range(3)) for j in range(3)]
    return [f"greatest({', '.join(f'f.p[{i + 1}] + {float(np.log(a[i, j]))!r}::DOUBLE' for i in range(3))})" for j in range(3)]


_START = ", ".join(f"{float(v)!r}::DOUBLE * exp(e[{k + 1}] - list_max(e))" for k, v in enumerate(DAYS.start))
_NEXT = ", ".join(f"({v}) * exp(r.e[{j + 1}] - list_max(r.e))" for j, v in enumerate(_enter("sum")))
_BACK = ", ".join(" + ".join(f"{float(DAYS.transitions[i, j])!r}::DOUBLE * exp(b.e[{j + 1}] - list_max(b.e)) * b.q[{j + 1}]" for j in range(3)) for i in range(3))
_UNIT = "list_transform({v}, lambda x: x / list_sum({v}))"
_BEST = ", ".join(f"{v} + r.e[{j + 1}]" for j, v in enumerate(_enter("max")))
_FROM = ", ".join("list_position([{0}], list_max([{0}]))".format(", ".join(f"f.p[{i + 1}] + {float(np.log(DAYS.transitions[i, j]))!r}::DOUBLE" for i in range(3))) for j in range(3))
_OBS = f"""{BARS_SQL}, o AS (SELECT symbol, day, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n, ln(close / lag(close) OVER ({W})) AS ret, ln(high / low) AS span FROM bars),
 r AS MATERIALIZED (SELECT symbol, day, i, n, [{", ".join(_log_e(k) for k in range(3))}] AS e FROM o)"""


@query("st20_hmm_decode", f"""WITH RECURSIVE {_OBS},
 f AS (SELECT symbol, i, {_UNIT.format(v=f"[{_START}]")} AS p FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.i, {_UNIT.format(v=f"[{_NEXT}]")} FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1),
 b AS (SELECT symbol, i, e, [1.0::DOUBLE, 1, 1] AS q FROM r WHERE i = n UNION ALL SELECT r.symbol, r.i, r.e, {_UNIT.format(v=f"[{_BACK}]")} FROM b JOIN r ON r.symbol = b.symbol AND r.i = b.i - 1),
 v AS (SELECT symbol, i, n, [{", ".join(f"{float(np.log(s))!r}::DOUBLE + e[{k + 1}]" for k, s in enumerate(DAYS.start))}] AS p, [0, 0, 0] AS came FROM r WHERE i = 1
  UNION ALL SELECT r.symbol, r.i, r.n, [{_BEST}], [{_FROM}] FROM v f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1),
 t AS (SELECT symbol, i, came, list_position(p, list_max(p)) AS s FROM v WHERE i = n UNION ALL SELECT v.symbol, v.i, v.came, t.came[t.s] FROM t JOIN v ON v.symbol = t.symbol AND v.i = t.i - 1)
 SELECT r.symbol, r.day, (t.s - 1)::INT AS state, {", ".join(f"round(f.p[{k}], 6) AS filtered_{k - 1}" for k in (1, 2, 3))},
 {", ".join(f"round(f.p[{k}] * b.q[{k}] / list_sum([f.p[1] * b.q[1], f.p[2] * b.q[2], f.p[3] * b.q[3]]), 6) AS smoothed_{k - 1}" for k in (1, 2, 3))}
 FROM r JOIN f USING (symbol, i) JOIN b USING (symbol, i) JOIN t USING (symbol, i)""")  # fmt: skip
def st20_decode(spark: SparkSession, d: str) -> DataFrame:
    """Filtered and smoothed probabilities and the Viterbi path of a given model over each symbol's whole series."""
    out = H.regimes(return_and_range(spark, d), KEYS, ORDER, bar_bucket(), DAYS.transitions, DAYS.start, ["ret", "span"], DAYS.log_emissions, ["day"], block=500)
    return out.select("symbol", "day", "state", *[F.round(F.col(c)[k], 6).alias(f"{c}_{k}") for c in ("filtered", "smoothed") for k in range(3)])


@query("st20_hmm_regimes")
def st20(spark: SparkSession, d: str) -> DataFrame:
    """A model of four states fitted by EM to all series, and what it says of each bar: label, probability, expected duration (no SQL; tests hold EM against a plain version)."""
    bars = return_and_range(spark, d)
    model = H.fit(bars, KEYS, ORDER, bar_bucket(), ["ret", "span"], states=4, iterations=8)
    out = H.regimes(bars, KEYS, ORDER, bar_bucket(), model.transitions, model.start, ["ret", "span"], model.log_emissions, ["day"])
    info = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(float(n)).alias("duration"), F.lit(float(1 - a)).alias("leave")) for label, n, a in zip(model.labels(), model.durations(), np.diag(model.transitions), strict=True)])
    now = F.get(info, F.col("state"))
    return out.select("symbol", "day", "state", now["label"].alias("label"), F.round(F.array_max("filtered"), 5).alias("confidence"), F.round(now["duration"], 4).alias("expected_bars"), F.round(now["leave"], 5).alias("transition_probability"))


#: The regimes, their transitions, the window and the scale of volatility.
REGIMES = ("trending", "mean_reverting", "volatile")
STAY = np.array([[0.88, 0.07, 0.05], [0.08, 0.84, 0.08], [0.10, 0.10, 0.80]])
WINDOW, VOLATILITY = 64, 0.01


def regime_emissions(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms of the three regimes' emissions of each bar, from drift, volatility and lag autocorrelation of the last returns."""

    def columns(w):
        f, g = frame(w, WINDOW), frame(w, WINDOW - 1)
        clamp = lambda c: F.greatest(F.lit(-20.0), F.least(c, F.lit(20.0)))
        zero = F.lit(0.0)
        strength, rho, vol = F.col("strength"), F.col("rho"), F.col("vol")
        return [
            {"_before": F.lag("close").over(w)},
            {"r": F.when(F.col("_before").isNotNull(), F.when((F.col("close") > 0) & (F.col("_before") > 0), F.log(F.col("close") / F.col("_before"))).otherwise(0.0))},
            {"_p": F.lag("r").over(w), "n": F.count("r").over(f), "vol": F.coalesce(F.stddev_samp("r").over(f), zero), "drift": F.coalesce(F.avg("r").over(f), zero)},
            {"_q": F.when(F.col("_p").isNotNull(), F.col("r"))},
            {"rho": F.when(F.col("n") > 2, F.coalesce(F.try_divide(F.covar_samp("_p", "_q").over(g), F.stddev_samp("_p").over(g) * F.stddev_samp("_q").over(g)), zero)).otherwise(0.0),
             "strength": F.coalesce(F.try_divide(F.abs("drift"), F.greatest("vol", F.lit(1e-9))), zero)},
            {"trending": clamp(1.25 * strength + F.greatest(rho, zero)), "mean_reverting": clamp(F.greatest(-rho, zero) * 1.5 + F.greatest(1 - strength, zero)), "volatile": clamp(vol / VOLATILITY)},
            {c: F.when(F.col("n") > 0, F.col(c)) for c in REGIMES},
        ]

    return over_bars(spark, d, columns, WINDOW + 1)


_C20 = "greatest(-20, least({}, 20))"
_EMIT = f"""{BARS_SQL}, b0 AS (SELECT *, lag(close) OVER ({W}) AS p FROM bars), b1 AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN close > 0 AND p > 0 THEN ln(close / p) ELSE 0 END END AS r FROM b0),
 b2 AS (SELECT *, lag(r) OVER ({W}) AS q, row_number() OVER ({W}) AS i FROM b1), b3 AS (SELECT *, CASE WHEN q IS NOT NULL THEN r END AS s FROM b2),
 b4 AS (SELECT symbol, day, i, count(r) OVER {rows(64)} AS n, coalesce(stddev_samp(r) OVER {rows(64)}, 0) AS vol, coalesce(avg(r) OVER {rows(64)}, 0) AS drift,
  covar_samp(q, s) OVER {rows(63)} AS cov, stddev_samp(q) OVER {rows(63)} * stddev_samp(s) OVER {rows(63)} AS sd FROM b3),
 b5 AS (SELECT *, CASE WHEN n > 2 AND sd > 0 THEN cov / sd ELSE 0 END AS rho, abs(drift) / greatest(vol, 1e-9) AS strength FROM b4),
 r AS MATERIALIZED (SELECT symbol, day, i, CASE WHEN n > 0 THEN [{_C20.format("1.25 * strength + greatest(rho, 0)")}, {_C20.format("greatest(-rho, 0) * 1.5 + greatest(1 - strength, 0)")}, {_C20.format("vol / 0.01")}]::DOUBLE[] ELSE [0.0, 0, 0]::DOUBLE[] END AS e FROM b5)"""
_STAY = ", ".join(f"({' + '.join(f'f.p[{i + 1}] * {float(STAY[i, j])!r}::DOUBLE' for i in range(3))}) * exp(r.e[{j + 1}] - list_max(r.e))" for j in range(3))


@query("st12_regime_filter", f"""WITH RECURSIVE {_EMIT},
 f AS (SELECT symbol, day, i, [1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3] AS p FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.day, r.i, {_UNIT.format(v=f"[{_STAY}]")} FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1),
 s AS (SELECT *, {list(REGIMES)!r}[list_position(p, list_max(p))] AS regime FROM f), c AS (SELECT *, CASE WHEN regime = lag(regime) OVER ({W}) THEN 0 ELSE 1 END AS new FROM s),
 g AS (SELECT *, sum(new) OVER ({W}) AS run FROM c)
 SELECT symbol, day, {", ".join(f"round(p[{k + 1}], 5) AS {n}" for k, n in enumerate(REGIMES))}, regime, row_number() OVER (PARTITION BY symbol, run ORDER BY day) AS duration FROM g""")  # fmt: skip
def st12(spark: SparkSession, d: str) -> DataFrame:
    """The forward filter of three regimes with the duration of the present one; a series' first bar has no return and starts even."""
    emissions = regime_emissions(spark, d)
    out = H.regimes(emissions, KEYS, ORDER, bar_bucket(), STAY, np.full(3, 1 / 3), list(REGIMES), lambda x: np.nan_to_num(x), ["day"], block=700)
    p = [F.col("filtered")[k] for k in range(3)]
    named = out.select("symbol", "day", *[F.round(c, 5).alias(n) for c, n in zip(p, REGIMES, strict=True)], F.get(F.array(*[F.lit(n) for n in REGIMES]), F.array_position("filtered", F.array_max("filtered")).cast("int") - 1).alias("regime"))
    return M.run_lengths(named, KEYS, ORDER, bar_bucket(), "regime", "duration")


@query("st12_regime_transitions", f"""WITH RECURSIVE {_EMIT},
 f AS (SELECT symbol, day, i, [1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3] AS p FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.day, r.i, {_UNIT.format(v=f"[{_STAY}]")} FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1),
 s AS (SELECT *, {list(REGIMES)!r}[list_position(p, list_max(p))] AS regime FROM f), c AS (SELECT symbol, lag(regime) OVER ({W}) AS source, regime AS target FROM s),
 n AS (SELECT symbol, source, target, count(*) AS n FROM c WHERE source IS NOT NULL GROUP BY ALL)
 SELECT symbol, source, target, n, round(n / sum(n) OVER (PARTITION BY symbol, source), 6) AS share FROM n""")  # fmt: skip
def st12_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often each regime follows each."""
    named = st12(spark, d).select("symbol", "day", "regime")
    steps = rolling(named, KEYS, ORDER, bar_bucket(), lambda w: {"source": F.lag("regime").over(w)}, before=1).where("source is not null")
    n = steps.groupBy("symbol", "source", F.col("regime").alias("target")).agg(F.count("*").alias("n"))
    total = n.groupBy("symbol", "source").agg(F.sum("n").alias("total"))
    return n.join(total, ["symbol", "source"]).select("symbol", "source", "target", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# ---- Kalman ----------------------------------------------------------------------------------------------------------

SPEC = K.KalmanSpec(states=2, process=0.05, noise=25.0, gate=3.0)


def _filter_sql(adapt: bool) -> str:
    """Recursive SQL of the two-state filter: x (level, velocity), P, noises q, off and r, the last innovations, and what was seen."""
    q, r = SPEC.process, SPEC.noise
    new = "CASE WHEN outlier THEN past ELSE list_append(past, y)[-50:] END" if adapt else "past"
    var, n = "list_var_pop(past2)", "len(past2) >= 10" if adapt else "false"
    scale = "CASE WHEN ratio > 1.5 THEN 0.95::DOUBLE + 0.05::DOUBLE * least(ratio, 3) WHEN ratio < 0.5 THEN 0.95::DOUBLE + 0.05::DOUBLE * greatest(ratio, 0.3::DOUBLE) ELSE 1 END"
    return f"""t AS MATERIALIZED (SELECT symbol, event_id, bid AS z, row_number() OVER (PARTITION BY symbol ORDER BY time_msc, event_id) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks),
 k AS (SELECT symbol, event_id, i, n, z AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, {q!r}::DOUBLE AS q, 0.0::DOUBLE AS o, {r!r}::DOUBLE AS r, []::DOUBLE[] AS past,
   0.0::DOUBLE AS y, {r!r}::DOUBLE AS s, false AS outlier FROM t WHERE i = 1
  UNION ALL SELECT symbol, event_id, i, n, x, v, p00, p01, p11, CASE WHEN {n} THEN greatest(q * scale, 1e-8) ELSE q END, CASE WHEN {n} THEN greatest(o * scale, 1e-8) ELSE o END, r2, past2, y, s, outlier
  FROM (SELECT *, {scale} AS scale FROM (SELECT *, {var} / greatest(p00 + r2, 1e-12) AS ratio FROM (SELECT *, CASE WHEN {n} THEN 0.95::DOUBLE * r + 0.05::DOUBLE * greatest({var}, 1e-6) ELSE r END AS r2 FROM (
   SELECT symbol, event_id, i, n, y, s, outlier, q, o, r, {new} AS past2, CASE WHEN outlier THEN xp ELSE xp + g0 * y END AS x, CASE WHEN outlier THEN v ELSE v + g1 * y END AS v,
    CASE WHEN outlier THEN a ELSE (1 - g0) * (1 - g0) * a + r * g0 * g0 END AS p00, CASE WHEN outlier THEN b ELSE (1 - g0) * (b - g1 * a) + r * g0 * g1 END AS p01,
    CASE WHEN outlier THEN c ELSE c - 2 * g1 * b + g1 * g1 * a + r * g1 * g1 END AS p11
   FROM (SELECT *, a / s AS g0, b / s AS g1, abs(y) > {SPEC.gate!r}::DOUBLE * sqrt(s) AS outlier FROM (SELECT *, z - xp AS y, greatest(a + r, 1e-12) AS s FROM (
    SELECT t.symbol, t.event_id, t.i, t.n, t.z, k.x + k.v AS xp, k.v, p00 + 2 * p01 + p11 + q AS a, p01 + p11 + o AS b, p11 + q AS c, q, o, r, past FROM k JOIN t ON t.symbol = k.symbol AND t.i = k.i + 1))))))))"""


@query("st19_kalman_trend", f"""WITH RECURSIVE {TICKS_SQL}, {_filter_sql(adapt=True)}
 SELECT symbol, event_id, round(x, 4) AS level, round(v, 4) AS velocity, round(sqrt(p00), 4) AS uncertainty, round(y, 4) AS innovation, round(s, 3) AS innovation_var, outlier, round(q, 5) AS process_noise, round(r, 3) AS measurement_noise,
 CASE WHEN len(past) = 0 THEN false WHEN len(past) > 5 THEN list_stddev_pop(past) >= 1e-12 AND abs(past[-1]) > 3 * list_stddev_pop(past) ELSE abs(past[-1]) > 3 END AS regime_change FROM k""")  # fmt: skip
def st19_trend(spark: SparkSession, d: str) -> DataFrame:
    """Level and velocity with the gate and adaptive noise, over each symbol's whole series."""
    out = K.kalman(ticks(spark, d), KEYS, ["time_msc", "event_id"], tick_bucket(), "bid", ["event_id"], SPEC)
    places = {"level": 4, "velocity": 4, "uncertainty": 4, "innovation": 4, "innovation_var": 3, "process_noise": 5, "measurement_noise": 3}
    return out.select("symbol", "event_id", *[F.round(c, n).alias(c) for c, n in places.items()], "outlier", "regime_change")


@query("k21_rts_smoother", f"""WITH RECURSIVE {TICKS_SQL}, {_filter_sql(adapt=False)},
 m AS MATERIALIZED (SELECT *, p00 + 2 * p01 + p11 + q AS a, p01 + p11 AS b, p11 + q AS c FROM k),
 g AS MATERIALIZED (SELECT *, ((p00 + p01) * c - p01 * b) / (a * c - b * b) AS c00, (p01 * a - (p00 + p01) * b) / (a * c - b * b) AS c01, ((p01 + p11) * c - p11 * b) / (a * c - b * b) AS c10, (p11 * a - (p01 + p11) * b) / (a * c - b * b) AS c11 FROM m),
 s2 AS (SELECT symbol, event_id, i, x AS sx, v AS sv FROM g WHERE i = n
  UNION ALL SELECT g.symbol, g.event_id, g.i, g.x + c00 * (sx - g.x - g.v) + c01 * (sv - g.v), g.v + c10 * (sx - g.x - g.v) + c11 * (sv - g.v) FROM s2 JOIN g ON g.symbol = s2.symbol AND g.i = s2.i - 1)
 SELECT symbol, event_id, round(sx, 4) AS level, round(sv, 4) AS velocity FROM s2""")  # fmt: skip
def k21(spark: SparkSession, d: str) -> DataFrame:
    """The smoother that looks back from the end of each series, with the gate."""
    out = K.smoothed(ticks(spark, d), KEYS, ["time_msc", "event_id"], tick_bucket(), "bid", ["event_id"], SPEC, block=700)
    return out.select("symbol", "event_id", F.round("level", 4).alias("level"), F.round("velocity", 4).alias("velocity"))


# ---- validators and trends -------------------------------------------------------------------------------------------

JUMP, SPREAD, GAP_MS = 0.5, 0.05, 600_000


@query("p19_tick_validator", f"""WITH RECURSIVE {TICKS_SQL}, j AS (SELECT *, (bid + ask) / 2 AS mid, CASE WHEN bid <= 0 OR ask <= 0 OR bid IS NULL OR ask IS NULL THEN 'non_positive' WHEN ask < bid THEN 'crossed' WHEN ask - bid > {SPREAD} THEN 'wide_spread' END AS bad FROM ticks),
 g AS MATERIALIZED (SELECT symbol, event_id, mid, row_number() OVER (PARTITION BY symbol ORDER BY time_msc, event_id) AS i FROM j WHERE bad IS NULL),
 a AS (SELECT symbol, event_id, i, mid AS last, true AS ok FROM g WHERE i = 1 UNION ALL
  SELECT g.symbol, g.event_id, g.i, CASE WHEN abs(g.mid - a.last) / a.last <= {JUMP} THEN g.mid ELSE a.last END, abs(g.mid - a.last) / a.last <= {JUMP} FROM a JOIN g ON g.symbol = a.symbol AND g.i = a.i + 1),
 v AS (SELECT j.symbol, j.event_id, time_msc, CASE WHEN bad IS NULL AND NOT ok THEN 'price_jump' ELSE bad END AS reason FROM j LEFT JOIN a ON a.event_id = j.event_id)
 SELECT symbol, event_id, reason, reason IS NULL AND coalesce(time_msc - max(CASE WHEN reason IS NULL THEN time_msc END) OVER (PARTITION BY symbol ORDER BY time_msc, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {GAP_MS}, false) AS gap FROM v""")  # fmt: skip
def p19(spark: SparkSession, d: str) -> DataFrame:
    """Ticks judged one by one, the price against the last accepted one."""
    t = ticks(spark, d).select("symbol", "event_id", "time_msc", "bid", "ask")
    out = M.validate_ticks(t, KEYS, ["time_msc", "event_id"], tick_bucket(), SPREAD, JUMP, GAP_MS)
    return out.select("symbol", "event_id", "reason", "gap")


_TR1 = "CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END"


@query("k11_halftrend", f"""WITH {BARS_SQL}, a AS (SELECT *, lag(close) OVER ({W}) AS p FROM bars), b AS (SELECT *, {_TR1} AS tr FROM a),
 c AS (SELECT *, count(tr) OVER {rows(100)} AS n, avg(tr) OVER {rows(100)} AS atr, max(high) OVER {rows(2)} AS hi, min(low) OVER {rows(2)} AS lo FROM b),
 e AS (SELECT symbol, day, close, CASE WHEN n >= 100 THEN atr END AS atr, CASE WHEN n >= 100 THEN hi - atr * 1.5 END AS upper, CASE WHEN n >= 100 THEN lo + atr * 1.5 END AS lower FROM c),
 f AS (SELECT *, CASE WHEN close > upper THEN 'UP' WHEN close < lower THEN 'DOWN' ELSE 'FLAT' END AS trend FROM e)
 SELECT symbol, day, trend, round(upper, 6) AS upper, round(lower, 6) AS lower, round(coalesce(CASE WHEN atr > 0 THEN least(CASE trend WHEN 'UP' THEN abs(close - upper) / atr WHEN 'DOWN' THEN abs(lower - close) / atr END, 3) END, 0), 6) AS strength FROM f""")  # fmt: skip
def k11(spark: SparkSession, d: str) -> DataFrame:
    out = M.halftrend(daily_bars(spark, d), KEYS, ORDER, bar_bucket())
    return out.select("symbol", "day", "trend", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"), F.round("strength", 6).alias("strength"))


def _ema_sql(name: str, n: int) -> str:
    return f"{name} AS (SELECT symbol, day, i, close AS y FROM n0 WHERE i = 1 UNION ALL SELECT r.symbol, r.day, r.i, e.y + 2.0::DOUBLE / {n + 1} * (r.close - e.y) FROM {name} e JOIN n0 r ON r.symbol = e.symbol AND r.i = e.i + 1)"


@query("e08_trend_follower", f"""WITH RECURSIVE {BARS_SQL}, {ADX_SQL}, n0 AS MATERIALIZED (SELECT symbol, day, close, row_number() OVER ({W}) AS i FROM bars), {_ema_sql("fast", 50)}, {_ema_sql("slow", 200)},
 way AS (SELECT f.symbol, f.day, f.y AS fast, s.y AS slow, CASE WHEN f.i < 200 OR adx < 25 THEN 'FLAT' WHEN f.y > s.y THEN 'BULL' WHEN f.y < s.y THEN 'BEAR' ELSE 'FLAT' END AS direction, f.i
  FROM fast f JOIN slow s ON s.symbol = f.symbol AND s.i = f.i JOIN adx a ON a.symbol = f.symbol AND a.day = f.day),
 c AS (SELECT *, CASE WHEN direction = lag(direction) OVER ({W}) THEN 0 ELSE 1 END AS new FROM way), runs AS (SELECT *, sum(new) OVER ({W}) AS run FROM c)
 SELECT symbol, day, direction, round(CASE WHEN direction = 'FLAT' THEN 0 ELSE least(1, abs(fast - slow) / slow * 100) END, 5) AS strength,
 CASE WHEN direction = 'FLAT' THEN 0 ELSE row_number() OVER (PARTITION BY symbol, run ORDER BY day) END AS duration FROM runs""")  # fmt: skip
def e08(spark: SparkSession, d: str) -> DataFrame:
    """Fast against slow average where the directional index is strong, and how long the direction has held."""
    b = written(directional_index(daily_bars(spark, d), KEYS, ORDER, bar_bucket()).select("symbol", "day", "close", "adx"), "adx")
    b = ordinal(b, KEYS, ORDER, bar_bucket())
    b = written(ema(written(ema(b, KEYS, "close", 2 / 51, "fast"), "fast"), KEYS, "close", 2 / 201, "slow"), "slow")
    strong = (F.col("_rn") >= 199) & (F.col("adx") >= 25)
    direction = F.when(strong & (F.col("fast") > F.col("slow")), "BULL").when(strong & (F.col("fast") < F.col("slow")), "BEAR").otherwise("FLAT")
    b = b.withColumn("direction", direction).drop("_rn")
    b = M.run_lengths(b, KEYS, ORDER, bar_bucket(), "direction", "duration", off="FLAT")
    strength = F.when(F.col("direction") == "FLAT", 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("fast") - F.col("slow")) / F.col("slow") * 100))
    return b.select("symbol", "day", "direction", F.round(strength, 5).alias("strength"), F.col("duration").cast("long").alias("duration"))


# ---- expanding quantiles ---------------------------------------------------------------------------------------------

_PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _expanding(q: float, name: str, col: str) -> str:
    return f"round(CASE WHEN count({col}) OVER {_PAST} >= 20 THEN quantile_cont({col}, {q}) OVER {_PAST} END, 4) AS {name}"


@query("w10_expanding_quantiles", f"""WITH {BARS_SQL}, a AS (SELECT symbol, day, tick_count, CASE WHEN count(*) OVER {rows(20)} >= 20 THEN stddev_pop(high - low) OVER {rows(20)} END AS spread FROM bars),
 b AS (SELECT symbol, day, {_expanding(0.33, "low_spread", "spread")}, {_expanding(0.66, "high_spread", "spread")}, {_expanding(0.8, "top_spread", "spread")}, spread FROM a)
 SELECT symbol, day, low_spread, high_spread, top_spread, coalesce(spread < low_spread, false) AS calm FROM b""")  # fmt: skip
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the spread of ranges over all bars before each bar."""
    span = F.col("high") - F.col("low")
    b = over_bars(spark, d, lambda w: {"spread": F.when(F.count("*").over(frame(w, 20)) >= 20, F.stddev_pop(span).over(frame(w, 20)))}, 20)
    out = expanding_quantiles(b.select("symbol", "day", "spread"), KEYS, ORDER, bar_bucket(), "spread", {"low_spread": 0.33, "high_spread": 0.66, "top_spread": 0.8}, least=20, block=500)
    return picked(out, "low_spread", "high_spread", "top_spread", places=4).join(out.select("symbol", "day", F.coalesce(F.col("spread") < F.round("low_spread", 4), F.lit(False)).alias("calm")), ["symbol", "day"])

