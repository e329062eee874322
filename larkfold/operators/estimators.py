"""Estimates over long series from sums over blocks: unit-root and cointegration tests, cross impact, and a two-sided Hawkes process.

Least squares needs sums of products only. Blocks (with the rows that their lags reach into) give a Gram matrix each, Spark adds them, and a
key's system is solved on one row. The Hawkes likelihood and its gradient are recurrences whose blocks compose in closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.blocks import BLOCK, each_block, kinds, numbers, pack, pack_with_past
from larkfold.operators.series import rolling
from larkfold.scratch import written

#: Response surface of the unit-root statistic with a constant (largest, smallest and switching value, and polynomials), and the 95 % values of the trace statistic of two series.
TAU_MOST, TAU_LEAST, TAU_SWITCH = 2.74, -18.83, -1.61
TAU_SMALL, TAU_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
TRACE_95 = (15.4943, 3.8415)


def unit_root_p(tau: float) -> float:
    """Probability of a smaller statistic under a unit root."""
    if tau >= TAU_MOST:
        return 1.0
    if tau <= TAU_LEAST:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(TAU_SMALL if tau <= TAU_SWITCH else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def added(matrices: DataFrame, keys: list[str], column: str = "_m") -> DataFrame:
    """(keys, the sum of all flat matrices of a key as one array), added element by element."""
    each = matrices.select(*keys, F.posexplode(column).alias("_pos", "_v")).groupBy(*keys, "_pos").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_v")))["_v"].alias(column))


def _lag_gram(x: np.ndarray, own: int, first: int, lags: int) -> np.ndarray:
    """Products of (difference, 1, level before, differences before) over a block's own rows that have all lags."""
    m, d = lags + 3, np.diff(x)
    # row t (in the array) has difference d[t - 1], level x[t - 1] and differences d[t - 2] down to d[t - 1 - lags]
    t = np.arange(max(own, lags + 1), len(x))
    t = t[first + t > lags]
    if not len(t):
        return np.zeros((m, m))
    past = sliding_window_view(d, lags + 1)[t - 1 - lags][:, ::-1]
    a = np.concatenate([past[:, :1], np.ones((len(t), 1)), x[t - 1][:, None], past[:, 1:]], axis=1)
    return a.T @ a


def _fit(g: np.ndarray, lags: int) -> tuple[float, float, float]:
    """(rows, residual sum of squares, t of the level) of the regression with so many lags, from its Gram matrix."""
    n, a, b = g[1, 1], g[1 : 3 + lags, 1 : 3 + lags], g[1 : 3 + lags, 0]
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    rss = max(float(g[0, 0] - b @ beta), 0.0)
    free = n - len(b)
    return n, rss, float(beta[1] / math.sqrt(rss / free * inverse[1, 1])) if free > 0 and rss > 0 and inverse[1, 1] > 0 else math.nan


def unit_root_test(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, n, lags, statistic, p) of the augmented Dickey-Fuller test with a constant.

    The number of lags has the least information criterion on the rows that have all lags (up to 12 (n / 100)^(1/4), or ``most``); the statistic is that of all rows
    that have the chosen ones. A series of fewer than 10 rows, or without deviation, has p = 1 and no statistic."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    upto = F.least(F.ceil(12 * F.pow(F.col("_n") / 100, F.lit(0.25))), F.floor(F.col("_n") / 2) - 2) if most is None else F.least(F.lit(most), F.floor(F.col("_n") / 2) - 2)
    sizes = written(sizes.withColumn("_lags", F.when((F.col("_n") >= 10) & (F.col("_sd") > 0), upto.cast("int"))), "root-sizes")
    reach = sizes.agg(F.max("_lags")).first()[0] or 0
    blocks = written(pack_with_past(df, keys, order, bucket, {"_x": value}, reach + 1, block), "root-blocks")

    def products(lags: DataFrame) -> DataFrame:
        def gram(row: dict) -> dict:
            m = _lag_gram(numbers(row["_x"]) - row["_mean"], row["_own"], row["_first"], row["_lags"])
            return {k: [row[k]] for k in keys} | {"_m": m.reshape(1, -1)}

        return added(each_block(blocks.join(lags.where("_lags is not null").select(*keys, "_lags", "_mean"), keys), gram, f"{kinds(blocks, keys)}, _m array<double>"), keys)

    own = kinds(blocks, keys)

    def choose(batches):
        for pdf in batches:
            best = []
            for flat in pdf["_m"]:
                size = math.isqrt(len(flat))
                g = np.reshape(flat, (size, size))
                criteria = []
                for p in range(size - 2):
                    n, rss, _ = _fit(g, p)
                    criteria.append((n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (p + 2) if rss > 0 else -math.inf, p))
                best.append(min(criteria)[1])
            yield pdf[keys].assign(_lags=best)

    chosen = written(products(sizes).mapInPandas(choose, f"{own}, _lags int").join(sizes.drop("_lags"), keys), "root-lags")

    def solve(batches):
        for pdf in batches:
            t = [_fit(np.reshape(m, (math.isqrt(len(m)),) * 2), math.isqrt(len(m)) - 3)[2] for m in pdf["_m"]]
            yield pdf[keys].assign(statistic=t, p=[unit_root_p(v) if v == v else 1.0 for v in t])

    tested = products(chosen).mapInPandas(solve, f"{own}, statistic double, p double").join(chosen.select(*keys, "_lags"), keys)
    out = sizes.select(*keys, F.col("_n").alias("n")).join(tested, keys, "left")
    return out.select(*keys, "n", F.col("_lags").alias("lags"), "statistic", F.coalesce("p", F.lit(1.0)).alias("p"))


def trace_test(df: DataFrame, keys: list[str], order: list[str], bucket: Column, y: str, x: str, block: int = BLOCK) -> DataFrame:
    """(keys, trace_0, trace_1, cointegrated) of the Johansen test of two series with one lagged difference and a constant; 0 with fewer than 20 rows."""
    means = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    blocks = pack_with_past(df, keys, order, bucket, {"_y": y, "_x": x}, 2, block).join(means, keys)

    def gram(row: dict) -> dict:
        v = np.stack([numbers(row["_y"]) - row["_my"], numbers(row["_x"]) - row["_mx"]], axis=1)
        d = np.diff(v, axis=0)
        t = np.arange(max(row["_own"], 2), len(v))
        a = np.concatenate([d[t - 1], d[t - 2], v[t - 1], np.ones((len(t), 1))], axis=1) if len(t) else np.zeros((0, 7))
        return {k: [row[k]] for k in keys} | {"_m": (a.T @ a).reshape(1, -1)}

    def solve(batches):
        for pdf in batches:
            out = []
            for flat in pdf["_m"]:
                g = np.reshape(flat, (7, 7))
                n = g[6, 6]
                s = (g[:6, :6] - np.outer(g[:6, 6], g[:6, 6]) / max(n, 1)) / max(n, 1)  # around the means
                now, lag, level = slice(0, 2), slice(2, 4), slice(4, 6)
                left = lambda a, b: s[a, b] - s[a, lag] @ np.linalg.pinv(s[lag, lag]) @ s[lag, b]  # noqa: E731, B023
                s00, s0k, skk = left(now, now), left(now, level), left(level, level)
                roots = np.sort(np.real(np.linalg.eigvals(np.linalg.pinv(skk) @ s0k.T @ np.linalg.pinv(s00) @ s0k)))[::-1]
                logs = np.log(np.maximum(1 - roots, 1e-300))
                out.append((float(-n * logs.sum()), float(-n * logs[1])))
            yield pdf[keys].assign(trace_0=[a for a, _ in out], trace_1=[b for _, b in out])

    found = added(each_block(blocks, gram, f"{kinds(blocks, keys)}, _m array<double>"), keys).mapInPandas(solve, f"{kinds(blocks, keys)}, trace_0 double, trace_1 double")
    out = means.join(found, keys, "left")
    enough = F.col("_n") >= 20
    trace = [F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in ("trace_0", "trace_1")]
    return out.select(*keys, *trace).withColumn("cointegrated", F.col("trace_0") > TRACE_95[0])


# ---- cross impact ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Impact:
    """``matrix[i][j]``: the return of symbol i for a standard deviation of symbol j's flow one bar before; ``flow``: the last standardised flows."""

    symbols: list[str]
    matrix: np.ndarray
    flow: np.ndarray

    def of(self, target: str) -> dict[str, float]:
        """What the last flows say of a symbol's next return, and how its impacts are spread over the others."""
        i = self.symbols.index(target)
        predicted = float(self.matrix[i] @ self.flow)
        others = np.abs(np.delete(self.matrix[i], i))
        share = others / others.sum() if others.sum() > 0 else np.zeros(len(others))
        entropy = float(-np.sum(share * np.log(share + 1e-12)) / np.log(len(share) + 1e-12)) if others.sum() > 0 else 0.0
        return {"predicted": predicted, "signal": math.tanh(predicted * 50), "strength": float(np.linalg.norm(others)), "entropy": entropy, "largest": float(others.max(initial=0.0))}


def cross_impact(bars: DataFrame, symbol: str, order: str, price: str, bucket: Column, flow: str | None = None, ridge: float = 1e-3, block: int = BLOCK) -> Impact | None:
    """Ridge regression of all symbols' log returns on all symbols' standardised flows (returns, if there is no flow) one bar before, over the bars that all symbols have.

    The symbols' number squared (not the bars') is what reaches the driver. None with fewer than 5 common returns."""
    symbols = sorted(r[0] for r in bars.select(symbol).where(F.col(symbol).isNotNull()).distinct().collect())
    pick = lambda c: F.array(*[F.max(F.when(F.col(symbol) == s, F.col(c).cast("double"))) for s in symbols])
    wide = bars.groupBy(order).agg(pick(price).alias("_p"), pick(flow or price).alias("_f")).withColumn("_all", F.lit(0))
    wide = wide.where(F.forall("_p", lambda v: v.isNotNull()) & F.forall("_f", lambda v: v.isNotNull()))
    logs = F.transform("_p", lambda v: F.log(F.greatest(v, F.lit(1e-9))))
    steps = rolling(wide.withColumn("_l", logs), ["_all"], [order], bucket, lambda w: {"_past": F.lag("_l").over(w)}, before=1).where("_past is not null")
    steps = steps.select("_all", order, F.zip_with("_l", "_past", lambda a, b: a - b).alias("_r"), "_f")
    flows = F.col("_f") if flow else F.col("_r")
    blocks = written(pack_with_past(steps.select("_all", order, "_r", flows.alias("_f")), ["_all"], [order], bucket, {"_r": "_r", "_f": "_f"}, 1, block), "impact-blocks")
    k = len(symbols)
    rows = lambda a: np.array(a.to_pylist(), float).reshape(-1, k)

    def moments(row: dict) -> dict:
        f = rows(row["_f"])[row["_own"] :]
        return {"_all": [0], "_m": np.concatenate([[len(f)], f.sum(axis=0), (f * f).sum(axis=0)])[None]}

    first = added(each_block(blocks, moments, "_all int, _m array<double>"), ["_all"]).first()
    if first is None or first["_m"][0] < 5:
        return None
    n, total, square = first["_m"][0], np.array(first["_m"][1 : 1 + k]), np.array(first["_m"][1 + k :])
    mean, sd = total / n, np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
    scale = lambda f: np.where(sd < 1e-12, 0.0, (f - mean) / np.where(sd < 1e-12, 1.0, sd))

    def gram(row: dict) -> dict:
        f, r = scale(rows(row["_f"])), rows(row["_r"])
        t = np.arange(max(row["_own"], 1), len(r))
        return {"_all": [0], "_m": np.concatenate([(f[t - 1].T @ f[t - 1]).ravel(), (f[t - 1].T @ r[t]).ravel()])[None]}

    m = np.array(added(each_block(blocks, gram, "_all int, _m array<double>"), ["_all"]).first()["_m"])
    xx, xy = m[: k * k].reshape(k, k), m[k * k :].reshape(k, k)
    beta = np.linalg.pinv(xx + ridge * np.eye(k)) @ xy
    last = steps.select(F.max_by(flows, F.col(order)).alias("f")).first()["f"]
    return Impact(symbols, beta.T, scale(np.array(last)))


# ---- two-sided Hawkes process ----------------------------------------------------------------------------------------

#: mu of either side, alpha (buy by buy, buy by sell, sell by buy, sell by sell), beta of either side's kernel; their bounds.
HAWKES_START, LOW, HIGH = (0.2, 0.2, 0.6, 0.2, 0.2, 0.6, 1.5, 1.5), 1e-6, 10.0


def _decayed(t: np.ndarray, side: np.ndarray, beta: float, j: int, start: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """R = sum of exp(-beta age) and D = sum of age exp(-beta age) of side j's events before each event, and after the last one, from those at t[0]."""
    n = len(t)
    keep, gap = np.exp(-beta * np.diff(t)), np.diff(t)
    r, d = np.empty(n), np.empty(n)
    r[0], d[0] = start
    one = (side == j).astype(float)
    for i in range(1, n):
        r[i] = keep[i - 1] * (r[i - 1] + one[i - 1])
        d[i] = keep[i - 1] * d[i - 1] + gap[i - 1] * r[i]
    return r, d, float(r[-1] + one[-1]), float(d[-1])


def spectral_radius(theta: np.ndarray) -> float:
    """Events that an event brings about: the branching ratio."""
    a, b = np.reshape(theta[2:6], (2, 2)), theta[6:8]
    return float(np.max(np.real(np.linalg.eigvals(a / b[None, :]))))


def hawkes_loss(blocks: DataFrame, keys: list[str], theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of all series and its gradient. Blocks: ``_t`` (times from the start of the series), ``_side`` (0 or 1)."""
    mu, a, b = theta[:2], np.reshape(theta[2:6], (2, 2)), theta[6:8]

    def ends(row: dict) -> dict:
        t, side = numbers(row["_t"]), numbers(row["_side"])
        after = [_decayed(t, side, b[j], j, (0.0, 0.0))[2:] for j in (0, 1)]
        return {k: [row[k]] for k in [*keys, "_b"]} | {"_at": np.array([[t[0], t[-1], *after[0], *after[1]]])}

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, entry, state, last = pdf.sort_values("_b", ignore_index=True), [], np.zeros(4), None  # one row a block
        for at in pdf["_at"]:
            if last is not None:
                state = _aged(state, at[0] - last, b)
            entry.append([last if last is not None else at[0], *state])
            state, last = _aged(state, at[1] - at[0], b) + at[2:], at[1]
        return pdf[[*keys, "_b"]].assign(_entry=entry)

    def parts(row: dict) -> dict:
        t, side = numbers(row["_t"]), numbers(row["_side"]).astype(int)
        before, *state = row["_entry"].to_pylist()
        r, d, g, loss = [], [], np.zeros(8), 0.0
        for j in (0, 1):
            x = _decayed(t, side, b[j], j, (state[2 * j], state[2 * j + 1]))
            r.append(x[0])
            d.append(x[1])
        r, d = np.array(r), np.array(d)
        for i in (0, 1):
            on = side == i
            rate = np.maximum(mu[i] + a[i] @ r[:, on], 1e-12)
            loss -= np.log(rate).sum()
            g[i] -= (1 / rate).sum()
            for j in (0, 1):
                g[2 + 2 * i + j] -= (r[j, on] / rate).sum()
                g[6 + j] += a[i, j] * (d[j, on] / rate).sum()
        # integral over each gap: what decays in it is R just after the event before minus R at this one
        span = t[-1] - before
        loss += mu.sum() * span
        g[:2] += span
        for j in (0, 1):
            own = side == j
            full = np.concatenate([[_before(state, j, t[0] - before, b)[0]], r[j, :-1] + own[:-1]])
            full_d = np.concatenate([[_before(state, j, t[0] - before, b)[1]], d[j, :-1]])
            mass = (full - r[j]).sum() / b[j]
            loss += a[:, j].sum() * mass
            g[2 + j] += mass
            g[4 + j] += mass
            # d/d beta of (R0 - R) / beta, with dR/dbeta = -D
            g[6 + j] += a[:, j].sum() * ((d[j] - full_d).sum() / b[j] - mass / b[j])
        return {"_all": [0], "_m": np.concatenate([[loss], g])[None]}

    joined = blocks.join(each_block(blocks, ends, f"{kinds(blocks, keys)}, _b long, _at array<double>").groupBy(*keys).applyInPandas(carry, f"{kinds(blocks, keys)}, _b long, _entry array<double>"), [*keys, "_b"])
    row = added(each_block(joined, parts, "_all int, _m array<double>"), ["_all"]).first()
    if row is None:
        return 0.0, np.zeros(8)
    return float(row["_m"][0]), np.array(row["_m"][1:])


def _aged(state: np.ndarray, age: float, b: np.ndarray) -> np.ndarray:
    """(R, D) of both sides after a time without events."""
    r, d, keep = state[0::2], state[1::2], np.exp(-b * age)
    return np.stack([keep * r, keep * (d + age * r)], axis=1).ravel()


def _before(state: list[float], j: int, age: float, b: np.ndarray) -> tuple[float, float]:
    """(R, D) of a side at the event before, from those at this one."""
    r = state[2 * j] * math.exp(b[j] * age)
    return r, state[2 * j + 1] * math.exp(b[j] * age) - age * r


def fit_hawkes(events: DataFrame, keys: list[str], order: list[str], bucket: Column, time: Column, side: Column, iterations: int = 15, block: int = BLOCK) -> tuple[np.ndarray, float]:
    """(parameters, negative log likelihood) of one process for all series: quasi-Newton steps in the logarithms, within bounds. A penalty keeps the branching ratio under 1.

    ``time`` is in units in which a kernel's decay is between 1e-6 and 10; ``side`` is 0 or 1."""
    blocks = written(pack(events, keys, order, bucket, {"_t": time.cast("double"), "_side": side.cast("int")}, block), "hawkes-blocks")

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        theta = np.exp(z)
        value, g = hawkes_loss(blocks, keys, theta)
        over = spectral_radius(theta) - 0.995
        if over > 0:
            value += 1e5 * over * over
            near = np.array([(spectral_radius(theta * np.where(np.arange(8) == i, 1 + 1e-6, 1)) - over - 0.995) / (1e-6 * theta[i]) for i in range(8)])
            g = g + 2e5 * over * near
        return value, g * theta

    z, inverse = np.log(HAWKES_START), np.eye(8)
    value, g = loss(z)
    for i in range(iterations):
        step = -inverse @ g
        if g @ step >= 0:
            inverse, step = np.eye(8), -g
        size = min(1.0, 1.0 / max(np.abs(step).max(), 1e-12)) if i == 0 or np.abs(step).max() > 2 else 1.0
        while True:
            new = np.clip(z + size * step, math.log(LOW), math.log(HIGH))
            try_value, try_g = loss(new)
            if try_value <= value + 1e-4 * g @ (new - z) or size < 1e-4:
                break
            size /= 3
        s, y = new - z, try_g - g
        if not value - try_value > 1e-8 * max(1.0, abs(value)):
            break
        z, value, g = new, try_value, try_g
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            turn = np.eye(8) - rho * np.outer(s, y)
            inverse = turn @ inverse @ turn.T + rho * np.outer(s, s)
    return np.exp(z), value
