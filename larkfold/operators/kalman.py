"""Kalman filter of level, velocity and acceleration with a gate and adaptive noise, and the smoother that looks back.

Whether an observation passes the gate depends on the data, so steps don't compose in closed form: blocks walk speculatively
(``blocks.with_entries``) and repeat where they started from the wrong state. The smoother is a chain of affine maps from a
row's smoothed state to the one before; a block's maps are composed to one, and those of a series are composed backwards.

Adaptive noise rests in a dead zone in which it keeps what it has, so it doesn't forget its past: then laps of blocks are walked in
order, each once and from its true start.

Defined cases: a null or NaN observation only predicts; before the first observation all is null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.blocks import BLOCK, each_block, element, kinds, lapped, numbers, pack, with_entries
from larkfold.scratch import written


@dataclass(frozen=True)
class KalmanSpec:
    """States (1 level, 2 with velocity, 3 with acceleration), noises, the gate in standard deviations (0: none), and how noises adapt."""

    states: int = 2
    process: float = 1e-4
    noise: float = 1e-2
    gate: float = 4.0
    adapt: bool = True
    window: int = 50
    rate: float = 0.05
    least_process: float = 1e-8
    least_noise: float = 1e-6
    #: Innovations before noises adapt, and how many standard deviations of the last innovations a change of regime is.
    warm: int = 10
    change: float = 3.0

    def transition(self) -> np.ndarray:
        return np.array([[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])[: self.states, : self.states]


class Filter:
    """One walk. The state is a list of numbers, so that a walk can go on where another ended. Matrices are written out in numbers, as
    arrays of so few cost far more than their arithmetic; states that a spec doesn't have stay 0."""

    def __init__(self, spec: KalmanSpec, state: list[float] | None) -> None:
        self.spec, self.f, self.n = spec, spec.transition(), spec.states
        self.var: float | None = None
        if state is None:
            self._x, self._p = [0.0, 0.0, 0.0], [1.0, 0.0, 0.0, float(self.n > 1), 0.0, float(self.n > 2)]
            self.q, self.off, self.r, self.past, self.begun = spec.process, 0.0, spec.noise, [], False
        else:
            self._x, self._p = list(state[:3]), list(state[3:9])
            self.q, self.off, self.r, begun = state[9:13]
            self.begun, self.past = bool(begun), list(state[13:])

    @property
    def x(self) -> np.ndarray:
        return np.array(self._x[: self.n])

    @property
    def p(self) -> np.ndarray:
        a, b, d, c, e, g = self._p
        return np.array([[a, b, d], [b, c, e], [d, e, g]])[: self.n, : self.n]

    def state(self) -> list[float]:
        return [*self._x, *self._p, self.q, self.off, self.r, float(self.begun), *self.past]

    def process(self) -> np.ndarray:
        return np.full((self.n, self.n), self.off) + (self.q - self.off) * np.eye(self.n)

    def step(self, z: float) -> tuple[float, float, bool] | None:
        """(innovation, its variance, outlier) of the next observation; None if there is nothing to say."""
        blind = z != z
        if not self.begun:
            if blind:
                return None
            self._x[0], self.begun = z, True
            return 0.0, self.r, False
        spec, n, q, off, r = self.spec, self.n, self.q, self.off, self.r
        x0, x1, x2 = self._x
        a, b, d, c, e, g = self._p
        if n == 1:
            a += q
        elif n == 2:
            x0 += x1
            a, b, c = a + 2 * b + c + q, b + c + off, c + q
        else:
            x0, x1 = x0 + x1 + 0.5 * x2, x1 + x2
            m0, m1, m2 = a + b + 0.5 * d, b + c + 0.5 * e, d + e + 0.5 * g  # the first row of F P
            a, b, d, c, e, g = m0 + m1 + 0.5 * m2 + q, m1 + m2 + off, m2 + off, c + 2 * e + g + q, e + g + off, g + q
        y, s = (math.nan if blind else z - x0), max(a + r, 1e-12)
        outlier = not blind and spec.gate > 0 and abs(y) > spec.gate * math.sqrt(s)
        if not blind and not outlier:
            g0, g1, g2 = a / s, b / s, d / s
            k = 1 - g0
            x0 += g0 * y
            if n > 1:
                x1 += g1 * y
                c = c - 2 * g1 * b + g1 * g1 * a + r * g1 * g1
            if n > 2:
                x2 += g2 * y
                e = e - g1 * d - g2 * b + g1 * g2 * a + r * g1 * g2
                g = g - 2 * g2 * d + g2 * g2 * a + r * g2 * g2
                d = k * (d - g2 * a) + r * g0 * g2
            if n > 1:
                b = k * (b - g1 * a) + r * g0 * g1
            a = k * k * a + r * g0 * g0
            self.past.append(y)
            if len(self.past) > spec.window:
                del self.past[0]
            self.var = None
        self._x, self._p = [x0, x1, x2], [a, b, d, c, e, g]
        if spec.adapt and not blind and len(self.past) >= spec.warm:
            self._adapt()
        return y, s, outlier

    def variance(self) -> float:
        """Of the last innovations."""
        if self.var is None:
            mean = sum(self.past) / len(self.past)
            apart = [y - mean for y in self.past]
            self.var = math.sumprod(apart, apart) / len(apart)
        return self.var

    def _adapt(self) -> None:
        spec, var = self.spec, self.variance()
        self.r = (1 - spec.rate) * self.r + spec.rate * max(var, spec.least_noise)
        ratio = var / max(self._p[0] + self.r, 1e-12)
        if not 0.5 <= ratio <= 1.5:
            by = 1 - spec.rate + spec.rate * min(max(ratio, 0.3), 3.0)
            self.q, self.off = self.q * by, self.off * by
        self.q, self.off = max(self.q, spec.least_process), max(self.off, spec.least_process)

    def changed(self) -> bool:
        """The last accepted innovation is far out of the last ones."""
        if not self.past:
            return False
        sd = math.sqrt(self.variance()) if len(self.past) > 5 else 1.0
        return sd >= 1e-12 and abs(self.past[-1]) > self.spec.change * sd


STATES = ["level", "velocity", "acceleration"]
FIELDS = "level double, velocity double, acceleration double, uncertainty double, innovation double, innovation_var double, log_likelihood double, outlier boolean, process_noise double, measurement_noise double, regime_change boolean"


def _rows(spec: KalmanSpec, z: np.ndarray, state: list[float] | None) -> Iterator[tuple | None]:
    f = Filter(spec, state)
    for v in z.tolist():
        said = f.step(v)
        if said is None:
            yield None
            continue
        y, s, outlier = said
        level, velocity, acceleration = f._x
        log = -0.5 * (math.log(2 * math.pi * s) + y * y / s)
        yield level, velocity, acceleration, math.sqrt(f._p[0]), y, s, log, outlier, f.q, f.r, f.changed()


def kalman(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, ids: list[str], spec: KalmanSpec, block: int = BLOCK, tolerance: float = 0.0) -> DataFrame:
    """(keys, ids, what the filter knows after each row)."""
    blocks = lapped(pack(df, keys, order, bucket, {**{i: i for i in ids}, "_z": value}, block), "kalman-blocks", block)

    def leave(row: dict, entry: list[float] | None) -> list[float]:
        f = Filter(spec, entry)
        for v in numbers(row["_z"]).tolist():
            f.step(v)
        return f.state()

    def walk(row: dict) -> dict:
        names = [c.split()[0] for c in FIELDS.split(", ")]
        out = list(_rows(spec, numbers(row["_z"]), None if row["entry"] is None else row["entry"].to_pylist()))
        made = {n: [None if r is None or r[i] != r[i] else r[i] for r in out] for i, n in enumerate(names)}
        return {k: [row[k]] * len(out) for k in keys} | {i: row[i] for i in ids} | made

    return each_block(with_entries(blocks, keys, leave, tolerance, ["_z"], forgets=not spec.adapt), walk, f"{kinds(blocks, keys)}, {kinds(blocks, ids, element)}, {FIELDS}")


def _affine(spec: KalmanSpec, z: np.ndarray, state: list[float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: C and d of smoothed = C (smoothed one later) + d, and the filtered state; NaN before the first observation."""
    f, n = Filter(spec, state), spec.states
    cs, ds, xs = np.zeros((len(z), n, n)), np.zeros((len(z), n)), np.full((len(z), n), np.nan)
    for t, v in enumerate(z.tolist()):
        if f.step(v) is None:
            continue
        ahead = f.f @ f.p @ f.f.T + f.process()
        if abs(np.linalg.det(ahead)) >= 1e-20:
            cs[t] = f.p @ f.f.T @ np.linalg.inv(ahead)
        ds[t], xs[t] = f.x - cs[t] @ (f.f @ f.x), f.x
    return cs, ds, xs


def smoothed(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, ids: list[str], spec: KalmanSpec, block: int = BLOCK) -> DataFrame:
    """(keys, ids, level, velocity, acceleration given all rows of the series); noises don't adapt."""
    spec = KalmanSpec(**{**spec.__dict__, "adapt": False})
    n = spec.states
    blocks = lapped(pack(df, keys, order, bucket, {**{i: i for i in ids}, "_z": value}, block), "kalman-blocks", block)

    def leave(row: dict, entry: list[float] | None) -> list[float]:
        f = Filter(spec, entry)
        for v in numbers(row["_z"]).tolist():
            f.step(v)
        f.past = []
        return f.state()

    def maps(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _affine(spec, numbers(row["_z"]), None if row["entry"] is None else row["entry"].to_pylist())

    def composed(row: dict) -> dict:
        """The chain from the row after the block to its first row, and what the first row is if nothing comes after."""
        cs, ds, xs = maps(row)
        c, d, last = np.eye(n), np.zeros(n), np.nan_to_num(xs[-1])
        for a, b in zip(reversed(cs), reversed(ds), strict=True):
            c, d = a @ c, a @ d + b
        for a, b in zip(reversed(cs[:-1]), reversed(ds[:-1]), strict=True):
            last = a @ last + b
        return {k: [row[k]] for k in [*keys, "_b"]} | {"c": c.reshape(1, -1), "d": d[None], "last": last[None]}

    walked = written(with_entries(blocks, keys, leave, needs=["_z"]), "kalman-entries")
    ends = each_block(walked, composed, f"{kinds(blocks, keys)}, _b long, c array<double>, d array<double>, last array<double>")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)  # one row a block
        after = [None]
        for i in reversed(range(1, len(pdf))):
            after.append(np.array(pdf["last"][i]) if after[-1] is None else np.reshape(pdf["c"][i], (n, n)) @ after[-1] + pdf["d"][i])
        return pdf[[*keys, "_b"]].assign(after=after[::-1])

    def walk(row: dict) -> dict:
        cs, ds, xs = maps(row)
        out = np.empty_like(xs)
        s = None if row["after"] is None else np.array(row["after"].to_pylist())
        for t in reversed(range(len(xs))):
            s = xs[t] if s is None else cs[t] @ s + ds[t]
            out[t] = s if not np.isnan(xs[t]).any() else np.nan
        columns = {name: out[:, i] if i < n else np.zeros(len(out)) for i, name in enumerate(STATES)}
        return {k: [row[k]] * len(out) for k in keys} | {i: row[i] for i in ids} | columns

    carried = ends.groupBy(*keys).applyInPandas(carry, f"{kinds(blocks, keys)}, _b long, after array<double>")
    return each_block(walked.join(carried, [*keys, "_b"]), walk, f"{kinds(blocks, keys)}, {kinds(blocks, ids, element)}, {', '.join(f'{s} double' for s in STATES)}")
