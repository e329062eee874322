"""Hidden Markov models over long series: EM, filter, smoother and Viterbi path by composed blocks.

A step of the model maps a vector over states to the next one: a K x K matrix in (+, x) for probabilities, in (max, +) for the best
path. A block of a series is the product of its steps' matrices, one row; the rows of a series are composed forwards and
backwards, and each block then knows what enters at either end. Inside a block, rows lie in lanes that step together, so numpy
multiplies a matrix of each lane at once. EM sums what its update needs over blocks in Spark; the driver gets one row.

Defined cases: a row with a null or NaN in an observation says nothing about its state (it still takes a step); a series of one row has its
start only; an empty table fits to the start values and decodes to nothing; ties of a path go to the first state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.blocks import BLOCK, each_block, element, kinds, numbers, pack
from larkfold.scratch import written

#: What is added to variances after each update, and the least relative gain of the likelihood that EM goes on for.
FLOOR, GAIN = 1e-4, 1e-7


@dataclass(frozen=True)
class HiddenMarkov:
    """Gaussian emissions: start (K), transitions (K, K), means (K, D), covariances (K, D, D)."""

    start: np.ndarray
    transitions: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covariances, strict=True)):
            d = x - m
            out[:, k] = -0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + (d @ np.linalg.inv(c) * d).sum(axis=1))
        return np.where(np.isnan(x).any(axis=1)[:, None], 0.0, out)

    def durations(self) -> np.ndarray:
        """Expected rows in each state."""
        stay = np.diag(self.transitions)
        return np.where(stay < 1, 1 / np.maximum(1 - stay, 1e-300), np.inf)

    def labels(self, ret: int = 0, vol: int = 1) -> list[str]:
        """A name for each state: by the mean return and volatility against the states' medians; crisis far above in volatility with a low return."""
        r, v = self.means[:, ret], self.means[:, vol]
        up, loud = r > np.median(r), v > np.median(v)
        crisis = (v > np.median(v) + 1.5 * v.std()) & (r < np.median(r))
        return ["crisis" if c else f"{'bull' if u else 'bear'}_{'volatile' if x else 'quiet'}" for c, u, x in zip(crisis, up, loud, strict=True)]


# ---- one block -------------------------------------------------------------------------------------------------------


def in_lanes(a: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """(n, ...) as (lanes, steps, ...), about as many lanes as steps; the rest is filled."""
    n = len(a)
    steps = max(1, int(np.ceil(np.sqrt(n))))
    short = -n % steps
    return np.concatenate([a, np.broadcast_to(fill, (short, *a.shape[1:]))]).reshape(-1, steps, *a.shape[1:])


def step_matrices(log_e: np.ndarray, transitions: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """By row the matrix from the state before to this state with its emission (scaled); the first row of a series has no step. And the log of all scales."""
    top = log_e.max(axis=1)
    e = np.exp(log_e - top[:, None])
    m = transitions[None] * e[:, None, :]
    if first:
        m[0] = np.diag(e[0])
    return m, float(top.sum())


def block_product(m: np.ndarray) -> np.ndarray:
    """The product of all matrices, scaled to a largest element of 1."""
    lanes = in_lanes(m, np.eye(m.shape[1]))
    p = np.broadcast_to(np.eye(m.shape[1]), (len(lanes), *m.shape[1:]))
    for s in range(lanes.shape[1]):
        p = p @ lanes[:, s]
        p = p / p.max(axis=(1, 2), keepdims=True)
    out = np.eye(m.shape[1])
    for q in p:
        out = out @ q
        out = out / out.max()
    return out


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = v.sum(axis=-1, keepdims=True)
    return v / s, s[..., 0]


def forward(entry: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered probabilities of each row from those before the block, and the log of the likelihood (without the emissions' scales)."""
    lanes = in_lanes(m, np.eye(m.shape[1]))
    starts = np.empty((len(lanes), m.shape[1]))
    a = entry / entry.sum()
    for i, lane in enumerate(_lane_products(lanes)):
        starts[i] = a
        a = _scaled(a @ lane)[0]
    out, logs, a = np.empty(lanes.shape[:3]), 0.0, starts
    for s in range(lanes.shape[1]):
        a, c = _scaled((a[:, None, :] @ lanes[:, s])[:, 0])
        out[:, s] = a
        logs += np.log(c).sum()
    return out.reshape(-1, m.shape[1])[: len(m)], float(logs)


def backward(exit_: np.ndarray, m: np.ndarray) -> np.ndarray:
    """By row how likely what comes after it is from each state (scaled), from that of what comes after the block."""
    lanes = in_lanes(m, np.eye(m.shape[1]))
    ends, b = np.empty((len(lanes), m.shape[1])), exit_ / exit_.sum()
    for i, lane in reversed(list(enumerate(_lane_products(lanes)))):
        ends[i] = b
        b = _scaled(lane @ b)[0]
    out, b = np.empty(lanes.shape[:3]), ends
    for s in reversed(range(lanes.shape[1])):
        out[:, s] = b
        b = _scaled((lanes[:, s] @ b[:, :, None])[:, :, 0])[0]
    return out.reshape(-1, m.shape[1])[: len(m)]


def _lane_products(lanes: np.ndarray) -> np.ndarray:
    p = np.broadcast_to(np.eye(lanes.shape[2]), (len(lanes), *lanes.shape[2:]))
    for s in range(lanes.shape[1]):
        p = p @ lanes[:, s]
        p = p / p.max(axis=(1, 2), keepdims=True)
    return p


def best_steps(log_e: np.ndarray, transitions: np.ndarray, first: bool) -> np.ndarray:
    """As ``step_matrices``, in logarithms."""
    w = np.log(np.maximum(transitions, 1e-300))[None] + log_e[:, None, :]
    if first:
        w[0] = np.where(np.eye(len(transitions), dtype=bool), log_e[0][None, :], -np.inf)
    return w


def _still(k: int) -> np.ndarray:
    return np.where(np.eye(k, dtype=bool), 0.0, -np.inf)


def _best(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (p[..., :, :, None] + w[..., None, :, :]).max(axis=-2)


def _best_lanes(lanes: np.ndarray) -> np.ndarray:
    p = np.broadcast_to(_still(lanes.shape[2]), (len(lanes), *lanes.shape[2:]))
    for s in range(lanes.shape[1]):
        p = _best(p, lanes[:, s])
    return p


def best_block(w: np.ndarray) -> np.ndarray:
    """The best score from each state before the block to each state at its end."""
    out = _still(w.shape[1])
    for p in _best_lanes(in_lanes(w, _still(w.shape[1]))):
        out = _best(out, p)
    return out


def best_path(entry: np.ndarray, last: int, w: np.ndarray) -> np.ndarray:
    """The states of the best path that has the scores ``entry`` before the block and ends in ``last``."""
    k = w.shape[1]
    lanes = in_lanes(w, _still(k))
    starts, d = np.empty((len(lanes), k)), entry
    for i, p in enumerate(_best_lanes(lanes)):
        starts[i] = d
        d = (d[:, None] + p).max(axis=0)
    back, d = np.empty(lanes.shape[:3], int), starts
    for s in range(lanes.shape[1]):
        scores = d[:, :, None] + lanes[:, s]
        back[:, s], d = scores.argmax(axis=1), scores.max(axis=1)
    row = np.arange(len(lanes))
    through = np.broadcast_to(np.arange(k), (len(lanes), k))
    for s in reversed(range(lanes.shape[1])):
        through = np.take_along_axis(back[:, s], through, axis=1)
    at = np.empty(len(lanes), int)
    for i in reversed(range(len(lanes))):
        at[i], last = last, through[i, last]
    path = np.empty(lanes.shape[:2], int)
    for s in reversed(range(lanes.shape[1])):
        path[:, s], at = at, back[row, s, at]
    return path.ravel()[: len(w)]


# ---- series of blocks ------------------------------------------------------------------------------------------------


def _square(values, k: int) -> np.ndarray:
    return np.asarray(values, float).reshape(k, k)


def _joined(blocks: DataFrame, keys: list[str], emit, transitions: np.ndarray, start: np.ndarray, best: bool = False) -> DataFrame:
    """Blocks with what enters them at both ends: ``_entry`` and ``_exit`` vectors, and for paths ``_last``, the state at the end."""
    k = len(start)

    def product(row: dict) -> dict:
        first = row["_first"] == 0
        p = best_block(best_steps(emit(row), transitions, first)) if best else block_product(step_matrices(emit(row), transitions, first)[0])
        return {c: [row[c]] for c in [*keys, "_b"]} | {"_p": p.reshape(1, -1)}

    ends = each_block(blocks, product, f"{kinds(blocks, keys)}, _b long, _p array<double>")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)
        p = [_square(v, k) for v in pdf["_p"]]
        entry, exit_, last = [np.log(np.maximum(start, 1e-300)) if best else start], [np.ones(k) / k], []
        for q in p[:-1]:
            entry.append((entry[-1][:, None] + q).max(axis=0) if best else _scaled(entry[-1] @ q)[0])
        if best:
            state = int((entry[-1][:, None] + p[-1]).max(axis=0).argmax())
            for v, q in zip(reversed(entry), reversed(p), strict=True):
                last.append(state)
                state = int((v + q[:, state]).argmax())
        else:
            for q in reversed(p[1:]):
                exit_.append(_scaled(q @ exit_[-1])[0])
        made = {"_entry": entry, "_exit": exit_[::-1] if not best else entry, "_last": last[::-1] if best else 0}
        return pdf[[*keys, "_b"]].assign(**made)

    carried = ends.groupBy(*keys).applyInPandas(carry, f"{kinds(blocks, keys)}, _b long, _entry array<double>, _exit array<double>, _last int")
    return blocks.join(carried, [*keys, "_b"])


def _observations(row: dict, columns: list[str]) -> np.ndarray:
    return np.stack([numbers(row[c]) for c in columns], axis=1)


def start_values(blocks: DataFrame, columns: list[str], states: int) -> HiddenMarkov:
    """States along the spread of each column, in another order for each, with the columns' variances."""
    flat = blocks.select(F.explode(F.arrays_zip(*columns)).alias("r")).select(*[F.nanvl(F.col("r").getField(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    row = flat.agg(*[f(c) for c in columns for f in (F.avg, F.var_pop)]).first()
    mean, var = (np.array([v or 0.0 for v in row[i::2]]) for i in (0, 1))
    at = np.linspace(-1, 1, states)
    turns = np.stack([np.roll(at, 0)[np.argsort([(k * (d + 1) + (k * (d + 1)) // states) % states for k in range(states)], kind="stable")] for d in range(len(columns))], axis=1)
    stay = np.full((states, states), 1 / states) + 0.5 * np.eye(states)
    return HiddenMarkov(np.full(states, 1 / states), stay / stay.sum(axis=1, keepdims=True), mean + turns * np.sqrt(var), np.array([np.diag(var + FLOOR)] * states))


def em_step(blocks: DataFrame, keys: list[str], columns: list[str], model: HiddenMarkov) -> tuple[HiddenMarkov, float]:
    """One update of all parameters and the log likelihood before it."""
    k, d = model.means.shape

    def sums(row: dict) -> dict:
        x = _observations(row, columns)
        seen = ~np.isnan(x).any(axis=1)
        log_e, first = model.log_emissions(x), row["_first"] == 0
        m, scales = step_matrices(log_e, model.transitions, first)
        entry = np.array(row["_entry"].to_pylist())
        alpha, logs = forward(entry, m)
        beta = backward(np.array(row["_exit"].to_pylist()), m)
        gamma = _scaled(alpha * beta)[0]
        before = np.concatenate([entry[None], alpha[:-1]])
        xi = before[:, :, None] * m * beta[:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        g, y = gamma[seen], x[seen]
        away = y[:, None, :] - model.means  # (n, K, D)
        out = [gamma[0] * first, xi[int(first) :].sum(axis=0), g.sum(axis=0), np.einsum("nk,nkd->kd", g, away), np.einsum("nk,nkd,nke->kde", g, away, away), [logs + scales]]
        return {"_s": np.concatenate([np.ravel(v) for v in out])[None]}

    joined = _joined(blocks, keys, lambda row: model.log_emissions(_observations(row, columns)), model.transitions, model.start)
    size = k + k * k + k + k * d + k * d * d + 1
    row = each_block(joined, sums, "_s array<double>").agg(*[F.coalesce(F.sum(F.col("_s")[i]), F.lit(0.0)) for i in range(size)]).first()
    start, xi, mass, away, square, logs = np.split(np.array(row), np.cumsum([k, k * k, k, k * d, k * d * d]))
    if not mass.sum() > 0:
        return model, float(logs[0])
    xi, away, square = xi.reshape(k, k), away.reshape(k, d), square.reshape(k, d, d)
    left = xi.sum(axis=1, keepdims=True)
    transitions = np.where(left > 1e-10, xi / np.maximum(left, 1e-300), 1 / k)
    some = mass > 1e-10
    shift = np.where(some[:, None], away / np.maximum(mass, 1e-300)[:, None], 0.0)
    spread = square / np.maximum(mass, 1e-300)[:, None, None] - shift[:, :, None] * shift[:, None, :] + FLOOR * np.eye(d)
    spread = np.where(some[:, None, None], spread, model.covariances)
    return replace(model, start=start / start.sum(), transitions=transitions, means=model.means + shift, covariances=spread), float(logs[0])


def fit(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str], states: int = 4, iterations: int = 20, model: HiddenMarkov | None = None, block: int = BLOCK) -> HiddenMarkov:
    """One model of all series (give the keys' rows alone for a model of their own): at most ``iterations`` updates by EM."""
    blocks = written(pack(df, keys, order, bucket, {c: c for c in columns}, block), "hmm-blocks")
    model, best = model or start_values(blocks, columns, states), -np.inf
    for _ in range(iterations):
        model, logs = em_step(blocks, keys, columns, model)
        if not logs - best > GAIN * abs(logs):
            break
        best = logs
    return model


def regimes(df: DataFrame, keys: list[str], order: list[str], bucket: Column, transitions: np.ndarray, start: np.ndarray, columns: list[str], emit, ids: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, ids, filtered, smoothed, state) of every row: probabilities of the states given the rows so far, and given all, and the state on the best path.

    ``emit`` maps the observations of rows (n, D) to the logarithms of their emissions (n, K)."""
    blocks = written(pack(df, keys, order, bucket, {**{i: i for i in ids}, **{f"_x_{c}": c for c in columns}}, block), "hmm-blocks")
    seen = lambda row: emit(_observations(row, [f"_x_{c}" for c in columns]))

    def probabilities(row: dict) -> dict:
        m, _ = step_matrices(seen(row), transitions, row["_first"] == 0)
        alpha, _ = forward(np.array(row["_entry"].to_pylist()), m)
        gamma = _scaled(alpha * backward(np.array(row["_exit"].to_pylist()), m))[0]
        n = len(alpha)
        return {c: [row[c]] * n for c in keys} | {i: row[i] for i in ids} | {"_rn": row["_first"] + np.arange(n), "filtered": alpha, "smoothed": gamma}

    def paths(row: dict) -> dict:
        w = best_steps(seen(row), transitions, row["_first"] == 0)
        path = best_path(np.array(row["_entry"].to_pylist()), row["_last"], w)
        return {c: [row[c]] * len(path) for c in keys} | {"_rn": row["_first"] + np.arange(len(path)), "state": path}

    own = kinds(blocks, keys)
    soft = each_block(_joined(blocks, keys, seen, transitions, start), probabilities, f"{own}, {kinds(blocks, ids, element)}, _rn long, filtered array<double>, smoothed array<double>")
    hard = each_block(_joined(blocks, keys, seen, transitions, start, best=True), paths, f"{own}, _rn long, state int")
    return soft.join(hard, [*keys, "_rn"]).drop("_rn")
