"""Complexity of the last rows of a series: sample and approximate entropy, Hurst exponent, Higuchi dimension, entropy of returns, Haar trend.

All are functions of a frame of fixed length. Blocks hold the rows that their frames reach back to, and numpy takes many frames
at once. A frame with a null has null, as have rows whose frame would be shorter than a measure takes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame

from larkfold.operators.blocks import each_block, element, kinds, numbers, pack_with_past

#: Rows of a block (frames overlap, so blocks are smaller than elsewhere), and numbers of a batch of frames.
BLOCK, BATCH = 16_384, 2_000_000


@dataclass(frozen=True)
class Measure:
    """A function of frames (n, length) of a column. A series' first rows have shorter frames, from ``least`` rows on (0: none). ``pairs``: it compares all pairs of a frame."""

    column: str
    length: int
    of: Callable[[np.ndarray], np.ndarray]
    least: int = 0
    pairs: bool = False


def over_frames(df: DataFrame, keys: list[str], order: list[str], bucket: Column, ids: list[str], measures: dict[str, Measure], block: int = BLOCK) -> DataFrame:
    """(keys, ids, a column of each measure)."""
    columns = sorted({m.column for m in measures.values()})
    past = max(m.length for m in measures.values()) - 1
    blocks = pack_with_past(df, keys, order, bucket, {**{i: i for i in ids}, **{f"_x_{c}": c for c in columns}}, past, block)

    def walk(row: dict) -> dict:
        own, out = row["_own"], {}
        for name, m in measures.items():
            out[name] = framed(numbers(row[f"_x_{m.column}"]), m, row["_first"] == 0)[own:]
        n = len(next(iter(out.values())))
        return {k: [row[k]] * n for k in keys} | {i: row[i].slice(own) for i in ids} | out

    return each_block(blocks, walk, f"{kinds(blocks, keys)}, {kinds(blocks, ids, element)}, " + ", ".join(f"{m} double" for m in measures))


def framed(x: np.ndarray, m: Measure, start: bool = True) -> np.ndarray:
    """The measure of the frame that ends at each row; NaN where there is none. ``start``: the first row is that of a series."""
    out = np.full(len(x), np.nan)
    for n in range(m.least or m.length, min(m.length, len(x) + 1)) if start else ():
        if not np.isnan(x[:n]).any():
            out[n - 1] = m.of(x[None, :n])[0]
    if len(x) < m.length:
        return out
    frames = sliding_window_view(x, m.length)
    full = np.flatnonzero(~np.isnan(frames).any(axis=1))
    step = max(1, BATCH // (m.length * (m.length if m.pairs else 8)))
    for i in range(0, len(full), step):
        at = full[i : i + step]
        out[at + m.length - 1] = m.of(frames[at])
    return out


def _near(frames: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether any two values of a frame are within ``scale`` standard deviations, and whether there is any deviation."""
    tolerance = scale * frames.std(axis=1)
    return np.abs(frames[:, :, None] - frames[:, None, :]) <= tolerance[:, None, None], tolerance > 0


def _matches(near: np.ndarray, m: int) -> np.ndarray:
    """Whether the templates of m values that start at i and j match."""
    n = near.shape[1] - m + 1
    out = near[:, :n, :n].copy()
    for k in range(1, m):
        out &= near[:, k : k + n, k : k + n]
    return out


def sample_entropy(m: int = 2, scale: float = 0.2) -> Callable[[np.ndarray], np.ndarray]:
    """-ln of the share of matching pairs of templates that still match when longer by one; 0 without matches or deviation."""

    def measure(frames: np.ndarray) -> np.ndarray:
        near, some = _near(frames, scale)
        a, b = (_matches(near, k) for k in (m, m + 1))
        share = [(x.sum(axis=(1, 2)) - x.shape[1]) / (x.shape[1] * (x.shape[1] - 1)) for x in (a, b)]
        ok = some & (share[0] > 0) & (share[1] > 0)
        ratio = np.divide(share[1], share[0], out=np.ones(len(frames)), where=ok)
        return np.where(ok, np.maximum(-np.log(np.where(ok, ratio, 1.0)), 0.0), 0.0)

    return measure


def approximate_entropy(m: int = 2, scale: float = 0.2) -> Callable[[np.ndarray], np.ndarray]:
    """How much the mean log share of matching templates (each matches itself) falls when templates are longer by one; 0 without deviation."""

    def measure(frames: np.ndarray) -> np.ndarray:
        near, some = _near(frames, scale)
        phi = [np.log(_matches(near, k).mean(axis=2)).mean(axis=1) for k in (m, m + 1)]
        return np.where(some, np.maximum(phi[0] - phi[1], 0.0), 0.0)

    return measure


def log_returns(prices: np.ndarray) -> np.ndarray:
    return np.diff(np.log(np.maximum(prices, 1e-10)), axis=1)


def _slopes(x: np.ndarray, y: np.ndarray, known: np.ndarray, least: int, without: float) -> np.ndarray:
    """Least-squares slopes of rows of y over x, of known points only."""
    n = known.sum(axis=1)
    x = np.where(known, np.broadcast_to(x, y.shape), 0.0)
    y = np.where(known, y, 0.0)
    count = np.maximum(n, 1)
    dx = np.where(known, x - (x.sum(axis=1) / count)[:, None], 0.0)
    top, bottom = (dx * y).sum(axis=1), (dx * dx).sum(axis=1)
    return np.where((n >= least) & (bottom > 0), top / np.where(bottom > 0, bottom, 1.0), without)


def hurst(frames: np.ndarray) -> np.ndarray:
    """Slope of log rescaled range over log size of segments, for up to 15 sizes from 10 to half the frame, within 0 and 1; 0.5 without three sizes."""
    n, r = frames.shape[1], log_returns(frames)
    if n < 22:
        return np.full(len(frames), 0.5)
    sizes = np.unique(np.logspace(1, np.log10(n // 2), num=15, dtype=int))
    logs, known = np.zeros((len(frames), len(sizes))), np.zeros((len(frames), len(sizes)), bool)
    for i, w in enumerate(sizes):
        parts = r.shape[1] // w
        if parts < 1:
            continue
        seg = r[:, : parts * w].reshape(len(r), parts, w)
        path = np.cumsum(seg - seg.mean(axis=2, keepdims=True), axis=2)
        sd = seg.std(axis=2, ddof=1)
        ok = sd > 1e-12
        ratio = np.where(ok, (path.max(axis=2) - path.min(axis=2)) / np.where(ok, sd, 1.0), 0.0)
        known[:, i] = ok.any(axis=1)
        logs[:, i] = np.log(np.where(known[:, i], ratio.sum(axis=1) / np.maximum(ok.sum(axis=1), 1), 1.0))
    return np.clip(_slopes(np.log(sizes), logs, known, 3, 0.5), 0.0, 1.0)


def higuchi(most: int = 10) -> Callable[[np.ndarray], np.ndarray]:
    """Slope of log mean curve length over log 1 / stride, for strides up to ``most``, within 1 and 2; 1.5 without three strides."""

    def measure(frames: np.ndarray) -> np.ndarray:
        n = frames.shape[1]
        top = min(most, n // 4)
        if top < 2:
            return np.full(len(frames), 1.5)
        lengths = np.zeros((len(frames), top))
        for k in range(1, top + 1):
            each = [sub for m in range(k) if (sub := frames[:, m::k]).shape[1] > 1]
            lengths[:, k - 1] = np.mean([np.abs(np.diff(sub, axis=1)).sum(axis=1) * (n - 1) / (k * (sub.shape[1] - 1) * k) for sub in each], axis=0)
        known = lengths > 0
        return np.clip(_slopes(-np.log(np.arange(1, top + 1)), np.log(np.where(known, lengths, 1.0)), known, 3, 1.5), 1.0, 2.0)

    return measure


def return_entropy(bins: int = 20) -> Callable[[np.ndarray], np.ndarray]:
    """Entropy of the returns' histogram between their extremes, as a share of the greatest; 1 with fewer than 10 returns."""

    def measure(frames: np.ndarray) -> np.ndarray:
        r = log_returns(frames)
        if r.shape[1] < 10:
            return np.ones(len(frames))
        lo, hi = r.min(axis=1, keepdims=True), r.max(axis=1, keepdims=True)
        lo, hi = np.where(lo == hi, lo - 0.5, lo), np.where(lo == hi, hi + 0.5, hi)
        edges = lo + (hi - lo) * np.arange(bins + 1) / bins
        at = np.minimum(((r - lo) * (bins / (hi - lo))).astype(int), bins - 1)
        at -= r < np.take_along_axis(edges, at, axis=1)
        at += (r >= np.take_along_axis(edges, at + 1, axis=1)) & (at != bins - 1)
        p = np.stack([(at == b).mean(axis=1) for b in range(bins)], axis=1)
        return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1) / np.log2(bins)

    return measure


def haar(what: str, levels: int = 3) -> Callable[[np.ndarray], np.ndarray]:
    """Of closes padded with the last one to a power of two: ``trend`` (the last value without the finest details), ``momentum`` (its slope over 5
    rows), ``noise`` (deviation of the finest details over that of closes, at most 2), ``strength`` (|momentum| over the deviation of the last 20)
    and ``energy_k``, the share of the energy of level k's details (1: finest) in that of all of them."""

    def measure(frames: np.ndarray) -> np.ndarray:
        n = frames.shape[1]
        size = 1 << int(np.ceil(np.log2(max(n, 8))))
        approx = np.concatenate([frames, np.repeat(frames[:, -1:], size - n, axis=1)], axis=1)
        details = []
        for _ in range(levels):
            a, b = approx[:, 0::2], approx[:, 1::2]
            details.append((a - b) / np.sqrt(2))
            approx = (a + b) / np.sqrt(2)
        for d in reversed([np.zeros_like(details[0]), *details[1:]]):
            approx = np.stack([approx + d, approx - d], axis=2).reshape(len(frames), -1) / np.sqrt(2)
        trend = approx[:, :n]
        slope = (trend[:, -1] - trend[:, -5]) / 5 if n >= 5 else np.zeros(len(frames))
        sd = frames.std(axis=1)
        if what == "trend":
            return trend[:, -1]
        if what == "momentum":
            return slope
        if what == "noise":
            return np.minimum(details[0].std(axis=1) / np.where(sd > 0, sd, 1.0), 2.0)
        if what == "strength":
            return np.abs(slope) / (frames[:, -20:].std(axis=1) + 1e-10) if n >= 20 else np.zeros(len(frames))
        energy = np.stack([(d * d).sum(axis=1) for d in details], axis=1)
        total = energy.sum(axis=1)
        return np.where(total > 0, energy[:, int(what.removeprefix("energy_")) - 1] / np.where(total > 0, total, 1.0), 0.0)

    return measure
