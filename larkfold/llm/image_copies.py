"""Copies of images by local descriptors (operator 2).

A media column holds grayscale PGM images. Each image gives corners (Harris, at two scales),
each corner an orientation (intensity centroid) and 256 binary tests turned to it. Images that are
cropped or edited keep most of these. Descriptors are joined through Hamming tables (8 samples of
40 bits: descriptors 8 bits apart share one with probability 0.93, 16 bits apart with 0.47), and a pair of images
is a copy if matches that agree in scale, rotation and translation cover 40 % of the corners of the
image with fewer, and at least ``MIN_INLIERS``.

Equal images are one class from the start. All descriptors go to the tables; the image with fewer corners looks
up its rarest ones only, so many that any set of its corners that makes a copy holds one of them, wherever the larger image has its
own. Rarity, a count sketch of fixed size over all descriptors, decides what that costs, not what is found:
page furniture is looked up by those images alone that it makes copies of each other. In a bucket of up to ``FEW`` images all meet in one task;
in a larger one they meet a leader, links are contracted, and what is left is compared in full (see ``link_members``).
Before all tests of a pair are compared, 32 tests of each corner and its place, 9 bytes, vote whether enough matches can agree at all. Images of up to ``LEAN`` corners
carry these into their buckets, so that a pair of them leaves its task only if they can.

Keys travel twice: first as sorted differences of some 3 bytes that only tell which buckets hold several, then those of such buckets alone.

Defined cases: a null or broken image has no corners and is a copy of nothing; a flat image has no corners, and only equal images
are its copies; an image within twice the border (20 pixels) in a direction is described with its edge repeated around it;
ties go to the smallest id; rows that repeat an id count as one image; a row with a null id has the class of the images that equal its own, and else none;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.llm.common import cut
from larkfold.llm.components import components, is_live, link_members, live_bits

WIDTH = 64
#: Corners within this many pixels of a stronger one are dropped; reach of the tests; an image's border, where none are taken.
APART, REACH, BORDER = 6, 7, 10
STRENGTH = 1e5
SCALES, TURNS, TESTS = 2, 24, 256
#: Hamming tables, and the sampled tests that make a key of one.
TABLES, KEY_BITS = 8, 40
MAX_HAMMING, MIN_INLIERS, COVER = 32, 3, 0.4
#: Tests apart among the first 32 of a match; the count is hypergeometric with mean 4 and deviation 1.75 at most.
BRIEF_HAMMING = 10
#: Images in a bucket whose pairs are all made at once, in one task; corners of those that carry what a vote needs.
FEW, LEAN = 256, 16
#: Keys that one group counts, about; bits of the maps of buckets, 2 MB; corners of a piece of a batch; comparisons done at once, and of a pair at most (beyond: in its blocks).
KEYS, MAP_BITS, CORNERS, AT_ONCE, AT_MOST = 1 << 19, 24, 1 << 16, 1 << 17, 1 << 20
#: Counters of the rarity sketch: 4 MB, whatever the input.
COUNTERS = 1 << 20
#: Pixels handled at once.
PIXELS = 1 << 20

_KEY = np.dtype([("bits", "u1", (TESTS // 8,)), ("x", "<f4"), ("y", "<f4"), ("scale", "u1"), ("turn", "u1")])
_BRIEF = np.dtype([("bits", "<u4"), ("x", "<u2"), ("y", "<u2"), ("at", "u1")])
_rng = np.random.Generator(np.random.PCG64(20240202))


def _patterns() -> np.ndarray:
    """(TURNS, 2, TESTS, 2) offsets (dy, dx) of the tests' points, turned."""
    p = _rng.normal(0, REACH / 2, (2, TESTS, 2))
    p *= np.minimum(1, REACH / np.linalg.norm(p, axis=2, keepdims=True))  # in a disc, so that turns stay in reach
    out = []
    for t in range(TURNS):
        a = 2 * math.pi * t / TURNS
        turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])  # of (y, x)
        out.append(np.rint(p @ turn.T))
    return np.array(out).astype(np.int64)


_TESTS = _patterns()
_SAMPLES = np.stack([_rng.permutation(TESTS)[:KEY_BITS] for _ in range(TABLES)])
_COS, _SIN = (f(np.arange(TURNS) * (2 * math.pi / TURNS)) for f in (np.cos, np.sin))
_DISC = [(y, x) for y in range(-REACH, REACH + 1) for x in range(-REACH, REACH + 1) if x * x + y * y <= REACH * REACH]
_DISC_Y, _DISC_X = (np.array(v) for v in zip(*_DISC, strict=True))


def byteplot(data: Column, width: int = WIDTH) -> Column:
    """A text or binary column as a PGM image, one pixel a byte, ``width`` pixels a row; null stays null."""
    raw = F.encode(data, "UTF-8")
    rows = F.ceil(F.octet_length(raw) / width)
    head = F.encode(F.concat(F.lit(f"P5 {width} "), rows.cast("string"), F.lit(" 255\n")), "UTF-8")
    return F.concat(head, F.rpad(raw, (rows * width).cast("int"), F.lit(b"\0")))


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary PGM; None if it isn't one."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head:
        return None
    w, h, top = map(int, head.groups())
    pixels = np.frombuffer(data, np.uint8, offset=head.end())
    if not w or not h or not 0 < top < 256 or len(pixels) < w * h:
        return None
    return pixels[: w * h].reshape(h, w)


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)-squares; 0 within r of the edge."""
    h, w = a.shape
    out = np.zeros_like(a)
    if h > 2 * r and w > 2 * r:
        rows = sum(a[i : h - 2 * r + i] for i in range(2 * r + 1))
        out[r : h - r, r : w - r] = sum(rows[:, i : w - 2 * r + i] for i in range(2 * r + 1))
    return out


def _widest(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over (2r+1)-squares."""
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], constant_values=-np.inf)
        size, w = 1, 2 * r + 1
        cut_ = lambda x, i, j: x[i:j] if axis == 0 else x[:, i:j]
        while 2 * size <= w:
            p = np.maximum(cut_(p, 0, p.shape[axis] - size), cut_(p, size, p.shape[axis]))
            size *= 2
        if size < w:
            p = np.maximum(cut_(p, 0, p.shape[axis] - (w - size)), cut_(p, w - size, p.shape[axis]))
        a = p
    return a


def _describe_stack(images: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """Descriptors of images of one width, stacked. Borders are as wide as a corner's surroundings, so no image sees its neighbour."""
    tall = np.concatenate(images).astype(np.float32)
    tops = np.cumsum([0, *(len(i) for i in images)])
    h, w = tall.shape
    if h <= 2 * BORDER or w <= 2 * BORDER:
        return [np.empty(0, _KEY) for _ in images]
    smooth = _box(tall, 1)
    gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
    gy[1:-1], gx[:, 1:-1] = (smooth[2:] - smooth[:-2]) / 18, (smooth[:, 2:] - smooth[:, :-2]) / 18
    yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gx * gy, 2)
    strong = yy * xx - xy * xy - np.float32(0.05) * (yy + xx) ** 2
    row = np.arange(h)
    which = np.searchsorted(tops, row, side="right") - 1
    inner = (row - tops[which] >= BORDER) & (tops[which + 1] - row > BORDER)
    strong[~inner] = -np.inf
    strong[:, :BORDER] = strong[:, w - BORDER :] = -np.inf
    y, x = np.nonzero((strong == _widest(strong, APART)) & (strong > STRENGTH))
    base = y * w + x
    blur = _box(tall, 2).ravel()
    disc = blur[base[:, None] + (_DISC_Y * w + _DISC_X)[None, :]]
    angle = np.arctan2(disc @ _DISC_Y.astype(np.float32), disc @ _DISC_X.astype(np.float32))
    turn = np.rint(angle / (2 * math.pi) * TURNS).astype(np.int64) % TURNS
    at = (_TESTS[..., 0] * w + _TESTS[..., 1])[turn]
    bits = blur[base[:, None] + at[:, 0]] < blur[base[:, None] + at[:, 1]]
    keys = np.zeros(len(y), _KEY)
    keys["bits"] = np.packbits(bits, axis=1)
    keys["x"], keys["y"] = x * (1 << scale), (y - tops[which[y]]) * (1 << scale)
    keys["scale"], keys["turn"] = scale, turn
    edges = np.searchsorted(which[y], np.arange(len(images) + 1))
    return [keys[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def describe(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """Corners with their descriptors, for each image."""
    out: list[list[np.ndarray]] = [[] for _ in images]
    level = {i: np.pad(a, BORDER, mode="edge") if min(a.shape) <= 2 * BORDER else a for i, a in enumerate(images) if a is not None}
    for scale in range(SCALES):
        by_width: dict[int, list[int]] = {}
        for i, a in level.items():
            by_width.setdefault(a.shape[1], []).append(i)
        for ids in by_width.values():
            held, n = [], 0
            for i in [*ids, None]:
                if held and (i is None or n >= PIXELS):
                    for j, keys in zip(held, _describe_stack([level[j] for j in held], scale), strict=True):
                        out[j].append(keys)
                    held, n = [], 0
                if i is not None:
                    held.append(i)
                    n += level[i].size
        level = {i: a[: a.shape[0] & ~1, : a.shape[1] & ~1].reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).mean(axis=(1, 3)) for i, a in level.items() if min(a.shape) >= 2}
    return [np.concatenate([*k, np.empty(0, _KEY)]) for k in out]


def table_keys(keys: np.ndarray) -> np.ndarray:
    """(corners, TABLES) keys of the Hamming tables, of 48 bits."""
    bits = np.unpackbits(np.ascontiguousarray(keys["bits"]), axis=1)
    words = np.zeros((len(keys), TABLES, 8), np.uint8)
    words[:, :, : KEY_BITS // 8] = np.packbits(bits[:, _SAMPLES], axis=2)
    mixed = words.view(np.uint64)[:, :, 0] ^ (np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(16)).view(np.int64)


def _moved(ratio: np.ndarray, turn: np.ndarray, p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How far the corners q lie from the corners p (x, y) after p's scaling and turn."""
    cos, sin, s = _COS[turn], _SIN[turn], 2.0**ratio
    return q[0] - s * (cos * p[0] - sin * p[1]), q[1] - s * (sin * p[0] + cos * p[1])


def consensus(a: np.ndarray, b: np.ndarray, least: int = 1) -> int:
    """Corners of the largest set of matches that agree in scale, rotation and translation; 0 if there are less than ``least`` matches at all."""
    if not len(a) or not len(b):
        return 0
    wa, wb = (np.ascontiguousarray(k["bits"]).view(np.uint64).reshape(len(k), -1) for k in (a, b))
    best, dist = np.zeros(len(a), np.int64), np.full(len(a), TESTS)
    for i in range(0, len(a), 256):
        d = np.bitwise_count(wa[i : i + 256, None, :] ^ wb[None, :, :]).sum(axis=2)
        best[i : i + 256], dist[i : i + 256] = d.argmin(axis=1), d.min(axis=1)
    m = np.flatnonzero(dist <= MAX_HAMMING)
    if len(m) < least:
        return 0
    p, q = a[m], b[best[m]]
    ratio = q["scale"].astype(int) - p["scale"]
    turn = (q["turn"].astype(int) - p["turn"]) % TURNS
    x, y = _moved(ratio, turn, (p["x"], p["y"]), (q["x"], q["y"]))
    most = 0
    for shift in (0, 4):  # two grids of translations, so that no agreement is cut by a bin's edge in both
        bins = np.stack([ratio, turn, np.floor((x + shift) / 8), np.floor((y + shift) / 8)], axis=1)
        if len(bins):
            most = max(most, int(np.unique(bins, axis=0, return_counts=True)[1].max()))
    return most


def needed(n: int) -> int:
    """Corners that must agree, for an image of n that is the one with fewer."""
    return max(MIN_INLIERS, math.ceil(COVER * n))


def is_copy(a: np.ndarray, b: np.ndarray) -> bool:
    """Counted in corners of the image with fewer; either way round if both have as many."""
    if len(a) > len(b):
        a, b = b, a
    least = needed(len(a))
    return consensus(a, b, least) >= least or (len(a) == len(b) and consensus(b, a, least) >= least)


def brief(keys: np.ndarray) -> bytes | None:
    """The first tests of each corner, and its place; None where a place needs more than 16 bits."""
    if len(keys) and max(keys["x"].max(), keys["y"].max()) >= 1 << 16:
        return None
    out = np.empty(len(keys), _BRIEF)
    out["bits"] = np.ascontiguousarray(keys["bits"][:, :4]).view("<u4").ravel()
    out["x"], out["y"], out["at"] = keys["x"], keys["y"], keys["scale"] * TURNS + keys["turn"]
    return out.tobytes()


def _most(of: np.ndarray, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each pair the largest number of its matches (corners i of a and j of b; ``of``: their pairs) that agree, as ``consensus`` has it; 0 where no scale and turn has
    what the pair needs. Places have 16 bits."""
    (sa, ta), (sb, tb) = (np.divmod(k["at"].astype(int), TURNS) if "at" in k.dtype.names else (k["scale"].astype(int), k["turn"].astype(int)) for k in (a, b))
    ratio, turn = sb[j] - sa[i], (tb[j] - ta[i]) % TURNS
    cell = (of * 2 * SCALES + ratio + SCALES) * 32 + turn
    on = np.flatnonzero(np.bincount(cell, minlength=1)[cell] >= need[of]) if len(cell) else cell
    p, q, cell = a[i[on]], b[j[on]], cell[on]
    x, y = _moved(ratio[on], turn[on], (p["x"].astype(float), p["y"].astype(float)), (q["x"].astype(float), q["y"].astype(float)))
    most = np.zeros(len(need), np.int64)
    for shift in (0, 4):
        bins = cell
        for v in (x, y):
            bins = (bins << 18) + (np.floor((v + shift) / 8).astype(np.int64) + (1 << 17))
        u, n = np.unique(bins, return_counts=True)
        np.maximum.at(most, (u >> 41) // (2 * SCALES), n)
    return most


def _in_chunks(ones: list[bytes | None], others: list[bytes | None], kind: np.dtype, fits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs that fit, about AT_ONCE comparisons at a time: which, corners of both sides, their numbers, what a copy needs, and for each comparison the corner of
    the first side (as lengths) and of the other; the largest pairs are left out."""
    fits = fits & np.array([x is not None and y is not None and len(x) * len(y) <= AT_MOST * kind.itemsize**2 for x, y in zip(ones, others, strict=True)], bool)
    todo = np.flatnonzero(fits)
    na, nb = (np.array([len(side[i]) // kind.itemsize for i in todo], np.int64) for side in (ones, others))
    chunk = np.cumsum(na * nb) // AT_ONCE
    for c in np.unique(chunk):
        at = np.flatnonzero(chunk == c)
        a, b = (np.frombuffer(b"".join(side[todo[i]] for i in at), kind) for side in (ones, others))
        ma, mb = na[at], nb[at]
        of = np.repeat(np.arange(len(at)), ma)
        lens = mb[of]
        back = np.cumsum(lens) - lens - (np.cumsum(mb) - mb)[of]
        j = np.arange(lens.sum(), dtype=np.int32) - np.repeat(back.astype(np.int32), lens)
        need = np.array([needed(n) for n in range(int(np.minimum(ma, mb).max(initial=0)) + 1)])[np.minimum(ma, mb)]
        yield todo[at], a, b, ma == mb, of, lens, j, need


def may_be_copies(ones: list[bytes | None], others: list[bytes | None]) -> np.ndarray:
    """Which pairs may be copies: whether matches, judged by their briefs, that agree in scale, rotation and translation are as many as a copy needs. Matches of a
    corner with several are all counted, so only what the briefs miss is lost: one match in a thousand of those that have MAX_HAMMING tests apart, fewer of the nearer ones."""
    keep = np.ones(len(ones), bool)  # the largest and those without a brief go on as they are
    for at, a, b, even, of, lens, j, need in _in_chunks(ones, others, _BRIEF, keep):
        bits = np.ascontiguousarray(b["bits"])
        hits = np.flatnonzero(np.bitwise_count(np.repeat(np.ascontiguousarray(a["bits"]), lens) ^ bits[j]) <= BRIEF_HAMMING)
        i, j = np.searchsorted(np.cumsum(lens), hits, side="right"), j[hits]
        most = _most(of[i], a, i, b, j, need)
        if (back := np.flatnonzero(even[of[i]])).size:
            most = np.maximum(most, _most(of[i[back]], b, j[back], a, i[back], need))
        keep[at] = most >= need
    return keep


def are_copies(ones: list[bytes], others: list[bytes]) -> np.ndarray:
    """``is_copy`` of many pairs of descriptors, the image with fewer corners first."""
    far = lambda x: (k := np.frombuffer(x, _KEY)).size and max(k["x"].max(), k["y"].max()) >= 1 << 16
    left = np.array([not (far(x) or far(y)) for x, y in zip(ones, others, strict=True)], bool)
    out, one_by_one = np.zeros(len(ones), bool), np.ones(len(ones), bool)
    for at, a, b, even, of, lens, j, need in _in_chunks(ones, others, _KEY, left):
        wa, wb = (np.ascontiguousarray(k["bits"]).view(np.uint64).reshape(len(k), -1) for k in (a, b))
        i = np.repeat(np.arange(len(a), dtype=np.int32), lens)
        dist = sum(np.bitwise_count(wa[i, w] ^ wb[j, w]).astype(np.int64) for w in range(wa.shape[1]))
        most = np.zeros(len(at), np.int64)
        of_b = np.zeros(len(b), np.int64)
        of_b[j] = of[i]
        for x, y, p, q, of_p, which in ((i, j, a, b, of, slice(None)), (j, i, b, a, of_b, np.flatnonzero(even[of[i]]))):  # the other way round too if both have as many
            near = np.full(len(p), np.iinfo(np.int64).max)
            value = (dist << 32) + y  # of equal distances the first
            np.minimum.at(near, x[which], value[which])
            m = np.flatnonzero(near >> 32 <= MAX_HAMMING)
            most = np.maximum(most, _most(of_p[m], p, m, q, near[m] & 0xFFFFFFFF, need))
        out[at], one_by_one[at] = most >= need, False
    for i in np.flatnonzero(one_by_one).tolist():
        out[i] = is_copy(np.frombuffer(ones[i], _KEY), np.frombuffer(others[i], _KEY))
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            images = [decode_pgm(d) for d in part.column(1).to_pylist()]
            keys = describe(images)
            digests = [None if a is None else hashlib.sha256(b"%d %d " % a.shape + a.tobytes()).digest() for a in images]
            cols = [part.column(0), pa.array([len(k) for k in keys], pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "keys", "digest"])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), _KEY)
        at, n = np.unique(table_keys(keys)[:, 0] % COUNTERS, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], names=["at", "n"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column n of corners, about CORNERS of them at a time."""
    for batch in batches:
        group = np.cumsum(batch.column("n").to_numpy()) // CORNERS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y > x:
                yield batch.slice(x, y - x)


def _entries(batch: pa.RecordBatch, rare: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the images of a batch: buckets of 32 bits and ``parts`` more, image, and whether it looks the bucket up. An image is in a bucket once, by its rarest descriptor."""
    n = batch.column("n").to_numpy().astype(np.int64)
    table = table_keys(np.frombuffer(b"".join(batch.column("keys").to_pylist()), _KEY))
    own = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rare[table[:, 0] % COUNTERS], own))
    rank = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    buckets = (table[order] >> (16 - parts)).ravel()
    same = (buckets.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.repeat(own.astype(np.uint64) * np.uint64(0x94D049BB133111EB), TABLES)
    at = np.unique(same ^ (same >> np.uint64(31)), return_index=True)[1]  # the first is the rarest; both steps are one to one but for the mix of bucket and image
    corner = at // TABLES
    looks = rank <= n[own] - np.array([needed(x) for x in n.tolist()], np.int64)[own]
    return buckets[at], own[corner], looks[corner]


def _dealt(counts: Broadcast, parts: int):
    """The buckets of a piece by part, sorted: differences, how many descriptors each holds and whether one looks it up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            buckets, _, looks = _entries(batch, counts.value, parts)
            order = np.argsort(buckets, kind="stable")
            buckets = buckets[order]
            first = np.flatnonzero(np.diff(buckets, prepend=-1))
            n, looks, buckets = np.diff(first, append=len(buckets)).astype("<u4"), np.maximum.reduceat(looks[order], first) if len(first) else looks, buckets[first]
            edges = np.searchsorted(buckets >> 32, np.arange((1 << parts) + 1))
            rows = []
            for part in np.flatnonzero(np.diff(edges)).tolist():
                x, y = edges[part], edges[part + 1]
                low = (buckets[x:y] & 0xFFFFFFFF).astype("<u4")
                planes = [np.diff(low, prepend=low.dtype.type(0)), n[x:y]]
                rows.append((part, y - x, b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 4).T.tobytes() for v in planes) + np.packbits(looks[x:y]).tobytes()))
            part, size, data = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["part", "size", "data"])

    return run


def _counted(parts: int):
    """Of one part: a map of the buckets that hold several descriptors and are looked up, a map of those of them with more than FEW, and their sizes."""

    def run(table: pa.Table) -> pa.Table:
        low, n, looks = [], [], []
        for size, data in zip(table.column("size").to_pylist(), table.column("data").to_pylist(), strict=True):
            planes = [np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * size, 4 * size * k).reshape(4, size).T).view("<u4").ravel() for k in (0, 1)]
            low.append(np.cumsum(planes[0], dtype=np.uint32))
            n.append(planes[1].astype(np.int64))
            looks.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * size), count=size))
        low, n, looks = np.concatenate(low), np.concatenate(n), np.concatenate(looks)
        order = np.argsort(low, kind="stable")
        low = low[order]
        first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        low, n, looks = low[first].astype(np.int64), np.add.reduceat(n[order], first), np.maximum.reduceat(looks[order], first)
        several = (n > 1) & (looks > 0)
        many, maps = several & (n > FEW), []
        for on in (several, many):
            bits = np.zeros(1 << (MAP_BITS - parts), bool)
            bits[low[on] >> (32 + parts - MAP_BITS)] = True
            maps.append(np.packbits(bits).tobytes())
        part = table.column("part")[0].as_py()
        crowded = [{"bucket": (part << 32) + b, "in_bucket": m} for b, m in zip(low[many].tolist(), n[many].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([maps[0]], pa.binary()), pa.array([maps[1]], pa.binary()), pa.array([crowded], _CROWDED)], names=["part", "several", "many", "crowded"])

    return run


_CROWDED = pa.list_(pa.struct([("bucket", pa.int64()), ("in_bucket", pa.int64())]))


def _on(bits: np.ndarray, buckets: np.ndarray, parts: int) -> np.ndarray:
    at = buckets >> (32 + parts - MAP_BITS)
    return (bits[at >> 3] << (at & 7).astype(np.uint8)) & 0x80 != 0


def _members(counts: Broadcast, maps: Broadcast, parts: int, many: bool):
    """Members of the buckets that hold several: of those that may hold many, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            buckets, own, looks = _entries(batch, counts.value, parts)
            on = np.flatnonzero(_on(maps.value[0], buckets, parts) & (_on(maps.value[1], buckets, parts) == many))
            own = own[on]
            ids, ns = (batch.column(c).to_numpy().astype(np.int64)[own] for c in ("id", "n"))
            short = pa.array([None if many or n > LEAN else brief(np.frombuffer(k, _KEY)) for n, k in zip(batch.column("n").to_pylist(), batch.column("keys").to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (buckets[on], ids, ns, looks[on])), short.take(pa.array(own))], names=["bucket", "id", "n", "probe", "brief"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of each list of members that may be copies, the image with fewer corners first."""
    for batch in batches:
        lists = batch.column(0)
        values, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
        ids, ns, looks = (values.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "probe"))
        short = values.field("brief").to_pylist()
        many = np.diff(offsets)
        held, n = [], 0
        for row in [*np.argsort(many, kind="stable").tolist(), None]:
            if held and (row is None or n + many[row] ** 2 > AT_MOST):
                x, y = (np.concatenate(c) for c in zip(*held, strict=True))
                swap = (ns[x] > ns[y]) | ((ns[x] == ns[y]) & (ids[x] > ids[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                asked = (ids[x] != ids[y]) & (looks[x] | (looks[y] & (ns[x] == ns[y])))
                x, y = x[asked], y[asked]
                first = np.unique(np.stack([ids[x], ids[y]]), axis=1, return_index=True)[1] if len(x) else x
                x, y = x[first], y[first]
                on = may_be_copies([short[i] for i in x.tolist()], [short[i] for i in y.tolist()])
                x, y = x[on], y[on]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array((ns[x] <= LEAN) & (ns[y] <= LEAN))], names=["a", "b", "likely"])
                held, n = [], 0
            if row is not None:
                i, j = np.triu_indices(int(many[row]), 1)
                held.append((i + offsets[row], j + offsets[row]))
                n += int(many[row]) ** 2


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = are_copies(batch.column("ka").to_pylist(), batch.column("kb").to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = may_be_copies(batch.column("ka").to_pylist(), batch.column("kb").to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _with_brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [brief(np.frombuffer(k, _KEY)) for k in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(short, pa.binary())], names=["id", "brief"])


def _named(ids: Broadcast):
    """The rows whose id may be among the ids of a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_live(ids, batch.column("id").to_numpy())))

    return run


def image_copies(images: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """(key, n_corners, copy_of, is_copy) of every row; copy_of: the smallest id of its group of copies, itself included."""
    spark = images.sparkSession
    rows = images.select(F.col(key).cast("long").alias("id"), F.col(image).alias("image"))
    every = cut(rows.mapInArrow(_described, "id long, n int, keys binary, digest binary"), "corners")
    classes = every.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))  # equal images
    of_row = cut(every.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", "digest", "rep"), "images-classes")
    others = cut(of_row.where("rep != id").select("id", "digest").distinct(), "images-equal")
    found = every.where(F.col("id").isNotNull() & (F.col("n") >= MIN_INLIERS))
    if not others.isEmpty():
        found = cut(found.join(others, ["id", "digest"], "left_anti").select("id", "n", "keys"), "corners-once")
    found = found.select("id", "n", "keys")
    of_row = of_row.drop("digest")
    counts = np.zeros(COUNTERS, np.int64)
    sums = found.select("keys").mapInArrow(_counters, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(np.minimum(counts, 0x7FFFFFFF).astype(np.int32))
    parts = min(16, max(6, math.ceil(math.log2(max(1, TABLES * int(counts.sum()) / KEYS)))))
    dealt = found.select("n", "keys").mapInArrow(_dealt(shared, parts), "part int, size int, data binary")
    sizes = cut(dealt.groupBy("part").applyInArrow(_counted(parts), "part int, several binary, many binary, crowded array<struct<bucket: long, in_bucket: long>>"), "images-sizes")
    held = np.zeros((2, 1 << (MAP_BITS - 3)), np.uint8)
    for r in sizes.select("part", "several", "many").collect():  # two bits a place of the maps, 4 MB
        for k in (1, 2):
            held[k - 1, r[0] << (MAP_BITS - 3 - parts) :][: len(r[k])] = np.frombuffer(r[k], np.uint8)
    maps = spark.sparkContext.broadcast(held)

    def members(many: bool) -> DataFrame:
        return found.mapInArrow(_members(shared, maps, parts, many), "bucket long, id long, n long, probe boolean, brief binary")

    def named(known: DataFrame, pairs: DataFrame) -> DataFrame:
        ids = live_bits(pairs.select(F.explode(F.array("a", "b")).alias("bucket")))
        return known.select("id", "keys").mapInArrow(_named(ids), "id long, keys binary")

    def verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """By briefs, then by all tests and the geometry; only the image with fewer corners, a, travels to the pairs."""
        side = lambda table, x, column: table.select(F.col("id").alias(x), F.col(column).alias(f"k{x}"))
        pairs = cut(pairs, "images-pairs")
        likely, rest = (pairs.where("likely").select("a", "b"), pairs.where("not likely").select("a", "b")) if "likely" in pairs.columns else (None, pairs)
        short = named(known, rest).mapInArrow(_with_brief, "id long, brief binary")
        voted = rest.join(side(short, "a", "brief"), "a").join(side(short, "b", "brief"), "b").mapInArrow(_likely, "a long, b long")
        likely = cut(likely.union(voted) if likely is not None else voted, "images-likely")
        whole = named(known, likely)
        return likely.join(side(whole, "a", "keys"), "a").join(side(whole, "b", "keys"), "b").mapInArrow(_copies, "a long, b long")

    in_bucket = sizes.select(F.explode("crowded").alias("c")).select("c.*")
    crowded = cut(members(True).drop("brief").join(in_bucket, "bucket", "left").withColumn("in_bucket", F.coalesce("in_bucket", F.lit(FEW))), "images-members")
    of_few = members(False).repartition("bucket").groupBy("bucket").agg(F.collect_list(F.struct("id", "n", "probe", "brief")).alias("all")).where(F.size("all") > 1)
    labels = link_members(crowded, found, verify, name="images", others=of_few.select("all").mapInArrow(_met, "a long, b long, likely boolean"))
    # rows that repeat an id with other images join their classes
    several = of_row.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("id")
    if not several.isEmpty():
        same = of_row.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same), "images-ids")
    of_row = of_row.withColumn("of", F.coalesce("rep", "id"))
    out = of_row.join(labels.withColumnRenamed("id", "of"), "of", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_corners"), F.coalesce("component", "of").alias("copy_of")
    )
    return out.withColumn("is_copy", F.coalesce(F.col("copy_of") != F.col(key), F.lit(False)))
