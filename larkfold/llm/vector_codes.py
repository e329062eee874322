"""Vector code compression with segment-mean lower bounds (operator 12).

A vector becomes integers floor(256 x), is cut into 16 equal parts, and each part is named by the nearest of 64 entries of
that part's codebook. The nearest entry is found from coarse to fine: a part and an entry, each cut into 1, 2, 4, ...
blocks, are at least

    sum over blocks (difference of block sums)^2 / block length  +  (difference of residual norms)^2

apart (the residual is what the block means leave). An entry whose bound is above the distance to the entry with the
smallest coarse bound can't be nearest and goes; what every level leaves gets its exact distance in integers. Bounds are
lowered by more than their rounding, so no nearest entry is ever lost.

Codebooks are fitted over all vectors: each task sums its parts by entry, the sums of tasks are added by (part, entry),
and only the codebooks (16 x 64 entries, bounded by the vectors' length) pass the driver. Integers are 64 bits where that
is exact and unbounded otherwise.

Defined cases: a null vector, and one with a null or non-finite component, has no code and is dropped, as is one whose
length is not the most common length that 16 divides (of equally common ones the longest). Seeds are the smallest ids,
null ids last, repeated ids by their vectors; with fewer than 64 vectors there are as many entries as vectors. Repeated
rows each get their row. Null labels count as one label. An error that a long can't hold is the largest long. An empty
table, or one without a vector to keep, gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows handled at once in a task.
ROWS = 2048
LARGEST, LIMB = 2**63 - 1, 10**18


def whole_vector(v: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers, or as unbounded ones where those don't fit."""
    q = np.floor(x.astype(np.float64) * SCALE)
    return q.astype(np.int64) if not q.size or np.abs(q).max() < 2.0**62 else np.frompyfunc(int, 1, 1)(q).astype(object)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if squares of sums over a row stay exact, else as unbounded ones."""
    largest = max((abs(int(m)) for x in (a, b) if x.size for m in (x.min(), x.max())), default=0)
    kind = np.int64 if largest * a.shape[1] < 2**30 else object
    return a.astype(kind), b.astype(kind)


def block_profile(v: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: block sums over the root of the block's length, and the norm of what the block means leave. Only the last steps round."""
    edges = np.linspace(0, v.shape[1], blocks + 1).astype(int)
    sums = [v[:, a:b].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    lengths = np.diff(edges)
    left = sum(((n * (v[:, a:b] ** 2).sum(axis=1) - s * s).astype(np.float64) / n for s, n, a, b in zip(sums, lengths.tolist(), edges[:-1], edges[1:], strict=True)), np.zeros(len(v)))
    return np.stack([s.astype(np.float64) for s in sums], axis=1) / np.sqrt(lengths), np.sqrt(left)


def levels(length: int) -> list[int]:
    """Numbers of blocks from coarse to fine; as many blocks as components would be the distance itself."""
    return [n for n in (2**i for i in range(length.bit_length())) if n < length] or [1]


@dataclass
class Nearest:
    entry: np.ndarray
    distance: np.ndarray
    #: Pairs of a part and an entry, and how many of them were left for an exact distance.
    pairs: int
    survivors: int


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> Nearest:
    """The nearest entry of each part (ties to the lower index) and its exact squared distance."""
    x, c = _exact(parts, entries)
    size = lambda v: (v * v).sum(axis=1).astype(np.float64)
    slack = 1e-9 * (size(x)[:, None] + size(c)[None, :]) + 1e-9
    steps = levels(x.shape[1])
    (sx, rx), (sc, rc) = block_profile(x, steps[0]), block_profile(c, steps[0])
    bound = (rx[:, None] - rc[None, :]) ** 2 - slack
    for i in range(steps[0]):
        bound += (sx[:, i, None] - sc[None, :, i]) ** 2
    apart = lambda rows, cols: ((x[rows] - c[cols]) ** 2).sum(axis=1)
    reach = apart(np.arange(len(x)), bound.argmin(axis=1))
    far = reach.astype(np.float64) * (1 + 1e-12)
    rows, cols = np.nonzero(bound <= far[:, None])
    for n in steps[1:]:
        (sx, rx), (sc, rc) = block_profile(x, n), block_profile(c, n)
        finer = ((sx[rows] - sc[cols]) ** 2).sum(axis=1) + (rx[rows] - rc[cols]) ** 2 - slack[rows, cols]
        left = finer <= far[rows]
        rows, cols = rows[left], cols[left]
    exact = apart(rows, cols)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    best = np.minimum.reduceat(exact, starts) if len(starts) else exact
    hit = np.flatnonzero(exact == best[rows])  # every part keeps an entry, so rows are numbered without gaps
    first = hit[np.flatnonzero(np.diff(rows[hit], prepend=-1))]
    return Nearest(cols[first], exact[first], len(x) * len(c), len(rows))


@dataclass
class Codebooks:
    """By part: an entry a row, of integers."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for part in self.entries for v in part.ravel()).encode()).hexdigest()


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A few rows at a time, with their integers; the vectors are the first column."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            yield rows, quantise(rows.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


def _sums(kept: DataFrame, books: Codebooks, length: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By (part, entry): the number of nearest parts and their sums, over all vectors."""
    width = length // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros(e.shape, object) for e in books.entries]
        for _, q in _chunks(batches, length):
            for p in range(PARTS):
                part = q[:, p * width : (p + 1) * width]
                at = nearest_entries(part, books.entries[p]).entry
                n[p] += np.bincount(at, minlength=len(n[p]))
                own = np.zeros(total[p].shape, _exact(part, part[:0])[0].dtype)
                np.add.at(own, at, part.astype(own.dtype))
                total[p] += own.astype(object)
        made = [(p, e, int(n[p][e]), [limb for v in total[p][e] for limb in _limbs(int(v))]) for p in range(PARTS) for e in np.flatnonzero(n[p]).tolist()]
        columns = list(zip(*made, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "limbs"])

    limbs = [F.sum(F.col("limbs")[i].cast("decimal(38,0)")) for i in range(3 * width)]
    added = kept.select("vector").mapInArrow(add, "part int, entry int, n long, limbs array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*limbs).alias("limbs"))
    whole = lambda a, b, c: (int(a) * LIMB + int(b)) * LIMB + int(c)
    return {(r["part"], r["entry"]): (r["n"], [whole(*r["limbs"][i : i + 3]) for i in range(0, 3 * width, 3)]) for r in added.collect()}


def _limbs(v: int) -> tuple[int, int, int]:
    """A sum of any size in three longs, which are added by themselves."""
    high, low = divmod(v, LIMB)
    return *divmod(high, LIMB), low


def _kept(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    of = F.col(label) if label else F.lit(None).cast("string")
    return vectors.select(F.col(vector).alias("vector"), F.col(key).alias("id"), of.alias("label")).where(whole_vector(F.col("vector")))


def fit_codebooks(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks of all vectors, after ``ROUNDS`` rounds; None if no vector can be coded."""
    kept = _kept(vectors, key, vector, None)
    size = F.size("vector")
    common = kept.where((size > 0) & (size % PARTS == 0)).groupBy(size.alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return None
    length = common["length"]
    kept = kept.where(size == length)
    seeds = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    seed = quantise(np.array([r["vector"] for r in seeds], np.float64))
    books = Codebooks(np.split(seed, PARTS, axis=1))
    for _ in range(ROUNDS):
        moved = [[list(map(int, e)) for e in part] for part in books.entries]
        for (p, e), (n, total) in _sums(kept, books, length).items():
            moved[p][e] = [v // n for v in total]
        books = Codebooks([_narrow(part) for part in moved])
    return books


def _narrow(rows: list[list[int]]) -> np.ndarray:
    fits = all(abs(v) < 2**62 for row in rows for v in row)
    return np.array(rows, np.int64 if fits else object)


def encode(vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(id, label, codes array<int>, error long): the entry of each part and the squared distance to what the code stands for."""
    length = PARTS * books.entries[0].shape[1]
    width = length // PARTS
    kept = _kept(vectors, key, vector, label).where(F.size("vector") == length)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, q in _chunks(batches, length):
            found = [nearest_entries(q[:, p * width : (p + 1) * width], books.entries[p]) for p in range(PARTS)]
            codes = np.stack([f.entry for f in found], axis=1).astype(np.int32)
            error = sum(f.distance.astype(object) for f in found)
            codes = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, PARTS, dtype=np.int32), codes.ravel())
            error = pa.array([min(int(e), LARGEST) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), codes, error], names=["id", "label", "codes", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long")


def decode(codes: list[int], books: Codebooks) -> list[int]:
    """The integers that a code stands for."""
    return [int(v) for p, e in enumerate(codes) for v in books.entries[p][e]]


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that can be coded."""
    books = fit_codebooks(vectors, key, vector)
    kinds = dict(vectors.select(F.col(key).alias("id"), F.col(label).alias("label")).dtypes)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(vectors, books, key, vector, label), "vector-codes")
    hexed = F.lower(F.array_join(F.transform("codes", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    rows = coded.select("label", F.col("id").alias(key), hexed.alias("code"), "error")
    both = rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select(F.col(f"`{key}`"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
