"""Near-duplicates by SetSketch registers (operator 3).

Each document is the set of its distinct five-word shingles. Its SetSketch holds
``REGISTERS`` truncated minima on an exponential scale, K = 1 - floor(log_b(h)), with h the
least of exponential hash values: sketches merge by the larger register, and equal registers
are about as likely as the Jaccard similarity. Bands of register values give candidates; the
similarity of a candidate is judged by the joint likelihood of which registers are greater,
smaller and equal, given both set sizes; what the likelihood can't exclude is verified on the full sets.

Equal sets are one class from the start. Within a band bucket the classes are compared with
one leader, which is linear in the bucket; verified links are contracted to components; a bucket that
still spans several components gets another leader. Sets that can't have links, by how many shingles they
share with other components at all, drop out after the first leader. After ``LEADER_ROUNDS`` the pairs across components that are
left are found by what they differ in from a common reference (``_differences``): copies of one original that are no links share the
original's shingles only, and such pairs are never made. So a bucket of copies costs its size, and no pair that shares a
band stays open. A pair at the threshold misses all bands with probability
(1 - 0.75 ** 4) ** 32, 5 in a million.

Defined cases: a null text and a text without words have the empty set, stand alone and are
kept; a text of fewer words than a shingle is one shingle; rows that repeat an id are judged
row by row; rows with a null id are compared like others, name no group (``component_id`` is null if a group has no other id) and aren't kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.llm.common import cut, slices
from larkfold.llm.components import is_live, link_buckets, meet

SHINGLE = 5
THRESHOLD = 0.75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
LEADER_ROUNDS = 2
#: Parts of the sets that are compared with one reference.
SALTS = 16
#: A candidate goes to verification unless its likelihood at the threshold is e**-this of the best (about six sigmas).
SLACK = 18.0

_rng = np.random.Generator(np.random.PCG64(20240101))
_LETTER = _rng.integers(0, 1 << 64, 64 * 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DRAW = (_rng.integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _whole_words(text: bytes, piece: int) -> Iterator[bytes]:
    """A long text in pieces of about so many bytes that end where a word ends."""
    at = 0
    while len(text) - at > piece:
        gap = _GAP.search(text, at + piece)
        if not gap:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:]


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word of the whole text, in order: the sum of a random number for each byte and its place in
    the word. Places are told apart modulo 64, and beyond by a random factor for each 64 bytes."""
    parts = [_hashes(p) for p in _whole_words(text, piece)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text.translate(_FOLD), np.uint8)
    on = np.zeros(len(raw) + 2, np.int8)
    on[1:-1] = _WORD[raw]
    edges = np.flatnonzero(on[1:] != on[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    place = np.zeros(len(raw), np.int32)
    place[start] = start
    place = np.arange(len(raw), dtype=np.int32) - np.maximum.accumulate(place)
    each = _LETTER[((place & 63) << 8) + raw]
    if (end - start).max() > 64:
        far = np.flatnonzero(place > 63)
        each[far] *= mix((place[far] >> 6).astype(np.uint64) * _PLACE[62]) | np.uint64(1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64) * _PLACE[61])


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n = min(k, len(w))
    s = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        s += w[i : len(w) - n + 1 + i] * _PLACE[i]
    return np.unique(mix(s))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set: uint16 registers, all 0 for the empty set."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 1024):
        x = shingles[i : i + 1024]
        u = _DRAW * x.astype(np.uint32)
        u ^= (x >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, u.min(axis=1), out=least)
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE  # uniform to exponential keeps the order, so the least is taken first
    return np.clip(1 - np.floor(np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of the bands of register values."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _PLACE[60], parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key + parts[:, :, i] * _PLACE[40 + i])
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-12, 1.0)
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Joint likelihood of a similarity j, for set sizes in proportion u : v (u + v = 1)."""
    p, q = _p(u - v * j), _p(v - u * j)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1.0))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of each row's pair of sketches, and how far (in log likelihood) the threshold or anything above it is from it."""
    na, nb = na.astype(float), nb.astype(float)
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 65)[:, None] * top
    curve = log_likelihood(grid, u, v, more, less, same)
    best = curve.argmax(axis=0)
    rows = np.arange(len(u))
    j = grid[best, rows]
    at = log_likelihood(np.maximum(j, np.minimum(THRESHOLD, top)), u, v, more, less, same)
    return j, curve[best, rows] - at


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, cid, regs) of every row; cid names the set (null for the empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, cid, regs = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                cid.append(set_name(s) if len(s) else None)
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(regs, pa.binary())], names=["key", "n", "cid", "regs"]
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long, cid long, regs binary")


def set_name(shingles: np.ndarray) -> int:
    """64 bits that name a set."""
    h = mix(shingles * _PLACE[50] + np.arange(len(shingles), dtype=np.uint64) * _PLACE[51])
    return int(mix(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h))])).view(np.int64)[0])


def _bands(live: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            n = batch.num_rows
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(n, REGISTERS)
            buckets = band_keys(regs).ravel()
            on = is_live(live, buckets)
            cid, size = (np.repeat(batch.column(i).to_numpy(), BANDS)[on] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(buckets[on]), pa.array(cid), pa.array(size)], names=["bucket", "id", "n"])

    return run


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        n = batch.num_rows
        ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, REGISTERS) for c in ("ra", "rb"))
        _, gap = estimate(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(gap <= SLACK))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = []
        for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= round(100 * THRESHOLD) * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"]
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()]
        n = [len(s) for s in sets]
        cols = [pa.array(np.concatenate([*sets, np.empty(0, np.int64)])), *(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("id", "component"))]
        yield pa.RecordBatch.from_arrays(cols, names=["shingle", "id", "component"])


def _shared_with_others(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, most): how many of an id's shingles occur in any other component. An id needs the threshold's share of its own
    size for any link, as |a & b| >= t / (1 + t) * (|a| + |b|) and |b| >= t * |a|; without it, it is left out."""
    rows = sets.join(ids, "id").mapInArrow(_shingles, "shingle long, id long, component long")
    common = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    most = rows.join(common.select("shingle"), "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("most"))
    size = sets.select("id", (F.octet_length("set") / 8).alias("of"))
    return most.join(size, "id").where(F.col("most") * 100 >= F.col("of") * round(100 * THRESHOLD)).select("id", "most").distinct()


def _fits(n: str, m: str) -> Column:
    """Sizes that allow the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * round(100 * THRESHOLD)


def _can_share(n: str, most_n: str, m: str, most_m: str) -> Column:
    """Whether two sets can share what the threshold takes: t / (1 + t) of both sizes together."""
    t = round(100 * THRESHOLD)
    return F.least(most_n, most_m) * (100 + t) >= (F.col(n) + F.col(m)) * t


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets against their references: how many of the reference's shingles are missing, and which shingles it doesn't have."""
    for batch in slices(batches):
        missing, extra = [], []
        for x, ref in zip(batch.column("set").to_pylist(), batch.column("ref_set").to_pylist(), strict=True):
            x, ref = np.frombuffer(x, np.int64), np.frombuffer(ref, np.int64)
            new = np.setdiff1d(x, ref, assume_unique=True)
            missing.append(len(ref) - (len(x) - len(new)))
            extra.append(new)
        size = [len(s) // 8 for s in batch.column("ref_set").to_pylist()]
        cols = [*(batch.column(c) for c in ("id", "ref", "n", "most", "component")), pa.array(missing, pa.int64()), pa.array(size, pa.int64()), pa.array(extra, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "ref", "n", "most", "component", "missing", "ref_n", "extra"])


def _differences(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) across components that can still be links, by what the sets differ in from a common reference.

    left: (bucket, id, n, crowd, component, most). An id's reference R is the leader with the largest buckets that any of its
    buckets has. For two sets with the same one, |x & y| <= |R| - max(|R - x|, |R - y|) + |(x & y) - R|. Either the first two terms
    alone reach the threshold's share: those pairs come from the buckets; or x and y have shingles in common that R doesn't have, at least as many as
    what lacks: those come from a prefix-filtered join on such shingles, rarest first. Pairs with different references come from the buckets, too.
    """
    t = round(100 * THRESHOLD)
    need = lambda n, m: F.ceil((n + m) * t / (100 + t) - 1e-9)  # noqa: E731  shingles in common that make a link
    by_crowd = F.struct("crowd", "id")
    leaders = left.groupBy("bucket").agg(F.max_by(F.struct("crowd", "id", "component"), by_crowd).alias("l"), F.first("in_bucket").alias("in_bucket"))
    left = meet(left, leaders).withColumns({"lead": F.struct("l.crowd", "l.id"), "major": F.col("l.component")}).drop("l")
    chosen = left.groupBy("id").agg(F.max("lead").alias("lead"), *(F.first(c).alias(c) for c in ("n", "most", "component")))
    chosen = chosen.select("id", "n", "most", "component", F.col("lead.id").alias("ref"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    refs = chosen.select("ref").distinct().join(sets.select(F.col("id").alias("ref"), F.col("set").alias("ref_set")), "ref")
    refs = refs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    kinds = "id long, ref long, n long, most long, component long, missing long, ref_n long, extra array<long>"
    apart = cut(chosen.join(sets, "id").join(refs, ["ref", "salt"]).mapInArrow(_against, kinds), "setsketch-apart")

    # pairs that the reference's own shingles may link, and pairs with different references; one of a pair isn't in the leader's component
    placed = left.select("bucket", "id", "major").join(apart.drop("extra"), "id").withColumn("reach", F.floor((F.col("ref_n") - F.col("missing")) * (100 + t) / t + 1e-9) - F.col("n"))
    other = placed.select("bucket", *(F.col(c).alias(f"{c}_y") for c in ("id", "ref", "n", "most", "component", "reach")))
    minor = placed.where("component != major")
    across = (F.col("component") != F.col("component_y")) & _fits("n", "n_y") & _can_share("n", "most", "n_y", "most_y")
    once = (F.col("component_y") == F.col("major")) | (F.col("id") < F.col("id_y"))
    near = (F.col("ref") != F.col("ref_y")) | ((F.col("n_y") <= F.col("reach")) & (F.col("n") <= F.col("reach_y")))
    free = minor.join(other, "bucket").where(across & once & near).select(F.least("id", "id_y").alias("a"), F.greatest("id", "id_y").alias("b"))

    # pairs that need shingles which the reference doesn't have
    least = apart.groupBy("ref").agg(F.min("n").alias("least_n")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = apart.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    base = salted.join(least, ["ref", "salt"]).withColumn("lacks", need(F.col("n"), F.greatest(F.col("least_n"), F.ceil(F.col("n") * t / 100))) - F.col("ref_n") + F.col("missing"))
    extra = base.select("id", "ref", "n", "most", "component", "missing", "ref_n", F.greatest("lacks", F.lit(1)).alias("lacks"), F.explode("extra").alias("shingle"))
    common = extra.groupBy("ref", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("often")).where("lo != hi")
    shared = extra.join(common.select("ref", "shingle", "often"), ["ref", "shingle"])
    of_id = Window.partitionBy("id")
    shared = shared.withColumns({"rank": F.row_number().over(of_id.orderBy("often", "shingle")), "all": F.count("*").over(of_id)})
    prefix = shared.where("rank <= all - lacks + 1")
    twin = prefix.select("ref", "shingle", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "most", "component", "missing", "all")))
    enough = need(F.col("n"), F.col("n_y")) - F.col("ref_n") + F.greatest("missing", "missing_y") <= F.least("all", "all_y")
    joined = prefix.join(twin, ["ref", "shingle"]).where((F.col("id") < F.col("id_y")) & across & enough)
    return free.union(joined.select(F.col("id").alias("a"), F.col("id_y").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    sketched = cut(sketch_documents(docs, key, text), "setsketch")
    classes = cut(
        sketched.where("n > 0").groupBy("cid").agg(F.min("key").alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs")), "setsketch-classes"
    )

    def members(live: Broadcast | None) -> DataFrame:
        return classes.select("cid", "n", "regs").mapInArrow(_bands(live), "bucket long, id long, n long")

    def details(ids: DataFrame) -> DataFrame:
        wanted = ids.join(classes.select(F.col("cid").alias("id"), F.col("first").alias("key")), "id")
        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        sets = texts.join(wanted.select("key"), "key", "left_semi").select("text").mapInArrow(_sets, "id long, set binary")
        nameless = wanted.where("key is null").select("id")  # classes of rows without an id are found by their sets
        if nameless.isEmpty():
            return sets
        rest = texts.where("key is null").select("text").mapInArrow(_sets, "id long, set binary")
        return sets.union(rest.join(nameless, "id", "left_semi").dropDuplicates(["id"]))

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """By likelihood, then on the full sets."""
        side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely, "a long, b long")
        full = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
        return likely.join(full("a"), "a").join(full("b"), "b").mapInArrow(_verified, "a long, b long")

    labels = link_buckets(members, details, verify, _fits, _shared_with_others, _can_share, _differences, LEADER_ROUNDS, "setsketch")
    named = classes.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = named.join(least, "component").select("cid", "component_id")
    out = sketched.select("key", "n", "cid").join(of_class, "cid", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    )
