"""Removal of repeated 100-byte strings by a common-prefix-aware distributed merge sort (operator 7).

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier (in a
document with a smaller id, or earlier in the same one). Strings are judged on the input.

Sorting every suffix would move a hundred times the input, so the sort takes the suffixes at
*anchors*: positions whose 32-byte gram has the least hash in some window of 100 bytes. A
window's choice depends on its content only, so two equal strings hold an anchor at the same offset,
and comparing what stands left and right of equal anchors finds every equal string.

1. Gram hashes of anchors are exchanged in packed blocks by hash range. Those that occur once drop out.
2. Each task sorts the suffixes at the remaining anchors into runs, front-coded (length of the prefix shared
   with the entry before, and the rest), and the runs are exchanged by sampled suffix ranges.
3. Each range is merged by a loser tree whose nodes keep the common prefix with the last winner, so that
   known prefixes are never compared again; the merge yields the order and all common prefix lengths.
4. For each split of the length into left and right context, entries that agree in both form a class
   (by the common prefix lengths, exactly); all but the first of a class are repeats. Intervals go back by document group.

Copies inside a block or run are settled there and travel as one entry. A gram that fills more than a range in the sample
gets parts of its own: 100 equal bytes around it hold, besides the gram, at least 34 equal bytes right of it or 34 left of it, so its
entries are dealt twice, by the 34 bytes to the right (for the splits with up to 34 bytes to the left) and by the 34 to the left (for the
others). What a run settles for all splits of a side isn't sent to that side.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes keep all; a row with a null id keeps all and
is not compared, nor does it travel; equal rows are one document and get equal results; rows with one id and unlike texts are
documents of their own, in the order of their texts' digests (no row loses bytes that only stand elsewhere in another one's
text); an empty table gives an empty result; extra columns are ignored. Long texts are read in pieces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfold.llm.common import cut
from larkfold.llm.packing import group_of, pack, squeeze, text_bytes, unsqueeze
from larkfold.operators.series import ordinal

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
#: Bytes of text handled at once, anchors in a block of hashes, entries in a run.
PIECE, BLOCK, RUN = 1 << 18, 1 << 16, 1 << 14
#: Bytes of text for each hash range and suffix range.
RANGE_BYTES = 4 << 20
#: Documents in the sample that places the range bounds, and grams from each; suffix ranges at most (beyond that, a range is dealt by a hash of its grams).
SAMPLE_DOCS, SAMPLE_GRAMS, RANGES = 4000, 16, 4096
#: Equal rows that are written out at once.
COPIES = 65_536
#: Context that the two sides of a hot gram are dealt by. A gram is hot if it comes so often in the sample, and fills half a range.
HALF, OFTEN = LEFT // 2, 4
#: Entries of a run that are decoded at once.
DECODE = 1024

_B = 0xD6E8FEB86659FD93
_ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("many", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("pos", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a byte string."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size, power = 1, _B
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    w = length - GRAM + 1
    least = _sliding(h, w, np.minimum)
    # a position is the least of some window if the greatest of the windows' minima around it is its own hash
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    return at, h[at]


def _strings(docs: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(ids, starts in their documents, joined bytes) of about PIECE bytes at once; pieces of a long text overlap by LENGTH - 1 bytes."""
    ids, starts, parts, n = [], [], [], 0
    for doc, text in docs:
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            ids.append(doc)
            starts.append((at, len(part)))
            parts.append(part)
            n += len(part)
            if n >= PIECE:
                yield np.array(ids), np.array(starts), b"".join(parts)
                ids, starts, parts, n = [], [], [], 0
    if parts:
        yield np.array(ids), np.array(starts), b"".join(parts)


def document_anchors(docs: list[tuple[int, bytes]]) -> np.ndarray:
    """Anchors of documents as _ENTRY rows, once for each place."""
    out = []
    for ids, starts, data in _strings(docs):
        at, h = anchors(data)
        ends = np.cumsum(starts[:, 1])
        which = np.searchsorted(ends, at, side="right")
        inside = at + GRAM <= ends[which]
        at, h, which = at[inside], h[inside], which[inside]
        e = np.zeros(len(at), _ENTRY)
        e["hash"], e["doc"], e["pos"] = h, ids[which], at - (ends - starts[:, 1])[which] + starts[which, 0]
        out.append(e)
    if not out:
        return np.empty(0, _ENTRY)
    e = np.concatenate(out)
    again = np.zeros(len(e), bool)  # a long text's pieces overlap
    long = np.isin(e["doc"], [d for d, t in docs if len(t) > PIECE]) if any(len(t) > PIECE for _, t in docs) else again
    if long.any():
        part = np.flatnonzero(long)
        _, first = np.unique(e[part][["doc", "pos"]], return_index=True)
        again[part] = True
        again[part[first]] = False
        e = e[~again]
    return e


def _groups(of: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows by group, each packed."""
    order = np.argsort(of, kind="stable")
    of, rows = of[order], rows[order]
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(of[a]), rows[a:b].tobytes()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


BLOCKS = ["part", "known", "block"], [pa.int32(), pa.bool_(), pa.binary()]


def _hash_blocks(parts: int):
    """Map side of step 1: anchors of the documents in blocks by hash range. Of a gram that the block holds
    several times one entry goes on, marked; its places are known to repeat and go along as such."""

    def block(entries: np.ndarray, salt: int) -> pa.RecordBatch:
        entries = entries[np.argsort(entries["hash"], kind="stable")]
        same = np.concatenate(([False], entries["hash"][1:] == entries["hash"][:-1]))
        many = same | np.concatenate((same[1:], [False]))
        one = entries[~same]
        one["many"] = many[~same]
        rows = [(p, False, b) for p, b in _groups(((one["hash"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), one)]
        places = np.zeros(many.sum(), _PLACE)
        places["doc"], places["pos"] = entries["doc"][many], entries["pos"][many]
        rows += [((salt + p) % parts, True, b) for p, b in _groups(np.arange(len(places)) // 4096, places)]
        return _batch(rows, *BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, salt = [], 0, TaskContext.get().partitionId() * 104729  # so that tasks start at different parts
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # a few texts at a time as Python objects
                part = batch.slice(i, 256)
                e = document_anchors(list(zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)))
                held.append(e)
                n += len(e)
                if n >= BLOCK:
                    yield block(np.concatenate(held), salt)
                    salt += 7919
                    held, n = [], 0
        if n:
            yield block(np.concatenate(held), salt)

    return run


def _repeated(groups: int):
    """Reduce side of step 1: places of the grams that occur more than once, packed by document group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, known = [np.empty(0, _ENTRY)], []
        for batch in batches:
            for old, block in zip(batch.column("known").to_pylist(), batch.column("block"), strict=True):
                (known if old else entries).append(np.frombuffer(block.as_py(), _PLACE if old else _ENTRY))
        e = np.concatenate(entries)
        del entries
        order = np.argsort(e["hash"], kind="stable")
        h = e["hash"][order]
        same = h[1:] == h[:-1]
        more = np.zeros(len(e), bool)
        more[order[1:]] = same
        more[order[:-1]] |= same
        del h, order
        e = e[more & (e["many"] == 0)]  # the places of the marked are known already
        places = np.empty(len(e), _PLACE)
        places["doc"], places["pos"] = e["doc"], e["pos"]
        places = np.concatenate([places, *known])
        rows = [(g, squeeze(b)) for g, b in _groups(group_of(places["doc"], groups), places)]
        yield _batch(rows, ["g", "places"], [pa.int32(), pa.binary()])

    return run


class Entries:
    """Suffixes with their surroundings: right context (LENGTH bytes from the anchor) and left context (LEFT bytes
    before it, reversed), zero-padded, with their true lengths."""

    FIELDS = ("doc", "pos", "nr", "nl", "right", "left")

    def __init__(self, doc, pos, nr, nl, right, left):
        self.doc, self.pos, self.nr, self.nl, self.right, self.left = doc, pos, nr, nl, right, left

    @classmethod
    def of(cls, doc: int, text: bytes, at: np.ndarray) -> Entries:
        data = np.frombuffer(b"\0" * LEFT + text + b"\0" * LENGTH, np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(data, LEFT + LENGTH)[at]
        return cls(
            np.full(len(at), doc, np.int64), at.astype(np.int32), np.minimum(len(text) - at, LENGTH).astype(np.uint8),
            np.minimum(at, LEFT).astype(np.uint8), view[:, LEFT:], view[:, LEFT - 1 :: -1],
        )

    @classmethod
    def concat(cls, parts: list[Entries]) -> Entries:
        """Takes the parts apart field by field, so that no more than one field is held twice."""
        fields = []
        for f in cls.FIELDS:
            fields.append(np.concatenate([getattr(p, f) for p in parts]))
            for p in parts:
                delattr(p, f)
        return cls(*fields)

    def take(self, order: np.ndarray) -> Entries:
        return Entries(*(getattr(self, f)[order] for f in self.FIELDS))

    def sort(self, order: np.ndarray) -> Entries:
        """In place, field by field."""
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[order])
        return self

    def __len__(self) -> int:
        return len(self.doc)


def _text(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as sortable strings."""
    return np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel()


def shared_prefix(matrix: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before; 0 for the first."""
    out = np.zeros(len(matrix), np.uint8)
    if len(matrix) > 1:
        other = matrix[1:] != matrix[:-1]
        first = other.argmax(axis=1)
        out[1:] = np.where(other[np.arange(len(first)), first], first, matrix.shape[1])
    return out


def _whole_copies(e: Entries) -> tuple[Entries, np.ndarray]:
    """Entries without those whose surroundings equal an earlier entry's altogether, and the spans of what is left out."""
    e = e.take(np.lexsort((e.pos, e.doc)))
    both = np.hstack([e.right, e.left, e.nr[:, None], e.nl[:, None]])
    _, first, inverse = np.unique(both.view(f"V{both.shape[1]}").ravel(), return_index=True, return_inverse=True)
    lead = first[inverse]
    strictly = (e.doc[lead] != e.doc) | (e.pos[lead] != e.pos)
    fits = strictly & (e.nr.astype(int) + e.nl >= LENGTH)
    gone = np.zeros(fits.sum(), _SPAN)
    gone["doc"], gone["start"], gone["end"] = e.doc[fits], e.pos[fits] - e.nl[fits], e.pos[fits] + e.nr[fits]
    return e.take(np.flatnonzero(lead == np.arange(len(e)))), gone


def front_code(e: Entries) -> bytes:
    """A sorted run: counts, prefix lengths, the rest of each suffix, and the other columns."""
    same = shared_prefix(e.right)
    rest = e.right[np.arange(LENGTH)[None, :] >= same[:, None]]
    return squeeze(b"".join([np.array([len(e), len(rest)], np.int64).tobytes(), same.tobytes(), rest.tobytes(), *(getattr(e, f).tobytes() for f in ("doc", "pos", "nr", "nl", "left"))]))


def front_decode(run: bytes) -> tuple[Entries, np.ndarray]:
    """The entries of a run and their prefix lengths."""
    run = unsqueeze(run)
    n, size = np.frombuffer(run, np.int64, 2)
    at = 16

    def read(dtype, count):
        nonlocal at
        out = np.frombuffer(run, dtype, count, at)
        at += out.nbytes
        return out

    same, rest = read(np.uint8, n), read(np.uint8, size)
    doc, pos, nr, nl, left = read(np.int64, n), read(np.int32, n), read(np.uint8, n), read(np.uint8, n), read(np.uint8, n * LEFT)
    right = np.zeros((n, LENGTH), np.uint8)
    right[np.arange(LENGTH)[None, :] >= same[:, None]] = rest
    for a in range(0, n, DECODE):  # an entry's byte j is that of the last entry before it that wrote byte j
        first = max(a - 1, 0)  # complete already
        part = right[first : a + DECODE]
        wrote = np.where(np.arange(LENGTH)[None, :] >= same[first : a + DECODE, None], np.arange(len(part))[:, None], 0)
        wrote[0] = 0
        np.maximum.accumulate(wrote, axis=0, out=wrote)
        part[:] = np.take_along_axis(part, wrote, axis=0)
    return Entries(doc, pos, nr, nl, right, left.reshape(-1, LEFT)), same


def merge_runs(runs: list[tuple[memoryview, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs of (strings of LENGTH bytes end to end, prefix lengths) with a loser tree: (run, index, prefix shared with the string before).

    A node holds a losing run and the prefix its head shares with the string that beat it. When a run's next head comes up, the
    head that shares more with the last winner is smaller; only for equal lengths bytes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * len(runs)
    loser = [-1] * k  # runs; -1: none, the end of all
    shared = [0] * k

    def order(a: int, b: int, known: int) -> tuple[int, int]:
        """Which of two heads comes first (ties: of the lesser run), and the prefix they share."""
        x, y = LENGTH * at[a], LENGTH * at[b]
        x, y = (int.from_bytes(runs[r][0][i + known : i + LENGTH], "big") for r, i in ((a, x), (b, y)))
        return (a if x < y or (x == y and a < b) else b), LENGTH - (((x ^ y).bit_length() + 7) >> 3)

    def play(node: int) -> int:
        """The winner of a subtree, while it is built."""
        if node >= k:
            i = node - k
            return i if i < len(runs) and runs[i][1] else -1
        a, b = play(2 * node), play(2 * node + 1)
        if a < 0 or b < 0:
            return max(a, b)
        first, shared[node] = order(a, b, 0)
        loser[node] = a + b - first
        return first

    win, same = play(1) if k > 1 else (0 if runs and runs[0][1] else -1), 0
    while win >= 0:
        i = at[win]
        yield win, i, same
        at[win] = i = i + 1
        prefixes = runs[win][1]
        node = (win + k) >> 1
        cur, same = (win, prefixes[i]) if i < len(prefixes) else (-1, -1)
        while node:
            other = loser[node]
            if other >= 0:
                n = shared[node]
                if n > same:
                    loser[node], shared[node] = cur, same
                    cur, same = other, n
                elif n == same:
                    first, shared[node] = order(cur, other, n)
                    loser[node] = cur + other - first
                    cur = first
            node >>= 1
        win = cur


def repeats(e: Entries, same: np.ndarray, first: int = 0, last: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """What starts earlier, too, of entries sorted by right context with their prefix lengths, for the splits with ``first`` to ``last`` bytes to the left:
    the spans that such strings cover, and for each entry whether a split is open (possible, and none starts earlier) of those with up to
    HALF bytes to the left, and of those with at least HALF."""
    n = len(e)
    still = np.ones((n, 2), bool)
    # entries alone with their gram have nothing to be compared with
    gram = np.cumsum(same < GRAM)
    crowd = np.bincount(gram)[gram] > 1 if n else np.empty(0, bool)
    by_place = np.lexsort((e.pos, e.doc))
    by_place = by_place[crowd[by_place]]
    if not len(by_place):
        return np.empty(0, _SPAN), still
    doc, pos, nr, nl = (x[by_place] for x in (e.doc, e.pos, e.nr, e.nl))
    left = e.left[by_place]
    by_left = np.argsort(_text(left), kind="stable")
    same_left = shared_prefix(left[by_left])
    del left
    back = np.empty(len(by_left), np.int64)
    back[by_left] = np.arange(len(by_left))
    low, high = np.full(len(doc), LENGTH, np.int16), np.full(len(doc), -1, np.int16)
    unsettled = np.zeros((len(doc), 2), bool)
    for to_left in range(first, last + 1):
        to_right = LENGTH - to_left
        fit = np.flatnonzero((nr >= to_right) & (nl >= to_left))
        if not len(fit):
            continue
        key = np.cumsum(same < to_right)[by_place[fit]] * (n + 1) + np.cumsum(same_left < to_left)[back[fit]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        own = fit[order]
        lead = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        is_late = (doc[lead] != doc[own]) | (pos[lead] != pos[own])
        late = own[is_late]
        low[late] = np.minimum(low[late], to_left)
        high[late] = to_left
        for side in (0, 1):
            if to_left <= HALF if side == 0 else to_left >= HALF:
                unsettled[own[~is_late], side] = True
    still[by_place] = unsettled
    hit = high >= 0
    out = np.zeros(hit.sum(), _SPAN)
    out["doc"], out["start"], out["end"] = doc[hit], pos[hit] - high[hit], pos[hit] + LENGTH - low[hit]
    return out, still


class Parts:
    """Where entries go: ranges of their suffixes (each dealt by a hash of the gram if there are more parts than ranges), and for each
    hot gram ``width`` parts by the bytes to the right and as many by those to the left."""

    def __init__(self, grams: list[bytes], parts: int):
        """grams: a sorted sample."""
        ranges = min(parts, RANGES)
        self.subs = -(-parts // ranges)
        counts: dict[bytes, int] = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        hot = {g: 2 * c * parts / len(grams) for g, c in counts.items() if c >= OFTEN and 2 * c * parts >= len(grams)}
        # half of the ranges by all grams, half by those that repeat in the sample: a few families of copies may be most of what is dealt
        half = -(-ranges // 2)
        rest = [g for g in grams if g not in hot]
        again = [g for g in rest if counts[g] > 1]
        self.bounds = np.array(sorted({x[len(x) * i // half] for x in (rest, again) if x for i in range(1, half)}), f"S{GRAM}")
        self.hot = np.array(sorted(hot), f"S{GRAM}")
        self.width = np.array([max(2, math.ceil(hot[g])) for g in sorted(hot)], np.int64)
        self.first = (len(self.bounds) + 1) * self.subs + np.concatenate(([0], np.cumsum(2 * self.width))).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def splits(self, part: int) -> tuple[int, int]:
        """The splits that a part answers for, by the bytes to the left."""
        if part < self.first[0]:
            return 0, LEFT
        i = np.searchsorted(self.first, part, side="right") - 1
        return (0, HALF) if part < self.first[i] + self.width[i] else (HALF, LEFT)

    def hot_of(self, gram: np.ndarray) -> np.ndarray:
        """The number of each hot gram; -1 for others."""
        if not len(self.hot):
            return np.full(len(gram), -1)
        at = np.minimum(np.searchsorted(self.hot, gram), len(self.hot) - 1)
        return np.where(self.hot[at] == gram, at, -1)

    def of(self, right: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, _text(right[:, :GRAM]), side="right") * self.subs
        return at if self.subs == 1 else at + _hash(right[:, :GRAM]) % self.subs

    def of_hot(self, hot: np.ndarray, context: np.ndarray, side: int) -> np.ndarray:
        return self.first[hot] + side * self.width[hot] + _hash(context) % self.width[hot]


def _hash(matrix: np.ndarray) -> np.ndarray:
    h = np.zeros(len(matrix), np.uint64)
    for j in range(matrix.shape[1]):
        h = (h + matrix[:, j]) * np.uint64(_B)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


RUNS = ["part", "known", "block"], [pa.int32(), pa.bool_(), pa.binary()]


def _documents(blocks: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    """Ids and texts of a group, block by block."""
    for raw in blocks.column("block").to_pylist():
        for batch in pa.ipc.open_stream(raw):
            yield from ((d, t or b"") for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True))


def _sorted_runs(parts: Parts):
    """Step 2: front-coded sorted runs by part, from a group's documents and places."""

    def runs(e: Entries, to: np.ndarray) -> Iterator[tuple[int, bool, bytes]]:
        """Entries in order, as a run for each part."""
        order = np.argsort(to, kind="stable")
        to = to[order]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(e) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(to[a]), False, front_code(e.take(order[a:b]))

    def flush(held: list[Entries], salt: int) -> Iterator[tuple[int, bool, bytes]]:
        e, gone = _whole_copies(Entries.concat(held))
        e.sort(np.argsort(_text(e.right), kind="stable"))
        hot = parts.hot_of(_text(e.right[:, :GRAM]))
        if (hot >= 0).any():
            cold, e, hot = e.take(np.flatnonzero(hot < 0)), e.take(np.flatnonzero(hot >= 0)), hot[hot >= 0]
            yield from runs(cold, parts.of(cold.right))
            late, still = repeats(e, shared_prefix(e.right))
            gone = np.concatenate([gone, late])
            for side, context in enumerate((e.right[:, GRAM : GRAM + HALF], e.left[:, :HALF])):
                go = np.flatnonzero(still[:, side])
                yield from runs(e.take(go), parts.of_hot(hot[go], context[go], side))
        else:
            yield from runs(e, parts.of(e.right))
        for p, b in _groups(np.arange(len(gone)) // 4096, gone):
            yield (salt + p) % len(parts), True, squeeze(b)

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        places = np.concatenate([np.frombuffer(unsqueeze(b), _PLACE) for b in found.column("places").to_pylist()] or [np.empty(0, _PLACE)])
        places.sort(order=["doc", "pos"])
        held, n, salt, rows = [], 0, key[0].as_py() * 7919, []
        for doc, text in _documents(docs):
            if doc is None:
                continue
            a, b = np.searchsorted(places["doc"], [doc, doc + 1])
            at = places["pos"][a:b].astype(np.int64)
            at = at[at < len(text)]  # rows that repeat an id may have another text
            for i in range(0, len(at), RUN):
                held.append(Entries.of(doc, text, at[i : i + RUN]))
                n += len(held[-1])
                if n >= RUN:
                    rows += flush(held, salt)
                    held, n, salt = [], 0, salt + 1
        if n:
            rows += flush(held, salt)
        return pa.Table.from_batches([_batch(rows, *RUNS)])

    return run


def _merged(groups: int, parts: Parts):
    """Reduce side: merges a part's runs and packs its spans by document group."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, runs = [np.empty(0, _SPAN)], []
        for batch in batches:
            for known, block in zip(batch.column("known").to_pylist(), batch.column("block"), strict=True):
                if known:
                    spans.append(np.frombuffer(unsqueeze(block.as_py()), _SPAN))
                else:
                    runs.append(front_decode(block.as_py()))
        if runs:
            base = np.cumsum([0, *(len(e) for e, _ in runs)]).tolist()
            heads = [(memoryview(e.right).cast("B"), same.tobytes()) for e, same in runs]
            merged = np.fromiter((x for w, i, s in merge_runs(heads) for x in (base[w] + i, s)), np.int32, 2 * base[-1]).reshape(-1, 2)
            del heads
            everything = Entries.concat([e for e, _ in runs])
            del runs
            spans.append(repeats(everything.sort(merged[:, 0]), merged[:, 1], *parts.splits(key[0].as_py()))[0])
            del everything
        found = np.concatenate(spans)
        rows = [(g, squeeze(b)) for g, b in _groups(group_of(found["doc"], groups), found)]
        yield _batch(rows, ["g", "spans"], [pa.int32(), pa.binary()])

    return run


def _removed(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Each document of a group with the union of its spans, as runs that don't touch."""
    s = np.concatenate([np.frombuffer(unsqueeze(b), _SPAN) for b in found.column("spans").to_pylist()] or [np.empty(0, _SPAN)])
    s = np.sort(s, order=["doc", "start"])
    out = []
    for doc, text in _documents(docs):
        a, b = np.searchsorted(s["doc"], [doc, doc + 1]) if doc is not None else (0, 0)
        start, end = s["start"][a:b], np.maximum.accumulate(np.minimum(s["end"][a:b], len(text)))
        new = np.concatenate(([True], start[1:] > end[:-1])) if a < b else np.empty(0, bool)
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [b - a - 1])) if a < b else np.empty(0, np.int64)
        cuts = np.stack([start[new], end[last]], axis=1).astype(np.int32)
        digest = hashlib.sha256(kept(text, cuts.tolist())).hexdigest()
        out.append((doc, len(text), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), digest, cuts.tobytes()))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return pa.Table.from_batches([_batch(out, names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])])


def _parts(docs: DataFrame, rows: int, parts: int) -> Parts:
    """Parts from the grams at anchors of a bounded hash sample of the documents. They balance the work; results don't depend on them."""
    limit = min(1.0, SAMPLE_DOCS / max(rows, 1))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                at = anchors(text[: 4 * PIECE])[0]
                out += [text[p : p + GRAM] for p in at[:: max(1, -(-len(at) // SAMPLE_GRAMS))]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["gram"])

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(limit * (1 << 20)) + 1).select("text")
    return Parts(sorted(bytes(r[0]).rstrip(b"\0") for r in few.mapInArrow(grams, "gram binary").collect()), parts)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans: packed int32 pairs (start, end) of removed bytes."""
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = every.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = _remove(known)
    else:
        out = _remove_by_row(known)
    no, zero = every.where("doc_id is null"), F.lit(0).cast("long")
    whole = F.coalesce("text", F.lit(""))
    alone = no.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), F.unhex(F.lit("")).alias("spans"))
    return out.unionByName(alone).withColumnRenamed("doc_id", key)


def _remove_by_row(rows: DataFrame) -> DataFrame:
    """Ids repeat: distinct (id, text) are numbered in order and taken as documents, and each row gets the result of its own."""
    order = ["doc_id", "digest"]
    same = rows.groupBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    same = cut(same, "repeats-rows")
    placed = cut(same.select(*order, "n").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "repeats-order")
    numbers = cut(ordinal(placed.withColumn("all", F.lit(0)), ["all"], order, F.col("range"), "number").drop("all"), "repeats-numbers")
    out = _remove(same.join(numbers.drop("n"), order).select(F.col("number").alias("doc_id"), "text")).withColumnRenamed("doc_id", "number")
    each = out.join(numbers, "number").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / COPIES).cast("int"))))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("piece") * COPIES, F.lit(COPIES)).cast("int"))))
    return each.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _remove(every: DataFrame) -> DataFrame:
    """The rows of ids that don't repeat."""
    rows = every.where(F.col("text").isNotNull())
    n, size = text_bytes(rows)
    parts = max(16, -(-size // RANGE_BYTES))
    dealt = pack(every, parts)  # used twice; Spark reuses the exchange
    blocks = rows.mapInArrow(_hash_blocks(parts), "part int, known boolean, block binary")
    places = blocks.groupBy("part").applyInArrow(_repeated(parts), "g int, places binary")
    dealing = _parts(rows, n, parts)
    runs = dealt.groupBy("g").cogroup(places.groupBy("g")).applyInArrow(_sorted_runs(dealing), "part int, known boolean, block binary")
    spans = runs.groupBy("part").applyInArrow(_merged(parts, dealing), "g int, spans binary")
    return dealt.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"
    )


def kept(text: bytes, cuts: list[list[int]]) -> bytes:
    """A text without its spans."""
    at, out = 0, []
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple]:
    """Straight from the definition, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out
