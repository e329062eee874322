"""Benchmark decontamination with one Aho-Corasick automaton (operator 10).

Items are normalised to words (A-Z lower-cased, runs of ASCII letters, digits and
non-ASCII characters), cut to windows of ten consecutive words (an item of fewer words
is one window), and put, with a space on each side of every word, into one automaton.
Each document is normalised the same way, keeping lengths, and scanned once; matched
offsets are mapped back to words and to characters of the original.

The automaton goes to the executors as a broadcast of at most ``max_windows`` windows;
a larger benchmark is scanned in blocks of that many, one automaton and one pass over the
documents each. The driver reads the benchmark partition by partition and holds one block. A worker builds an automaton once and
keeps it until it gets another. The documents are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null or wordless
item is never found; an item id that comes twice counts once; items with a null id are found, as one item with a null id, last in ``item_ids``;
rows that repeat an id are scanned each; empty tables give no rows (documents) or no hits (benchmark); extra columns are ignored, or kept as one struct.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkfold.llm.common import ALNUM_TABLE, cut, whole_row

WINDOW = 10
#: Windows in one automaton: at about 1 KB of trie for a window, half a GB at most.
MAX_WINDOWS = 200_000


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def windows(item: bytes, n: int = WINDOW) -> Iterator[bytes]:
    w = words(item)
    if w:
        for i in range(max(1, len(w) - n + 1)):
            yield b" " + b" ".join(w[i : i + n]) + b" "


def blocks(items: Iterable[tuple[str | None, bytes]], max_windows: int, n: int = WINDOW) -> Iterator[dict[bytes, set[str]]]:
    """The windows of the items with their item ids, in blocks of at most ``max_windows`` windows (an item may go over two)."""
    block: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in windows(text, n):
            if w not in block and len(block) >= max_windows:
                yield block
                block = {}
            block.setdefault(w, set()).add(item_id)
    yield block


class Scanner:
    """One automaton."""

    def __init__(self, block: dict[bytes, set[str]]):
        self.auto = ahocorasick.Automaton()
        for w, ids in block.items():
            self.auto.add_word(w.decode("latin-1"), (len(w), tuple(ids)))
        self.empty = not block
        if block:
            self.auto.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, runs of hit words as (first, end), ids of the items found."""
        w = words(text)
        if not w or self.empty:
            return len(w), [], set()
        joined = b" " + b" ".join(w) + b" "
        found: set[str] = set()
        spans: list[tuple[int, int]] = []
        for end, (length, ids) in self.auto.iter(joined.decode("latin-1")):
            spans.append((end - length + 1, end))
            found.update(ids)
        if not spans:
            return len(w), [], found
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)  # the i-th is before word i
        hit = np.zeros(len(w) + 1, np.int32)
        first, last = np.searchsorted(spaces, np.array(spans).T)
        np.add.at(hit, first, 1)
        np.add.at(hit, last, -1)
        on = np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(on))
        return len(w), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], found


_latest: dict[str, Scanner] = {}


def _scanner(name: str, block) -> Scanner:
    """The automaton of a block, built once in each Python worker."""
    if name not in _latest:
        _latest.clear()
        _latest[name] = Scanner(block.value)
    return _latest[name]


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in the original at which words start and end (normalising keeps lengths)."""
    on = np.concatenate(([0], (np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) != 32).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(on)).reshape(-1, 2)
    return edges[:, 0], edges[:, 1]


WORD_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
CHAR_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = ("n_words", "word_spans", "char_spans", "item_ids")
SCHEMA = "n_words long, word_spans array<struct<first:int,end:int>>, char_spans array<struct<start:int,end:int>>, item_ids array<string>"


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str | None = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """(key, n_words, word_spans, char_spans, item_ids) for every row; with ``key`` None, the whole row as ``row`` in its place.

    ``word_spans``: runs of hit words, by word number. ``char_spans``: the same runs as
    character offsets of the original text. ``item_ids``: sorted ids of the items found.
    """
    spark = docs.sparkSession
    items = (
        (r[0], bytes(r[1]))
        for r in benchmark.select(F.col("item_id").cast("string"), F.encode(F.col("text"), "UTF-8"))
        .where(F.col("text").isNotNull())
        .orderBy("item_id")
        .toLocalIterator()
    )
    out = docs.select(F.col(key).alias("kept"), F.col(text).alias("text")) if key else docs.select(whole_row(docs).alias("kept"))
    for i, block in enumerate(blocks(items, max_windows, window)):
        out = _pass(cut(out, "decontamination") if i else out, None if key else text, spark.sparkContext.broadcast(block), again=i > 0)
    return out.select(F.col("kept").alias(key or "row"), *FOUND)


def _pass(df: DataFrame, inner: str | None, block, again: bool) -> DataFrame:
    """Scans every text for one block of windows and merges what it finds with what earlier passes found. inner: the text's name in the kept row."""
    own = df.columns[: 1 if inner else 2]
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(name, block)
        for batch in batches:
            texts = (batch.column(0).field(inner) if inner else batch.column("text")).cast(pa.binary()).to_pylist()
            n_words, spans, chars, ids = [], [], [], []
            for i, t in enumerate(texts):
                n, runs, found = scanner.scan(t or b"")
                if again:
                    runs = merge(runs + [(s["first"], s["end"]) for s in batch.column("word_spans")[i].as_py()])
                    found.update(batch.column("item_ids")[i].as_py())
                n_words.append(n)
                spans.append([{"first": a, "end": b} for a, b in runs])
                chars.append(character_spans(t, runs) if runs else [])
                ids.append(sorted(found - {None}) + [None] * (None in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in own] + [pa.array(n_words, pa.int64()), pa.array(spans, WORD_SPANS), pa.array(chars, CHAR_SPANS), pa.array(ids, pa.list_(pa.string()))],
                names=[*own, *FOUND],
            )

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in own), *StructType.fromDDL(SCHEMA)]))


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs, as runs that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def character_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as character offsets of the original text."""
    start, end = word_offsets(text)
    at = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))  # characters before each byte
    return [{"start": int(at[start[a]]), "end": int(at[end[b - 1]])} for a, b in runs]


def hit_words() -> Column:
    return F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of each document: hit words, items and whether it is contaminated."""
    return scan_documents(docs, benchmark, **options).select(
        options.get("key", "doc_id"),
        "n_words",
        hit_words().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], n: int = WINDOW) -> dict:
    """Straight from the definition, for tests."""
    its = [(i, [x.decode() for x in words(t.encode())]) for i, t in items if t is not None]
    out = {}
    for d, t in docs:
        w = [x.decode() for x in words((t or "").encode())]
        hit, ids = set(), set()
        for i, iw in its:
            k = min(n, len(iw))
            wins = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if k else set()
            for p in range(len(w) - k + 1 if k else 0):
                if tuple(w[p : p + k]) in wins:
                    hit.update(range(p, p + k))
                    ids.add(i if i is None else str(i))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(), bool(hit))
    return out
