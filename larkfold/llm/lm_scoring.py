"""Cross-entropy difference of two n-gram models (operator 9).

The target model is trained on the documents named as target, the background model on as many words of other documents, drawn by a
hash of the id: matched models of one size, one vocabulary (the words that come at least ``MIN_COUNT`` times in all documents; any other word is
unknown to all) and one smoothing, so the level of a score doesn't depend on how large the target is. A document's score is the mean
over its words of target loss minus background loss, so the lower the more like the target. A third model of all documents
gives ``corpus_loss``. Counts leave out the word being scored where its document was counted, else documents would know themselves.

Counts cover all documents and are exchanged twice, never broadcast: documents are dealt to
groups of bounded size; each group sends its distinct n-grams with their counts to hash ranges, a range adds
them up and answers each group with the totals that differ from the group's own. A frequent n-gram is
one entry a group. The documents' exchange is the same for counting and scoring, so Spark reuses it.

Smoothing: unigrams get ADD more counts each out of VOCABULARY words; bigrams are drawn to the unigram
by a Dirichlet prior of MU words; an unknown word, or one after an unknown word, is scored by its unigram.

Drawing the background: documents are in order of a hash draw of DRAWS values, and those up to the greatest value are taken at which they have no more words
than the target; all others if they have fewer.

Defined cases: a null text or one without words has 0 tokens and null losses; target ids without a
document are ignored; a null id is no target, and its draw is by its text; rows that repeat an id are scored and counted each, and are drawn together; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.llm.common import cut, word_count
from larkfold.llm.packing import pack, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from larkfold.llm.setsketch import mix, word_hashes

MIN_COUNT = 2
VOCABULARY, ADD, MU = float(1 << 20), 0.1, 20.0
#: Bytes of text in a group, and of all text for a hash range.
GROUP_BYTES = 8 << 20
#: Values of a background draw: STEPS ranges of STEPS values.
STEPS = 1 << 10
DRAWS = STEPS * STEPS

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: The models: target, background, all documents.
MODELS = ("tg", "bg", "al")


class Counts:
    """Words, bigrams and distinct n-grams of one group of documents."""

    def __init__(self, blocks: pa.Table, drawn: int):
        ids: list[int | None] = []
        draws: list[int] = []
        hashes: list[np.ndarray] = []
        target: set[int] = set()
        for raw in blocks.column("block").to_pylist():  # one block's texts at a time
            for batch in pa.ipc.open_stream(raw):
                if batch.num_columns == 1:
                    target.update(batch.column(0).to_pylist())
                else:
                    ids += batch.column(0).to_pylist()
                    draws += batch.column(2).to_pylist()
                    hashes += [word_hashes(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        self.ids = ids
        self.n = np.array([len(h) for h in hashes], np.int64)
        named = np.array([i is not None and i in target for i in ids], bool)
        roles = {"tg": named, "bg": ~named & (np.array(draws, np.int64) < drawn), "al": np.ones(len(ids), bool)}
        words = np.concatenate([*hashes, np.empty(0, np.uint64)])
        del hashes
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        follows = self.doc[1:] == self.doc[:-1]
        self.second = np.flatnonzero(follows) + 1  # words with a word before them
        pairs = mix(words[self.second - 1] * _A + words[self.second] * _B) | np.uint64(1)
        words = words & ~np.uint64(1)
        self.keys, self.at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        self.on = {m: role[self.doc] for m, role in roles.items()}  # which words a model has counted
        self.counts = {m: np.bincount(self.at[np.concatenate([on, on[self.second]])], minlength=len(self.keys)).astype(np.int64) for m, on in self.on.items()}

    def ranges(self, parts: int) -> list[tuple[int, int, int]]:
        of = _part(self.keys, parts)
        edges = np.searchsorted(of, np.arange(parts + 1))
        return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]

    def losses(self, totals: dict[str, int]) -> list[np.ndarray]:
        """Mean loss of each document under each model."""
        m = len(self.doc)
        word, pair = self.at[:m], self.at[m:]
        known = self.counts["al"][word] >= MIN_COUNT
        both = known[self.second] & known[self.second - 1]
        second, pair = self.second[both], pair[both]
        out = []
        for model in MODELS:
            counts, less = self.counts[model], self.on[model].astype(float)
            p = (np.where(known, counts[word] - less, 0) + ADD) / (totals[model] - less + ADD * VOCABULARY)
            p[second] = (counts[pair] - less[second] + MU * p[second]) / (counts[word[second - 1]] - less[second] + MU)
            out.append(np.bincount(self.doc, -np.log(p), len(self.n)) / np.maximum(self.n, 1))
        return out


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_FLAT = {m: pa.binary() for m in MODELS}


def _count(parts: int, drawn: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        c = Counts(docs, drawn)
        rows = [(p, key[0].as_py(), squeeze_sorted(c.keys[a:b]), *(squeeze(c.counts[m][a:b].astype(np.uint32).tobytes()) for m in MODELS)) for p, a, b in c.ranges(parts)]
        kinds = {"part": pa.int32(), "g": pa.int32(), "keys": pa.binary(), **_FLAT}
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return run


def _totals(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    keys = [unsqueeze_sorted(b) for b in blocks.column("keys").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    edges = np.cumsum([0, *(len(k) for k in keys)])
    del keys
    sums, changed = {}, np.zeros(len(at), bool)
    for m in MODELS:
        own = np.concatenate([np.frombuffer(unsqueeze(b), np.uint32) for b in blocks.column(m).to_pylist()])
        sums[m] = np.bincount(at, own, len(distinct)).astype(np.uint32)[at]
        changed |= sums[m] != own
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mask = changed[a:b]
        out.append([squeeze(np.packbits(mask).tobytes()), *(squeeze(sums[m][a:b][mask].tobytes()) for m in MODELS)])
    cols = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
    return pa.table([blocks.column("g"), pa.array([key[0].as_py()] * len(out), pa.int32()), *cols], names=["g", "part", "mask", *MODELS])


SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, corpus_loss double, score double"


def _score(parts: int, drawn: int, totals: dict[str, int]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Counts(docs, drawn)
        at = {p: (a, b) for p, a, b in c.ranges(parts)}
        for row in range(answers.num_rows):
            part, mask, *counts = (answers.column(x)[row].as_py() for x in ("part", "mask", *MODELS))
            a, b = at[part]
            where = a + np.flatnonzero(np.unpackbits(np.frombuffer(unsqueeze(mask), np.uint8))[: b - a])
            for m, x in zip(MODELS, counts, strict=True):
                c.counts[m][where] = np.frombuffer(unsqueeze(x), np.uint32)
        target, background, corpus = c.losses(totals)
        cols = [pa.array(x, mask=c.n == 0) for x in (target, background, corpus, target - background)]
        return pa.table([pa.array(c.ids, pa.int64()), pa.array(c.n), *cols], names=["doc_id", "n_tokens", "target_loss", "background_loss", "corpus_loss", "score"])

    return run


def draw() -> Column:
    """The draw of a document of the background."""
    return F.pmod(F.xxhash64(F.lit(9), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(DRAWS)).cast("int")


def _drawn(marked: DataFrame, words: int) -> tuple[int, int]:
    """The draw below which other documents than the target's have at most so many words, and how many they have. Words of a range of draws, then of
    the draws of one range: STEPS rows each reach the driver."""
    others, end, n = marked.where(F.col("on").isNull()), 0, 0
    for step in (STEPS, 1):
        within = others.where(F.col("draw").between(end, end + STEPS * step - 1)).groupBy(F.floor(F.col("draw") / step).alias("d")).agg(F.sum("n").alias("n"))
        sums = {r["d"]: r["n"] for r in within.collect()}
        first = end // step
        for d in range(first, first + STEPS):
            if n + sums.get(d, 0) > words:
                break
            n += sums.get(d, 0)
            end = (d + 1) * step
    return end, n


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, corpus_loss, score) of every row. target_ids: one column of ids."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("draw", draw())
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    sizes = rows.select("doc_id", "draw", F.octet_length("text").alias("b"), word_count(F.col("text")).alias("n"))
    marked = cut(sizes.join(ids.withColumn("on", F.lit(1)), "doc_id", "left"), "lm-sizes")
    total = marked.agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.sum(F.when(F.col("on") == 1, F.col("n"))).alias("t")).first()
    n_target = total["t"] or 0
    drawn, n_background = _drawn(marked, n_target)
    groups = max(8, -(-(total["b"] or 0) // GROUP_BYTES))
    dealt = pack(rows, groups).unionByName(pack(ids, groups))
    flat = ", ".join(f"{m} binary" for m in MODELS)
    counted = dealt.groupBy("g").applyInArrow(_count(groups, drawn), f"part int, g int, keys binary, {flat}")
    answers = counted.groupBy("part").applyInArrow(_totals, f"g int, part int, mask binary, {flat}")
    totals = {"tg": n_target, "bg": n_background, "al": total["n"] or 0}
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_score(groups, drawn, totals), SCHEMA).withColumnRenamed("doc_id", key)


def brute_force(docs: list[tuple[int, str | None]], target: set[int], draws: dict[int, int]) -> dict[int, tuple]:
    """Straight from the definition, for tests (ids are unique)."""
    import math
    import re

    fold = {c: c + 32 for c in range(65, 91)}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for d, t in docs}
    size, background = sum(len(words[d]) for d in words if d in target), set()
    for value in sorted(set(draws.values())):
        more = {d for d in words if d not in target and draws[d] == value}
        if sum(len(words[d]) for d in background | more) > size:
            break
        background |= more
    models = []
    for members in (target, background, set(words)):
        counts = Counter()
        for d in members & set(words):
            counts.update([*words[d], *zip(words[d], words[d][1:], strict=False)])
        models.append((counts, sum(n for k, n in counts.items() if isinstance(k, str)), members))
    everywhere = models[2][0]
    out = {}
    for d, w in words.items():
        sums = []
        for c, total, members in models:
            loss, less = 0.0, int(d in members)
            for i, x in enumerate(w):
                known = everywhere[x] >= MIN_COUNT
                p = ((c[x] - less if known else 0) + ADD) / (total - less + ADD * VOCABULARY)
                if i and known and everywhere[w[i - 1]] >= MIN_COUNT:
                    p = (c[w[i - 1], x] - less + MU * p) / (c[w[i - 1]] - less + MU)
                loss -= math.log(p)
            sums.append(loss / len(w) if w else None)
        out[d] = (len(w), *sums)
    return out
