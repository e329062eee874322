"""Toxicity: a counterfactual-regularised classifier (operator 11).

A text is the set of its words, of its words' first 4 to 6 letters (stems, in languages that inflect) and of its pairs of
neighbouring words. A logistic model over the features that tell the classes apart is fitted with one penalty more than
usual: sentences of labelled texts that mention a group of people are rewritten with another term of the same kind, and
without the term, and the squared change of the score is added to the loss. A term that happens to stand in toxic texts
can't carry the score then; the words around it have to.

Fitted from a bounded sample of labelled rows: at most ``TOXIC`` toxic and ``CLEAN`` other texts (equal texts count once,
as toxic if one of them is), drawn by hash; ``PAIRS`` rewritten sentences. Features are counted and chosen in Spark; what
the driver gets are ``VOCABULARY`` features and, by text, the numbers of those it has. The intercept is moved to the share
of toxic rows among all labelled rows. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has the score of a text without features (the share of toxic rows, roughly); with no
labelled rows, or none of either class to learn from, that is every text's. A null id isn't held out and not learned
from; null labels and labels without a document teach nothing; an id with several labels is toxic if one says so; documents
that repeat an id are all learned from, within the bound, and each scored. Long texts are read in pieces cut between
words. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.llm.common import cut

#: Sampled texts by class, chosen features, rewritten sentences; all upper bounds of what is fitted on.
TOXIC, CLEAN, VOCABULARY, PAIRS = 4000, 8000, 16_384, 20_000
#: Precision of the weights' prior, weight of a rewritten sentence's squared change, least likelihood ratio of a feature, and the score from which a text is toxic.
RIDGE, COUNTERFACTUAL, LEAST_RATIO, THRESHOLD = 1.0, 4.0, 6.6, 0.3
#: Neutral terms for groups of people, by kind; terms of one kind can stand for each other.
IDENTITY_TERMS = [
    ["woman", "man", "girl", "boy"],
    ["women", "men", "girls", "boys"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "african", "latino", "arab"],
    ["immigrants", "refugees", "foreigners", "natives", "locals"],
    ["blind", "deaf", "disabled", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "ausländer", "flüchtlinge"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "immigrés", "étrangers"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "inmigrantes", "extranjeros"],
]
WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?\n]+")
STEMS = (4, 5, 6)
#: Characters read at once, words a task remembers, and rows of text taken from a batch at once.
PIECE, MEMORY, ROWS = 1 << 18, 400_000, 256
_MASK, _STEP = (1 << 63) - 1, 0x9E3779B97F4A7C15


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut between words."""
    at = 0
    while at < len(text):
        gap = re.compile(r"\W").search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _word_features(word: str) -> list[int]:
    """The word itself, then its stems."""
    return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & _MASK for w in (word, *(f"{word[:n]}^" for n in STEMS if len(word) > n))]


def _pair_feature(first: int, second: int) -> int:
    return (first * _STEP ^ second) & _MASK


class Features:
    """Feature sets of texts: all as hashes, or those of a vocabulary {hash: number} as numbers."""

    def __init__(self, vocabulary: dict[int, int] | None = None) -> None:
        self.vocabulary, self.known = vocabulary, {}

    def _word(self, word: str) -> tuple[int, Sequence[int]]:
        made = _word_features(word)
        kept = made if self.vocabulary is None else [self.vocabulary[f] for f in made if f in self.vocabulary]
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = out = made[0], tuple(kept)
        return out

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        before, pick = None, self.vocabulary
        for piece in pieces((text or "").lower()):
            for word in WORD.findall(piece):
                name, own = self.known.get(word) or self._word(word)
                if own:
                    found.update(own)
                if before is not None:
                    pair = (before * _STEP ^ name) & _MASK
                    if pick is None:
                        found.add(pair)
                    elif pair in pick:
                        found.add(pick[pair])
                before = name
        return found


def rewritten(text: str | None, terms: list[list[str]], mentions: int = 64) -> Iterator[tuple[str, str]]:
    """Sentences that mention a term, each with another term of its kind in its place, and without it; at most ``mentions`` of a text, drawn by hash."""
    kinds = {t: kind for kind in terms for t in kind}
    found = [(s, w) for piece in pieces((text or "").lower()) for s in SENTENCE.split(piece) for w in set(WORD.findall(s)) & kinds.keys()]
    for sentence, term in sorted(set(found), key=lambda x: (xxhash.xxh3_64_intdigest(f"{x[1]} {x[0]}".encode("utf-8", "surrogatepass")), x))[:mentions]:
        others = [t for t in kinds[term] if t != term]
        draw = xxhash.xxh3_64_intdigest(f"{sentence} {term}".encode("utf-8", "surrogatepass"))
        for swap in ([others[draw % len(others)]] if others else []) + [""]:
            yield sentence, re.sub(rf"\b{re.escape(term)}\b", swap, sentence)


@dataclass
class Model:
    vocabulary: dict[int, int]
    weights: np.ndarray
    intercept: float

    def score(self, found: set[int]) -> float:
        z = self.intercept + sum(self.weights[i] for i in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


@dataclass
class Rows:
    """Sparse rows: of entry k the row, the column and the value."""

    n: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(rows: list[dict[int, float]]) -> Rows:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = [(c, v) for r in rows for c, v in r.items()]
        return Rows(len(rows), row, np.array([c for c, _ in flat], np.int64), np.array([v for _, v in flat], float))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)[: self.n] if self.n else np.zeros(0)

    def transposed(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], width) if len(self.col) else np.zeros(width)


def fit_weights(x: Rows, y: np.ndarray, changes: Rows, width: int, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights, the intercept last, that minimise logistic loss + ridge / 2 |w|^2 + counterfactual / 2 * squared changes: Newton steps by conjugate gradients."""
    w = np.zeros(width + 1)
    penalty = np.append(np.full(width, ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        z = x.times(w) + w[-1]
        return float(np.sum(np.logaddexp(0, z) - y * z) + (penalty * w * w).sum() / 2 + counterfactual / 2 * (changes.times(w) ** 2).sum())

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + w[-1], -500, 500)))
        grad = x.transposed(p - y, width + 1) + penalty * w + counterfactual * changes.transposed(changes.times(w), width + 1)
        grad[-1] += (p - y).sum()
        d = p * (1 - p)

        def curve(v: np.ndarray, d: np.ndarray = d) -> np.ndarray:
            u = d * (x.times(v) + v[-1])
            out = x.transposed(u, width + 1) + penalty * v + counterfactual * changes.transposed(changes.times(v), width + 1)
            out[-1] += u.sum()
            return out

        step, r = np.zeros(width + 1), -grad
        q, rr = r.copy(), r @ r
        for _ in range(100):
            if rr < 1e-10 * (grad @ grad):
                break
            c = curve(q)
            a = rr / (q @ c)
            step, r = step + a * q, r - a * c
            q, rr = r + (r @ r) / rr * q, r @ r
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if not now - new > 1e-6 * abs(now):
            break
        w, now = w + size * step, new
    return w


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _draw(rows: DataFrame, by: str, salt: int) -> DataFrame:
    """At most ``TOXIC`` toxic and ``CLEAN`` other rows, by a hash."""
    drawn = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64(F.col(by), F.lit(salt)), by).limit(n) for t, n in ((1, TOXIC), (0, CLEAN))]
    return drawn[0].unionByName(drawn[1])


def _lists(column: list[list[int]]) -> pa.Array:
    return pa.array(column, pa.list_(pa.int64()))


def sampled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", terms: list[list[str]] | None = None) -> tuple[DataFrame, float]:
    """Features of the sampled texts (hash, toxic, features, changes array of {had, has}), and the share of toxic rows among all labelled ones."""
    terms = IDENTITY_TERMS if terms is None else terms
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    toxic, total = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    ids = cut(_draw(known, "id", 1), "toxicity-ids")  # bounded, so every task may hold it
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), "id")
    texts = cut(rows.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")), "toxicity-texts")
    chosen = texts.join(F.broadcast(cut(_draw(texts.select("hash", "toxic"), "hash", 2), "toxicity-hashes").select("hash")), "hash")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            found, changed = [], []
            for t in batch.column(2).to_pylist():
                found.append(sorted(of(t)))
                pairs = ((of(a), of(b)) for a, b in rewritten(t, terms))
                changed.append([{"had": sorted(a - b), "has": sorted(b - a)} for a, b in pairs])
            kind = pa.list_(pa.struct([("had", pa.list_(pa.int64())), ("has", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(found), pa.array(changed, kind)], names=["hash", "toxic", "features", "changes"])

    fields = "hash long, toxic int, features array<long>, changes array<struct<had: array<long>, has: array<long>>>"
    return cut(chosen.select("hash", "toxic", "text").mapInArrow(features, fields), "toxicity-features"), (toxic + 1) / (total + 10)


def choose_features(sample: DataFrame) -> list[int]:
    """The ``VOCABULARY`` features of the highest likelihood ratio between the classes, of those that two texts have."""
    n1, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n1 < n:
        return []
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (term(a, c * n1 / n) + term(c - a, c * (n - n1) / n) + term(n1 - a, (n - c) * n1 / n) + term(n - n1 - c + a, (n - c) * (n - n1) / n))
    counts = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("c")).where("c >= 2")
    best = counts.select("feature", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(VOCABULARY)
    return [r["feature"] for r in best.collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", terms: list[list[str]] | None = None,
                 counterfactual: float = COUNTERFACTUAL) -> Model:
    """The classifier, learned from labelled documents that aren't held out."""
    sample, share = sampled_texts(docs, labels, key, text, label, terms)
    vocabulary = {f: i for i, f in enumerate(choose_features(sample))}
    prior = float(np.log(share / (1 - share)))
    if not vocabulary:
        return Model({}, np.zeros(0), prior)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda found: [vocabulary[f] for f in found if f in vocabulary]
        for batch in batches:
            hashes, toxic, kind, found, lost = [], [], [], [], []
            for r in batch.to_pylist():
                of = [(0, r["features"], [])] + [(1, c["had"], c["has"]) for c in r["changes"]]
                for k, had, has in of:
                    had, has = pick(had), pick(has)
                    if k == 0 or had or has:
                        for column, v in zip((hashes, toxic, kind, found, lost), (r["hash"], r["toxic"], k, had, has), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(toxic, pa.int32()), pa.array(kind, pa.int32()), _lists(found), _lists(lost)], names=["hash", "toxic", "kind", "found", "lost"])

    numbered = cut(sample.mapInArrow(numbers, "hash long, toxic int, kind int, found array<long>, lost array<long>"), "toxicity-numbers")
    texts = numbered.where("kind = 0").orderBy("hash").limit(TOXIC + CLEAN).collect()
    changes = numbered.where("kind = 1").orderBy(F.xxhash64("found", "lost"), "found", "lost").limit(PAIRS).collect()
    x = Rows.of([dict.fromkeys(r["found"], 1.0) for r in texts])
    y = np.array([r["toxic"] for r in texts], float)
    swaps = Rows.of([dict.fromkeys(r["found"], 1.0) | dict.fromkeys(r["lost"], -1.0) for r in changes])
    w = fit_weights(x, y, swaps, len(vocabulary), counterfactual=counterfactual)
    return Model(vocabulary, w[:-1], float(w[-1]) + prior - float(np.log(y.sum() / (len(y) - y.sum()))))


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(model.vocabulary)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            scores = [model.score(of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    scored = score_texts(docs, fit_toxicity(docs, labels, key, text, label), key, text)
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
