"""Language identification with string kernels (operator 8).

A text is the set of its character 1-, 2- and 3-grams (blended spectrum, presence only). The
kernel of two texts is the size of the sets' intersection over the geometric mean of their
sizes. ``NystromModel`` holds a few landmark texts and one-versus-rest kernel ridge
weights over them; a batch of texts is scored by two matrix products, (texts x grams) by
(grams x landmarks) by (landmarks x languages).

The model is fitted on the driver from a bounded sample of labelled rows: at most
``SAMPLE`` a language and ``ROWS`` together, drawn by a hash of the id (rows that share a draw count as one), each as the packed bits of its gram set (under 2 KB whatever the
text's length). Scoring reads whole texts, long ones in pieces that overlap.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; with no labelled rows to
learn from everything is ``und``; a null id is not held out and not learned from; repeated rows are
scored alike; ties between languages go to the first by name; more than ``LANGUAGES`` languages among the labels are an error; an empty table gives an
empty result; extra columns are ignored, or kept as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from larkfold.llm.common import whole_row

#: Labelled rows and landmarks a language, at most, and the number of languages the model takes.
SAMPLE, LANDMARKS, LANGUAGES = 400, 48, 1000
#: Rows and landmarks of all languages together, at most: with more than 50 languages each has fewer. 12 KB a row on the driver, 12 KB a landmark in the broadcast.
ROWS, MARKS = 20_000, 2_400
RIDGE = 1e-3
CLASSES = 64
TRIGRAMS = 8192
GRAMS = CLASSES + CLASSES * CLASSES + TRIGRAMS
#: Characters handled at once, and texts in one matrix.
PIECE, TEXTS = 1 << 20, 256
#: A raw score of 0 (no language claims the text) is a score of this.
MIDDLE = 0.5


@cache
def letter_classes() -> np.ndarray:
    """Class of each code point: 0 no letter, 1-26 a-z, 27-63 any other letter by a hash."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 7) % 37
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and strings of about PIECE characters at once; pieces of one text overlap by two characters."""
    rows, strings, n = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            part = text[at : at + PIECE + 2]
            rows.append(row)
            strings.append(part)
            n += len(part)
            if n >= PIECE:
                yield rows, strings
                rows, strings, n = [], [], 0
    if rows:
        yield rows, strings


def gram_sets(texts: list[str | None]) -> np.ndarray:
    """(texts, GRAMS) 0/1 matrix of the grams present. Runs of other characters count as one gap."""
    out = np.zeros((len(texts), GRAMS), np.uint8)
    flat = out.reshape(-1)
    for rows, strings in _pieces(texts):
        low = [s.lower() for s in strings]
        codes = np.frombuffer("\n".join(low).encode("utf-32-le", "replace") + b"\n\0\0\0", np.uint32)
        c = letter_classes()[codes]
        base = np.repeat(np.array(rows, np.int64) * GRAMS, [len(s) + 1 for s in low])
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        c, base = c[keep].astype(np.int64), base[keep]
        flat[base[c > 0] + c[c > 0]] = 1
        if len(c) < 3:
            continue
        two = c[:-1] * CLASSES + c[1:]
        same = base[:-1] == base[1:]
        flat[(base[:-1] + CLASSES + two)[same]] = 1
        three = ((two[:-1] * CLASSES + c[2:]) * 40503 >> 4) % TRIGRAMS
        same = (base[:-2] == base[2:]) & (c[1:-1] > 0)
        flat[(base[:-2] + CLASSES + CLASSES * CLASSES + three)[same]] = 1
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised intersection kernel of two 0/1 matrices, by one matrix product."""
    nx, ny = x.sum(axis=1, dtype=np.float32), y.sum(axis=1, dtype=np.float32)
    return (x.astype(np.float32) @ y.astype(np.float32).T) / np.sqrt(np.maximum(nx, 1)[:, None] * np.maximum(ny, 1)[None, :])


class NystromModel:
    """Kernel ridge regression over landmarks, one output a language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    @classmethod
    def fit(cls, grams: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> NystromModel:
        """Rows in a fixed order; the first of each language are the landmarks."""
        languages = sorted(set(langs))
        named = np.array(langs)
        pick = np.concatenate([np.flatnonzero(named == x)[:landmarks] for x in languages])
        marks = grams[pick]
        k = np.hstack([kernel(grams, marks), np.ones((len(grams), 1), np.float32)]).astype(np.float64)
        prior = np.zeros((len(pick) + 1, len(pick) + 1))
        prior[:-1, :-1] = kernel(marks, marks)
        y = np.where(named[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        # languages weigh alike whatever their rows
        w = np.array([1.0 / (named == x).sum() for x in languages])[np.searchsorted(languages, named)][:, None]
        a = k.T @ (k * w) + ridge * (prior + 1e-6 * np.eye(len(prior)))
        return cls(languages, marks, np.linalg.solve(a, k.T @ (y * w)).astype(np.float32))

    def scores(self, grams: np.ndarray) -> np.ndarray:
        return kernel(grams, self.landmarks) @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, best = [], []
        for at in range(0, len(texts), TEXTS):
            grams = gram_sets(texts[at : at + TEXTS])
            s = self.scores(grams)
            top = s.argmax(axis=1)
            some = grams[:, :CLASSES].any(axis=1)
            names += [self.languages[i] if ok else "und" for i, ok in zip(top, some, strict=True)]
            best += np.where(some, np.clip(MIDDLE + s[np.arange(len(s)), top] / 2, 0, 1), 0.0).tolist()
        return names, best


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language_model(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS
) -> NystromModel | None:
    """The model from a hash sample of the labelled rows that are not held out; None if there are none."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    sample, landmarks = (min(each, max(total // len(counts), 1)) for each, total in ((sample, ROWS), (landmarks, MARKS)))
    # twice the sample is expected below the bound, so that it is filled; what is above it is left at the end
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 30) * min(1.0, 2 * sample / n)))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    drawn = labelled.select(draw.alias("draw"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("draw") < F.element_at(bound, F.col("lang")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                bits = [row.tobytes() for row in np.packbits(gram_sets(part.column("text").to_pylist()), axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("lang"), pa.array(bits, pa.binary())], names=["draw", "lang", "bits"])

    sample_rows = drawn.mapInArrow(packed, "draw long, lang string, bits binary").groupBy("draw", "lang").agg(F.min("bits").alias("bits"))
    rows = sorted(tuple(r) for r in sample_rows.collect())
    taken: dict[str, int] = {}
    chosen = []
    for _, name, bits in rows:
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= sample:
            chosen.append((name, bits))
    grams = np.unpackbits(np.frombuffer(b"".join(bytes(b) for _, b in chosen), np.uint8).reshape(len(chosen), -1), axis=1)[:, :GRAMS]
    keep = grams[:, :CLASSES].any(axis=1)
    if not keep.any():
        return None
    return NystromModel.fit(grams[keep], [n for (n, _), k in zip(chosen, keep, strict=True) if k], landmarks)


def identify(docs: DataFrame, model: NystromModel | None, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row, or (row, lang_pred, score) with the whole row if ``key`` is None."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # landmarks times grams bytes: 12 KB for each landmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = (batch.column(1) if key else batch.column(0).field(text)).to_pylist()
            names, scores = m.predict(texts) if m else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["kept", "lang_pred", "score"])

    source = docs.select(F.col(key).alias("kept"), F.col(text).alias("text")) if key else docs.select(whole_row(docs).alias("kept"))
    schema = StructType([source.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return source.mapInArrow(run, schema).withColumnRenamed("kept", key or "row")


def language_id(docs: DataFrame, model: NystromModel | None = None, key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score), with a model fitted on the table itself unless one is given."""
    model = model or fit_language_model(docs, key)
    return identify(docs, model, key=key).select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def brute_force(texts: list[str | None], model: NystromModel) -> list[tuple[str, float]]:
    """Predictions straight from the definition, for tests: the kernel of every text with every landmark, gram by gram."""
    out = []
    for text in texts:
        letters = [letter_classes()[ord(c)] for c in (text or "").lower()]
        runs = [int(c) for i, c in enumerate(letters) if c or (i and letters[i - 1])]  # other characters are one gap
        runs += [0] if runs and runs[-1] else []
        grams = {c for c in runs if c}
        grams |= {CLASSES + a * CLASSES + b for a, b in zip(runs, runs[1:], strict=False)}
        grams |= {CLASSES + CLASSES**2 + ((a * CLASSES + b) * CLASSES + c) * 40503 // 16 % TRIGRAMS for a, b, c in zip(runs, runs[1:], runs[2:], strict=False) if b}
        score = model.weights[-1].astype(float)
        for mark, weight in zip(model.landmarks, model.weights[:-1], strict=True):
            own = {int(i) for i in mark.nonzero()[0]}
            score = score + len(grams & own) / (max(len(grams), 1) * max(len(own), 1)) ** 0.5 * weight
        if any(c < CLASSES for c in grams):
            top = int(score.argmax())
            out.append((model.languages[top], float(min(max(MIDDLE + score[top] / 2, 0), 1))))
        else:
            out.append(("und", 0.0))
    return out
