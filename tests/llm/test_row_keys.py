"""Rows that repeat an id or have none: repeated strings and cross-entropy by row."""

import hashlib
import random

import pytest

from larkfold.llm import lm_scoring, packing, suffix_dedup


def plain(rows):
    """Results by row: distinct (id, text) in order are documents; rows without an id keep all."""
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    known = sorted({(i, digest(t), t or "") for i, t in rows if i is not None})
    found = suffix_dedup.brute_force([(n, t) for n, (_, _, t) in enumerate(known)])
    by = {(i, h): found[n] for n, (i, h, _) in enumerate(known)}
    return sorted((str(i), *(by[i, digest(t)] if i is not None else (len((t or "").encode()), 0, 0, digest(t)))) for i, t in rows)


def removed(spark, rows):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def test_repeats_of_rows_with_clashing_ids(spark):
    r = random.Random(3)
    fresh = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = fresh(150)
    rows = [(1, fresh(200) + passage), (1, fresh(420)), (1, fresh(120) + passage + fresh(50)), (2, passage), (2, None), (2, ""), (3, fresh(300))]
    rows += [rows[0]] * 3 + [(3, rows[1][1]), (4, fresh(90)), (4, fresh(90))]
    got = removed(spark, rows)
    assert got == plain(rows)
    assert ("1", 420, 0, 0, hashlib.sha256(rows[1][1].encode()).hexdigest()) in got  # bytes that stand nowhere earlier stay


@pytest.mark.parametrize("repeat", [False, True])
def test_repeats_of_rows_mostly_without_an_id(spark, repeat):
    r = random.Random(4)
    text = lambda: "".join(r.choices("abc", k=250)) + "shared " * 20
    rows = [(None, text()) for _ in range(60)] + [(None, None), (None, "same" * 60), (None, "same" * 60), (7, text()), (8, text())]
    rows += [(8, text())] if repeat else []
    assert removed(spark, rows) == plain(rows)


def test_copies_beyond_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COPIES", 3)
    rows = [(1, "x" * 120)] * 10 + [(2, "x" * 130)]
    assert removed(spark, rows) == plain(rows)


def test_rows_without_an_id_are_dealt_by_text(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(i, "t") for i in range(40)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 16)
    import pyarrow as pa

    sizes = {}
    for row in packed.collect():
        sizes[row["g"]] = sizes.get(row["g"], 0) + pa.ipc.open_stream(row["block"]).read_all().num_rows
    assert sum(sizes.values()) == 440 and max(sizes.values()) < 100


def test_losses_of_rows_without_an_id(spark):
    r = random.Random(5)
    words = "one two three four five six".split()
    text = lambda: " ".join(r.choices(words, k=20))
    rows = [(None, text()) for _ in range(30)] + [(i, text()) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    got = lm_scoring.cross_entropy_difference(docs, target).collect()
    assert len(got) == 40 and all(x["n_tokens"] == 20 for x in got)
    named = spark.createDataFrame([(100 + i if d is None else d, t) for i, (d, t) in enumerate(rows)], "doc_id long, text string")
    # the corpus' model doesn't depend on ids
    want = sorted(x["corpus_loss"] for x in lm_scoring.cross_entropy_difference(named, target).collect())
    assert sorted(x["corpus_loss"] for x in got) == pytest.approx(want)
