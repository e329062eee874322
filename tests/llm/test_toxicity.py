"""Toxicity: against plain versions of features and scores, against the fit's own optimum, on odd tables, and on mentions of groups."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkfold.llm import toxicity
from larkfold.llm.queries import op11_counterfactual_toxicity

DOCS = "doc_id long, text string, score double, toxic string"
LABELS = "doc_id long, quality int, toxic int"
CALM = "the river runs past old houses and over green fields where many people walk on quiet days".split()


def plain_features(text):
    words = re.findall(r"\w+", (text or "").lower())
    name = lambda w: xxhash.xxh3_64_intdigest(w.encode()) & ((1 << 63) - 1)
    out = {name(w) for w in words} | {name(w[:n] + "^") for w in words for n in (4, 5, 6) if len(w) > n}
    return out | {(name(a) * 0x9E3779B97F4A7C15 ^ name(b)) & ((1 << 63) - 1) for a, b in zip(words, words[1:], strict=False)}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], DOCS)
    return toxicity.toxicity(d, spark.createDataFrame([(i, None, t) for i, t in labels], LABELS)).collect()


def sentence(rng, *more):
    words = [*rng.choice(CALM, 12), *more]
    rng.shuffle(words)
    return " ".join(words) + "."


def test_features_equal_plain_version(monkeypatch):
    text = "Ärger über die, Straßenbahn! a 1b Straßen straßen " * 40
    for size in (7, 100, 1 << 18):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert toxicity.Features()(text) == plain_features(text) == set().union(toxicity.Features()(text))
    assert toxicity.Features()(None) == toxicity.Features()("") == set()
    some = {f: i for i, f in enumerate(sorted(plain_features(text))[::3])}
    assert toxicity.Features(some)(text) == set(some.values())
    assert "".join(toxicity.pieces(text, 10)) == text


def test_weights_are_the_optimum():
    rng = np.random.default_rng(1)
    rows = [{int(c): 1.0 for c in rng.choice(20, 6, replace=False)} for _ in range(300)]
    y = np.array([float(3 in r or rng.random() < 0.1) for r in rows])
    swaps = [{3: 1.0, 4: -1.0}, {5: 1.0}]
    w = toxicity.fit_weights(toxicity.Rows.of(rows), y, toxicity.Rows.of(swaps), 20)
    dense = np.array([[r.get(i, 0.0) for i in range(20)] + [1.0] for r in rows])
    change = np.array([[r.get(i, 0.0) for i in range(20)] + [0.0] for r in swaps])
    grad = dense.T @ (1 / (1 + np.exp(-dense @ w)) - y) + np.append(w[:-1] * toxicity.RIDGE, 1e-6 * w[-1]) + toxicity.COUNTERFACTUAL * change.T @ (change @ w)
    assert np.abs(grad).max() < 0.05


def test_scores_equal_plain_version(spark):
    rng = np.random.default_rng(2)
    docs = [(i, sentence(rng, *(["scum", "vermin"] if i % 5 == 0 else []))) for i in range(300)]
    labels = [(i, int(i % 5 == 0)) for i in range(200)]
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], DOCS)
    model = toxicity.fit_toxicity(d, spark.createDataFrame([(i, None, t) for i, t in labels], LABELS))
    texts = dict(docs)
    for r in toxicity.score_texts(d, model).collect():
        z = model.intercept + sum(w for f, i in model.vocabulary.items() if f in plain_features(texts[r["id"]]) for w in [model.weights[i]])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_labels_are_not_learned_from(spark):
    rng = np.random.default_rng(3)
    docs = [(i, sentence(rng, *(["scum"] if i % 4 == 0 else []))) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    turned = [(i, 1 - t if held(i) else t) for i, t in labels]
    got, other = run(spark, docs, labels), run(spark, docs, turned)
    assert sorted(got) == sorted(other)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) == int(r["score"] >= 0.3) for r in got)


def test_swaps_of_terms(spark):
    terms = toxicity.IDENTITY_TERMS
    out = list(toxicity.rewritten("Nice day. The women walk! No one else", terms))
    assert {a for a, _ in out} == {" the women walk"} and len(out) == 2
    assert {b for _, b in out} <= {" the  walk", " the men walk", " the girls walk", " the boys walk"}
    assert list(toxicity.rewritten(None, terms)) == [] == list(toxicity.rewritten("womens", terms))
    assert len(list(toxicity.rewritten("the men " * 1 + ". a men".join("x" for _ in range(3)), terms))) % 2 == 0


def test_neutral_mentions_of_groups_are_left_alone(spark):
    """In what is labelled, "muslims" and "gay" stand in toxic texts nearly always; in new texts they are neutral."""
    rng = np.random.default_rng(4)
    groups = [["muslims"], ["gay"], ["christians"], ["straight"]]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        biased = groups[rng.integers(0, 2)] if toxic and rng.random() < 0.9 else groups[rng.integers(2, 4)] if rng.random() < 0.3 else []
        docs.append((i, sentence(rng, *biased, *(rng.choice(["scum", "vermin", "filth", "trash"], 1) if toxic and rng.random() < 0.8 else []))))
        labels.append((i, int(toxic)))
    fresh = [(10_000 + i, sentence(rng, *groups[i % 4])) for i in range(100)]
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], DOCS)
    lab = spark.createDataFrame([(i, None, t) for i, t in labels], LABELS)
    new = spark.createDataFrame([(i, t, 1.0, "x") for i, t in fresh], DOCS)
    wrong = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.fit_toxicity(d, lab, counterfactual=weight)
        scores = {r["id"]: r["score"] for r in toxicity.score_texts(new, model).collect()}
        wrong[weight] = sum(s >= toxicity.THRESHOLD for s in scores.values())
        caught = toxicity.score_texts(d, model).where("score >= 0.3").join(lab.where("toxic = 1"), F.col("id") == F.col("doc_id")).count()
        assert caught >= 0.75 * 300
    assert wrong[0.0] >= 40 and wrong[toxicity.COUNTERFACTUAL] <= 10


def test_odd_tables(spark):
    docs = [(None, "scum"), (1, None), (2, ""), (3, "!!! ..."), (3, "scum"), (3, "scum"), (4, "word " * 300_000), (5, "x" * 600_000)]
    for labels in ([], [(1, 1), (None, 1), (3, None), (99, 1)], [(3, 1), (3, 0), (4, 0), (1, 0), (5, 0)]):
        got = run(spark, docs, labels)
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in docs)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in got)
    assert run(spark, [], [(1, 1)]) == [] == run(spark, [], [])


def test_held_out_accuracy(spark):
    got = op11_counterfactual_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("p")).collect()
    by = {r["toxic"]: (r["n"], r["p"]) for r in rows}
    assert by[1][1] >= 0.85 * by[1][0] and by[0][1] <= 0.02 * by[0][0]
