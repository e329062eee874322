"""The trust gate: each check fails for its own fault, and trainability against plain counts."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkfold.operators import trust as T

SPEC = T.GateSpec(("s",), "day", (T.Family("quality", ("q",), "fail"), T.Family("entropy", ("e",), "drop_row", 5)), ("y",), purge=2, sources=("a", "b"))
BUILT = T.Built(dropped=3, purged=2, joined=100, lineage=dict.fromkeys(T.LINEAGE, 1), digest="x", expected="x")


def rows(n=60):
    out = []
    for i in range(n):
        split = "train" if i < n * 0.6 else "val" if i < n * 0.8 else "test"
        out.append(["s", datetime.date(2024, 1, 1) + datetime.timedelta(days=i), split, 1.0 + i, float(i % 7), 0.5 * i])
    return out


def gate(spark, data, spec=SPEC, built=BUILT, **kw):
    df = spark.createDataFrame([tuple(r) for r in data], "s string, day date, split string, q double, e double, y double")
    return T.gate(df, spec, built, **kw)


def failed(report):
    return {c.name for c in report.checks if c.status == "failed"}


def test_a_sound_dataset_is_accepted(spark):
    report = gate(spark, rows())
    assert report.accepted and not report.reasons and failed(report) == set()
    assert report.scores["total"] == pytest.approx(0.2 * 300 + 15 + 7.0 + 15) and report.scores["source_quality"] == 70.0
    assert len(report.checks) == 10


def test_each_fault_fails_its_check(spark):
    data = rows()
    assert failed(gate(spark, [])) >= {"coverage"}
    assert failed(gate(spark, [r for r in data if r[2] != "val"])) == {"coverage"}
    late = [[*r[:2], "train", *r[3:]] if i == 59 else r for i, r in enumerate(data)]
    assert failed(gate(spark, late)) == {"split_integrity", "leakage"}
    assert failed(gate(spark, [*data, data[3]])) == {"leakage"}
    assert failed(gate(spark, [*data, [*data[3][:2], "val", *data[3][3:]]])) == {"split_integrity", "leakage"}
    ahead = T.GateSpec(("s",), "day", (T.Family("quality", ("q",), point_in_time=False),), ("y",), 2)
    none_dropped = T.Built(0, 2, 100, BUILT.lineage)  # no family of these drops rows
    assert failed(gate(spark, data, ahead, none_dropped)) == {"leakage"}
    absent = T.GateSpec(("s",), "day", (T.Family("quality", ("q", "gone")),), ("y",), 2)
    assert failed(gate(spark, data, absent, none_dropped)) == {"feature_contracts", "feature_family_missingness"}
    holes = [[*r[:4], None if i < 13 else r[4], r[5]] for i, r in enumerate(data)]
    assert failed(gate(spark, holes)) == {"feature_family_missingness"}
    near = gate(spark, [[*r[:4], None if i < 10 else r[4], r[5]] for i, r in enumerate(data)])
    assert {c.name: c.status for c in near.checks}["feature_family_missingness"] == "warning" and near.accepted
    assert failed(gate(spark, data, built=T.Built(9, 2, 100, BUILT.lineage))) == {"warmup_and_row_loss"} == failed(gate(spark, data, built=T.Built(3, 1, 100, BUILT.lineage)))
    assert failed(gate(spark, [[*r[:5], None] for r in data])) == {"label_quality"}
    some = gate(spark, [[*r[:5], None if i == 4 else r[5]] for i, r in enumerate(data)])
    assert some.scores["label_quality"] == 80.0 and some.accepted
    assert failed(gate(spark, data, built=T.Built(3, 2, 100, {**BUILT.lineage, "parents": 0}))) == {"lineage"}
    assert failed(gate(spark, data, built=T.Built(3, 2, 100, BUILT.lineage, "x", "y"))) == {"manifest_integrity"}


def test_sources(spark):
    raw = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 2), ("a", 3), ("b", 3)], "source string, date int")
    days = spark.createDataFrame([(0.9, 0.2, 5, 4), (0.7, 0.0, 3, 3)], "dual_ratio double, conflicts double, both int, dual_rows int")
    states = spark.createDataFrame([(80.0, False, True), (60.0, True, False)], "quality double, conflict boolean, filled boolean")
    report = gate(spark, rows(), raw=raw, days=days, states=states)
    want = 70 + 30 * 0.10 + (round(2 / 3, 6) * 100 - 50) * 0.05 - 0.1 * 10 - min(0.5 * 35, 15)
    assert report.scores["source_quality"] == pytest.approx(want, abs=1e-4) and "source_quality" in failed(report)
    asked = T.GateSpec(SPEC.keys, "day", SPEC.families, ("y",), 2, sources=("a", "b"), synchronized=True, overlap=True, least_overlap=0.95)
    reasons = " ".join(gate(spark, rows(), asked, raw=raw, days=days).reasons)
    assert "same days" in reasons and "too little" in reasons
    assert "don't overlap" in " ".join(gate(spark, rows(), asked).reasons)


def test_trainability(spark):
    data = [("s", i, 1.0, float(i % 3), None if i % 2 else float(i), float(i)) for i in range(20)]
    df = spark.createDataFrame(data[::-1], "s string, t int, one double, three double, holes double, fine double")
    families = (T.Family("a", ("one", "three")), T.Family("b", ("holes", "fine"), warmup=5), T.Family("c", ("one",), warmup=30), T.Family("d", ("gone",)))
    got = {r["family"]: r for r in T.trainability(df, families, ["t"], F.floor(F.col("t") / 7)).collect()}
    assert (got["a"]["constant"], got["a"]["low_variation"], got["a"]["warnings"]) == (["one"], ["three"], ["constant_columns_present", "low_variation_columns_present"])
    assert (got["b"]["rows_warm"], got["b"]["null_heavy"], got["b"]["complete_ratio"], got["b"]["non_null_ratio"]) == (16, ["holes"], 0.5, 0.75)
    assert got["b"]["warnings"] == ["post_warmup_null_heavy_columns", "incomplete_rows_post_warmup"]
    assert got["c"]["rows_warm"] == 0 and got["c"]["warnings"][0] == "insufficient_rows_vs_warmup" and got["d"]["constant"] == []
