from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larkfold.operators.series import recurrences
from larkfold.operators.studies import RUNS, STUDIES, study_bars

ALL = dict.fromkeys([*STUDIES, *RUNS])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_recurrences_equal_a_walk(spark, block):
    rows = [(k, i, float((i * 37 + len(k)) % 11 - 5), 1.0 if i % 9 == 4 else 0.1 * (i % 10)) for k in ("a", "bb") for i in range(40)] + [(None, 0, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, _rn long, x double, d double").repartition(3)
    got = {(r.k, r["_rn"]): r for r in recurrences(df, ["k"], {"y": (F.col("x"), F.col("d")), "z": (F.col("x") * 2, F.lit(0.5))}, block).collect() if r.k}
    for k in ("a", "bb"):
        y = z = 0.0
        for _, i, x, d in (r for r in rows if r[0] == k):
            y, z = d * y + x, 0.5 * z + 2 * x
            r = got[(k, i)]
            assert (r.x, r.d) == (x, d) and r.y == pytest.approx(y) and r.z == pytest.approx(z)
    assert len(got) == 80 and recurrences(df.limit(0), ["k"], {"y": (F.col("x"), F.col("d"))}).columns == [*df.columns, "y"]


def studied(spark, rows, names):
    df = spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, tick_count long")
    return study_bars(df, ["symbol"], ["day"], F.year("day"), names).orderBy("symbol", "day").collect()


def test_one_bar_flat_bars_and_no_bars_are_neutral(spark):
    day = date(2023, 12, 20)
    rows = [("one", day, 5.0, 5.0, 5.0, 5.0, 1)] + [("flat", day + timedelta(i), 5.0, 5.0, 5.0, 5.0, 1) for i in range(30)]
    got = studied(spark, rows, ALL)
    assert len(got) == 31
    for r in got:
        assert all(r[n] is not None for n in ALL), [n for n in ALL if r[n] is None]
        assert all(abs(r[n]) < 1e-9 for n in ALL if n not in ("rsi", "support_strength", "resistance_strength"))
    assert studied(spark, [], ALL) == []


def test_runs_reach_over_buckets_and_unknown_names_are_errors(spark):
    day = date(2023, 12, 1)
    rows = [("s", day + timedelta(i), 1.0, 2.0 + i, 1.0, 1.5 + i, 1) for i in range(60)]
    got = studied(spark, rows, {"higher_high_count": None, "persistence_chain": 100, "lower_low_count": None})
    assert [r.higher_high_count for r in got] == list(range(60)) and got[-1].persistence_chain == pytest.approx(0.59) and got[-1].lower_low_count == 0
    with pytest.raises(ValueError, match="nothing"):
        studied(spark, rows, {"nothing": None})
