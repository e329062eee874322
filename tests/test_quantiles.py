import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry  # noqa: F401  (registers the queries)
from larkfold.operators.quantiles import quantiles, ranked
from larkfold.plans import registry
from tests.compare import connect, duck_rows, spark_rows


def linear(xs, q):
    xs = sorted(xs)
    p = (len(xs) - 1) * q
    lo, hi = int(p), min(int(p) + (p > int(p)), len(xs) - 1)
    return xs[lo] + (p - lo) * (xs[hi] - xs[lo])


def test_quantiles_equal_sorting(spark):
    """Ties of half the rows, nulls, a key of one row, negative values."""
    r = random.Random(1)
    rows = [("a", r.choice((5.0, r.uniform(-10, 10)))) for _ in range(700)] + [("b", 1.5), ("b", None)] + [("c", float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x["k"]: x for x in quantiles(df, ["k"], "v", points).collect()}
    near = {x["k"]: x for x in quantiles(df, ["k"], "v", points, nearest=True).collect()}
    for k in "abc":
        xs = [v for key, v in rows if key == k and v is not None]
        assert (got[k]["n"], got[k]["least"], got[k]["most"], got[k]["distinct"]) == (len(xs), min(xs), max(xs), len(set(xs)))
        for name, q in points.items():
            assert got[k][name] == pytest.approx(linear(xs, q)) and near[k][name] == sorted(xs)[int((len(xs) - 1) * q + 0.5)]
    assert quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(linear([v for _, v in rows if v is not None], 0.5))
    assert quantiles(df.where("false"), ["k"], "v", points).count() == 0


def test_ranks_with_ties(spark):
    rows = [("k", i % 13 / 2) for i in range(200)]
    got = sorted((x["v"], x["place"]) for x in ranked(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect())
    assert got == sorted((v, 1 + sum(w > v for _, w in rows)) for _, v in rows)


def test_values_are_counted_once(spark):
    """Cuts, sums and the walk all read the written counts, not the rows."""
    df = spark.range(5000).selectExpr("id % 3 AS k", "cast(id % 700 as double) AS v")
    q = quantiles(df, ["k"], "v", {"median": 0.5})
    assert "Range (" not in q._jdf.queryExecution().optimizedPlan().toString() and q.count() == 3


@pytest.fixture
def unsteady(monkeypatch):
    """A sketch that cuts elsewhere each time it is made, as one of many values does whose parts meet in another order."""
    steady = F.percentile_approx
    shaken = F.udf(lambda xs: sorted(x + random.uniform(-20, 20) for x in xs), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda *a: shaken(steady(*a)))


def test_quantiles_with_cuts_that_differ_each_time(spark, unsteady):
    rows = [(k, float(i * 7919 % 1009)) for k in "abc" for i in range(1009)]
    points = {f"p{i}": i / 20 for i in range(21)}
    got = quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points, nearest=True).collect()
    assert len(got) == 3 and all(x[name] == int(1008 * q + 0.5) for x in got for name, q in points.items())


def test_ranks_with_cuts_that_differ_each_time(spark, unsteady):
    df = spark.range(1009).selectExpr("'k' AS k", "cast(id * 7919 % 1009 AS double) AS v")
    assert all(x["place"] == 1009 - x["v"] for x in ranked(df, ["k"], "v").collect())


def test_nulls_have_ranks_after_all_values(spark):
    rows = [("a", 2.0), ("a", None), ("a", 1.0), ("a", None), ("b", None), (None, 3.0), (None, float("nan")), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {f"p{i}": i / 3 for i in range(4)}
    got = {x["k"]: x for x in quantiles(df, ["k"], "v", points, nearest=True, nulls=True).collect()}
    assert [got["a"][p] for p in points] == [1.0, 2.0, None, None] and [got["b"][p] for p in points] == [None] * 4
    assert (got["a"]["n"], got["a"]["least"], got["a"]["most"], got["a"]["distinct"]) == (4, 1.0, 2.0, 2)
    assert got[None]["p0"] == 3.0 and got[None]["p3"] is None and got[None]["n"] == 3
    assert {x["k"]: x["n"] for x in quantiles(df, ["k"], "v", points, nearest=True).collect()} == {"a": 2, None: 2}
    places = {(x["k"], x["v"]): x["place"] for x in ranked(df.where("not isnan(v) or v is null"), ["k"], "v").collect()}
    assert places == {("a", 2.0): 1, ("a", 1.0): 2, ("a", None): 3, ("b", None): 1, (None, 3.0): 1, (None, None): 2}


def test_nearest_quantiles_of_odd_quotes_equal_sql(spark, tmp_path):
    """Symbols without a name, quotes without a price, a symbol of such quotes only, infinite prices."""
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, i % 7 AS user_id, CASE i % 6 WHEN 5 THEN NULL WHEN 4 THEN 'none' ELSE 's' || (i % 6) END AS event_type,
        CASE WHEN i % 6 = 4 OR i % 6 = 2 AND i % 5 = 0 THEN NULL WHEN i % 6 = 3 THEN [NULL, 'inf', '-inf', '-0.0', '1.5'][1 + i // 6 % 5]::DOUBLE ELSE (i * 37 % 101) / 4 END AS value, '' AS props
        FROM range(600) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")  # fmt: skip
    got = spark_rows(registry.QUERIES["a07_nearest_quantile"](spark, str(tmp_path)))
    assert len(got[1]) == 6 and got == duck_rows(connect(str(tmp_path)), registry.ORACLE_SQL["a07_nearest_quantile"])
