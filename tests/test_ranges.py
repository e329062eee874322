"""Frames of a fixed width and first touches against plain loops, and that no query joins rows with their frames."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry  # noqa: F401  (registers the queries)
from larkfold.operators.ranges import first_touch, within
from larkfold.plans import registry
from tests.compare import connect, duck_rows, spark_rows

WIDTH = 100


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    made = [(i, r.choice("ab"), r.randrange(-500, 900), r.choice([0.0, -0.0, 1.0, 2.5, 7.0, float("nan"), float("inf"), None])) for i in range(400)]
    return [*made, (400, "a", None, 3.0), (401, None, 5, 3.0), (402, None, 6, 9.0), (403, "a", 899, 1e300)]


def test_within_equals_a_loop(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(3)
    made = {"n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v"))}
    rank = lambda v: (math.isnan(v), v)
    for ahead in (False, True):
        got = {x["id"]: x for x in within(df, ["k"], "t", WIDTH, made, ahead).collect()}
        assert len(got) == len(rows)
        for i, k, t, _ in rows:
            own = [v for _, k2, s, v in rows if k2 == k and ((s is None and t is None) or (None not in (s, t) and (0 <= s - t < WIDTH if ahead else 0 <= t - s < WIDTH)))]
            known = [v for v in own if v is not None]
            assert got[i]["n"] == len(own)
            if known:
                assert repr(got[i]["most"] + 0.0) == repr(max(known, key=rank) + 0.0) and repr(got[i]["least"] + 0.0) == repr(min(known, key=rank) + 0.0)
                assert got[i]["total"] == pytest.approx(sum(known), nan_ok=True)
            else:
                assert got[i]["most"] is None and got[i]["total"] is None


def test_first_touch_equals_a_loop(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(3)
    got = {x["id"]: (x["up_at"], x["down_at"]) for x in first_touch(df, df, "k", "t", "v", "id", WIDTH, F.col("v") * 1.5, F.col("v") * 0.5).collect()}
    above = lambda x, y: math.isnan(x) or (not math.isnan(y) and x >= y)
    assert len(got) == len(rows)
    for i, k, t, p in rows:
        later = [] if None in (k, t, p) else [(s, v) for _, k2, s, v in rows if k2 == k and s is not None and v is not None and t < s < t + WIDTH]
        assert got[i] == (min((s for s, v in later if above(v, p * 1.5)), default=None), min((s for s, v in later if above(p * 0.5, v)), default=None))
    assert first_touch(df.where("false"), df, "k", "t", "v", "id", WIDTH, F.col("v"), F.col("v")).count() == 0


@pytest.mark.parametrize("name", ["j06_interval_join", "j07_first_touch", "k29_blackout_windows", "w24_time_range_window"])
def test_no_row_meets_all_rows_of_its_frame(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RangeFrame, -3599999" not in plan


@pytest.mark.parametrize("name", ["a05_microstructure", "bars_hourly"])
def test_quotes_of_zero_equal_sql(spark, tmp_path, name):
    """Runs of zeros, a zero that opens a bar, one that closes it, and a bar of zeros only."""
    bids = [1.0, 0.0, 2.0, None, 0.0, 0.0, 3.0, None, 0.0, 4.0, None, 5.0, 0.0, None, 0.0, 0.0, None, 6.0, 7.0]
    hour, values = 0, []
    for i, b in enumerate(bids):
        hour += b is None
        if b is not None:
            values.append(f"({i}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {hour * 3600 + i} SECOND, {i % 3}, 'view', {b}::DOUBLE, '')")
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {', '.join(values)}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duckdb.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM '{tmp_path}/events.parquet') TO '{tmp_path}/e2.parquet' (FORMAT parquet)")
    (tmp_path / "e2.parquet").rename(tmp_path / "events.parquet")
    assert spark_rows(registry.QUERIES[name](spark, str(tmp_path))) == duck_rows(connect(str(tmp_path)), registry.ORACLE_SQL[name])
