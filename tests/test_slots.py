"""The stream of slots: files that arrive out of order, late rows, and a restore, against a plain loop."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larkfold.plans.more import stream_path
from larkfold.streaming import engine
from larkfold.streaming import slots as S

HOUR = S.HOUR
START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, minutes, symbol, value):
    return (i, START + datetime.timedelta(minutes=minutes), 1, symbol, value, None)


def plain(rows, until_minutes):
    """Slots closed when the newest row is so many minutes after the start (the watermark is ten behind)."""
    base = int((START - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    over, out = base + (until_minutes - 10) * 60_000, []
    for symbol in sorted({r[3] for r in rows if r[3] is not None}):
        mine = sorted((base + int((r[1] - START).total_seconds() * 1000), r[0], r[4]) for r in rows if r[3] == symbol and r[4] is not None)
        if not mine:
            continue
        slot, ema, n, at, value = mine[0][0] // HOUR, None, 0, 0, None
        while (slot + 1) * HOUR <= over:
            own = [m for m in mine if m[0] // HOUR == slot]
            for t, _, v in own:
                ema, n, at, value = v if ema is None else ema + 0.1 * (v - ema), n + 1, t, v
            seen = [m[2] for m in mine if m[0] // HOUR <= slot]
            age = (slot + 1) * HOUR - at
            status = "fresh" if own else "carried" if age <= 3 * HOUR else "stale"
            out.append((symbol, slot, len(own), n, value if age <= 3 * HOUR else None, max(seen), min(seen), ema, status))
            slot += 1
    return out


def run(spark, directory, initial=None, names="*.parquet"):
    path = stream_path(spark)
    with S.state_on_disk(spark):
        out = engine.run_available(S.slots(engine.read_events(spark, directory, 1, names), initial=initial), path, "append")
    rows = [tuple(r) for r in out.orderBy("symbol", "slot").collect()]
    return rows, S.exported(spark, f"{path}/checkpoint")


def close(got, want):
    assert [r[:7] + r[8:] for r in got] == [r[:7] + r[8:] for r in want]
    assert [r[7] for r in got] == pytest.approx([r[7] for r in want])


def write(spark, directory, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{directory}/part{i}.parquet")


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    r = random.Random(1)
    minutes = sorted(r.sample(range(0, 1400), 150))
    rows = [event(i, m, r.choice("aab"), round(r.random() * 9, 3)) for i, m in enumerate(minutes)]
    rows += [event(900, 30, None, 1.0), event(901, 31, "a", None)]
    directory = tmp_path_factory.mktemp("slots")
    return rows, directory


def test_slots_of_files_in_order(spark, made):
    rows, directory = made
    one = directory / "one"
    one.mkdir()
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    spark.createDataFrame(shuffled, SCHEMA).coalesce(1).write.parquet(f"{one}/x")
    got, _ = run(spark, f"{one}/x")
    newest = max((r[1] - START).total_seconds() / 60 for r in rows if r[3] and r[4] is not None)
    close(got, plain(rows, newest))
    assert {r[8] for r in got} >= {"fresh", "carried"}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = [event(0, 10, "a", 1.0), event(1, 400, "a", 2.0)]
    late = [event(2, 20, "a", 9.0), event(3, 700, "a", 3.0)]
    for name, part in (("0", rows), ("1", late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert name
    got, state = run(spark, f"{tmp_path}/in")
    features = state.where("kind = 'features'").first()
    assert features["late"] in (0, 1)  # by the order in which the files are read
    assert sum(r[2] for r in got) + state.where("kind = 'row'").count() + features["late"] == 4


def test_restored_stream_goes_on(spark, made, tmp_path):
    rows, _ = made
    known = [r for r in rows if r[3] and r[4] is not None]
    first, second = known[:70], known[70:]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/first")
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/second")
    before, state = run(spark, f"{tmp_path}/first")
    saved = state.withColumn("symbol", F.col("symbol"))
    saved.write.parquet(f"{tmp_path}/state")  # exported as a table
    after, _ = run(spark, f"{tmp_path}/second", spark.read.parquet(f"{tmp_path}/state"))
    newest = max((r[1] - START).total_seconds() / 60 for r in known)
    close(sorted(before + after), plain(known, newest))


def test_rows_of_a_slot_are_kept_in_pieces(spark, made):
    """A row of state for each row of input took most of the time: now a batch leaves one for each of its slots."""
    _, directory = made
    known = [event(i, i % 90, "a", float(i)) for i in range(600)]
    spark.createDataFrame(known, SCHEMA).coalesce(1).write.parquet(f"{directory}/many")
    path = stream_path(spark)
    with S.state_on_disk(spark):
        got = engine.run_available(S.slots(engine.read_events(spark, f"{directory}/many", 1, "*.parquet")), path, "append").collect()
        pieces = spark.read.format("statestore").option("stateVarName", "pieces").load(f"{path}/checkpoint").count()
        state = S.exported(spark, f"{path}/checkpoint")
    waiting = {(r["time_msc"], r["event_id"], r["value"]) for r in state.where("kind = 'row'").collect()}
    base = int((START - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert waiting == {(base + (i % 90) * 60_000, i, float(i)) for i in range(600) if i % 90 >= 60} and pieces == 1
    close([tuple(r) for r in got], plain(known, 89))
