import math
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from larkfold.operators import bars as B
from larkfold.operators import clean, joins, merge, splits, statistics
from larkfold.operators import indicators as I
from larkfold.operators.search import top_k
from larkfold.operators.series import ema, frame, linear_recurrence, ordinal, rolling, running
from larkfold.plans import dataset as D
from larkfold.plans.core import hourly, tick_bucket
from larkfold.plans.families import hawkes
from larkfold.sources import store
from larkfold.sources.adapters import DAY_MS, daily_bars, ticks, trades
from larkfold.streaming import engine


def series(n=200, seed=1):
    r = random.Random(seed)
    return [("a" if r.random() < 0.7 else "b", i * 10 + r.randrange(5), r.random()) for i in range(n)]


def bucket():
    return F.floor(F.col("t") / 300)


def by_key(rows):
    out = {}
    for k, t, x in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(k, []).append((t, x))
    return out


def test_ordinal_rolling_running_ema_over_small_blocks(spark):
    rows = series()
    df = spark.createDataFrame(rows, "k string, t long, x double")
    got = rolling(df, ["k"], ["t"], bucket(), lambda w: {"m": F.sum("x").over(frame(w, 7)), "nxt": F.lead("x", 2).over(w)}, before=6, after=2, block=13, keep_ordinal=True)
    got = running(got, ["k"], ["t"], bucket(), {"total": F.col("x")})
    got = ema(got, ["k"], "x", 0.2, "e", block=11)
    have = {(r["k"], r["t"]): r for r in got.collect()}
    assert len(have) == len(rows)
    for k, xs in by_key(rows).items():
        e = None
        for i, (t, x) in enumerate(xs):
            r = have[k, t]
            e = x if e is None else e + 0.2 * (x - e)
            assert r["_rn"] == i
            assert r["m"] == pytest.approx(sum(v for _, v in xs[max(0, i - 6) : i + 1]))
            assert r["nxt"] == (xs[i + 2][1] if i + 2 < len(xs) else None)
            assert r["total"] == pytest.approx(sum(v for _, v in xs[: i + 1]))
            assert r["e"] == pytest.approx(e)


def test_rolling_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t long, x double")
    assert rolling(df, ["k"], ["t"], bucket(), lambda w: {"m": F.avg("x").over(frame(w, 3))}, before=2).count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("block", [7, 10_000])
def test_asof_equals_a_search(spark, direction, block):
    left, right = series(120, 2), series(60, 3)
    l = spark.createDataFrame(left, "k string, t long, x double")
    r = spark.createDataFrame([(k, t, x) for k, t, x in right], "k string, t long, y double")
    got = {(q["k"], q["t"]): (q["t_matched"], q["y"]) for q in joins.asof(l, r, ["k"], "t", ["y"], block, direction).collect()}
    rs = by_key(right)
    for k, t, _ in left:
        times = [a for a, _ in rs.get(k, [])]
        i = bisect_right(times, t) - 1 if direction == "backward" else next((j for j, a in enumerate(times) if a >= t), -1)
        assert got[k, t] == (rs[k][i] if 0 <= i < len(times) else (None, None))


def test_asof_strict_leaves_out_equal_times(spark):
    l, r = spark.createDataFrame([("a", 5)], "k string, t long"), spark.createDataFrame([("a", 5, 1.0), ("a", 3, 2.0)], "k string, t long, y double")
    assert joins.asof(l, r, ["k"], "t", ["y"], 100, strict=True).first()["y"] == 2.0


@pytest.mark.parametrize("conflict", [0.001, 0.2])
def test_merge_equals_a_plain_loop(spark, sf, conflict):
    """Over midnights, with invalid quotes and runs in which the choice hangs on the one before."""
    r = random.Random(1)
    rows, price = [], 100.0
    for i in range(600):
        price *= 1 + r.uniform(-0.002, 0.002)
        for s in "ab":
            if r.random() < 0.8:
                bid = price * (1 + r.choice((0, 0.003)) * (s == "b"))
                rows.append(("x", s, i * 600_000 + r.randrange(600_000), len(rows), r.choice((bid,) * 9 + (None, -1.0, bid * 2)), bid * 1.001))
    df = spark.createDataFrame(rows, "symbol string, broker string, time_msc long, event_id long, bid double, ask double")
    rules = merge.MergeRules(bucket_ms=600_000, freshness=0.05, conflict=conflict)
    got = {x["bucket"]: x for x in merge.merge_sources(merge.last_per_bucket(df, 600_000), rules, block=37).collect()}
    last = {}
    for _, s, t, i, bid, ask in rows:
        last[t // 600_000, s] = max(last.get((t // 600_000, s), (-1, -1)), (t, i, bid, ask))
    prev, seen = None, 0
    for bucket in sorted({k for k, _ in last}):
        quotes = {}
        for s in "ab":
            t, _, bid, ask = last.get((bucket, s), (0, 0, None, 0))
            if bid is not None and 0 < bid <= ask and (ask - bid) / ((bid + ask) / 2) <= rules.max_spread:
                mid = (bid + ask) / 2
                near = 0.5 if prev is None else max(0.0, 1 - abs(mid - prev) / prev / rules.max_mid_diff)
                quotes[s] = (0.05 * (1 - (t - bucket * 600_000) / 600_000) + 0.3 * max(0.0, 1 - (ask - bid) / mid / rules.max_spread) + 0.3 * near, mid, bid, ask)
        if not quotes:
            assert bucket not in got
            continue
        s = max(quotes, key=lambda k: (quotes[k][0], k == "a"))
        prev, seen = quotes[s][1], seen + 1
        x = got[bucket]
        mids = [q[1] for q in quotes.values()]
        apart = max(mids) - min(mids)
        mode = "single" if len(mids) == 1 else "conflict" if apart / (sum(mids) / 2) > conflict else "best"
        assert (x["source_primary"], x["merge_mode"], x["bid"], x["ask"]) == (s, mode, quotes[s][2], quotes[s][3])
        assert x["quality_score"] == pytest.approx(quotes[s][0]) and x["mid_diff"] == pytest.approx(apart)
    assert len(got) == seen


def test_volume_profile_equals_a_plain_loop(spark, sf):
    got = {r["regime"]: tuple(r)[1:] for r in B.volume_profile(trades(spark, sf), "regime", "price", "volume", 10.0).collect()}
    sums = {}
    for r in trades(spark, sf).select("regime", "price", "volume").collect():
        b = sums.setdefault(r["regime"], {})
        k = int(r["price"] // 10)
        b[k] = b.get(k, 0) + float(r["volume"])
    for regime, b in sums.items():
        bins = sorted(b)
        i = j = max(range(len(bins)), key=lambda n: (b[bins[n]], -n))
        poc, area, total = bins[i], b[bins[i]], sum(b.values())
        while area < 0.7 * total:
            up = b[bins[j + 1]] if j + 1 < len(bins) else -1
            down = b[bins[i - 1]] if i else -1
            if up >= down:
                j += 1
                area += up
            else:
                i -= 1
                area += down
        assert got[regime][:3] == (poc, bins[i], bins[j]) and got[regime][3] == pytest.approx(total)


def test_features_dont_look_ahead(spark, sf):
    """A feature of a day is the same whatever comes after it."""
    bars = daily_bars(spark, sf)
    names = {n: None for n in I.INDICATORS}
    cut = F.lit("1998-01-01").cast("date")
    key = lambda df: {(r["symbol"], r["day"]): tuple(round(r[n], 9) if r[n] is not None else None for n in sorted(names)) for r in df.collect()}
    run = lambda b: I.compute(b, ["symbol"], ["day"], F.year("day"), names)
    short, long = key(run(bars.where(F.col("day") < cut))), key(run(bars).where(F.col("day") < cut))
    assert short == long


def test_clean_keeps_first_rows_and_drops_whole_runs(spark):
    rows = [("s", i, i, p, p) for i, p in enumerate([1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "symbol string, time_msc long, event_id long, bid double, ask double")
    left = clean.stale_runs(df, ["symbol"], ["time_msc", "event_id"], tick_bucket(), 2)
    assert sorted(r["bid"] for r in left.collect()) == [1.0, 3.0, 3.0, 4.0]


def test_append_dedup_round_trip(spark, tmp_path):
    old = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], "time_msc long, symbol string, v double")
    new = spark.createDataFrame([(2, "x", 5.0, 1), (3, "x", 3.0, 2)], "time_msc long, symbol string, v double, extra int")
    got = store.append_dedup(old, new)
    assert sorted(map(tuple, got.select("time_msc", "v").collect())) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    got.write.parquet(f"{tmp_path}/a/part")
    assert store.read(spark, f"{tmp_path}/a").count() == 3
    assert store.net_new(new, old, ["time_msc"]) == 1
    with pytest.raises(ValueError):
        store.require(old, "nope")
    store.write_journal(old, f"{tmp_path}/j")
    assert store.read_journal(spark, f"{tmp_path}/j", old.schema).count() == 2


def test_top_k_equals_brute_force(spark):
    r = random.Random(4)
    vs = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(99, [0.0] * 4)]
    df = spark.createDataFrame(vs, "id long, v array<double>").repartition(3)
    got = {}
    for q in top_k(df, df.where("id % 10 = 0"), "id", "v", 3).orderBy("place").collect():
        got.setdefault(q["query_id"], []).append(q["match_id"])
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-30, sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for i, v in vs:
        if i % 10 == 0:
            assert got[i] == [j for _, j in sorted((-cos(v, w), j) for j, w in vs if j != i)[:3]]
    assert top_k(df, df.where("false"), "id", "v", 3).count() == 0


def test_stream_features_equal_a_loop(spark, sf, tmp_path):
    got = {r["event_type"]: r for r in engine.run_available(engine.features(engine.read_events(spark, sf)), str(tmp_path), "update").collect()}
    state = {}
    for r in ticks(spark, sf).orderBy("time_msc", "event_id").collect():
        s = state.setdefault(r["symbol"], [0, None])
        s[0] += 1
        s[1] = r["bid"] if s[1] is None else s[1] + 0.1 * (r["bid"] - s[1])
    assert {k: r["n"] for k, r in got.items()} == {k: s[0] for k, s in state.items()}
    for k, s in state.items():
        assert got[k]["ema"] == pytest.approx(s[1])


def test_stream_bars_equal_batch(spark, sf, tmp_path):
    stream = engine.run_available(engine.tumbling(engine.read_events(spark, sf), "1 hour"), str(tmp_path))
    batch = ticks(spark, sf).groupBy("symbol", (F.floor(F.col("time_msc") / 3_600_000) * 3_600_000).alias("start")).agg(F.count("*").alias("n"), F.max("bid").alias("high"))
    assert sorted((r["event_type"], r["start"], r["n"], r["high"]) for r in stream.collect()) == sorted(map(tuple, batch.collect()))


def test_late_rows_and_several_batches(spark, sf, tmp_path):
    """A file a micro-batch: bars are mended while their window is open, and a row behind the watermark is dropped."""
    base = 1_700_000_000_000 // 3_600_000 * 3_600_000
    minutes = [(0, [0, 5, 30]), (1, [50, 70]), (2, [40, 200]), (3, [205]), (4, [20, 210])]  # 40 comes late but inside 90 minutes, 20 after its window is closed
    n = 0
    for k, at in minutes:
        rows = []
        for m in at:
            rows.append((n, base + 60_000 * m, 1, "x", float(m), ""))
            n += 1
        df = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string, value double, props string")
        df = df.select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
        df.toPandas().to_parquet(tmp_path / f"events-{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    stream = engine.tumbling(engine.read_events(spark, str(tmp_path), files=1, names="events-*.parquet"), "1 hour", late="90 minutes")
    out = engine.run_available(stream, str(tmp_path / "run"), "update", ("event_type", "start"))
    got = {(r["start"] - base) // 3_600_000: (r["n"], r["open"], r["close"]) for r in out.collect()}
    assert got == {0: (5, 0.0, 50.0), 1: (1, 70.0, 70.0), 3: (3, 200.0, 210.0)}
    assert stream.isStreaming


def test_hawkes_is_the_sum_it_stands_for(spark, sf):
    rows = ticks(spark, sf).where("symbol = 'purchase'").select("symbol", "time_msc", "event_id")
    got = {r["event_id"]: r["intensity"] for r in hawkes(rows, 0.5, 1.0).collect()}
    all_ = sorted((r["time_msc"], r["event_id"]) for r in rows.collect())
    for i, (t, e) in enumerate(all_[:60]):
        past = [u for u, _ in all_[:i]]
        assert got[e] == pytest.approx(0.1 + sum(0.5 * math.exp(-(t - u) / 3_600_000) for u in past))


def test_kalman_granger_and_isotonic(spark):
    rows = [("k", i, float(i % 7), 0) for i in range(40)]
    level = None
    k = statistics.kalman_level(spark.createDataFrame(rows, "k string, t long, v double, day long"), ["k"], ["t"], F.floor(F.col("t") / 8), "v", 1.0, 4.0, block=7)
    p = 4.0
    for r in sorted(k.collect(), key=lambda r: r["t"]):
        if level is None:
            level = r["v"]
        else:
            p += 1.0
            g = p / (p + 4.0)
            level, p = level + g * (r["v"] - level), (1 - g) * p
        assert r["level"] == pytest.approx(level) and r["variance"] == pytest.approx(p)
    r = random.Random(3)
    xs = [r.random() for _ in range(200)]
    ys = [0.0] + [0.8 * xs[i - 1] + 0.1 * r.random() for i in range(1, 200)]
    lagged = [("k", ys[i], ys[i - 1], xs[i - 1]) for i in range(1, 200)]
    assert statistics.granger(spark.createDataFrame(lagged, "k string, y double, y_lag1 double, x_lag1 double"), ["k"], "x", "y", 1).first()["f"] > 100
    points = spark.createDataFrame([("k", 0.05, True), ("k", 0.15, False), ("k", 0.25, False), ("k", 0.95, True)], "k string, s double, y boolean")
    got = [x["calibrated"] for x in statistics.isotonic(points, ["k"], "s", "y", 10).orderBy("bin").collect()]
    assert got == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1.0])


def test_recurrences_by_blocks(spark):
    r = random.Random(2)
    rows = [(k, i, r.random(), r.random()) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, _rn long, x double, d double")
    for decay in (0.9, "d"):
        got = {(x["k"], x["_rn"]): x["y"] for x in linear_recurrence(df, ["k"], "x", decay, "y", block=7).collect()}
        y = {}
        for k, i, x, d in rows:
            y[k] = (d if decay == "d" else decay) * y.get(k, 0.0) + x
            assert got[k, i] == pytest.approx(y[k])


def test_quotes_of_zero_divide_nothing(spark):
    """Bid and ask of 0 in raw ticks: under ANSI a division would end the query."""
    rows = [("x", "a", i * 1000, i, q, q, 1, 32) for i, q in enumerate([1.0, 0.0, 0.0, 2.0, 0.0])]
    t = spark.createDataFrame(rows, "symbol string, broker string, time_msc long, event_id long, bid double, ask double, user_id long, flags int")
    m = B.microstructure(t, 60_000).first()
    assert (m["ticks"], m["spread_bps_max"]) == (5, 0.0)
    assert B.build_bars(t, 60_000).first()["tick_count"] == 5 and B.build_bars(t.where("bid = 0"), 60_000).first()["mid_return"] is None
    assert t.where(clean.valid_quote()).count() == 2 and {r["stage"]: r["n"] for r in clean.clean_report(t).collect()} == {"kept": 2, "non_positive": 3}
    assert clean.drop_spikes(t, ["symbol"], ["time_msc"], F.lit(0), 2, 0.5).count() >= 2
    assert merge.merge_sources(merge.last_per_bucket(t, 1000), merge.MergeRules(bucket_ms=1000)).count() == 2


def test_folds_reach_the_newest_rows(spark):
    df = spark.range(1003).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    got = splits.walk_forward(df, ["k"], ["t"], F.floor(F.col("t") / 100), folds=4, train=0.6, gap=0.02, embargo=5)
    tests = got.where("part = 'test'").groupBy("fold").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("fold").collect()
    assert [(r["a"], r["b"]) for r in tests] == [(601 + 100 * k, 700 + 100 * k) for k in range(4)]
    assert {r["fold"]: r["m"] for r in got.where("part = 'train'").groupBy("fold").agg(F.max("t").alias("m")).collect()} == {k: 601 + 100 * k - 20 - 1 for k in range(4)}


def test_bootstrap_reruns_agree(spark):
    rows = [("a", i, 0.01 * (-1) ** i) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, day long, r double")
    one, two = (sorted(map(tuple, statistics.bootstrap_paths(df, "symbol", "r", 25, chunk=10).collect())) for _ in range(2))
    assert one == two and len(one) == 25


def test_gaps_close_over_the_weekend(spark):
    friday = 1_704_484_800_000  # 2024-01-05 20:00 UTC
    df = spark.createDataFrame([("s", friday), ("s", friday + 52 * 3_600_000)], "symbol string, bar long")
    assert B.gaps(df, 3_600_000).first()["missing"] == 3  # Friday 21 h, Sunday 22 h and 23 h


def test_predicates(spark):
    with pytest.raises(ValueError):
        I.condition({"left": "x", "op": "like", "right": 1}, None)


def test_selectors_and_hash():
    assert [f.name for f in D.select_features(("stat/*",))] == ["stat/z_20", "stat/z_60"]
    with pytest.raises(ValueError):
        D.select_features(("nothing/*",))
    assert D.DatasetSpec("a").content_hash() != D.DatasetSpec("b").content_hash()


def test_bar_invariants(spark, sf):
    assert hourly(spark, sf).where("low > open or low > close or high < open or high < close or spread_min > spread_mean").count() == 0
    assert DAY_MS == 86_400_000
