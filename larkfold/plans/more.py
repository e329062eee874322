"""Queries: streams, datasets, indicators, predicates and vector search."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import indicators as I
from larkfold.operators.search import top_k
from larkfold.operators.series import ema, ordinal, rolling
from larkfold.plans import dataset as D
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, W, bar_bucket, guard, picked, rows
from larkfold.sources.adapters import BARS_SQL, daily_bars, table
from larkfold.streaming import engine

TR = f"CASE WHEN lag(close) OVER ({W}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END"
HI, LO = f"max(high) OVER {rows(20)}", f"min(low) OVER {rows(20)}"


def stream_path(spark: SparkSession) -> str:
    """A fresh folder for a stream's checkpoint and output, under the shared folder where there is one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="larkfold-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("st03_stream_tumbling_bars", """SELECT event_type, epoch_us(ts) // 3600000000 * 3600000 AS start, arg_min(value, (epoch_us(ts) // 1000, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (epoch_us(ts) // 1000, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL""")  # fmt: skip
def st03(spark: SparkSession, d: str) -> DataFrame:
    return engine.run_available(engine.tumbling(engine.read_events(spark, d), "1 hour"), stream_path(spark), "update", ("event_type", "start"))


@query("st03_stream_sliding_bars", """WITH s AS (SELECT *, epoch_us(ts) // 1800000000 * 1800000 - k * 1800000 AS start FROM events, range(0, 2) t(k))
 SELECT event_type, start, arg_min(value, (epoch_us(ts) // 1000, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (epoch_us(ts) // 1000, event_id)) AS close, count(*) AS n FROM s GROUP BY ALL""")  # fmt: skip
def st03_sliding(spark: SparkSession, d: str) -> DataFrame:
    return engine.run_available(engine.tumbling(engine.read_events(spark, d), "1 hour", slide="30 minutes"), stream_path(spark), "update", ("event_type", "start"))


@query("st04_stream_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, value FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 3600000 THEN 0 ELSE 1 END AS new FROM e),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start, max(t) + 3600000 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")  # fmt: skip
def st04(spark: SparkSession, d: str) -> DataFrame:
    s = engine.run_available(engine.sessions(engine.read_events(spark, d), "1 hour"), stream_path(spark))
    return s.withColumn("total", F.round("total", 4))


@query("st01_stream_stateful_features")
def st01(spark: SparkSession, d: str) -> DataFrame:
    """The stateful feature after each micro-batch (no SQL; a test holds it against a plain loop)."""
    out = engine.run_available(engine.features(engine.read_events(spark, d)), stream_path(spark), "update")
    return out.select("event_type", "seq_no", "n", "skipped", *[F.round(c, 6).alias(c) for c in ("ema", "high", "low")])


SPEC = D.DatasetSpec("daily", features=("price/*", "stat/z_20", "volume/*"), horizon=5, min_ticks=2, embargo=5)


@query("x03_dataset_compile", f"""WITH {BARS_SQL}, f AS (SELECT symbol, day, tick_count, close / lag(close) OVER ({W}) - 1 AS ret_1, (high - low) / close AS range_share,
  CASE WHEN {guard("stddev_samp(close)", 20)} > 0 THEN (close - avg(close) OVER {rows(20)}) / stddev_samp(close) OVER {rows(20)} END AS z_20, coalesce({guard("avg(tick_count)", 10)}, 0) AS ticks_10,
  lead(close, 5) OVER ({W}) / close - 1 AS label FROM bars), k AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE tick_count >= 2 AND label IS NOT NULL AND ret_1 IS NOT NULL AND z_20 IS NOT NULL)
 SELECT symbol, day, round(ret_1, 6) AS ret_1, round(range_share, 6) AS range_share, round(z_20, 5) AS z_20, round(ticks_10, 6) AS ticks_10, round(label, 6) AS label,
 CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + 5 THEN 'embargo' WHEN i < floor(n * 0.85) THEN 'valid' WHEN i < floor(n * 0.85) + 5 THEN 'embargo' ELSE 'test' END AS split FROM k""")  # fmt: skip
def x03(spark: SparkSession, d: str) -> DataFrame:
    out = D.compile_dataset(SPEC, daily_bars(spark, d), KEYS, ORDER, bar_bucket())
    return out.select("symbol", "day", *[F.round(c, 5 if c == "z_20" else 6).alias(c) for c in ("ret_1", "range_share", "z_20", "ticks_10", "label")], "split")


@query("x05_trust_report", f"""WITH {BARS_SQL}, f AS (SELECT symbol, day, close, close / lag(close) OVER ({W}) - 1 AS ret FROM bars), r AS (SELECT count(*) AS rows, sum((ret IS NULL)::INT)::BIGINT AS nulls, 0::BIGINT AS infinities, 0::BIGINT AS constants, 0::BIGINT AS duplicates FROM f)
 SELECT *, round(100 - least(5 * 100 * nulls / (rows * 2), 30), 6) AS score FROM r""")  # fmt: skip
def x05(spark: SparkSession, d: str) -> DataFrame:
    df = rolling(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), lambda w: {"ret": F.col("close") / F.lag("close").over(w) - 1}, 1)
    return D.trust_report(df, ["symbol", "day"], ["close", "ret"]).withColumn("score", F.round("score", 6))


NAMES = ("momentum", "stochastic_k", "williams_r", "compression_ratio", "expansion_ratio", "parkinson_vol", "garman_klass_vol", "dist_rolling_high", "breakout_proximity", "overlap_ratio", "bar_position", "inside_bar", "doji", "sma", "volume_rank")


@query("ib_indicators", f"""WITH {BARS_SQL}, t AS (SELECT *, {TR} AS tr FROM bars), p AS (SELECT *, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl, list(tick_count) OVER {rows(20)} AS vs,
  max(high) OVER {rows(14)} AS h14, min(low) OVER {rows(14)} AS l14, {HI} AS h20, {LO} AS l20, max(high) OVER {rows(10)} AS h10, min(low) OVER {rows(10)} AS l10, avg(tr) OVER {rows(14)} AS atr14, avg(tr) OVER {rows(20)} AS atr20,
  coalesce(close / lag(close, 10) OVER ({W}) - 1, 0) AS momentum, avg(pow(ln(high / low), 2)) OVER {rows(20)} AS pk, avg(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)) OVER {rows(20)} AS gk, avg(close) OVER {rows(20)} AS ma FROM t),
 x AS (SELECT symbol, day, momentum, CASE WHEN h14 - l14 > 1e-12 THEN (close - l14) / (h14 - l14) ELSE 0.5 END AS stochastic_k, CASE WHEN h14 - l14 > 1e-12 THEN (close - h14) / (h14 - l14) ELSE -0.5 END AS williams_r,
  CASE WHEN h20 - l20 > 1e-12 THEN 1 - (h10 - l10) / (h20 - l20) ELSE 0 END AS compression_ratio, CASE WHEN atr20 > 1e-12 THEN tr / atr20 ELSE 0 END AS expansion_ratio, sqrt(pk / (4 * ln(2))) AS parkinson_vol, sqrt(greatest(gk, 0)) AS garman_klass_vol,
  CASE WHEN h20 - l20 > 1e-12 THEN (close - h20) / (h20 - l20) ELSE 0 END AS dist_rolling_high, CASE WHEN h20 - l20 > 1e-12 THEN 1 - least(h20 - close, close - l20) / (h20 - l20) ELSE 0 END AS breakout_proximity,
  CASE WHEN ph IS NULL THEN CASE WHEN high - low > 1e-12 THEN 1.0 ELSE 0 END WHEN greatest(high, ph) - least(low, pl) > 1e-12 THEN greatest(least(high, ph) - greatest(low, pl), 0) / (greatest(high, ph) - least(low, pl)) ELSE 0 END AS overlap_ratio,
  CASE WHEN high - low > 1e-12 THEN (close - low) / (high - low) ELSE 0.5 END AS bar_position, coalesce((high <= ph AND low >= pl)::INT, 0)::DOUBLE AS inside_bar, (high - low > 1e-12 AND abs(close - open) < 0.1 * (high - low))::INT::DOUBLE AS doji,
  CASE WHEN atr14 > 1e-12 THEN (close - ma) / atr14 ELSE 0 END AS sma, len(list_filter(vs, lambda v: v <= tick_count)) / len(vs) AS volume_rank FROM p)
 SELECT symbol, day, {", ".join(f"round({n}, 5) AS {n}" for n in NAMES)} FROM x""")  # fmt: skip
def ib(spark: SparkSession, d: str) -> DataFrame:
    """Appendix B: a set of native indicators over one window pass."""
    return picked(I.compute(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), {n: None for n in NAMES}), *NAMES, places=5)


@query("ib_wilder_atr", f"""WITH RECURSIVE {BARS_SQL}, t AS (SELECT symbol, day, {TR} AS tr, row_number() OVER ({W}) AS i FROM bars),
 e AS (SELECT symbol, day, i, tr AS y FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.day, t.i, e.y + (t.tr - e.y) / 14 FROM e JOIN t ON t.symbol = e.symbol AND t.i = e.i + 1) SELECT symbol, day, round(y, 4) AS atr_14 FROM e""")  # fmt: skip
def ib_atr(spark: SparkSession, d: str) -> DataFrame:
    r = rolling(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), lambda w: {"tr": I.true_range(w)}, 1)
    return picked(ema(ordinal(r, KEYS, ORDER, bar_bucket()), KEYS, "tr", 1 / 14, "atr_14", block=500), "atr_14", places=4)


CONDITIONS = [
    {"left": "close", "op": "crosses_above", "right": "ma"},
    {"left": "share", "op": "between", "right": 0.2, "high": 0.8},
    {"left": "tick_count", "op": "gt", "right": 1, "negate": True},
]


@query("q_predicate_dsl", f"""WITH {BARS_SQL}, m AS (SELECT symbol, day, close, tick_count, avg(close) OVER {rows(10)} AS ma, (high - low) / close AS share FROM bars), p AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(ma) OVER ({W}) AS pm FROM m)
 SELECT symbol, day, (coalesce(close > ma AND pc <= pm, false)::INT + (share >= 0.2 AND share <= 0.8)::INT + (NOT tick_count > 1)::INT) >= 2 AS matched FROM p""")  # fmt: skip
def q_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Strategy conditions as columns: two of three must hold."""

    def columns(w):
        return [{"ma": F.avg("close").over(w.rowsBetween(-9, 0)), "share": (F.col("high") - F.col("low")) / F.col("close")}, {"matched": I.match(CONDITIONS, 2, w)}]

    return rolling(daily_bars(spark, d), KEYS, ORDER, bar_bucket(), columns, 10).select("symbol", "day", "matched")


@query("j18_cosine_top_k", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
 SELECT query_id, match_id, round(c, 5) AS cosine, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, match_id))::INTEGER AS place FROM s QUALIFY place <= 5""")  # fmt: skip
def j18(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 5))
