"""Queries: streams with event-time timers, carried values, and state that is exported and restored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.plans.more import stream_path
from larkfold.plans.registry import query
from larkfold.sources.adapters import TICKS_SQL, ticks
from larkfold.streaming import engine
from larkfold.streaming import slots as S

HOUR = S.HOUR

SLOTS_SQL = f"""WITH RECURSIVE {TICKS_SQL}, r AS MATERIALIZED (SELECT symbol, time_msc, event_id, bid, time_msc // {HOUR} AS slot, row_number() OVER w AS i, max(bid) OVER w AS high, min(bid) OVER w AS low FROM ticks
  WHERE symbol IS NOT NULL AND bid IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY time_msc, event_id)),
 e AS (SELECT symbol, i, bid AS ema FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.i, 0.9::DOUBLE * e.ema + 0.1::DOUBLE * r.bid FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1),
 g AS (SELECT symbol, slot, count(*) AS n, max(i) AS total, arg_max(bid, i) AS close, arg_max(high, i) AS high, arg_max(low, i) AS low, max(time_msc) AS t FROM r GROUP BY ALL),
 s AS (SELECT symbol, unnest(range(min(slot), (SELECT max(time_msc) - 600000 FROM ticks) // {HOUR})) AS slot FROM g GROUP BY symbol)
 SELECT s.symbol, s.slot, CASE WHEN g.slot = s.slot THEN n ELSE 0 END AS n, total, CASE WHEN (s.slot + 1) * {HOUR} - t <= {3 * HOUR} THEN close END AS close, high, low, round(ema, 6) AS ema,
 CASE WHEN g.slot = s.slot THEN 'fresh' WHEN (s.slot + 1) * {HOUR} - t <= {3 * HOUR} THEN 'carried' ELSE 'stale' END AS status
 FROM s ASOF JOIN g ON g.symbol = s.symbol AND s.slot >= g.slot JOIN e ON e.symbol = s.symbol AND e.i = g.total"""


@query("st02_stream_slots", SLOTS_SQL)
def st02(spark: SparkSession, d: str) -> DataFrame:
    """ST02, ST06: hourly features of each symbol as the watermark closes the hours, empty ones carried forward or stale."""
    with S.state_on_disk(spark):
        out = engine.run_available(S.slots(engine.read_events(spark, d)), stream_path(spark), "append")
    return out.withColumn("ema", F.round("ema", 6))


@query("st15_stream_restore", SLOTS_SQL)
def st15_restore(spark: SparkSession, d: str) -> DataFrame:
    """ST15: a stream stops halfway; its state is exported as a table, and another stream goes on from it. Together they give what one gives."""
    middle = ticks(spark, d).agg(F.floor((F.min("time_msc") + F.max("time_msc")) / 2)).first()[0] or 0
    events, first, second = engine.read_events(spark, d), stream_path(spark), stream_path(spark)
    with S.state_on_disk(spark):
        before = engine.run_available(S.slots(events.where(F.col("time_msc") < middle)), first, "append")
        state = S.exported(spark, f"{first}/checkpoint")
        after = engine.run_available(S.slots(events.where(F.col("time_msc") >= middle), initial=state), second, "append")
    return before.unionByName(after).withColumn("ema", F.round("ema", 6))
