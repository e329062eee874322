"""Views of the test tables as ticks, trades and bars (pure projections and one aggregate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(c.cast("date")).cast("long") * DAY_MS
    return day + (F.hour(c) * 3_600_000 + F.minute(c) * 60_000).cast("long") + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes: five symbols, two brokers; (time_msc, event_id) is a total order."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        epoch_ms("ts").alias("time_msc"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("broker"),
        "user_id",
        F.col("value").alias("bid"),
        (F.col("value") * 1.0004).alias("ask"),
        F.pmod(F.col("event_id"), F.lit(128)).cast("int").alias("flags"),
    )


TICKS_SQL = """ticks AS (
  SELECT event_id, epoch_us(ts) // 1000 AS time_msc, event_type AS symbol,
         CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS broker, user_id,
         value AS bid, value * 1.0004 AS ask, CAST(event_id % 128 AS INTEGER) AS flags
  FROM events)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("regime"), F.col("l_linestatus").alias("session"), F.col("l_discount").alias("discount"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily bars of the total price, one series a priority; order of a day by order key."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_totalprice").alias("price")
    )
    key = F.struct("o_orderkey")
    return o.groupBy("symbol", "day").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("*").alias("tick_count")
    )


BARS_SQL = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*) AS tick_count
  FROM orders GROUP BY ALL)"""
