"""Parquet, CSV and JSON-lines sources and sinks with the store's conventions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfold.operators.clean import dedup

#: The keys by which an append drops earlier rows, time first (the first present counts), then identity.
TIME_KEYS = ("time_msc", "ts_msc", "time_utc", "ts_utc", "bar_start", "anchor_ts_utc")
IDENTITY_KEYS = ("broker_id", "symbol", "timeframe")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or directory tree of Parquet, unioned by name; corrupt and missing files are skipped."""
    r = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return (r.schema(schema) if schema else r).parquet(path)


def read_dates(spark: SparkSession, base: str, start: str, end: str) -> DataFrame:
    """The ``date=`` partitions from start to end (inclusive); other partitions aren't listed by the scan."""
    return spark.read.parquet(base).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name, columns that a frame lacks as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_dedup(old: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows and a new batch; of rows with one key the new batch's last (then by all columns) stays."""
    both = union_relaxed(old.withColumn("_batch", F.lit(0)), new.withColumn("_batch", F.lit(1)))
    keys = [next((k for k in TIME_KEYS if k in both.columns), None), *(k for k in IDENTITY_KEYS if k in both.columns)]
    keys = [k for k in keys if k]
    if not keys:
        return both.drop("_batch")
    rest = [c for c in both.columns if c not in (*keys, "_batch")]
    return dedup(both, keys, [F.col("_batch"), *[F.col(c) for c in rest]]).drop("_batch")


def write_by_date(df: DataFrame, base: str, ts: str = "time_utc", mode: str = "append") -> None:
    """Partitioned by the date of a timestamp; one shuffle puts a date's rows together, AQE splits large ones."""
    df.withColumn("date", F.to_date(ts)).hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(base)


def net_new(new: DataFrame, old: DataFrame, keys: list[str]) -> int:
    return new.join(old.select(*keys), keys, "left_anti").count()


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *required: str) -> DataFrame:
    return require(spark.read.schema(schema).option("header", True).csv(path), *required)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Journal rows; order them by ``seq_no`` where order matters."""
    return spark.read.schema(schema).json(path)


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, cast; missing ones null. A value that can't be cast is null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
