"""Where each kind of table lies in a store, by partition columns, and how it is written there and read back with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a store and the columns they are partitioned by, outermost first.
LAYOUTS = {
    "raw_ticks": ("broker", "symbol", "date"),
    "native_bars": ("broker", "symbol", "timeframe", "date"),
    "bars": ("symbol", "timeframe", "date"),
    "canonical_ticks": ("symbol", "date"),
    "merge_diagnostics": ("symbol", "date"),
    "merge_qa": ("symbol", "date"),
    "state": ("symbol", "clock", "version", "date"),
    "state_windows": ("symbol", "clock", "version", "window", "date"),
    "features": ("feature", "clock", "date"),
    "labels": ("label_pack", "clock", "date"),
    "datasets": ("dataset", "split"),
}


def location(root: str, kind: str, **values: object) -> str:
    """The folder of a table, or of a partition of it: ``values`` are given for the outermost columns, without a gap."""
    columns = _columns(kind)
    given = columns[: len(values)]
    if set(given) != set(values):
        raise ValueError(f"{kind} is partitioned by {', '.join(columns)}; got {', '.join(values)}")
    for v in values.values():
        if not str(v) or any(c in str(v) for c in "/\\=") or str(v) in (".", ".."):
            raise ValueError(f"{v!r} can't name a partition")
    return "/".join([root.rstrip("/"), kind, *[f"{c}={values[c]}" for c in given]])


def save(df: DataFrame, root: str, kind: str) -> None:
    """Replaces the partitions that ``df`` has rows for and leaves all others. Rows of a partition meet in one shuffle, large partitions are split; a null
    partition value is the default partition and is read back as null."""
    columns = _columns(kind)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{kind} is partitioned by {', '.join(columns)}; missing: {', '.join(missing)}")
    df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(location(root, kind))


def load(spark: SparkSession, root: str, kind: str, start: str | None = None, end: str | None = None, **values: object) -> DataFrame:
    """The table where partition columns have the ``values`` (a list: any of them) and dates lie from ``start`` to ``end``; other partitions aren't read."""
    df = spark.read.parquet(location(root, kind))
    for c, v in values.items():
        if c not in _columns(kind):
            raise ValueError(f"{kind} isn't partitioned by {c}")
        df = df.where(F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == F.lit(v))
    for bound, keep in ((start, lambda b: F.col("date") >= b), (end, lambda b: F.col("date") <= b)):
        if bound is not None:
            df = df.where(keep(F.lit(bound).cast("date")))
    return df


def _columns(kind: str) -> tuple[str, ...]:
    if kind not in LAYOUTS:
        raise ValueError(f"no layout for {kind}")
    return LAYOUTS[kind]
