"""Declarative datasets: features by selector, labels, filters, missing-value policies, splits, profile and trust report."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from larkfold.operators.labels import future_return
from larkfold.operators.series import full, rolling
from larkfold.operators.splits import holdout

POLICIES = ("allow", "drop_row", "impute_zero", "fail")


@dataclass(frozen=True)
class Feature:
    """A feature: ``group/name``, its expression over a block's window, rows it looks back and its missing-value policy."""

    name: str
    make: Callable[[WindowSpec], Column]
    rows_back: int
    policy: str = "allow"

    @property
    def column(self) -> str:
        return self.name.split("/")[-1]


def _z(n: int) -> Callable[[WindowSpec], Column]:
    def make(w: WindowSpec) -> Column:
        c = F.col("close")
        return F.try_divide(c - full(F.avg, c, w, n), full(F.stddev_samp, c, w, n))

    return make


FEATURES = [
    Feature("price/ret_1", lambda w: F.col("close") / F.lag("close").over(w) - 1, 1, "drop_row"),
    Feature("price/range_share", lambda w: (F.col("high") - F.col("low")) / F.col("close"), 0),
    Feature("stat/z_20", _z(20), 20, "drop_row"),
    Feature("stat/z_60", _z(60), 60),
    Feature("volume/ticks_10", lambda w: full(F.avg, F.col("tick_count"), w, 10), 10, "impute_zero"),
]


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    features: tuple[str, ...] = ("*",)
    horizon: int = 5
    min_ticks: int = 1
    train: float = 0.7
    valid: float = 0.15
    embargo: int = 0
    extra: dict = field(default_factory=dict)

    def content_hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def select_features(selectors: tuple[str, ...], catalog: list[Feature] = FEATURES) -> list[Feature]:
    """Features that match any selector, in catalog order; a selector without a match is an error."""
    for s in selectors:
        if not any(fnmatchcase(f.name, s) for f in catalog):
            raise ValueError(f"no feature matches {s}")
    return [f for f in catalog if any(fnmatchcase(f.name, s) for s in selectors)]


def compile_dataset(spec: DatasetSpec, bars: DataFrame, keys: list[str], order: list[str], bucket: Column, catalog: list[Feature] = FEATURES) -> DataFrame:
    """Bars to a split dataset in one lazy plan: features and label over shared blocks, filters, policies, split by time."""
    chosen = select_features(spec.features, catalog)

    def columns(w):
        return {**{f.column: f.make(w) for f in chosen}, "label": future_return("close", spec.horizon, w)}

    df = rolling(bars, keys, order, bucket, columns, before=max(f.rows_back for f in chosen) + 1, after=spec.horizon)
    df = df.where((F.col("tick_count") >= spec.min_ticks) & F.col("label").isNotNull())
    for f in chosen:
        if f.policy == "impute_zero":
            df = df.withColumn(f.column, F.coalesce(f.column, F.lit(0.0)))
        elif f.policy == "drop_row":
            df = df.where(F.col(f.column).isNotNull())
        elif f.policy == "fail":
            df = df.withColumn(f.column, F.coalesce(f.column, F.raise_error(F.lit(f"{f.name} is null")).cast("double")))
    return holdout(df.select(*keys, *order, *[f.column for f in chosen], "label"), keys, order, bucket, spec.train, spec.valid, spec.embargo)


def trust_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row of checks over a dataset and a score: nulls, infinities, constants, duplicate keys, split order."""
    by_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in columns], *[F.sum((F.abs(F.col(c)) == float("inf")).cast("long")).alias(f"inf_{c}") for c in columns],
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns],
    )
    total = lambda p: sum((F.coalesce(F.sum(f"{p}_{c}"), F.lit(0)) for c in columns), F.lit(0))
    constant = sum(((F.min(f"min_{c}") == F.max(f"max_{c}")).cast("int") for c in columns), F.lit(0))
    r = by_key.agg(
        F.sum("n").alias("rows"), total("null").cast("long").alias("nulls"), total("inf").cast("long").alias("infinities"), constant.cast("long").alias("constants"),
        F.sum((F.col("n") > 1).cast("long")).alias("duplicates"),
    )
    share = 100 * F.col("nulls") / (F.col("rows") * len(columns))
    score = 100 - F.least(5 * share, F.lit(30.0)) - F.when(F.col("infinities") > 0, 20).otherwise(0) - F.when(F.col("duplicates") > 0, 10).otherwise(0) - F.least(2 * F.col("constants"), F.lit(10))
    return r.withColumn("score", F.greatest(score, F.lit(0.0)))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two datasets has: (side, n)."""
    only = lambda a, b, s: a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return only(old, new, "only_old").union(only(new, old, "only_new"))


def manifest(spec: DatasetSpec, inputs: dict[str, str], rows: int) -> dict:
    """Lineage of a built dataset, for a JSON sidecar."""
    return {"name": spec.name, "spec": asdict(spec), "content_hash": spec.content_hash(), "inputs": inputs, "rows": rows}
