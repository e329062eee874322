"""Time series at scale: ranks, rolling frames, running sums and recurrences without one task a series.

A window partitioned by symbol alone puts a whole series into one task. Here rows get their
ordinal by two steps (counts of time buckets, then ranks inside a bucket); rolling frames run over
blocks of ordinals, each block with a copy of the rows its frames reach into (a halo); running
sums and linear recurrences run inside blocks and are joined by what the blocks before carry in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block. Halos are copied, so it should be well above the longest frame.
BLOCK = 65_536


def ordinal(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "_rn") -> DataFrame:
    """Adds the 0-based rank of a row in its series. ``bucket`` must not fall as ``order`` rises; it bounds what one task sorts."""
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return df.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start")


def rolling(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    block: int = BLOCK,
    keep_ordinal: bool = False,
) -> DataFrame:
    """Adds columns over ROWS frames that reach at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` gets the ordered window of a block. Where it needs columns of its own first, chain calls of
    ``withColumns`` on what it returns: an entry may be a list of dicts, applied in turn.
    """
    df = ordinal(df, keys, order, bucket)
    b = (F.col("_rn") / block).cast("long")
    at = F.col("_rn") % block
    homes = [F.struct(b.alias("b"), F.lit(False).alias("halo"))]
    if before:
        homes.append(F.when(at >= block - before, F.struct((b + 1).alias("b"), F.lit(True).alias("halo"))))
    if after:
        homes.append(F.when((at < after) & (b > 0), F.struct((b - 1).alias("b"), F.lit(True).alias("halo"))))
    df = df.withColumn("_h", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull()))) if len(homes) > 1 else df.withColumn("_h", homes[0])
    df = df.withColumns({"_b": F.col("_h.b"), "_halo": F.col("_h.halo")}).drop("_h")
    w = Window.partitionBy(*keys, "_b").orderBy("_rn")
    made = columns(w)
    for step in made if isinstance(made, list) else [made]:
        df = df.withColumns(step)
    return df.where("not _halo").drop("_b", "_halo", *([] if keep_ordinal else ["_rn"]))


def frame(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows; null until ``least`` (n) of them are not null."""
    f = frame(w, n)
    return F.when(F.count(c).over(f) >= (n if least is None else least), agg(c).over(f))


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (from the start of the series, the current row included) in two steps."""
    df = df.withColumn("_bucket", bucket).withColumns({f"_v_{k}": c for k, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    parts = parts.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(parts, [*keys, "_bucket"]).withColumns({k: F.col(f"_c_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    return out.drop("_bucket", *[f"{p}{k}" for k in sums for p in ("_v_", "_c_")])


def linear_recurrence(df: DataFrame, keys: list[str], value: str, decay: float | str, out: str, block: int = BLOCK, ordinal_column: str = "_rn") -> DataFrame:
    """y[0] = x[0]; y[i] = decay[i] * y[i-1] + x[i], with a decay for all or a column of them. Needs the ordinal of each row."""
    return linear_recurrences(df, keys, {out: value}, decay, block, ordinal_column)


def linear_recurrences(df: DataFrame, keys: list[str], values: dict[str, str], decay: float | str, block: int = BLOCK, ordinal_column: str = "_rn") -> DataFrame:
    """Several of them (output: input column) with one decay.

    A block is scanned from zero by itself; over the blocks' ends (one row a block) the same recurrence
    gives what each block is carried; y = own + product of decays so far * carried.
    """
    b = (F.col(ordinal_column) / block).cast("long")
    df = df.withColumns({"_b": b, "_decay": (F.lit(decay) if isinstance(decay, float) else F.col(decay)).cast("double")})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal_column, ignore_index=True)
        for out, value in values.items():
            pdf[f"_own_{out}"], pdf["_left"] = _scan(pdf[value].to_numpy(float), pdf["_decay"].to_numpy(float))
        return pdf

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", `_own_{o}` double" for o in values) + ", _left double"
    own = df.groupBy(*keys, "_b").applyInPandas(scan, fields)
    ends = own.groupBy(*keys, "_b").agg(F.max_by("_left", ordinal_column).alias("_all"), *[F.max_by(f"_own_{o}", ordinal_column).alias(f"_end_{o}") for o in values])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)
        for o in values:
            y, _ = _scan(pdf[f"_end_{o}"].to_numpy(float), pdf["_all"].to_numpy(float))
            pdf[f"_carried_{o}"] = np.concatenate(([0.0], y[:-1]))
        return pdf[[*keys, "_b", *(f"_carried_{o}" for o in values)]]

    kinds = dict(df.dtypes)
    carried = ends.groupBy(*keys).applyInPandas(carry, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _b long" + "".join(f", `_carried_{o}` double" for o in values))
    made = {o: F.col(f"_own_{o}") + F.col("_left") * F.col(f"_carried_{o}") for o in values}
    return own.join(carried, [*keys, "_b"]).withColumns(made).drop("_b", "_decay", "_left", *[f"{p}_{o}" for o in values for p in ("_own", "_carried")])


def recurrences(df: DataFrame, keys: list[str], made: dict[str, tuple[Column, Column]], block: int = BLOCK) -> DataFrame:
    """Adds y[0] = x[0]; y[i] = decay[i] * y[i-1] + x[i] for each {name: (x, decay)}, each with decays of its own. Needs ``_rn``.

    As ``linear_recurrences``, but only keys, ordinals and the numbers go through Python: a block travels as one row of arrays, and comes back
    as arrays that are zipped with the block's other columns.
    """
    count = len(made)  # what runs in Python mustn't hold columns
    rest = [c for c in df.columns if c not in keys]
    b = (F.col("_rn") / block).cast("long").alias("_b")
    inputs = {f"_x{j}": x.cast("double") for j, (x, _) in enumerate(made.values())} | {f"_d{j}": d.cast("double") for j, (_, d) in enumerate(made.values())}
    packed = df.groupBy(*keys, b).agg(F.array_sort(F.collect_list(F.struct("_rn", F.struct(*[F.col(c) for c in rest if c != "_rn"]).alias("_rest"), *[c.alias(n) for n, c in inputs.items()]))).alias("_rows"))

    @F.pandas_udf("array<double>")
    def own(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_scan(np.asarray(a, float), np.asarray(e, float))[0] for a, e in zip(x, d, strict=True)])

    @F.pandas_udf("array<double>")
    def left(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_scan(np.asarray(a, float), np.asarray(e, float))[1] for a, e in zip(x, d, strict=True)])

    arrays = {f"_{part}{j}": f(F.col(f"_rows._x{j}"), F.col(f"_rows._d{j}")) for j in range(count) for part, f in (("own", own), ("left", left))}
    packed = packed.withColumns(arrays)
    ends = packed.select(*keys, "_b", *[F.element_at(f"_{part}{j}", -1).alias(f"_{part}{j}") for j in range(count) for part in ("own", "left")])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)
        for j in range(count):
            y, _ = _scan(pdf[f"_own{j}"].to_numpy(float), pdf[f"_left{j}"].to_numpy(float))
            pdf[f"_c{j}"] = np.concatenate(([0.0], y[:-1]))
        return pdf[[*keys, "_b", *(f"_c{j}" for j in range(count))]]

    kinds = dict(df.dtypes)
    carried = ends.groupBy(*keys).applyInPandas(carry, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _b long" + "".join(f", `_c{j}` double" for j in range(count)))
    zipped = F.arrays_zip("_rows", *arrays)
    out = packed.join(carried, [*keys, "_b"]).select(*keys, F.explode(zipped).alias("_z"), *[f"_c{j}" for j in range(count)])
    values = [(F.col(f"_z._own{j}") + F.col(f"_z._left{j}") * F.col(f"_c{j}")).alias(name) for j, name in enumerate(made)]
    return out.select(*keys, *[F.col("_z._rows._rn" if c == "_rn" else f"_z._rows._rest.{c}").alias(c) for c in rest], *values)


def _scan(x: np.ndarray, decay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y[i] = decay[i] * y[i-1] + x[i] from y[-1] = 0, and the products of the decays so far: steps are composed in pairs, fours, eights and so on."""
    y, left, step = x.astype(float), decay.astype(float), 1
    while step < len(y):
        y[step:] += left[step:] * y[:-step]
        left[step:] *= left[:-step]
        step *= 2
    return y, left


def ema(df: DataFrame, keys: list[str], value: str, alpha: float, out: str, block: int = BLOCK) -> DataFrame:
    """y[0] = x[0]; y[i] = y[i-1] + alpha * (x[i] - y[i-1]). Needs ``_rn``."""
    x = df.withColumn("_x", F.when(F.col("_rn") == 0, F.col(value)).otherwise(alpha * F.col(value)).cast("double"))
    return linear_recurrence(x, keys, "_x", 1.0 - alpha, out, block).drop("_x")


def islands(change: Column, w: WindowSpec) -> Column:
    """Number of the run a row is in, counting changes (true where a run starts) inside a window."""
    return F.sum(F.coalesce(change.cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
