"""Series as packed blocks: a row holds up to ``BLOCK`` successive rows of a series as arrays.

What has to walk a series in order walks blocks: what a block does to whatever enters it is summed up in one row, the rows of
a series are composed in order, and a second walk of each block knows what enters. Walks are maps over rows, so a pass over the
blocks shuffles nothing but the one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkfold.operators.series import ordinal
from larkfold.scratch import placed, written

#: Rows of a block, and bytes of what blocks give that are handed on together.
BLOCK, HELD = 65_536, 8 << 20
#: Rows of a series that a task walks in order where only the true start of a block helps, about; rounds in which blocks start from guesses.
LAP, GUESSES = 1 << 20, 3


def pack(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: dict[str, Column | str], block: int = BLOCK) -> DataFrame:
    """(keys, _b, _first, an array for each column in order): block ``_b`` of a series and the ordinal of its first row. ``bucket`` is that of ``ordinal``."""
    of = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    rows = ordinal(df, keys, order, bucket).select(*keys, "_rn", *[c.alias(n) for n, c in of.items()])
    b = (F.col("_rn") / block).cast("long").alias("_b")
    packed = rows.groupBy(*keys, b).agg(F.array_sort(F.collect_list(F.struct("_rn", F.struct(*of).alias("_v")))).alias("_rows"))
    return packed.select(*keys, "_b", F.col("_rows._rn")[0].alias("_first"), *[F.col(f"_rows._v.{n}").alias(n) for n in of])


def each_block(blocks: DataFrame, walk: Callable[[dict], dict], fields: str) -> DataFrame:
    """Maps blocks: ``walk`` gets a row as {name: value} (arrays as Arrow arrays) and returns {name: values}, a row for each value."""
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                made = walk({n: v.values if isinstance(v, pa.ListScalar) else v.as_py() for n, v in row.items()})
                done.append(pa.RecordBatch.from_arrays([_array(made[f.name], f.type) for f in schema], schema=schema))
                size += done[-1].nbytes
                if size > HELD or len(done) == 4096:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done, size = [], 0
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return blocks.mapInArrow(run, fields)


def _array(values, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and isinstance(values, np.ndarray):
        flat = pa.array(values.ravel(), kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), flat)
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind, from_pandas=True)


def numbers(a: pa.Array) -> np.ndarray:
    """Doubles of an array, NaN where it has none."""
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def kinds(df: DataFrame, columns: list[str], of: Callable[[str], str] = lambda t: t) -> str:
    """DDL of columns; ``of`` changes each type."""
    have = dict(df.dtypes)
    return ", ".join(f"`{c}` {of(have[c])}" for c in columns)


def element(kind: str) -> str:
    return kind.removeprefix("array<").removesuffix(">")


def lapped(packed: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """Packed blocks, written in a folder for each lap of successive ones, ``_lap``."""
    return written(packed.withColumn("_lap", (F.col("_b") / max(1, LAP // block)).cast("long")), name, "_lap")


def with_entries(blocks: DataFrame, keys: list[str], leave: Callable[[dict, list[float] | None], list[float]], tolerance: float = 0.0, needs: list[str] | None = None, forgets: bool = True) -> DataFrame:
    """Blocks of series that a state machine walks, each with ``entry``, the state it starts from (null at the start of a series).

    ``leave`` walks a block from a state (None: no past) and returns the state at its end, as numbers; it gets the columns ``needs``. For machines that can't be composed in closed form:
    all blocks first walk without a past; a block that turns out to start from another state than it had walks again, until none does. A
    machine that forgets its past repeats each block once. One that never does (or still hasn't after GUESSES rounds) would repeat all that follows a block with each round,
    so it goes lap by lap, each block once and from its true start. Give it blocks that are ``lapped``, or each lap reads all of them.
    Ends must agree to the last bit, or within ``tolerance`` of their size, so the walk is that of the series in order.
    """
    pairs = f"{kinds(blocks, keys)}, _b long, entry array<double>, exit array<double>"
    lean = blocks.select(*keys, "_b", *(needs if needs is not None else [c for c in blocks.columns if c not in (*keys, "_b", "_lap")]), F.col("_lap") if "_lap" in blocks.columns else (F.col("_b") / 16).cast("long").alias("_lap"))
    entered = lambda known: blocks.join(known.select(*keys, "_b", "entry"), [*keys, "_b"])
    if not forgets:
        return entered(_in_laps(lean, keys, leave, pairs))

    def ends(row: dict) -> dict:
        entry = None if row["entry"] is None else row["entry"].to_pylist()
        return {k: [row[k]] for k in [*keys, "_b"]} | {"entry": [entry], "exit": [list(map(float, leave(row, entry)))]}

    known = written(each_block(lean.withColumn("entry", F.lit(None).cast("array<double>")), ends, pairs), "block-ends")
    before = Window.partitionBy(*keys).orderBy("_b")  # one row a block
    near = lambda x: F.abs(x["start"] - x["entry"]) <= tolerance * (F.abs(x["start"]) + F.abs(x["entry"]))
    same = F.col("start").eqNullSafe(F.col("entry"))
    if tolerance:
        same = same | F.coalesce((F.size("start") == F.size("entry")) & F.forall(F.arrays_zip("start", "entry"), near), F.lit(False))
    for _ in range(GUESSES):
        started = known.withColumn("start", F.lag("exit").over(before))
        stale = written(started.where(~same).select(*keys, "_b", F.col("start").alias("entry")), "block-starts")
        if stale.isEmpty():
            return entered(known)
        again = each_block(lean.join(stale, [*keys, "_b"]), ends, pairs)
        known = written(known.join(stale.select(*keys, "_b"), [*keys, "_b"], "left_anti").unionByName(again), "block-ends")
    if known.withColumn("start", F.lag("exit").over(before)).where(~same).isEmpty():
        return entered(known)
    return entered(_in_laps(lean, keys, leave, pairs))


def _in_laps(blocks: DataFrame, keys: list[str], leave: Callable[[dict, list[float] | None], list[float]], pairs: str) -> DataFrame:
    """(keys, _b, entry, exit): a task walks a lap of one series from where the lap before ended."""
    spark, schema = blocks.sparkSession, to_arrow_schema(StructType.fromDDL(pairs))

    def walk(lap: pa.Table) -> pa.Table:
        entry, out = lap["carry"][0].as_py(), []
        for i in np.argsort(lap["_b"].to_numpy()):
            row = {n: lap[n][int(i)] for n in lap.column_names}
            row = {n: v.values if isinstance(v, pa.ListScalar) else v.as_py() for n, v in row.items()}
            left = list(map(float, leave(row, entry)))
            out.append({k: row[k] for k in [*keys, "_b"]} | {"entry": entry, "exit": left})
            entry = left
        return pa.Table.from_pylist(out, schema)

    path = placed(spark, "block-ends")
    last = blocks.agg(F.max("_lap")).first()[0]
    carry = blocks.where("false").select(*keys, F.lit(None).cast("array<double>").alias("carry"))
    for lap in range(0 if last is None else last + 1):
        here = f"{path}/lap={lap}"
        blocks.where(F.col("_lap") == lap).join(carry, keys, "left").groupBy(*keys).applyInArrow(walk, pairs).write.parquet(here)
        carry = spark.read.schema(pairs).parquet(here).groupBy(*keys).agg(F.max_by("exit", "_b").alias("carry"))
    return blocks.where("false").select(*keys, "_b", F.lit(None).cast("array<double>").alias("entry")) if last is None else spark.read.schema(pairs).parquet(f"{path}/lap=*")


def pack_with_past(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: dict[str, Column | str], past: int, block: int = BLOCK) -> DataFrame:
    """As ``pack``, each block with up to ``past`` rows before it in front; ``_own`` is where its own rows start, ``_first`` the ordinal of the first one."""
    of = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    rows = ordinal(df, keys, order, bucket).select(*keys, "_rn", *[c.alias(n) for n, c in of.items()])
    b, at = (F.col("_rn") / block).cast("long"), F.col("_rn") % block
    reach = -(-past // block)  # blocks that a row is past of
    after = [F.when(at >= k * block - past, b + k) for k in range(1, reach + 1)]
    rows = rows.withColumn("_b", F.explode(F.array_compact(F.array(b, *after))))
    packed = rows.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("_rn", F.struct(*of).alias("_v")))).alias("_rows"))
    own = F.col("_rows._rn")
    packed = packed.withColumn("_own", F.size(F.filter(own, lambda r: r < F.col("_b") * block))).where(F.col("_own") < F.size("_rows"))
    return packed.select(*keys, "_b", "_own", own[0].alias("_first"), *[F.col(f"_rows._v.{n}").alias(n) for n in of])
