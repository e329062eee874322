"""Mixing sources to target weights by weighted fair queueing (operator 4).

Every source is a queue of its documents in shuffled (hashed) order. A document's virtual
finish time is the cumulative size of its source up to it, divided by the source's target;
a source short of its target is queued again from the start, up to ``max_repeats`` times, and its last
document is served if most of it fits its target. All services, sorted by finish time over all sources, are truncated at the
total budget, the sum of all sizes.

The truncation needs no running total over all rows. What finishes by time 1 is within every source's target, so within the
budget; later than that a source finishes one service at most, that of the document that straddles its target. So the total
at time 1, a sum over sources, and the straddlers' sizes in order of finish time, one row a source, say which straddlers the
budget holds. ``mix_sources`` range-sorts what is left by finish time.

Cumulative sums run in two steps (sums over hash ranges of a source, then inside a range),
so a source with a third of all rows is never in one task.

Defined cases: a null source is a source of its own, ranked last; a null text has size 0
and takes part with its zero words; rows with a null key come last in the queue of their source, by size; equal rows follow each
other in the queue; an empty table gives an empty result; kept columns travel as one struct, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from larkfold.llm.common import cut, whole_row, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Hash ranges of one source.
RANGES = 4096
#: Rows without a key from this size on are one range.
LARGEST = 1 << 20


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets for a table of (source, source_size), one row a source.

    Shares of the total by weight; a target above ``max_repeats`` times its source's size
    stops there and the excess is reshared by weight. In order of cap / weight that has
    a closed form: the sources that stop are a prefix, and the rest share what is left at the
    first that doesn't (the level only falls after it).
    The windows run over one row a source.
    """
    ranked = sizes.withColumn(
        "w",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"),
        ),
    ).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.withColumns(
        {
            "budget": F.sum("source_size").over(Window.partitionBy()).cast("double"),
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_w": F.sum("w").over(after),
        }
    ).withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left_w"))
    stops = F.col("cap") <= F.col("level") * F.col("w")
    shared = F.max(F.when(~stops, F.col("level"))).over(Window.partitionBy())
    return level.select(
        "source",
        "source_size",
        F.round(F.when(stops, F.col("cap")).otherwise(shared * F.col("w")), 6).alias("target"),
    )


def _straddlers(rows: DataFrame, starts: DataFrame, inside: WindowSpec, size: Column, max_repeats: int) -> DataFrame:
    """(_k, over): for each source whose target falls inside a document, when that service finishes past the target, if the
    total budget holds it. rows: (row, _k, _r, _o, _id); starts: (_k, _r, _start, _s, source_size, target)."""
    turn = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))
    starts = starts.where("target > 0").withColumns({"_turn": turn, "_x": F.col("target") - turn * F.col("source_size")})
    crossed = starts.where((F.col("_start") < F.col("_x")) & (F.col("_x") < F.col("_start") + F.col("_s")))
    crossed = cut(crossed, "mixing-crossed")  # one range a source at most; written, so that its size is known and decides how the rows meet it
    # sizes are taken again, of the few rows only that are in such a range
    met = rows.join(crossed, ["_k", "_r"])
    rows = met.select("row.*", F.struct(*[c for c in met.columns if c != "row"]).alias("_mixing")).select(size.alias("size"), "_mixing.*")
    rows = rows.withColumn("_end", F.col("_start") + F.sum("size").over(inside)).where((F.col("_end") - F.col("size") < F.col("_x")) & (F.col("_x") < F.col("_end")))
    crossing = rows.select("_k", (F.col("_x") - F.col("_end") + F.col("size")).alias("short"), (F.col("_turn") * F.col("source_size") + F.col("_end")).alias("over"), "size", "_end", "_x")
    # one row a source from here on
    targets = starts.select("_k", "target").distinct().join(crossing, "_k", "left")
    served = F.round(F.sum(F.col("target") - F.coalesce("short", F.lit(0.0))).over(Window.partitionBy())).cast("long")
    most_fits = F.coalesce(F.col("_end") - F.col("size") / 2 <= F.col("_x"), F.lit(False))
    order = Window.orderBy(~F.col("_most"), F.col("over") / F.col("target"), F.col("_k") == "n", "_k").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.round(F.sum("target").over(Window.partitionBy())).cast("long")
    ranked = targets.withColumns({"_most": most_fits, "_served": served, "_budget": budget}).withColumn("_total", F.col("_served") + F.sum(F.when(F.col("_most"), F.col("size")).otherwise(0)).over(order))
    return ranked.where(F.col("_most") & (F.col("_total") <= F.col("_budget"))).select("_k", F.col("over").cast("long").alias("over"))


def fair_queue(
    docs: DataFrame,
    size: Column | None = None,
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    ranges: int = RANGES,
    keep: bool = False,
) -> DataFrame:
    """Every row as (key, source, size, source_size, target, finish): ``finish`` holds the
    virtual finish times of the repeats that are taken, at most 1 but for a straddler. With ``keep``, a last column ``row`` holds the whole row."""
    size = word_count(F.col("text")) if size is None else size
    size = size.cast("long")
    rows = docs.select(whole_row(docs), F.col(key).alias("_id"), F.col(source).alias("source"), size.alias("size"))
    order = F.md5(F.col("_id").cast("string"))
    rows = rows.withColumns({"_o": F.coalesce(order, F.lit("g")), "_k": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))})
    of_hash = (F.conv(F.substring("_o", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int")
    # rows without a key are queued by size, and so are their ranges: many of them aren't one range
    of_size = F.lit(ranges) + F.least(F.coalesce("size", F.lit(0)), F.lit(LARGEST)).cast("int")
    rows = rows.withColumn("_r", F.when(F.col("_id").isNull(), of_size).otherwise(of_hash))
    slim = rows.drop("row")
    sums = slim.groupBy("_k", "source", "_r").agg(F.sum("size").alias("_s"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, max_repeats).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_k"), "source_size", "target"
    )
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_k", "_r", "_s", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start")).join(targets, "_k")
    starts = cut(starts, "mixing-starts")  # ``ranges`` rows a source
    inside = Window.partitionBy("_k", "_r").orderBy("_o", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    over = _straddlers(rows.drop("source", "size"), starts, inside, size, max_repeats)
    queued = (rows if keep else slim).join(starts.join(over, "_k", "left").drop("_s"), ["_k", "_r"]).withColumn("_end", F.col("_start") + F.sum("size").over(inside))
    ends = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: e * F.col("source_size") + F.col("_end"))
    taken = F.filter(ends, lambda end: (end <= F.col("target")) | F.coalesce((end == F.col("over")) & (end - F.col("size") < F.col("target")), F.lit(False)))
    finish = F.when(F.col("target") > 0, F.transform(taken, lambda end: end / F.col("target"))).otherwise(
        F.array().cast("array<double>")
    )
    return queued.select(F.col("_id").alias(key), "source", "size", "source_size", "target", finish.alias("finish"), *(["row"] if keep else []))


def mix_sources(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, range-sorted by virtual finish time."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("_finish", f"row.{options.get('key', 'doc_id')}")
    served = fair_queue(docs, keep=True, **options).select("row", F.explode("finish").alias("_finish"))
    return served.repartitionByRange(n, *order).sortWithinPartitions(*order).select("row.*")
