"""Two quote sources to one feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.operators.joins import asof_nearest
from larkfold.operators.series import BLOCK, ordinal

DAY_MS = 86_400_000
SIDES = ("a", "b")


@dataclass(frozen=True)
class MergeRules:
    """Bucket width, what makes a quote valid, weights of a quote's score, and the share of the average mid from which two mids conflict."""

    bucket_ms: int = 100
    max_spread: float = 0.005
    max_mid_diff: float = 0.002
    freshness: float = 0.4
    spread: float = 0.3
    continuity: float = 0.3
    conflict: float = 0.001
    near_miss_factor: int = 5
    prefer: str = "a"


def last_per_bucket(ticks: DataFrame, bucket_ms: int, sources: tuple[str, str] = SIDES, extra: tuple[str, ...] = ()) -> DataFrame:
    """The last quote of each source in each bucket side by side: one aggregate on (symbol, bucket), which is the full outer join of both sides."""
    o = F.struct("time_msc", "event_id")
    pick = lambda c, s: F.max_by(F.when(F.col("broker") == s, F.col(c)), F.when(F.col("broker") == s, o))
    aggs = [pick(c, s).alias(f"{s}_{c}") for s in sources for c in ("bid", "ask", "time_msc", *extra)]
    return ticks.groupBy("symbol", F.floor(F.col("time_msc") / bucket_ms).alias("bucket")).agg(*aggs)


def validated(buckets: DataFrame, rules: MergeRules) -> DataFrame:
    """Adds, for each side, whether it has a quote (``has_``), whether it is valid, and the mid of a valid quote."""
    for s in SIDES:
        bid, ask = F.col(f"{s}_bid"), F.col(f"{s}_ask")
        mid = (bid + ask) / 2
        ok = (bid > 0) & (ask > 0) & (bid <= ask) & (F.try_divide(ask - bid, mid) <= rules.max_spread)
        buckets = buckets.withColumns({f"has_{s}": F.col(f"{s}_time_msc").isNotNull(), f"valid_{s}": F.coalesce(ok, F.lit(False))})
        buckets = buckets.withColumn(f"mid_{s}", F.when(F.col(f"valid_{s}"), mid))
    return buckets


def _score(side: str, before: Column, rules: MergeRules) -> Column:
    """Freshness (counted from the start of the bucket), tightness, and closeness to the mid emitted before (a half if there is none)."""
    mid = F.col(f"mid_{side}")
    fresh = 1 - F.least(F.abs(F.col(f"{side}_time_msc") - F.col("bucket") * rules.bucket_ms) / rules.bucket_ms, F.lit(1.0))
    tight = F.greatest(F.lit(0.0), 1 - (F.col(f"{side}_ask") - F.col(f"{side}_bid")) / mid / rules.max_spread)
    close = F.when(before > 0, F.greatest(F.lit(0.0), 1 - F.abs(mid - before) / before / rules.max_mid_diff)).otherwise(0.5)
    return rules.freshness * fresh + rules.spread * tight + rules.continuity * close


def _choice(before: Column, rules: MergeRules) -> Column:
    """0 for side a, 1 for side b."""
    a, b = _score("a", before, rules), _score("b", before, rules)
    tie = F.lit(SIDES.index(rules.prefer))
    return F.when(~F.col("valid_b"), 0).when(~F.col("valid_a"), 1).when(a > b, 0).when(b > a, 1).otherwise(tie)


def merge_sources(buckets: DataFrame, rules: MergeRules, block: int = BLOCK) -> DataFrame:
    """One quote for each bucket with a valid one, with its score, mode and what the other source had.

    A bucket's choice depends on the mid emitted before it, which is one of the two mids of the bucket before. So a bucket maps the
    side chosen before to the side chosen now: always a, always b, the same, or the other. The side chosen is that of the last
    bucket that decides by itself, turned once for each ``other`` since. Both are found inside blocks of rows and carried over blocks by one
    row a block, so neither a symbol nor a day is walked in order, and nothing restarts anywhere.
    """
    day = F.floor(F.col("bucket") * rules.bucket_ms / DAY_MS)
    b = validated(buckets, rules).where("valid_a or valid_b")
    b = ordinal(b, ["symbol"], ["bucket"], day)
    number, at = (F.col("_rn") / block).cast("long"), F.col("_rn") % block
    homes = F.array(F.struct(number.alias("b"), F.lit(False).alias("halo")), F.when(at == block - 1, F.struct((number + 1).alias("b"), F.lit(True).alias("halo"))))
    b = b.withColumn("_h", F.explode(F.filter(homes, lambda h: h.isNotNull()))).withColumns({"_b": F.col("_h.b"), "_halo": F.col("_h.halo")})
    w = Window.partitionBy("symbol", "_b").orderBy("_rn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"_pa": F.lag("mid_a").over(w), "_pb": F.lag("mid_b").over(w)}).where("not _halo")
    # what can't have been chosen before maps like the other
    b = b.withColumns({"_if_a": _choice(F.coalesce("_pa", "_pb"), rules), "_if_b": _choice(F.coalesce("_pb", "_pa"), rules)})
    b = b.withColumn("_turns", F.sum(((F.col("_if_a") == 1) & (F.col("_if_b") == 0)).cast("long")).over(upto))
    own = F.when(F.col("_if_a") == F.col("_if_b"), F.pmod(F.col("_if_a") + F.col("_turns"), F.lit(2)))
    b = b.withColumn("_own", F.last(own, ignorenulls=True).over(upto))
    ends = b.groupBy("symbol", "_b").agg(F.max_by("_own", "_rn").alias("_end"), F.max_by("_turns", "_rn").alias("_all"))
    blocks = Window.partitionBy("symbol").orderBy("_b")
    ends = ends.withColumn("_past", F.sum("_all").over(blocks))
    ends = ends.withColumn("_end", F.pmod(F.col("_end") + F.col("_all") + F.col("_past"), F.lit(2)))
    entering = F.pmod(F.last("_end", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)) + F.col("_past") - F.col("_all"), F.lit(2))
    b = b.join(ends.select("symbol", "_b", entering.alias("_in")), ["symbol", "_b"])
    b = b.withColumn("_side", F.pmod(F.coalesce("_own", "_in") + F.col("_turns"), F.lit(2)))
    b = b.withColumn("_was", F.coalesce(F.lag("_side").over(w), F.col("_in")))
    before = F.when(F.col("_was") == 0, F.col("_pa")).when(F.col("_was") == 1, F.col("_pb"))
    is_a, both = F.col("_side") == 0, F.col("valid_a") & F.col("valid_b")
    of = lambda c: F.when(is_a, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    apart = F.abs(F.col("mid_a") - F.col("mid_b"))
    conflict = F.coalesce(both & (apart / ((F.col("mid_a") + F.col("mid_b")) / 2) > rules.conflict), F.lit(False))
    given = lambda c: F.when(both, F.col(c)).otherwise(0.0)
    spread = lambda s: F.col(f"{s}_ask") - F.col(f"{s}_bid")
    return b.select(
        "symbol", "bucket", of("bid").alias("bid"), of("ask").alias("ask"), F.when(is_a, "a").otherwise("b").alias("source_primary"),
        F.when(~both, "").when(is_a, "b").otherwise("a").alias("source_secondary"),
        F.when(~both, "single").when(conflict, "conflict").otherwise("best").alias("merge_mode"),
        F.when(is_a, _score("a", before, rules)).otherwise(_score("b", before, rules)).alias("quality_score"), conflict.alias("conflict_flag"),
        *[given(f"{s}_{c}").alias(f"broker_{s}_{c}") for s in SIDES for c in ("bid", "ask")],
        F.when(both, apart).otherwise(0.0).alias("mid_diff"), F.when(both, F.abs(spread("a") - spread("b"))).otherwise(0.0).alias("spread_diff"),
    )


def co_presence(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Which sources the buckets have, and how far apart their quotes are. Offsets are below the bucket's width, which bounds the median's state."""
    a, b = F.col("a_bid").isNotNull(), F.col("b_bid").isNotNull()
    off = F.when(a & b, F.abs(F.col("a_time_msc") - F.col("b_time_msc")))
    n = lambda c: F.sum(c.cast("long"))
    return buckets.groupBy(*by).agg(
        n(a & ~b).alias("only_a"), n(b & ~a).alias("only_b"), n(a & b).alias("both"), F.percentile(off, F.lit(0.5)).alias("median_offset_ms"), F.max(off).alias("max_offset_ms")
    )


def diagnostics(ticks: DataFrame, rules: MergeRules) -> DataFrame:
    """Twenty measures of each symbol and day of a merge: presence and validity of the sources by bucket, offsets (the 95 % one by nearest rank),
    minutes both have, ticks whose nearest of the other source is outside the bucket but near, and what the merge emits."""
    step = rules.bucket_ms
    day = lambda ms: F.floor(F.col(ms) / DAY_MS).alias("day")
    b = validated(last_per_bucket(ticks, step), rules).withColumn("day", F.floor(F.col("bucket") * step / DAY_MS))
    has_a, has_b, ok_a, ok_b = (F.col(c) for c in ("has_a", "has_b", "valid_a", "valid_b"))
    n = lambda c: F.sum(c.cast("long"))
    both = has_a & has_b
    off = F.when(both, F.abs(F.col("a_time_msc") - F.col("b_time_msc")))
    counts = b.groupBy("symbol", "day").agg(
        n(has_a & ~has_b).alias("bucket_a_only"), n(has_b & ~has_a).alias("bucket_b_only"), n(both).alias("bucket_both"), n(both & ok_a & ok_b).alias("bucket_both_valid"),
        n(both & (ok_a != ok_b)).alias("bucket_both_downgraded_to_single"), n(both & ~ok_a & ~ok_b).alias("bucket_both_rejected"),
        n(has_a & ~ok_a).alias("bucket_invalid_a"), n(has_b & ~ok_b).alias("bucket_invalid_b"), F.coalesce(F.percentile(off, F.lit(0.5)), F.lit(0.0)).alias("median_offset_both_ms"),
    )
    # one row for each offset of a day: fewer than the bucket has milliseconds
    offs = b.where(both).groupBy("symbol", "day", off.alias("off")).agg(F.count("*").alias("c"))
    of_day = Window.partitionBy("symbol", "day")
    at = offs.withColumns({"_upto": F.sum("c").over(of_day.orderBy("off")), "_n": F.sum("c").over(of_day)})
    p95 = at.where(F.col("_upto") > F.floor((F.col("_n") - 1) * 0.95 + 0.5)).groupBy("symbol", "day").agg(F.min("off").cast("double").alias("p95_offset_both_ms"))
    minutes = ticks.groupBy("symbol", day("time_msc"), F.floor(F.col("time_msc") / 60_000).alias("minute")).agg((F.min("broker") != F.max("broker")).alias("two"))
    minutes = minutes.groupBy("symbol", "day").agg(F.sum(F.col("two").cast("long")).alias("wallclock_overlap_minutes"))
    t = ticks.select("symbol", day("time_msc"), F.col("time_msc").alias("t"), "broker")
    left, right = t.where("broker = 'a'").drop("broker"), t.where("broker = 'b'").select("symbol", "day", "t").distinct().withColumn("one", F.lit(1))
    apart = F.abs(F.col("t") - F.col("t_matched"))
    near = asof_nearest(left, right, ["symbol", "day"], "t", ["one"], DAY_MS // 24).where((apart > step) & (apart <= max(step * max(rules.near_miss_factor, 2), step + 1)))
    near = near.groupBy("symbol", "day").agg(F.count("*").alias("near_miss_pairs"))
    out = merge_sources(last_per_bucket(ticks, step), rules).groupBy("symbol", F.floor(F.col("bucket") * step / DAY_MS).alias("day")).agg(
        F.count("*").alias("canonical_rows"), n(F.col("source_secondary") != "").alias("canonical_dual_rows"), n(F.col("conflict_flag")).alias("conflicts")
    )
    for other in (p95, minutes, near, out):
        counts = counts.join(other, ["symbol", "day"], "left")
    counts = counts.fillna(0).withColumn("validation_reject_count", F.col("bucket_invalid_a") + F.col("bucket_invalid_b"))
    return counts.withColumns({"bucket_ms": F.lit(step), "dual_source_ratio": F.round(F.coalesce(F.try_divide("canonical_dual_rows", "canonical_rows"), F.lit(0.0)), 8)})
