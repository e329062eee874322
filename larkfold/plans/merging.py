"""Queries of the canonical merge: two sources' quotes, with planted faults, to one feed, and its daily diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import merge
from larkfold.plans.registry import query
from larkfold.sources.adapters import DAY_MS, TICKS_SQL, ticks

HOUR = 3_600_000
#: The test quotes are hours apart and jump, so the limits are wide.
RULES = merge.MergeRules(bucket_ms=HOUR, max_spread=0.01, max_mid_diff=1.0, conflict=0.5)


def quotes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return ticks(spark, d).select(
        "symbol", "broker", "time_msc", "event_id",
        F.when(e % 17 == 0, None).when(e % 19 == 0, -F.col("bid")).otherwise(F.col("bid")).alias("bid"),
        F.when(e % 23 == 0, F.col("bid") * 0.9).when(e % 29 == 0, F.col("bid") * 1.5).otherwise(F.col("ask")).alias("ask"),
    )


def _score(s: str, prev: str) -> str:
    return (
        f"0.4 * (1 - least(abs({s}_t - bucket * {HOUR}) / {HOUR}, 1.0)) + 0.3 * greatest(0, 1 - ({s}_ask - {s}_bid) / mid_{s} / 0.01)"
        f" + 0.3 * CASE WHEN {prev} > 0 THEN greatest(0, 1 - abs(mid_{s} - {prev}) / {prev} / 1.0) ELSE 0.5 END"
    )


def _chosen(prev: str) -> str:
    """The columns of a step of the recursion, from a row of v and the mid before."""
    a, b = _score("a", prev), _score("b", prev)
    side = f"CASE WHEN NOT valid_b THEN 0 WHEN NOT valid_a THEN 1 WHEN ({a}) >= ({b}) THEN 0 ELSE 1 END"
    return f"{side} AS side, CASE WHEN {side} = 0 THEN {a} ELSE {b} END AS q, CASE WHEN {side} = 0 THEN mid_a ELSE mid_b END AS mid"


_PICK = ", ".join(f"max(CASE WHEN broker = '{s}' THEN {c} END) AS {s}_{n}" for s in "ab" for c, n in (("bid", "bid"), ("ask", "ask"), ("time_msc", "t")))
_VALID = ", ".join(
    f"{s}_t IS NOT NULL AS has_{s}, coalesce({s}_bid > 0 AND {s}_ask > 0 AND {s}_bid <= {s}_ask AND ({s}_ask - {s}_bid) / (({s}_bid + {s}_ask) / 2) <= 0.01, false) AS valid_{s}, ({s}_bid + {s}_ask) / 2 AS mid_{s}" for s in "ab"
)
MERGE_SQL = f"""{TICKS_SQL}, quotes AS (SELECT symbol, broker, time_msc, event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -bid ELSE bid END AS bid,
  CASE WHEN event_id % 23 = 0 THEN bid * 0.9 WHEN event_id % 29 = 0 THEN bid * 1.5 ELSE ask END AS ask FROM ticks),
 lastq AS (SELECT *, time_msc // {HOUR} AS bucket FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, time_msc // {HOUR}, broker ORDER BY time_msc DESC, event_id DESC) = 1),
 b AS (SELECT symbol, bucket, {_PICK} FROM lastq GROUP BY ALL), f AS (SELECT *, {_VALID} FROM b),
 v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn FROM f WHERE valid_a OR valid_b),
 r AS (SELECT symbol, rn, {_chosen("NULL::DOUBLE")} FROM v WHERE rn = 1 UNION ALL SELECT v.symbol, v.rn, {_chosen("r.mid").replace("mid_", "v.mid_")} FROM r JOIN v ON v.symbol = r.symbol AND v.rn = r.rn + 1),
 m AS (SELECT symbol, bucket, side, q, valid_a AND valid_b AS two, CASE WHEN side = 0 THEN a_bid ELSE b_bid END AS bid, CASE WHEN side = 0 THEN a_ask ELSE b_ask END AS ask,
   a_bid, a_ask, b_bid, b_ask, mid_a, mid_b, coalesce(valid_a AND valid_b AND abs(mid_a - mid_b) / ((mid_a + mid_b) / 2) > 0.5, false) AS conflict FROM v JOIN r USING (symbol, rn))"""


@query("j01_canonical_merge", f"""WITH RECURSIVE {MERGE_SQL} SELECT symbol, bucket, round(bid, 6) AS bid, round(ask, 6) AS ask, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS source_primary,
  CASE WHEN NOT two THEN '' WHEN side = 0 THEN 'b' ELSE 'a' END AS source_secondary, CASE WHEN NOT two THEN 'single' WHEN conflict THEN 'conflict' ELSE 'best' END AS merge_mode, round(q, 6) AS quality_score, conflict AS conflict_flag,
  {", ".join(f"round(CASE WHEN two THEN {s}_{c} ELSE 0 END, 6) AS broker_{s}_{c}" for s in "ab" for c in ("bid", "ask"))}, round(CASE WHEN two THEN abs(mid_a - mid_b) ELSE 0 END, 6) AS mid_diff,
  round(CASE WHEN two THEN abs((a_ask - a_bid) - (b_ask - b_bid)) ELSE 0 END, 6) AS spread_diff FROM m""")  # fmt: skip
def j01_merge(spark: SparkSession, d: str) -> DataFrame:
    """The recursive merge of both sources, over the whole series of each symbol."""
    m = merge.merge_sources(merge.last_per_bucket(quotes(spark, d), HOUR), RULES)
    return m.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in m.dtypes])


@query("a07_canonical_diagnostics", f"""WITH RECURSIVE {MERGE_SQL}, k AS (SELECT symbol, bucket * {HOUR} // {DAY_MS} AS day, *, CASE WHEN has_a AND has_b THEN abs(a_t - b_t) END AS off FROM f),
 c AS (SELECT symbol, day, {HOUR} AS bucket_ms, {", ".join(f"sum(({cond})::INT)::BIGINT AS {n}" for n, cond in (
    ("bucket_a_only", "has_a AND NOT has_b"), ("bucket_b_only", "has_b AND NOT has_a"), ("bucket_both", "has_a AND has_b"), ("bucket_both_valid", "has_a AND has_b AND valid_a AND valid_b"),
    ("bucket_both_downgraded_to_single", "has_a AND has_b AND valid_a <> valid_b"), ("bucket_both_rejected", "has_a AND has_b AND NOT valid_a AND NOT valid_b"), ("bucket_invalid_a", "has_a AND NOT valid_a"),
    ("bucket_invalid_b", "has_b AND NOT valid_b")))}, bucket_invalid_a + bucket_invalid_b AS validation_reject_count, coalesce(quantile_cont(off, 0.5), 0)::DOUBLE AS median_offset_both_ms,
   coalesce(list_sort(list(off) FILTER (off IS NOT NULL))[CAST(floor((count(off) - 1) * 0.95 + 0.5) AS BIGINT) + 1], 0)::DOUBLE AS p95_offset_both_ms FROM k GROUP BY ALL),
 mi AS (SELECT symbol, day, count(*) AS n FROM (SELECT symbol, time_msc // {DAY_MS} AS day, time_msc // 60000 AS minute FROM quotes GROUP BY ALL HAVING count(DISTINCT broker) = 2) GROUP BY ALL),
 qa AS (SELECT symbol, time_msc // {DAY_MS} AS day, time_msc AS t, event_id FROM quotes WHERE broker = 'a'), qb AS (SELECT DISTINCT symbol, time_msc // {DAY_MS} AS day, time_msc AS t FROM quotes WHERE broker = 'b'),
 n1 AS (SELECT qa.*, qb.t AS back FROM qa ASOF LEFT JOIN qb ON qa.symbol = qb.symbol AND qa.day = qb.day AND qa.t >= qb.t), n2 AS (SELECT n1.*, qb.t AS next FROM n1 ASOF LEFT JOIN qb ON n1.symbol = qb.symbol AND n1.day = qb.day AND n1.t <= qb.t),
 nm AS (SELECT symbol, day, count(*) AS n FROM (SELECT *, least(coalesce(t - back, 9e15::BIGINT), coalesce(next - t, 9e15::BIGINT)) AS off FROM n2) WHERE off > {HOUR} AND off <= {5 * HOUR} GROUP BY ALL),
 o AS (SELECT symbol, bucket * {HOUR} // {DAY_MS} AS day, count(*) AS rows_, sum(two::INT)::BIGINT AS dual, sum(conflict::INT)::BIGINT AS conflicts FROM m GROUP BY ALL)
 SELECT c.*, coalesce(mi.n, 0) AS wallclock_overlap_minutes, coalesce(nm.n, 0) AS near_miss_pairs, coalesce(o.rows_, 0) AS canonical_rows, coalesce(dual, 0) AS canonical_dual_rows, coalesce(conflicts, 0) AS conflicts,
  round(coalesce(dual / nullif(rows_, 0), 0), 8) AS dual_source_ratio FROM c LEFT JOIN mi USING (symbol, day) LEFT JOIN nm USING (symbol, day) LEFT JOIN o USING (symbol, day)""")  # fmt: skip
def a07_canonical(spark: SparkSession, d: str) -> DataFrame:
    """What the merge saw and did, by symbol and day."""
    return merge.diagnostics(quotes(spark, d), RULES)
