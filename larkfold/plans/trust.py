"""Queries: the trust gate of a dataset and the trainability of its feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import trust as T
from larkfold.operators.series import full
from larkfold.plans.registry import query
from larkfold.plans.series import W, bar_bucket, over_bars, rows
from larkfold.sources.adapters import BARS_SQL, DAY_MS, TICKS_SQL, ticks

HOUR = 3_600_000
CUTS = ("1998-07-01", "2000-01-01")
FAMILIES = (
    T.Family("quality", ("range_share",), "fail"),
    T.Family("multiscale", ("z_20", "z_60"), "allow", 60),
    T.Family("activity", ("tick_count", "busy"), "allow", 1),
)


def dataset(spark: SparkSession, d: str) -> DataFrame:
    """Bars with features of three families, a label of the return over the next five bars, and splits by date."""
    c = F.col("close")

    def columns(w):
        z = lambda n: F.try_divide(c - full(F.avg, c, w, n), full(F.stddev_samp, c, w, n))
        return {"z_20": z(20), "z_60": z(60), "range_share": (F.col("high") - F.col("low")) / c, "busy": (F.col("tick_count") >= 3).cast("int"), "label_5": F.lead("close", 5).over(w) / c - 1}

    split = F.when(F.col("day") < CUTS[0], "train").when(F.col("day") < CUTS[1], "val").otherwise("test")
    return over_bars(spark, d, columns, 60, 5).withColumn("split", split)


DATA_SQL = f"""{BARS_SQL}, data AS (SELECT symbol, day, tick_count, (tick_count >= 3)::INT AS busy, (high - low) / close AS range_share, lead(close, 5) OVER ({W}) / close - 1 AS label_5,
  {", ".join(f"CASE WHEN count(*) OVER {rows(n)} >= {n} AND stddev_samp(close) OVER {rows(n)} <> 0 THEN (close - avg(close) OVER {rows(n)}) / stddev_samp(close) OVER {rows(n)} END AS z_{n}" for n in (20, 60))},
  CASE WHEN day < DATE '{CUTS[0]}' THEN 'train' WHEN day < DATE '{CUTS[1]}' THEN 'val' ELSE 'test' END AS split FROM bars)"""


@query("x05_trust_gate", f"""WITH {DATA_SQL}, {TICKS_SQL}, r AS (SELECT count(*) AS n, count(*) FILTER (split = 'train') AS n0, count(*) FILTER (split = 'val') AS n1, count(*) FILTER (split = 'test') AS n2,
  max(day) FILTER (split = 'train') AS z0, min(day) FILTER (split = 'val') AS a1, max(day) FILTER (split = 'val') AS z1, min(day) FILTER (split = 'test') AS a2, count(*) - count(label_5) AS nulls, count(label_5) AS labels,
  100 * (count(*) - count(range_share)) / count(*) AS q, round(100 * (2 * count(*) - count(z_20) - count(z_60)) / (2 * count(*)), 4) AS m, round(100 * (2 * count(*) - count(tick_count) - count(busy)) / (2 * count(*)), 4) AS v FROM data),
 k AS (SELECT sum(n - 1) AS twice, sum(s - 1) AS shared FROM (SELECT count(*) AS n, count(DISTINCT split) AS s FROM data GROUP BY symbol, day)),
 h AS (SELECT time_msc // {DAY_MS} AS d, count(DISTINCT broker) AS b FROM ticks GROUP BY d, time_msc // {HOUR}), days AS (SELECT d, avg((b = 2)::INT) AS ratio, sum((b = 2)::INT) AS both FROM h GROUP BY d),
 c AS (SELECT count(*) AS dates, sum((b = 2)::INT) AS common FROM (SELECT time_msc // {DAY_MS} AS d, count(DISTINCT broker) AS b FROM ticks GROUP BY d)),
 s AS (SELECT round(least(greatest(70 + greatest(least(avg(ratio) * 100, 100) - 50, 0) * 0.10 + greatest(least(round(any_value(common / dates), 6) * 100, 100) - 50, 0) * 0.05, 0), 100), 4) AS source FROM days, c),
 t AS (SELECT *, CASE WHEN n > 0 AND n0 > 0 AND n1 > 0 AND n2 > 0 THEN 100.0 ELSE 0 END AS coverage, CASE WHEN coalesce(z0 >= a1, false) OR coalesce(z1 >= a2, false) OR shared > 0 THEN 0 ELSE 100.0 END AS integrity,
  CASE WHEN q > 0 OR m > 10 THEN 0 ELSE round(greatest(100 - least(m, 20) - least(v / 10, 20), 0), 4) END AS missing, CASE WHEN labels = 0 THEN 0 WHEN nulls > 0 THEN 80.0 ELSE 100.0 END AS label FROM r, k, s),
 u AS (SELECT *, CASE WHEN twice > 0 OR integrity = 0 THEN 0 ELSE 100.0 END AS leakage FROM t), x AS (SELECT *, round(coverage * 0.2 + leakage * 0.2 + round((200 + missing) / 3, 4) * 0.2 + label * 0.15 + source * 0.1 + 100 * 0.15, 4) AS total FROM u),
 o AS (SELECT unnest(['coverage', 'split_integrity', 'leakage', 'feature_contracts', 'feature_family_missingness', 'warmup_and_row_loss', 'label_quality', 'source_quality', 'lineage', 'manifest_integrity', 'total']) AS "check",
  unnest([coverage, integrity, leakage, 100, missing, 100, label, source, 100, 100, total]::DOUBLE[]) AS score,
  unnest([CASE WHEN coverage = 0 THEN 'failed' ELSE 'passed' END, CASE WHEN integrity = 0 THEN 'failed' ELSE 'passed' END, CASE WHEN leakage = 0 THEN 'failed' ELSE 'passed' END, 'passed', CASE WHEN missing = 0 THEN 'failed' WHEN m > 7.5 THEN 'warning' ELSE 'passed' END, 'passed',
   CASE WHEN label = 0 THEN 'failed' WHEN label = 80 THEN 'warning' ELSE 'passed' END, CASE WHEN source < 60 THEN 'failed' WHEN source < 75 THEN 'warning' ELSE 'passed' END, 'passed', 'passed',
   CASE WHEN total >= 80 AND coverage >= 85 AND leakage = 100 AND integrity = 100 AND round((200 + missing) / 3, 4) >= 80 AND missing > 0 AND label >= 80 AND source >= 60 THEN 'accepted' ELSE 'rejected' END]) AS status FROM x)
 SELECT "check", status, round(score, 2) AS score FROM o""")  # fmt: skip
def x05_gate(spark: SparkSession, d: str) -> DataFrame:
    """The ten checks over a dataset and its sources, and the decision."""
    t = ticks(spark, d)
    raw = t.select(F.col("broker").alias("source"), F.floor(F.col("time_msc") / DAY_MS).alias("date"))
    both = t.groupBy(F.floor(F.col("time_msc") / DAY_MS).alias("d"), F.floor(F.col("time_msc") / HOUR)).agg(F.count_distinct("broker").alias("b"))
    dual = (F.col("b") == 2).cast("long")
    days = both.groupBy("d").agg(F.avg(dual).alias("dual_ratio"), F.lit(0.0).alias("conflicts"), F.sum(dual).alias("both"), F.sum(dual).alias("dual_rows"))
    spec = T.GateSpec(("symbol",), "day", FAMILIES, ("label_5",), sources=("a", "b"))
    report = T.gate(dataset(spark, d), spec, T.Built(lineage=dict.fromkeys(T.LINEAGE, 1)), raw, days)
    made = [(c.name, c.status, c.score) for c in report.checks] + [("total", "accepted" if report.accepted else "rejected", report.scores["total"])]
    return spark.createDataFrame(made, "check string, status string, score double").withColumn("score", F.round("score", 2))


def _family_sql(f: T.Family) -> str:
    warm = f"i >= {max(f.warmup - 1, 0)}"
    some = " + ".join(f"count({c}) FILTER ({warm})" for c in f.columns)
    pick = lambda test: f"list_sort(list_filter([{', '.join(f'CASE WHEN {test(c)} THEN {c!r} END' for c in f.columns)}], lambda x: x IS NOT NULL))"
    return f"""SELECT '{f.name}' AS family, count(*) AS rows_total, count(*) FILTER ({warm}) AS rows_warm, round(count(*) FILTER ({warm} AND {" AND ".join(f"{c} IS NOT NULL" for c in f.columns)}) / count(*) FILTER ({warm}), 6) AS complete_ratio,
 round(({some}) / (count(*) FILTER ({warm}) * {len(f.columns)}), 6) AS non_null_ratio, {pick(lambda c: f"count(DISTINCT {c}) FILTER ({warm}) = 1")} AS constant, {pick(lambda c: f"count(DISTINCT {c}) FILTER ({warm}) IN (2, 3)")} AS low_variation,
 {pick(lambda c: f"round(count({c}) FILTER ({warm}) / count(*) FILTER ({warm}), 6) < 0.75")} AS null_heavy, count(*) <= {f.warmup} AS short, {len(f.columns)} AS n FROM r"""


@query("a13_trainability", f"""WITH {DATA_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY day, symbol) - 1 AS i FROM data), f AS ({" UNION ALL ".join(map(_family_sql, FAMILIES))})
 SELECT family, rows_total, rows_warm, complete_ratio, non_null_ratio, array_to_string(constant, ',') AS constant, array_to_string(low_variation, ',') AS low_variation, array_to_string(null_heavy, ',') AS null_heavy,
 array_to_string(list_filter([CASE WHEN short THEN 'insufficient_rows_vs_warmup' END, CASE WHEN len(null_heavy) > 0 THEN 'post_warmup_null_heavy_columns' END, CASE WHEN len(constant) > 0 THEN 'constant_columns_present' END,
  CASE WHEN len(constant) = n THEN 'family_degenerate_all_constant' END, CASE WHEN len(low_variation) > 0 THEN 'low_variation_columns_present' END, CASE WHEN complete_ratio < 0.75 THEN 'incomplete_rows_post_warmup' END], lambda x: x IS NOT NULL), ',') AS warnings FROM f""")  # fmt: skip
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Which feature families can be learned from after their warm-up."""
    out = T.trainability(dataset(spark, d), FAMILIES, ["day", "symbol"], bar_bucket())
    return out.select("family", "rows_total", "rows_warm", "complete_ratio", "non_null_ratio", *[F.concat_ws(",", c).alias(c) for c in ("constant", "low_variation", "null_heavy", "warnings")])
