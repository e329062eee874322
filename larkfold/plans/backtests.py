"""Queries: the report and deployment check of backtests, walk-forward splits, prefixed joins, builders by name and the store's layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import performance as P
from larkfold.operators import splits as X
from larkfold.operators.joins import prefixed_join
from larkfold.operators.series import full, rolling
from larkfold.plans.builders import Step, build
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, W, bar_bucket, rows
from larkfold.scratch import shared_dir
from larkfold.sources import layouts
from larkfold.sources.adapters import BARS_SQL, TICKS_SQL, daily_bars, table, ticks

CAPITAL, TRIALS, RISK_FREE = 50_000_000.0, 3, 0.05
ORDER = ["exited", "l_orderkey", "l_linenumber"]


def closed_trades(spark: SparkSession, d: str) -> DataFrame:
    """Lines as closed trades, a book for each return flag and line status: profit by discount, held for days of the line number."""
    c = F.col
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("book"), "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("exited"),
        F.date_sub(F.to_date("l_shipdate"), c("l_linenumber")).alias("entered"), (c("l_extendedprice") * c("l_tax") * 0.01).alias("fee"),
        (c("l_extendedprice") * (c("l_discount") - 0.048)).alias("pnl"), ((c("l_discount") - 0.048) / 0.02).alias("r"),
    )


TRADES_SQL = """t AS (SELECT l_returnflag || l_linestatus AS book, l_orderkey, l_linenumber, l_shipdate::DATE AS exited, l_shipdate::DATE - l_linenumber AS entered, l_extendedprice * l_tax * 0.01 AS fee,
  l_extendedprice * (l_discount - 0.048) AS pnl, (l_discount - 0.048) / 0.02 AS r FROM lineitem)"""
SHOWN = {
    "n_trades": 0, "days": 0, "longest_drawdown": 0, "longest_wins": 0, "longest_losses": 0, "longest_losing_days": 0, "months": 0, "profitable_months": 0, "n_returns": 0,
    "net_profit": 1, "largest_win": 2, "largest_loss": 2, "avg_win": 3, "avg_loss": 3, "expectancy": 3, "r_expectancy": 6, "fees": 1, "win_rate_pct": 5, "total_return_pct": 5, "cagr_pct": 5, "avg_days_held": 6, "avg_days_between": 6,
    "max_drawdown_pct": 5, "avg_drawdown_pct": 5, "ulcer_index": 5, "pain_index": 5, "profit_factor": 5, "payoff_ratio": 5, "expectancy_r": 5, "sharpe": 4, "sharpe_population": 4, "sortino": 4, "information_ratio": 4, "omega": 5, "gain_to_pain": 5,
    "tail_ratio": 5, "burke": 4, "ulcer_performance": 3, "calmar": 4, "return_over_drawdown": 4, "deflated_t": 3, "cost_pct": 4, "profitable_month_pct": 4, "profitability_score": 5, "composite_score": 5,
}
_DAY = "PARTITION BY book ORDER BY exited"
_T = "PARTITION BY book ORDER BY exited, l_orderkey, l_linenumber"
_UNIT = "least(greatest(coalesce({}, 0), 0), 1)"
_OVER = "{} / nullif({}, 0)"
REPORT_SQL = f"""WITH {TRADES_SQL}, e AS (SELECT *, {CAPITAL} + sum(pnl) OVER ({_T}) AS equity, row_number() OVER ({_T}) - 1 AS i, sign(pnl) AS s FROM t),
 q AS (SELECT *, greatest(max(equity) OVER ({_T}), {CAPITAL}) AS peak, CASE WHEN s = lag(s) OVER ({_T}) THEN 0 ELSE 1 END AS fresh, greatest(entered - lag(exited) OVER (PARTITION BY book ORDER BY entered, exited, l_orderkey, l_linenumber), 0) AS gap FROM e),
 v AS (SELECT *, (peak - equity) / peak AS depth, coalesce(max(CASE WHEN equity >= peak THEN i END) OVER ({_T}), -1) AS episode, i - max(CASE WHEN fresh = 1 THEN i END) OVER ({_T}) + 1 AS run FROM q),
 a AS (SELECT book, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl < 0 THEN -pnl END) AS avg_loss, sum(greatest(pnl, 0)) AS gp, sum(greatest(-pnl, 0)) AS gl, max(CASE WHEN pnl > 0 THEN pnl END) AS largest_win,
  max(CASE WHEN pnl < 0 THEN -pnl END) AS largest_loss, avg(r) AS r_expectancy, avg(pnl) AS expectancy, sum(fee) AS fees, avg(exited - entered) AS avg_days_held, avg(gap) AS avg_days_between, 100 * max(depth) AS max_drawdown_pct,
  100 * avg(CASE WHEN depth > 0 THEN depth END) AS avg_drawdown_pct, sqrt(avg(pow(100 * depth, 2))) AS ulcer_index, 100 * avg(depth) AS pain_index, max(i - episode) AS longest_drawdown, max(CASE WHEN s > 0 THEN run ELSE 0 END) AS longest_wins,
  max(CASE WHEN s < 0 THEN run ELSE 0 END) AS longest_losses, greatest(max(exited) - min(entered), 1) AS days, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS win_rate_pct FROM v GROUP BY book),
 w AS (SELECT book, sqrt(sum(pow(100 * depth, 2))) AS worst FROM (SELECT book, episode, max(depth) AS depth FROM v WHERE depth > 0 GROUP BY book, episode QUALIFY row_number() OVER (PARTITION BY book ORDER BY max(depth) DESC, episode) <= {P.WORST}) GROUP BY book),
 d0 AS (SELECT book, exited, sum(pnl) AS pnl, arg_max(equity, i) AS equity FROM v GROUP BY ALL), d1 AS (SELECT *, equity / lag(equity) OVER ({_DAY}) - 1 AS ret, row_number() OVER ({_DAY}) AS k FROM d0),
 d2 AS (SELECT *, ret - {P.daily_rate(RISK_FREE)!r} AS x, k - coalesce(max(CASE WHEN pnl >= 0 THEN k END) OVER ({_DAY}), 0) AS losing FROM d1),
 d AS (SELECT book, count(ret) AS n_returns, avg(x) AS ax, stddev_samp(x) AS sd, stddev_samp(CASE WHEN x < 0 THEN x END) AS dn, avg(ret) AS m, stddev_pop(ret) AS pop, sum(greatest(ret, 0)) AS g, sum(greatest(-ret, 0)) AS l, max(losing) AS longest_losing_days,
  abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)) AS tail_ratio, avg(pow(ret - mu, 3)) / pow(stddev_pop(ret), 3) AS sk, avg(pow(ret - mu, 4)) / pow(stddev_pop(ret), 4) AS ku FROM (SELECT *, avg(ret) OVER (PARTITION BY book) AS mu FROM d2) GROUP BY book),
 m AS (SELECT book, count(*) AS months, count(*) FILTER (pnl > 0) AS profitable_months FROM (SELECT book, date_trunc('month', exited), sum(pnl) AS pnl FROM t GROUP BY ALL) GROUP BY book),
 j AS (SELECT *, gp - gl AS net_profit, {CAPITAL} + gp - gl AS final, 100 * (gp - gl) / {CAPITAL} AS total_return_pct, days / 365.25 AS years, {_OVER.format("gp", "gl")} AS profit_factor, avg_win / avg_loss AS payoff_ratio, expectancy / avg_loss AS expectancy_r, ax / sd * sqrt(252) AS sharpe,
  (m.m_ - {RISK_FREE} / 252) / pop * sqrt(252) AS sharpe_population, ax / dn * sqrt(252) AS sortino, m.m_ / sd * sqrt(252) AS information_ratio, g / l AS omega, (g - l) / l AS gain_to_pain, 100.0 * profitable_months / months AS profitable_month_pct, 100 * fees / gp AS cost_pct
  FROM a JOIN (SELECT *, m AS m_ FROM d) m USING (book) JOIN m AS mm USING (book) LEFT JOIN w USING (book)),
 z AS (SELECT *, CASE WHEN final > 0 THEN 100 * (pow(final / {CAPITAL}, 1 / years) - 1) END AS cagr_pct, total_return_pct / max_drawdown_pct AS return_over_drawdown, total_return_pct / years / worst AS burke, total_return_pct / ulcer_index AS ulcer_performance,
  (sharpe - {P.expected_best(TRIALS)!r}) / sqrt(greatest(1 - sk * sharpe + (ku - 1) / 4 * sharpe * sharpe, 1e-10) / (days - 1)) AS deflated_t FROM j),
 y AS (SELECT *, cagr_pct / max_drawdown_pct AS calmar FROM z),
 u AS (SELECT *, CASE WHEN n_trades < 50 OR net_profit <= 0 OR expectancy <= 0 THEN 0 ELSE {" + ".join(f"{k} * " + _UNIT.format(f"({n} - {low}) / {span}") for n, low, span, k in P.WEIGHTS)} + 0.05 * (1 - {_UNIT.format("cost_pct / 60")}) END AS profitability_score,
  CASE WHEN n_trades < 30 OR win_rate_pct < 40 OR max_drawdown_pct > 20 THEN 0 ELSE ({" + ".join(f"{k} * " + _UNIT.format(f"{n} / {cap}") for n, cap, k in P.COMPOSITE)}) * (1 - longest_losses / n_trades) END AS composite_score FROM y),
 b AS (SELECT *, concat_ws('|', {", ".join(f"CASE WHEN NOT coalesce({n} {'>=' if least else '<='} {bound}, false) THEN '{why}' END" for why, n, bound, least in P.GATES)},
  CASE WHEN net_profit <= 0 THEN 'NON_POSITIVE_NET_PROFIT' END, CASE WHEN expectancy <= 0 THEN 'NEG_EXPECTANCY' END) AS blocked_by FROM u)
 SELECT book, blocked_by, blocked_by = '' AS approved, {", ".join(f"{n}::BIGINT AS {n}" if not k else f"round({n}, {k}) AS {n}" for n, k in SHOWN.items())} FROM b"""


@query("a23_backtest_report", REPORT_SQL)
def a23(spark: SparkSession, d: str) -> DataFrame:
    """Some 45 figures of each book, its two scores, and the gates that keep it from deployment."""
    r = P.backtest_report(closed_trades(spark, d), ["book"], ORDER, F.trunc("exited", "month"), CAPITAL, RISK_FREE, TRIALS)
    return r.select("book", "blocked_by", "approved", *[F.round(n, k).alias(n) if k else F.col(n).cast("long").alias(n) for n, k in SHOWN.items()])


def _folds_sql(bounds: str, numbers: str, where: str = "true") -> str:
    """Rows of each part of each fold, from the bounds as SQL over n and k."""
    return f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), s AS (SELECT symbol, max(n) AS n FROM r GROUP BY symbol),
 f AS (SELECT symbol, k, {bounds} FROM s, {numbers} t(k) WHERE {where})
 SELECT symbol, k::INTEGER AS fold, CASE WHEN i < b THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(day) AS first, max(day) AS last
 FROM f JOIN r USING (symbol) WHERE (i >= a AND i < b) OR (i >= c AND i < e) GROUP BY ALL"""


def _folds(spark: SparkSession, d: str, rule) -> DataFrame:
    parts = X.folds_by_rule(daily_bars(spark, d), KEYS, ["day"], bar_bucket(), rule)
    return parts.groupBy("symbol", "fold", "part").agg(F.count("*").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("x02_reserved_tail", _folds_sql("0 AS a, n - 5 * (floor(n * 0.3 / 5) + 10) + k * (floor(n * 0.3 / 5) + 10) AS b, b + 10 AS c, b + 10 + floor(n * 0.3 / 5) AS e", "range(0, 5)", "n - 5 * (floor(n * 0.3 / 5) + 10) >= 1 AND floor(n * 0.3 / 5) >= 1"))
def x02_tail(spark: SparkSession, d: str) -> DataFrame:
    """Walk-forward over the newest rows, each test behind an embargo of its own."""
    return _folds(spark, d, X.reserved_tail(5, 0.3, 10))


@query("x02_fixed_start", _folds_sql("0 AS a, 50 + k * greatest((n - 60) // 4, 1) AS b, b + 10 AS c, CASE WHEN k = 3 THEN n ELSE least(n, b + 10 + greatest((n - 60) // 4, 1)) END AS e", "range(0, 4)", "n - 60 >= 4"))
def x02_start(spark: SparkSession, d: str) -> DataFrame:
    """Training folds from a smallest train set on; the last one ends with the series."""
    return _folds(spark, d, X.fixed_start(4, 50, 10))


@query("x02_sliding_windows", _folds_sql("k * 30 AS a, k * 30 + 60 AS b, k * 30 + 65 AS c, k * 30 + 85 AS e", "(SELECT unnest(range(0, (SELECT max(n) FROM s))))", "k * 30 + 85 <= n"))
def x02_slide(spark: SparkSession, d: str) -> DataFrame:
    """Rolling windows: 60 rows to train on, 5 between, 20 to test, 30 further each time."""
    return _folds(spark, d, X.sliding_windows(60, 20, 30, 5))


@query("x02_segments", _folds_sql("0 AS a, (k + 2) * (n // 6) AS b, (k + 2) * (n // 6) AS c, CASE WHEN k = 3 THEN n ELSE (k + 3) * (n // 6) END AS e", "range(0, 4)", "n >= 6 * 16"))
def x02_segments(spark: SparkSession, d: str) -> DataFrame:
    """Six equal segments, two of them for the first train set."""
    return _folds(spark, d, X.expanding_segments(6, 2))


@query("p21_prefixed_join", """SELECT l_orderkey, l_linenumber, l.l_quantity, x.l_quantity AS part_l_quantity, x.l_tax AS part_l_tax, x.n AS n FROM lineitem l
 LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS l_quantity, max(l_tax) AS l_tax, count(*) AS n FROM lineitem GROUP BY 1) x USING (l_partkey)""")  # fmt: skip
def p21(spark: SparkSession, d: str) -> DataFrame:
    """What a part's lines sum to, joined under the same names with a prefix."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    of_part = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"), F.count("*").alias("n"))
    return prefixed_join(li, of_part, ["l_partkey"], "part").select("l_orderkey", "l_linenumber", "l_quantity", "part_l_quantity", "part_l_tax", "n")


def deviation(df: DataFrame, window: int = 20) -> DataFrame:
    """A feature builder: distance of the close from its mean, in deviations."""
    c = F.col("close")
    return rolling(df, KEYS, ["day"], bar_bucket(), lambda w: {f"z_{window}": F.try_divide(c - full(F.avg, c, w, window), full(F.stddev_samp, c, w, window))}, window)


def direction(df: DataFrame, horizon: int = 5) -> DataFrame:
    """A label builder: sign of the move over the next bars; null at the end."""
    return rolling(df, KEYS, ["day"], bar_bucket(), lambda w: {f"direction_{horizon}": F.signum(F.lead("close", horizon).over(w) - F.col("close")).cast("int")}, after=horizon)


STEPS = [
    Step("larkfold.plans.backtests:deviation", {"window": 20}, ("symbol", "day", "close"), ("z_20",)),
    Step("larkfold.plans.backtests:deviation", {"window": 5}, ("close",), ("z_5",)),
    Step("larkfold.plans.backtests:direction", {"horizon": 3}, ("close",), ("direction_3",)),
]


@query("b01_builders_by_name", f"""WITH {BARS_SQL} SELECT symbol, day, {", ".join(f"round(CASE WHEN count(*) OVER {rows(n)} >= {n} AND stddev_samp(close) OVER {rows(n)} <> 0 THEN (close - avg(close) OVER {rows(n)}) / stddev_samp(close) OVER {rows(n)} END, 5) AS z_{n}" for n in (20, 5))},
 sign(lead(close, 3) OVER ({W}) - close)::INTEGER AS direction_3 FROM bars""")  # fmt: skip
def b01(spark: SparkSession, d: str) -> DataFrame:
    """2.11: features and a label by dotted path."""
    return build(daily_bars(spark, d), STEPS).select("symbol", "day", *[F.round(n, 5).alias(n) for n in ("z_20", "z_5")], "direction_3")


@query("s08_partitioned_layout", f"""WITH {TICKS_SQL} SELECT broker, symbol, make_date((time_msc // 86400000)::INTEGER) AS date, count(*) AS n, round(sum(bid), 3) AS bid, min(event_id) AS first FROM ticks WHERE broker = 'a' GROUP BY ALL""")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """Ticks by broker, symbol and date in the store's layout; one broker's partitions are read back."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    layouts.save(ticks(spark, d).withColumn("date", F.date_from_unix_date((F.col("time_msc") / 86_400_000).cast("int"))), root, "raw_ticks")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    of_day = layouts.load(spark, root, "raw_ticks", broker="a").groupBy("broker", "symbol", "date")
    return of_day.agg(F.count("*").alias("n"), F.round(F.sum("bid"), 3).alias("bid"), F.min("event_id").alias("first"))
