"""Queries: tests and fits of long series, Monte-Carlo paths, lineage of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.operators import estimators as S
from larkfold.operators import lineage
from larkfold.operators import monte_carlo as C
from larkfold.plans.core import tick_bucket
from larkfold.plans.registry import query
from larkfold.plans.series import KEYS, ORDER, bar_bucket, over_bars
from larkfold.scratch import written
from larkfold.sources.adapters import daily_bars, table, ticks


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Log closes of each pair of symbols on the days that both have, and the residual of the first on the second."""
    b = daily_bars(spark, d).select("symbol", "day", F.log("close").alias("v"))
    p = b.select(F.col("symbol").alias("first"), "day", F.col("v").alias("y")).join(b.select(F.col("symbol").alias("second"), "day", F.col("v").alias("x")), "day").where("first < second")
    p = p.withColumn("pair", F.concat_ws("~", "first", "second")).select("pair", "day", "y", "x")
    h = p.groupBy("pair").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"))
    return p.join(h, "pair").withColumn("residual", F.col("y") - F.col("beta") * F.col("x") - F.col("alpha"))


@query("k13_cointegration_tests")
def k13_tests(spark: SparkSession, d: str) -> DataFrame:
    """Augmented Dickey-Fuller test of each pair's residual with chosen lags and p-value, and Johansen's trace test (no SQL; tests hold both against direct regressions)."""
    p = pairs(spark, d)
    root = S.unit_root_test(p, ["pair"], ORDER, bar_bucket(), "residual")
    trace = S.trace_test(p, ["pair"], ORDER, bar_bucket(), "y", "x")
    both = root.join(trace, "pair").join(p.groupBy("pair").agg(F.first("beta").alias("beta")), "pair")
    decided = (F.col("p") < 0.05) | F.col("cointegrated")
    return both.select("pair", "n", F.round("beta", 6).alias("hedge_ratio"), "lags", F.round("statistic", 4).alias("adf"), F.round("p", 5).alias("p"), F.round("trace_0", 3).alias("trace_0"), F.round("trace_1", 3).alias("trace_1"), decided.alias("cointegrated"))


@query("k14_cross_impact")
def k14(spark: SparkSession, d: str) -> DataFrame:
    """Impact of each symbol's flow on each symbol's next return (no SQL; a test holds it against a direct ridge regression)."""
    found = S.cross_impact(daily_bars(spark, d).withColumn("ticks", F.col("tick_count").cast("double")), "symbol", "day", "close", bar_bucket(), flow="ticks")
    rows = [] if found is None else [(a, b, float(found.matrix[i, j]), *(found.of(a)[k] for k in ("predicted", "strength", "entropy"))) for i, a in enumerate(found.symbols) for j, b in enumerate(found.symbols)]
    out = spark.createDataFrame(rows, "target string, source string, beta double, predicted double, strength double, entropy double")
    return out.select("target", "source", *[F.round(c, 8).alias(c) for c in ("beta", "predicted", "strength", "entropy")])


@query("k16_hawkes_fit")
def k16_fit(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood fit of buys (even flags) and sells of all symbols in hours (no SQL; a test holds likelihood and gradient against plain sums)."""
    t = ticks(spark, d)
    first = t.groupBy("symbol").agg(F.min("time_msc").alias("start"))
    t = t.join(first, "symbol").select("symbol", "time_msc", "event_id", "flags", ((F.col("time_msc") - F.col("start")) / 3_600_000).alias("hours"))
    theta, loss = S.fit_hawkes(t, KEYS, ["time_msc", "event_id"], tick_bucket(), F.col("hours"), F.col("flags") % 2, iterations=6)
    names = ["mu_buy", "mu_sell", "alpha_bb", "alpha_bs", "alpha_sb", "alpha_ss", "beta_buy", "beta_sell"]
    return spark.createDataFrame([(n, round(float(v), 4)) for n, v in zip(names, theta, strict=True)] + [("branching_ratio", round(S.spectral_radius(theta), 4)), ("loss", round(loss, 2))], "name string, value double")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Daily changes of closes, scaled to an account, as the results of trades."""
    return over_bars(spark, d, lambda w: {"pnl": (F.col("close") / F.lag("close").over(w) - 1) * 20}, 1).where("pnl is not null").select("symbol", "day", "pnl")


@query("a24_path_summary")
def a24_paths(spark: SparkSession, d: str) -> DataFrame:
    """Block bootstrap, mirrored pairs, heavier losses and geometric Brownian motion (random, but the same on each run; a test holds paths against plain loops)."""
    out, pnl = None, written(results(spark, d), "pnl")
    for name, spec in (("block", C.PathSpec(paths=60)), ("antithetic", C.PathSpec("antithetic", paths=60)), ("stress", C.PathSpec(paths=60, worse=1.5)), ("gbm", C.PathSpec("gbm", paths=60))):
        made = C.equity_pieces(pnl, KEYS, ORDER, bar_bucket(), "pnl", spec)
        s = C.summary(written(C.path_results(made, KEYS, spec), "paths"), KEYS, spec).withColumn("method", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("symbol", "method", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("symbol", "method")])


@query("a24_equity_curves")
def a24_curves(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of equity over paths after each step (a test holds it against plain loops)."""
    out = C.curves(C.equity_pieces(written(results(spark, d), "pnl"), KEYS, ORDER, bar_bucket(), "pnl", C.PathSpec(paths=60)), KEYS)
    return out.select("symbol", "step", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith("equity")])


_EDGES = """e AS (SELECT DISTINCT 'line:' || l_orderkey || '.' || l_linenumber AS child, 'order:' || l_orderkey AS parent FROM lineitem UNION ALL SELECT DISTINCT 'line:' || l_orderkey || '.' || l_linenumber, 'part:' || l_partkey FROM lineitem
 UNION ALL SELECT DISTINCT 'line:' || l_orderkey || '.' || l_linenumber, 'supplier:' || l_suppkey FROM lineitem UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
 UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


KINDS = ["line", "order", "part", "supplier", "customer", "nation", "region"]
_LINE = ["l_orderkey", "l_linenumber"]
#: (table, kind and key of the child, kind and key of the parent)
EDGES = [
    ("lineitem", "line", _LINE, "order", "l_orderkey"), ("lineitem", "line", _LINE, "part", "l_partkey"), ("lineitem", "line", _LINE, "supplier", "l_suppkey"),
    ("supplier", "supplier", ["s_suppkey"], "nation", "s_nationkey"), ("orders", "order", ["o_orderkey"], "customer", "o_custkey"),
    ("customer", "customer", ["c_custkey"], "nation", "c_nationkey"), ("nation", "nation", ["n_nationkey"], "region", "n_regionkey"),
]


def _numbering(spark: SparkSession, d: str) -> tuple[int, int]:
    """(least line number, how many there may be) if (order key, line number, kind) and each other key with its kind fit a long; (0, 0) if not."""
    ends, whole = None, True
    for t in sorted({e[0] for e in EDGES}):
        rows = table(spark, d, t)
        keys = sorted({k for e in EDGES if e[0] == t for k in (*e[2], e[4])} - {"l_linenumber"})
        whole = whole and all(dict(rows.dtypes)[k] in ("tinyint", "smallint", "int", "bigint") for k in (*keys, *(["l_linenumber"] if t == "lineitem" else [])))
        line = F.col("l_linenumber") if t == "lineitem" else F.lit(None)
        wide = lambda c: c.cast("decimal(20,0)")
        known = rows.agg(wide(F.min(F.least(*keys, F.lit(0)))).alias("lo"), wide(F.max(F.greatest(*keys, F.lit(0)))).alias("hi"), wide(F.min(line)).alias("l0"), wide(F.max(line)).alias("l1"))
        ends = known if ends is None else ends.unionByName(known)
    if not whole:
        return 0, 0
    lo, hi, l0, l1 = ends.agg(F.min("lo"), F.max("hi"), F.min("l0"), F.max("l1")).first()
    width = int((l1 or 0) - (l0 or 0)) + 1
    return (int(l0 or 0), width) if (max(-int(lo or 0), int(hi or 0)) + 1) * width < 1 << 59 else (0, 0)


@query("j17_lineage_closure", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT child AS artifact, parent AS ancestor, 1 AS depth FROM e UNION SELECT artifact, e.parent, depth + 1 FROM r JOIN e ON r.ancestor = e.child),
 s AS (SELECT artifact, ancestor, min(depth) AS depth FROM r GROUP BY ALL)
 SELECT split_part(artifact, ':', 1) AS kind, split_part(ancestor, ':', 1) AS of_kind, depth::BIGINT AS depth, count(*) AS pairs, count(DISTINCT ancestor) AS ancestors, false AS cyclic FROM s GROUP BY ALL""")  # fmt: skip
def j17_closure(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of all artifacts by shortest path, whatever the depth. Artifacts are numbers where keys allow it: those take half the room of names."""
    least, width = _numbering(spark, d)
    code = lambda kind: F.lit(KINDS.index(kind)).cast("long")

    def node(kind: str, key: list[str]) -> Column:
        if not width:
            return F.concat(F.lit(f"{kind}:"), F.concat_ws(".", *key))
        at = F.col(key[0]).cast("long")
        return (at if len(key) == 1 else at * width + (F.col(key[1]) - least)) * 8 + code(kind)

    e = None
    for t, a, x, b, y in EDGES:
        known = table(spark, d, t).select(node(a, x).alias("child"), F.when(F.col(y).isNotNull(), node(b, [y])).alias("parent"))
        e = known if e is None else e.unionByName(known)
    kind = lambda c: F.pmod(F.col(c), F.lit(8)).cast("int") if width else F.substring_index(c, ":", 1)
    out = lineage.ancestors(e).groupBy(kind("artifact").alias("kind"), kind("ancestor").alias("of_kind"), "depth").agg(F.count("*").alias("pairs"), F.count_distinct("ancestor").alias("ancestors"), F.max("cyclic").alias("cyclic"))
    if width:
        names = F.array(*[F.lit(k) for k in KINDS])
        out = out.withColumns({c: F.get(names, F.col(c)) for c in ("kind", "of_kind")})
    return out
