"""URL filter by empirical-Bayes host reputation (operator 1).

Labelled page outcomes (bad or not) are counted by host. A beta prior passes down the
tree: all pages -> public suffix -> registered domain -> host. Each level's prior has the
parent's posterior mean and a strength fitted over that level by the method of moments, from how far its members' rates are from
their parents' beyond binomial noise. A host is blocked if the 5 % quantile of its beta posterior is above a limit.
Explicit rules come before the reputation; the longest rule that fits wins.

One pass counts by host (map-side partial sums) and is written once; the levels above are sums over hosts. Public suffixes come
from rules in the public suffix list's own syntax (``*.ck``, ``!www.ck``), a table that joins with the hosts' last labels. Verdicts go back to
the pages by a join on host; hosts with more than a thousandth of the pages (so a thousand at most) are dealt to several tasks.

Defined cases: a null url or one without ``://`` has an empty host and path and takes its
reputation from the pages like it; a host without labelled pages takes its domain's prior;
outcomes of unknown pages and null outcomes are ignored, several of one page all count;
with no outcomes at all nothing is blocked; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.llm.common import ascii_lower, cut

#: The rules of the production query as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Public suffix rules of more than one label that are in common use; without one, the suffix is the last label. A whole list is read by ``suffix_rules``.
SUFFIX_RULES = (
    "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "edu.br", "edu.cn", "edu.in", "edu.mx", "edu.tr", "gob.mx", "go.jp", "go.kr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ltd.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.mx", "org.nz", "org.uk", "org.za",
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kh", "*.mm", "*.np", "*.pg",
)
MAX_BAD_RATE = 0.5
#: Probability below the credible bound.
TAIL = 0.05
#: Bounds of a fitted prior strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: From so many pages on, a beta posterior's quantile is the normal one (they differ by less than 1e-4 then).
LARGE = 1e6
#: A host with more than this share of the pages is dealt to so many tasks.
HOT_SHARE, CELLS = 1e-3, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (n, rule, verdict); null if none does. Ties go to the first by text.
    For a list of rules written in code; the expression grows with it."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_min(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule) of a file in the public suffix list's format (one rule a line, // comments), or of SUFFIX_RULES."""
    if path is None:
        return spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    rule = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    return spark.read.text(path).select(F.lower(rule).alias("rule")).where("rule != '' and not startswith(rule, '//')").distinct()


def with_suffix_and_domain(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the public suffix and the registered domain (the name itself if it has nothing before its suffix) to a table with a unique ``host``.

    The longest rule wins, an exception over all: it names a domain, whose suffix is a label less. Without a rule the suffix is the last label."""
    name = F.regexp_replace(F.col("host"), r"^.*@|:[0-9]*$|\.+$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice("_labels", -n, n), ".")  # noqa: E731  the last n labels
    named = hosts.select("host", labels.alias("_labels")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("_labels"))))
    # what a rule for n labels can look like
    looks = F.array(last(F.col("n")), F.concat(F.lit("*."), last(F.greatest(F.col("n") - 1, F.lit(1)))), F.concat(F.lit("!"), last(F.col("n"))))
    asked = named.select("host", "n", F.explode(F.when(F.col("n") > 1, looks).otherwise(F.slice(looks, 1, 1))).alias("rule"))
    exception = F.col("rule").startswith("!")
    found = asked.join(rules, "rule").groupBy("host").agg(F.max(F.struct(exception.alias("e"), F.when(exception, F.col("n") - 1).otherwise(F.col("n")).alias("n"))).alias("r"))
    out = hosts.join(found, "host", "left").withColumn("_labels", labels).withColumn("_n", F.coalesce("r.n", F.lit(1)))
    return out.withColumns({"suffix": last(F.col("_n")), "domain": F.when(F.size("_labels") <= F.col("_n"), F.array_join("_labels", ".")).otherwise(last(F.col("_n") + 1))}).drop("_labels", "_n", "r")


def _strength(children: DataFrame) -> float:
    """Prior strength of a level by the method of moments, from (n, bad, parent): for a beta prior of mean m and strength k, the
    expected square of bad / n - m is m (1 - m) (1 + (n - 1) / (k + 1)) / n."""
    noise = F.col("parent") * (1 - F.col("parent"))
    apart = F.col("bad") / F.col("n") - F.col("parent")
    row = children.where("n > 0").agg(F.sum(F.col("n") * apart * apart - noise).alias("excess"), F.sum(noise * (F.col("n") - 1)).alias("weight")).first()
    if not row["weight"] or row["weight"] <= 0 or row["excess"] <= 0:
        return STRONGEST
    return min(max(row["weight"] / row["excess"] - 1, WEAKEST), STRONGEST)


def _shrunk(strength: float, parent: str) -> Column:
    """Posterior mean of a child from its counts and its parent's mean."""
    return (F.lit(strength) * F.col(parent) + F.col("bad")) / (F.lit(strength) + F.col("n"))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (from the side where it converges)."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-x)) / a
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + step * d), safe(1 + step / c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    return np.where(swap, 1 - front * h, front * h)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The quantile of each beta distribution, by halving; the normal one for large ones."""
    mean = a / (a + b)
    normal = np.clip(mean + NormalDist().inv_cdf(q) * np.sqrt(mean * (1 - mean) / (a + b + 1)), 0, 1)
    low, high = np.zeros(len(a)), np.ones(len(a))
    some = (a > 0) & (b > 0) & (a + b < LARGE)
    low[~some] = high[~some] = normal[~some]
    for _ in range(48):
        mid = (low + high) / 2
        less = beta_cdf(mid[some], a[some], b[some]) < q
        low[some], high[some] = np.where(less, mid[some], low[some]), np.where(less, high[some], mid[some])
    return (low + high) / 2


def _bounds(tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, weight = (batch.column(c).to_numpy() for c in ("bad_rate", "weight"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(beta_quantile(tail, rate * weight, (1 - rate) * weight))], names=["host", "pages", "n", "bad", "bad_rate", "bad_bound"])

    return run


def host_reputation(pages: DataFrame, outcomes: DataFrame, tail: float = TAIL, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, pages, n, bad, bad_rate, bad_bound) of every host of ``pages``.

    pages: (page_id, host). outcomes: (page_id, bad boolean). suffixes: (rule).
    """
    counted = (
        outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull())
        .groupBy("page_id")
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    hosts = (
        pages.join(counted, "page_id", "left")
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    )
    rules = suffix_rules(pages.sparkSession) if suffixes is None else suffixes
    hosts = cut(with_suffix_and_domain(cut(hosts, "url-counts"), rules), "url-hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    level = tops.withColumn("parent", F.lit(total["bad"] / total["n"] if total["n"] else 0.0))
    level = level.select("suffix", _shrunk(_strength(level), "parent").alias("parent"))
    level = domains.join(level, "suffix")
    level = level.select("suffix", "domain", _shrunk(_strength(level), "parent").alias("parent"))
    level = hosts.join(level, ["suffix", "domain"])
    strength = _strength(level)
    rated = level.select("host", "pages", "n", "bad", _shrunk(strength, "parent").alias("bad_rate"), (F.lit(strength) + F.col("n")).cast("double").alias("weight"))
    return rated.mapInArrow(_bounds(tail), "host string, pages long, n long, bad long, bad_rate double, bad_bound double")


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad_rate: float = MAX_BAD_RATE, tail: float = TAIL, suffixes: DataFrame | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) of every page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = cut(host_reputation(parsed.select("page_id", "host"), outcomes, tail, suffixes), "url-reputation")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_bound") > max_bad_rate, "block").otherwise("allow")
    everything = hosts.agg(F.sum("pages")).first()[0] or 0
    hot = hosts.where(F.col("pages") > HOT_SHARE * everything).select("host", F.lit(CELLS).alias("_cells"))  # 1 / HOT_SHARE rows at most
    spread = lambda df: df.join(F.broadcast(hot), "host", "left").withColumn("_cells", F.coalesce("_cells", F.lit(1)))
    dealt = spread(parsed).withColumn("_cell", F.pmod(F.xxhash64("page_id", "path"), F.col("_cells")))
    told = spread(hosts).withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells").cast("long") - 1))).drop("_cells")
    return (
        dealt.withColumn("_rule", rule)
        .join(told, ["host", "_cell"])
        .select(
            "page_id", "host", "path", F.col("_rule")["rule"].alias("rule"),
            F.coalesce(F.col("_rule")["verdict"], by_method).alias("verdict"), "bad_rate", "bad_bound",
        )
    )
