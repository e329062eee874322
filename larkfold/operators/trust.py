"""The gate that decides whether a dataset may be published: ten checks, a weighted score and reasons; and whether feature families can be trained on.

Counts come from one aggregate over the dataset, one over its clock, and small ones over sources, days and states. One row of counts reaches
the driver; scores and reasons are made from it.

Defined cases: an empty dataset fails coverage (and all labels count as null); columns that aren't there fail their checks; null times
belong to no split's range; without sources, days or states their parts of the score take the values of nothing known.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfold.operators.series import ordinal

#: Weights of the total, least scores, preferred source score, and greatest shares of nulls by family in percent.
WEIGHTS = {"coverage": 0.20, "leakage": 0.20, "feature_quality": 0.20, "label_quality": 0.15, "source_quality": 0.10, "lineage": 0.15}
LEAST = {"total": 80.0, "coverage": 85.0, "leakage": 100.0, "feature_quality": 80.0, "label_quality": 80.0, "source_quality": 60.0, "lineage": 100.0}
PREFERRED_SOURCE = 75.0
MOST_NULLS = {"time": 0.0, "session": 0.0, "quality": 0.0, "htf_context": 100.0, "disagreement": 15.0, "event_shape": 15.0, "entropy": 20.0, "multiscale": 10.0}


@dataclass(frozen=True)
class Family:
    """Features of a family: their columns, how nulls are treated, rows until they are warm, and whether they look at the past only."""

    name: str
    columns: tuple[str, ...]
    policy: str = "allow"
    warmup: int = 0
    point_in_time: bool = True

    def most_nulls(self) -> float:
        return MOST_NULLS.get(self.name, 100.0 if self.policy == "allow" else 0.0)


@dataclass(frozen=True)
class GateSpec:
    """The dataset's clock, splits in order, families, label columns, rows that labels purge, and what is asked of sources."""

    keys: tuple[str, ...]
    time: str
    families: tuple[Family, ...]
    labels: tuple[str, ...]
    purge: int = 0
    split: str = "split"
    splits: tuple[str, ...] = ("train", "val", "test")
    sources: tuple[str, ...] = ()
    synchronized: bool = False
    overlap: bool = False
    least_overlap: float = 0.0


@dataclass(frozen=True)
class Built:
    """What building says: rows removed and purged, rows after the join, the lineage's parts, and the manifest's digest as it is and as it should be."""

    dropped: int = 0
    purged: int = 0
    joined: int = 0
    lineage: dict[str, int] = field(default_factory=dict)
    digest: str = ""
    expected: str | None = None


LINEAGE = ("inputs", "states", "features", "label_pack", "spec", "parents")


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    score: float
    reason: str = ""


@dataclass(frozen=True)
class Report:
    checks: list[Check]
    scores: dict[str, float]
    accepted: bool
    reasons: list[str]


def counts(df: DataFrame, spec: GateSpec) -> dict:
    """All that the checks need of the dataset: rows, ranges of splits, nulls by column, repeated clock rows and rows in several splits."""
    t, columns = F.col(spec.time), [c for f in spec.families for c in f.columns] + list(spec.labels)
    here = [c for c in dict.fromkeys(columns) if c in df.columns]
    ranges = [agg(F.when(F.col(spec.split) == s, v)).alias(f"{n}_{i}") for i, s in enumerate(spec.splits) for n, agg, v in (("n", F.count, F.lit(1)), ("a", F.min, t), ("z", F.max, t))]
    row = df.agg(F.count("*").alias("rows"), *ranges, *[F.count(c).alias(f"some_{c}") for c in here]).first().asDict()
    clock = df.groupBy(*spec.keys, spec.time).agg(F.count("*").alias("_n"), F.count_distinct(spec.split).alias("_s"))
    twice = clock.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), F.coalesce(F.sum(F.greatest(F.col("_s") - 1, F.lit(0))), F.lit(0))).first()
    return row | {"here": set(here), "repeated": twice[0], "shared": twice[1]}


def source_counts(spec: GateSpec, raw: DataFrame | None, days: DataFrame | None, states: DataFrame | None) -> dict:
    """``raw``: (source, date) of each raw row; ``days``: (dual_ratio, conflicts, both, dual_rows) a day of merging; ``states``: (quality, conflict, filled) a state."""
    out = {"dates": 0, "synchronized": 0, "days": 0, "ratio": 0.0, "conflicts": 0.0, "dual_days": 0, "both": 0, "dual_rows": 0, "quality": 0.0, "conflict": 0.0, "filled": 0.0}
    if raw is not None and spec.sources:
        by_date = raw.where(F.col("source").isin(*spec.sources)).groupBy("date").agg(F.count_distinct("source").alias("n"))
        a, b = by_date.agg(F.count("*"), F.coalesce(F.sum((F.col("n") == len(spec.sources)).cast("long")), F.lit(0))).first()
        out |= {"dates": a, "synchronized": b}
    if days is not None:
        dual = (F.col("dual_ratio") > 0) | (F.col("dual_rows") > 0) | (F.col("both") > 0)
        row = days.agg(F.count("*"), F.avg("dual_ratio"), F.avg("conflicts"), F.sum(dual.cast("long")), F.sum("both"), F.sum("dual_rows")).first()
        out |= dict(zip(("days", "ratio", "conflicts", "dual_days", "both", "dual_rows"), [v or 0 for v in row], strict=True))
    if states is not None:
        row = states.agg(F.avg("quality"), F.avg(F.col("conflict").cast("double")), F.avg(F.col("filled").cast("double"))).first()
        out |= dict(zip(("quality", "conflict", "filled"), [v or 0.0 for v in row], strict=True))
    return out


def source_score(s: dict) -> float:
    """The states' quality (70 if none is known), more for overlap and common days, less for conflicts and filled gaps."""
    score = s["quality"] if s["quality"] > 0 else 70.0
    common = s["synchronized"] / s["dates"] if s["dates"] else 0.0
    if s["days"]:
        score += max(min(s["ratio"] * 100, 100) - 50, 0) * 0.10 + max(min(round(common, 6) * 100, 100) - 50, 0) * 0.05 - min(max(s["conflicts"], 0) * 10, 10)
    if s["quality"] <= 0:
        score -= min(max(s["conflict"], 0) * 20, 10)
    return round(max(0.0, min(100.0, score - min(max(s["filled"], 0) * 35, 15))), 4)


def _all_or_nothing(name: str, faults: list[str]) -> Check:
    return Check(name, "failed" if faults else "passed", 0.0 if faults else 100.0, "; ".join(faults))


def _missingness(c: dict, spec: GateSpec) -> Check:
    failed, near, score = [], [], 100.0
    for f in spec.families:
        here = [x for x in f.columns if x in c["here"]]
        cells = c["rows"] * len(here)
        share = round(100 * sum(c["rows"] - c[f"some_{x}"] for x in here) / cells, 4) if cells else 100.0 if f.columns else 0.0
        most = f.most_nulls()
        if len(here) < len(f.columns) or share > most:
            failed.append(f.name)
        elif most > 0 and share > 0.75 * most:
            near.append(f.name)
        score -= (100.0 if share > 0 else 0.0) if most <= 0 else min(share / most * 10, 20.0)
    if failed:
        return Check("feature_family_missingness", "failed", 0.0, f"too many nulls in {', '.join(sorted(failed))}")
    return Check("feature_family_missingness", "warning" if near else "passed", round(max(score, 0.0), 4), f"near the limit: {', '.join(sorted(near))}" if near else "")


def checks(c: dict, s: dict, spec: GateSpec, built: Built) -> list[Check]:
    empty = [n for i, n in enumerate(spec.splits) if not c[f"n_{i}"]]
    coverage = _all_or_nothing("coverage", ["no rows"] if not c["rows"] else [f"empty splits: {', '.join(empty)}"] if empty else [])
    ranges = [(c[f"a_{i}"], c[f"z_{i}"]) for i in range(len(spec.splits)) if c[f"a_{i}"] is not None]
    overlap = any(a <= z for (_, z), (a, _) in zip(ranges, ranges[1:], strict=False))
    integrity = _all_or_nothing("split_integrity", ["splits overlap or aren't in order"] if overlap or c["shared"] else [])
    leaks = [w for w, bad in (("repeated clock rows", c["repeated"] > 0), ("features that look ahead", not all(f.point_in_time for f in spec.families)), ("splits leak", integrity.status == "failed")) if bad]
    missing = [x for f in spec.families for x in f.columns if x not in c["here"]]
    budget = max([f.warmup for f in spec.families if f.policy == "drop_row"], default=0)
    lost = [w for w, bad in (("more rows dropped than warm-up allows", built.dropped > budget), ("purged rows differ from the label pack's", built.joined > spec.purge and built.purged != spec.purge)) if bad]
    none = [x for x in spec.labels if x not in c["here"]]
    null = [x for x in spec.labels if x in c["here"] and c["rows"] and not c[f"some_{x}"]]
    nulls = sum(c["rows"] - c[f"some_{x}"] for x in spec.labels if x in c["here"])
    label = Check("label_quality", "failed", 0.0, "missing label columns" if none else "labels all null") if none or null else Check("label_quality", "warning", 80.0, f"{nulls} null labels") if nulls else Check("label_quality", "passed", 100.0)
    score, asked = source_score(s), []
    if spec.synchronized and s["synchronized"] < s["dates"]:
        asked.append("required sources don't cover the same days")
    if spec.overlap and (not s["days"] or min(s["both"], s["dual_rows"], s["dual_days"]) <= 0):
        asked.append("sources don't overlap")
    if spec.overlap and s["ratio"] < spec.least_overlap:
        asked.append("sources overlap too little")
    bad = bool(asked) or score < LEAST["source_quality"]
    source = Check("source_quality", "failed" if bad else "warning" if score < PREFERRED_SOURCE else "passed", score, "; ".join(asked) or ("score too low" if bad else "score below what is preferred" if score < PREFERRED_SOURCE else ""))
    return [
        coverage, integrity, _all_or_nothing("leakage", leaks), _all_or_nothing("feature_contracts", [f"missing columns: {', '.join(missing)}"] if missing else []), _missingness(c, spec),
        _all_or_nothing("warmup_and_row_loss", lost), label, source, _all_or_nothing("lineage", [f"lineage lacks {', '.join(x for x in LINEAGE if not built.lineage.get(x))}"] if any(not built.lineage.get(x) for x in LINEAGE) else []),
        _all_or_nothing("manifest_integrity", ["manifest digest differs"] if built.expected is not None and built.digest != built.expected else []),
    ]


def gate(df: DataFrame, spec: GateSpec, built: Built, raw: DataFrame | None = None, days: DataFrame | None = None, states: DataFrame | None = None) -> Report:
    """The ten checks, the scores and the decision: no failed check, and every score at its least."""
    made = checks(counts(df, spec), source_counts(spec, raw, days, states), spec, built)
    by = {c.name: c.score for c in made}
    quality = round((by["feature_contracts"] + by["feature_family_missingness"] + by["warmup_and_row_loss"]) / 3, 4)
    scores = {"coverage": by["coverage"], "leakage": by["leakage"], "feature_quality": quality, "label_quality": by["label_quality"], "source_quality": by["source_quality"], "lineage": by["lineage"]}
    scores["total"] = round(sum(WEIGHTS[k] * v for k, v in scores.items()), 4)
    short = [f"{k} {v:.2f} is below {LEAST[k]:.2f}" for k, v in scores.items() if v < LEAST[k]]
    reasons = [f"{c.name}: {c.reason}" for c in made if c.status == "failed"] + short
    return Report(made, scores, not reasons, reasons)


def trainability(df: DataFrame, families: tuple[Family, ...], order: list[str], bucket: Column) -> DataFrame:
    """(family, rows_total, rows_warm, complete_ratio, non_null_ratio, constant, low_variation, null_heavy, warnings): whether a family's features can be learned from after its warm-up.

    Constant: one value; of low variation: two or three; null-heavy: under three quarters known."""
    rows = ordinal(df.withColumn("_all", F.lit(0)), ["_all"], order, bucket)
    out = None
    for f in families:
        cols = [c for c in f.columns if c in df.columns]
        warm = F.col("_rn") >= max(f.warmup - 1, 0)
        whole = F.lit(True)
        for c in cols:
            whole = whole & F.col(c).isNotNull()
        here = rows.agg(F.count("*").alias("total"), F.sum(warm.cast("long")).alias("n"), F.sum((warm & whole).cast("long")).alias("complete"), *[F.count(F.when(warm, F.col(c))).alias(f"some_{c}") for c in cols], *[F.count_distinct(F.when(warm, F.col(c))).alias(f"kinds_{c}") for c in cols])
        n = F.coalesce("n", F.lit(0))
        some, kinds_ = (lambda c: F.col(f"some_{c}")), (lambda c: F.col(f"kinds_{c}"))
        named = lambda test: F.array_sort(F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in cols]))) if cols else F.array().cast("array<string>")  # noqa: E731, B023
        ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
        total = F.lit(0)
        for c in cols:
            total = total + some(c)
        row = here.select(
            F.lit(f.name).alias("family"), F.col("total").alias("rows_total"), n.alias("rows_warm"), (ratio(F.coalesce("complete", F.lit(0)), n) if cols else F.lit(0.0)).alias("complete_ratio"),
            ratio(total, n * len(cols)).alias("non_null_ratio"), named(lambda c: kinds_(c) == 1).alias("constant"), named(lambda c: (kinds_(c) > 1) & (kinds_(c) <= 3)).alias("low_variation"),  # noqa: B023
            named(lambda c: (n > 0) & (F.round(some(c) / n, 6) < 0.75)).alias("null_heavy"),  # noqa: B023
        )
        said = [
            ("insufficient_rows_vs_warmup", F.col("rows_total") <= f.warmup), ("post_warmup_null_heavy_columns", F.size("null_heavy") > 0), ("constant_columns_present", F.size("constant") > 0),
            ("family_degenerate_all_constant", (F.size("constant") == len(cols)) & F.lit(bool(cols))), ("low_variation_columns_present", F.size("low_variation") > 0), ("incomplete_rows_post_warmup", F.coalesce(F.col("complete_ratio") < 0.75, F.lit(False))),
        ]
        row = row.withColumn("warnings", F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in said])))
        out = row if out is None else out.unionByName(row)
    return out
