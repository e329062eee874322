"""Connected components of a table of links, by label propagation with pointer jumping.

Links and labels stay distributed: each round is two joins and a map-side-combined
minimum, written to the shared folder. Nothing but the count of changed labels reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larkfold.llm.common import cut

#: Rows of a bucket that meet what there is once a bucket in one task, at most and about.
HOT = 256
#: Bits that tell which buckets hold several ids, 2 MB; they spare an exchange of the others, and decide nothing.
LIVE_BITS = 1 << 24


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id it reaches."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a != b").distinct(), f"{name}-links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), f"{name}-0")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        after = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        for _ in range(2):
            after = after.join(root, "component", "left").select("id", "old", F.coalesce("root", "component").alias("component"))
        seen = Observation()
        labels = cut(after.observe(seen, F.count_if(F.col("component") != F.col("old")).alias("changed")), name).select("id", "component")
        if not seen.get["changed"]:
            return labels


def more_links(labels: DataFrame | None, links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) with further links (a, b); the components so far are contracted first."""
    if labels is None:
        return components(links, name)
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between, name).select(F.col("id").alias("component"), F.col("component").alias("to"))
    fresh = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().join(labels, "id", "left_anti")
    every = labels.union(fresh.select("id", F.col("id").alias("component")))
    return cut(every.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"{name}-labels")


def live_bits(buckets: DataFrame) -> Broadcast:
    """A bitmap of fixed size of the buckets of a table."""
    at = F.pmod(F.col("bucket"), F.lit(LIVE_BITS)) + 1
    rows = buckets.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    held = np.zeros(LIVE_BITS // 8, np.uint8)
    for r in rows.collect():  # 512 rows at most
        held[(r["block"] - 1) * 4096 :][:4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return buckets.sparkSession.sparkContext.broadcast(held)


def is_live(live: Broadcast | None, buckets: np.ndarray) -> np.ndarray:
    """Which buckets may hold several ids."""
    if live is None:
        return np.ones(len(buckets), bool)
    at = buckets & np.int64(LIVE_BITS - 1)
    return (live.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def meet(members: DataFrame, per_bucket: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows (bucket, in_bucket, id, ...) with a table of one row a bucket (with in_bucket), a large bucket in cells of about HOT rows."""
    cells = F.ceil(F.col("in_bucket") / HOT)
    spread = per_bucket.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).drop("in_bucket")
    return members.withColumn("_cell", F.pmod(F.xxhash64("id"), cells)).join(spread, ["bucket", "_cell"], how).drop("_cell")


def link_buckets(
    members: Callable[[Broadcast | None], DataFrame],
    details: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    compatible: Callable[[str, str], Column] | None = None,
    most: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    possible: Callable[[str, str, str, str], Column] | None = None,
    rest: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    rounds: int = 3,
    name: str = "links",
) -> DataFrame:
    """Components of all links between ids that share a bucket: (id, component) of the linked ids.

    members: makes (bucket, id, n), with a bitmap only of the buckets that ``is_live`` lets through. ``details(ids)`` gives what ``verify(pairs, details)`` needs to tell which of the pairs
    (a, b) are links; it is made once, for the ids that share a bucket. ``compatible(n, m)`` says from two sizes if a link is possible.

    A bucket's ids are compared with one leader, which is linear in the bucket, and links are contracted. The first leader is the id
    with the largest buckets altogether: the original of a family of copies shares more with each of them than they do with each other. Buckets that
    still span several components get ``rounds`` - 1 more leaders, by hash, and in the end all their pairs across components
    are compared, so no pair that shares a bucket stays open; ``rest(open, details)`` may name the pairs (a, b) that can still be
    links without making all pairs of a bucket (without it, a leader leaves its bucket when all have been compared with it). After the first leader, ``most(ids, details)``
    gives for (id, component) how much of an id other components can hold at all, (id, most), without the ids for which that is too little;
    ``possible(n, most_n, m, most_m)`` drops the pairs that it rules out. As components only grow, the bound stays true.
    """
    sizes = cut(members(None).groupBy("bucket").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1"), f"{name}-sizes")  # the leanest row to shuffle
    members = cut(members(live_bits(sizes)).join(sizes, "bucket"), f"{name}-members")
    known = cut(details(members.select("id").distinct()), f"{name}-details")
    return link_members(members, known, verify, compatible, most, possible, rest, rounds, name)


def asks(p: str, n: str, q: str, m: str) -> Column:
    """Whether the one of lesser (or equal) n of two members looks up."""
    return (F.col(p) & (F.col(n) <= F.col(m))) | (F.col(q) & (F.col(m) <= F.col(n)))


def pair(n: str, x: str, m: str, y: str) -> list[Column]:
    """Two ids as a and b, the one of lesser n first."""
    first = F.struct(F.col(n), F.col(x)) < F.struct(F.col(m), F.col(y))
    return [F.when(first, F.col(x)).otherwise(F.col(y)).alias("a"), F.when(first, F.col(y)).otherwise(F.col(x)).alias("b")]


def link_members(
    members: DataFrame,
    known: DataFrame,
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    compatible: Callable[[str, str], Column] | None = None,
    most: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    possible: Callable[[str, str, str, str], Column] | None = None,
    rest: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    rounds: int = 3,
    name: str = "links",
    others: DataFrame | None = None,
) -> DataFrame:
    """``link_buckets`` from its members (bucket, id, n, in_bucket) on; ``others``: more pairs to verify in the first round, with flags for
    ``verify`` that the pairs made here don't have.

    With a column ``probe`` in the members, only the pairs count in which the id of lesser (or equal) n has it set; that id is then ``a``, and the second leader
    is the least id that has it set.
    """
    probing = "probe" in members.columns
    fits = compatible or (lambda n, m: F.lit(True))
    wanted = lambda p, n, q, m: asks(p, n, q, m) if probing else F.lit(True)
    labels = None
    left = members.join(members.groupBy("id").agg(F.sum("in_bucket").alias("crowd")), "id").withColumns({"component": F.col("id"), "most": F.col("n")})
    for step in range(rounds + 1):
        can = possible if possible and step else (lambda n, most_n, m, most_m: F.lit(True))
        if step < rounds:
            order = F.struct(-F.col("crowd"), "id") if not step else F.xxhash64(F.lit(step), "id")
            if probing and step == 1:
                order = F.struct(~F.col("probe"), "n", "id")
            leaders = left.groupBy("bucket").agg(F.min_by(F.struct("id", "n", "most", "component", *(["probe"] if probing else [])), order).alias("l"), F.first("in_bucket").alias("in_bucket"))
            apart = (F.col("component") != F.col("l.component")) & wanted("probe", "n", "l.probe", "l.n")
            met = meet(left, leaders)
            pairs = met.where(apart & fits("n", "l.n") & can("n", "most", "l.n", "l.most"))
            pairs = pairs.select(*pair("n", "id", "l.n", "l.id")) if probing else pairs.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b"))
            if others is not None and not step:
                pairs = pairs.withColumns({c: F.lit(False) for c in others.columns[2:]}).union(others)
        elif rest:
            pairs = rest(left, known)
        else:
            other = left.select("bucket", F.col("id").alias("d"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("most").alias("most_m"))
            once = F.col("probe") & (F.col("n") <= F.col("m")) if probing else F.col("id") < F.col("d")
            pairs = (left.where("probe") if probing else left).join(other, "bucket").where(once & (F.col("component") != F.col("c")) & fits("n", "m") & can("n", "most", "m", "most_m"))
            pairs = pairs.select(*pair("n", "id", "m", "d")) if probing else pairs.select(F.least("id", "d").alias("a"), F.greatest("id", "d").alias("b"))
        found = cut(verify(pairs.distinct(), known), f"{name}-found")
        labels = more_links(labels, found, name)
        if step == rounds:
            break
        named = (left if rest else met.where("id != l.id").drop("l")).drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        spans = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("in_bucket").alias("in_bucket")).where("lo != hi")
        left = cut(meet(named, spans.select("bucket", "in_bucket"), "left_semi"), f"{name}-open")
        if most and not step:
            bound = most(left.select("id", "component").distinct(), known)
            left = cut(left.drop("most").join(bound, "id"), f"{name}-possible")
        if left.isEmpty():
            break
    return labels
