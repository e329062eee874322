"""Lineage of any depth: artifacts that nothing derives from are taken off in layers, and what is left goes by pointer doubling.

Most artifacts of a lineage are leaves. They are no one's ancestors, so they needn't take part in rounds: once the ancestors of their
parents are known, one join gives theirs. Layers come off while they hold at least half of the edges, so there are few of them. In the
rest, every artifact knows its ancestors up to 2^k steps away after k rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfold.scratch import written


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(artifact, ancestor, depth): every ancestor by its shortest path, and ``cyclic``, whether the artifact is its own ancestor.

    Edges with a null end are left out, repeated ones count once. A layer is one join of its edges with the parents of all, and one of its
    edges with the ancestors of those that are left; its artifacts are on no cycle."""
    every = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("artifact"), F.col(parent).alias("ancestor"))
    rest, layers = every.distinct(), []
    while True:
        parents = every.select(F.col("ancestor").alias("artifact")).distinct().withColumn("inner", F.lit(True))
        split = written(rest.join(parents, "artifact", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "lineage-layer")
        layers.append(split.where("not inner").select("artifact", "ancestor"))
        every = rest = split.where("inner").select("artifact", "ancestor")
        leaves, inner = split.agg(F.count_if(~F.col("inner")), F.count_if("inner")).first()
        if leaves < inner or not inner:
            break
    found = _doubled(rest)
    for n, leaf in enumerate(reversed(layers), 1):
        far = leaf.join(found.select(F.col("artifact").alias("ancestor"), F.col("ancestor").alias("further"), "depth"), "ancestor").select("artifact", F.col("further").alias("ancestor"), F.col("depth") + 1)
        pairs = leaf.withColumn("depth", F.lit(1).cast("long")).union(far).groupBy("artifact", "ancestor").agg(F.min("depth").alias("depth"))
        found = found.unionByName(pairs.withColumn("cyclic", F.lit(False)))
        found = written(found, "lineage") if n < len(layers) else found
    return found


def _doubled(edges: DataFrame) -> DataFrame:
    """The same of distinct edges (artifact, ancestor). A round joins the pairs that are 2^k apart at most with themselves, so
    rounds are the logarithm of the longest shortest path; a cycle adds no pair after its length, so it ends too."""
    known = written(edges.withColumn("depth", F.lit(1).cast("long")), "lineage")
    reach = 1
    while True:
        on = known.select(F.col("artifact").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = known.where(F.col("depth") == reach).join(on, "ancestor").select("artifact", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        grown = written(known.unionByName(longer).groupBy("artifact", "ancestor").agg(F.min("depth").alias("depth")), "lineage")
        if grown.where(F.col("depth") > reach).isEmpty():
            cyclic = grown.where("artifact = ancestor").select("artifact", F.lit(True).alias("cyclic"))
            return grown.join(cyclic, "artifact", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
        known, reach = grown, 2 * reach
