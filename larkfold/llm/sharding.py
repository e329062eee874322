"""Sharding by a weighted hash tree (operator 5).

A topology is a tree of regions, racks and shards with a weight on every node. A key
descends it level by level; at each level every child draws ``-ln(u) / weight`` with u
hashed from (key, child) and the smallest draw wins. A child's share is its weight, and
its draws depend on no sibling, so changing weights moves keys only into or out of the
subtrees whose weights change.

Law ``key``, at any count: regions and racks have weights of their own, not the sum of what they hold,
and a further shard comes as one new child of one node: a region with one rack with one shard while regions
are wanted, then a rack with one shard, then a shard of a rack. So it takes keys from that node's children only, and
only into itself. What that costs is balance between counts that fill the tree: a rack with five shards gives each a fifth of a
rack where others give a fourth.

Defined cases: a null key hashes as a constant and lands in one shard; a null text has
size 8 and a null crc; repeated rows share a shard and take a slot each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Regions, and racks a region; racks take any number of shards (the production count fills them with four each).
FANOUT = (2, 3)
#: Ranks inside a shard are counted over so many hash ranges, so that no task ranks a whole shard.
RANGES = 1024

Tree = dict[int, list[tuple[int, float]]]


def topology(shards: int, fanout: tuple[int, int] = FANOUT, weights: dict[int, float] | None = None) -> tuple[Tree, dict[int, int]]:
    """Children with weights by node (0 is the root), and the shard of each leaf. The tree of n shards is that of n - 1 with one node more at one level.

    weights: of nodes (``region``, ``rack``, ``leaf`` number them); 1 for others.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    regions, racks = fanout
    tree: dict[int, dict[int, float]] = {0: {}}
    leaves: dict[int, int] = {}
    for s in range(shards):
        where = s % regions, s // regions % racks
        path = (0, region(where[0]), rack(*where), leaf(s))
        for parent, child in zip(path, path[1:], strict=False):
            tree.setdefault(parent, {})[child] = (weights or {}).get(child, 1.0)
        leaves[path[-1]] = s
    return {k: sorted(v.items()) for k, v in tree.items()}, leaves


def region(number: int) -> int:
    return 1 + number


def rack(region_number: int, number: int) -> int:
    return 1_000_000 + region_number * 1000 + number


def leaf(shard: int) -> int:
    return 1_000_000_000 + shard


def _uniform(*parts: Column) -> Column:
    """A hash in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def tree_shard(key: Column, tree: Tree, leaves: dict[int, int], depth: int = 3) -> Column:
    """The shard a key descends to."""
    nodes = F.create_map(
        *[
            x
            for parent, kids in tree.items()
            for x in (
                F.lit(parent),
                F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(c).alias("c")) for c, w in kids]),
            )
        ]
    )
    node: Column = F.lit(0)
    for _ in range(depth):
        drawn = F.transform(
            F.element_at(nodes, node),
            lambda k: F.struct((-F.log(_uniform(key, k["c"])) / k["w"]).alias("d"), k["c"].alias("c")),
        )
        node = F.array_min(drawn)["c"]
    return F.element_at(F.create_map(*[x for n, s in leaves.items() for x in (F.lit(n), F.lit(s))]), node)


def slots(df: DataFrame, shard: str, key: str, ties: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... inside each shard, in hash order.

    Two steps, so that a shard is never ranked in one task: count by (shard, hash range),
    running sums over at most ``ranges`` rows a shard, then ranks inside a range.
    """
    h = F.xxhash64(F.lit(7), F.col(key))
    df = df.withColumns({"_h": h, "_r": F.pmod(F.shiftright(h, 20), F.lit(ranges)).cast("int")})
    before = Window.partitionBy(shard).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(shard, "_r")
        .agg(F.count("*").alias("_n"))
        .select(shard, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(shard, "_r").orderBy("_h", key, *ties)
    return (
        df.join(starts, [shard, "_r"])
        .withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_h", "_r", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    data = F.encode(F.col(text), "UTF-8")
    tree, leaves = topology(shards)
    grown, more = topology(shards + 1)
    placed = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(F.col(key), tree, leaves).alias("shard"),
        tree_shard(F.col(key), grown, more).alias("grown_shard"),
    )
    return slots(placed, "shard", key, ["size", "text_crc32"]).select(
        key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
