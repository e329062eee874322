"""The trie of conversation prefixes by prefix-doubling naming (operator 13).

Every distinct turn gets a dense name; blocks of 2, 4, 8, ... turns at multiples of their length are named by the pair of
their halves' names, a level in each round of joins. A prefix of d turns is put together from the blocks of d's binary
digits, highest first: its name is found from the name of the prefix without d's lowest digit and that digit's block, a
digit in each round. A prefix is named by the smallest conversation that starts with it, which also names the trie's node.

What needs a node's subtree is summed without walking the trie. A node's smallest member is the smallest member of all
nodes below on its own path, so a node's subtree is the union of its members' paths where each of them is the smallest:
sums from a depth to a path's end, added over a node's members, are sums over the subtree.

Nothing is one task's: positions are ranks inside ranges of (conversation, turn), rounds join by (conversation, position), names
are grouped before they are joined back (a hot name's join is one that Spark splits), running sums go by blocks of positions, and
the ids of a node's last members are joined in pieces before they are hashed in order.

Defined cases: turns come in the order of turn (null first), those of one turn number in the order of their digests; a null
role or text is empty; equal rows are as many turns; rows without a conversation id belong to none and go. An empty table has no
nodes. Texts of any length travel no further than their digest. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfold.llm.common import cut
from larkfold.operators.series import running

#: Distinct keys that are numbered together; positions of a conversation in a block of its running sums; repeats of a row, and ids of a node, handled at once.
BUCKET, BLOCK, REPEATS, IDS = 500_000, 65_536, 65_536, 4096
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes): a row a turn; ``digest`` is that of the role's length, the role and the text."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes")
    )
    distinct = rows.groupBy("conv", "turn", "digest", "bytes").agg(F.count("*").alias("n"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = cut(distinct.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "trie-turns")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("conv", "range").agg(F.sum("n").alias("n")).select("conv", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = placed.join(starts, ["conv", "range"]).withColumn("first", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    pieces = at.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / REPEATS).cast("int"))))
    here = F.least(F.col("n") - F.col("piece") * REPEATS, F.lit(REPEATS))
    each = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), (here - 1).cast("int"))))
    return each.select("conv", (F.col("first") + F.col("piece").cast("long") * REPEATS + F.col("i")).alias("pos"), "digest", "bytes")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the one its group is named by."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the conversation c - c % 5: the same columns, null position for one without turns."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size")).withColumns({"base": F.col("conv") - F.col("conv") % 5, "h": shared_turns(F.col("conv"))})
    bases = sizes.where("conv = base").select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    plan = sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_size", F.lit(0))))
    heads = turns.where((F.col("conv") % 5 == 0) & (F.col("pos") < 8)).withColumnRenamed("conv", "base")
    taken = plan.select("base", "conv", "h").join(heads, "base").where("pos < h").select("conv", "pos", "digest", "bytes")
    own = turns.where(F.col("pos") >= shared_turns(F.col("conv"))).join(plan.select("conv", "h", "head"), "conv")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")
    bare = plan.where("head = 0 and size <= h").select("conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("bytes"))
    return taken.unionByName(own).unionByName(bare)


def dense_names(keys: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The distinct keys (of at most ``rows``) with a dense number from 0 as ``name``: ranks inside buckets of a hash, after the keys of the buckets before."""
    buckets = 64 + rows // BUCKET
    distinct = keys.select(*columns).distinct().withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    sizes = distinct.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(*columns)
    return distinct.join(starts, "_bucket").select(*columns, (F.col("_start") + F.row_number().over(inside) - 1).alias("name"))


def named_blocks(turns: DataFrame) -> list[DataFrame]:
    """By level k: (conv, j, name) of every whole block of 2^k turns that starts at turn j 2^k."""
    sizes = turns.agg(F.count("*").alias("n"), F.max("pos").alias("last")).first()
    names = dense_names(turns, ["digest"], sizes["n"])
    found = [cut(turns.join(names, "digest").select("conv", F.col("pos").alias("j"), "name"), "trie-blocks-0")]
    for k in range(1, ((sizes["last"] or 0) + 1).bit_length()):
        half = [F.max(F.when(F.col("j") % 2 == i, F.col("name"))) for i in (0, 1)]
        pairs = found[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(half[0].alias("left"), half[1].alias("right")).where("right is not null")
        names = dense_names(pairs, ["left", "right"], sizes["n"] >> k)
        found.append(cut(pairs.join(names, ["left", "right"]).select("conv", "j", "name"), f"trie-blocks-{k}"))
    return found


def named_prefixes(blocks: list[DataFrame]) -> DataFrame:
    """(conv, depth, node, n_convs): the smallest conversation with the same first ``depth`` turns, and how many have them; depth 0 is left out."""
    found: DataFrame | None = None
    for k in reversed(range(len(blocks))):
        start = F.shiftleft("j", k)
        block = blocks[k].where("j % 2 = 0").select("conv", start.alias("before"), (start + 2**k).alias("depth"), "name")
        ends = block.where("before = 0").select("conv", "depth", "name", F.lit(0).cast("long").alias("parent"))
        if found is not None:
            parents = found.select("conv", F.col("depth").alias("before"), F.col("node").alias("parent"))
            ends = ends.unionByName(block.where("before > 0").join(parents, ["conv", "before"]).select("conv", "depth", "name", "parent"))
        names = cut(ends.groupBy("depth", "parent", "name").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")), f"trie-names-{k}")
        here = cut(ends.join(names, ["depth", "parent", "name"]).select("conv", "depth", "node", "n_convs"), f"trie-prefixes-{k}")
        found = here if found is None else found.unionByName(here)
    return found


def hashed_members(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of rows (depth, node, conv): the hash of the conversations in order, joined by commas.

    Ids in order are joined to pieces where they lie; a node's pieces meet in the order of their first ids and are hashed one by one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*of, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, node) != of or len(ids) == IDS:
                    close()
                    of = (depth, node)
                ids.append(conv)
            yield _rows(out, ["depth", "node", "first", "ids"])
            out.clear()
        close()
        yield _rows(out, ["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha, out = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (depth, node) != of:
                    if sha:
                        out.append((*of, sha.hexdigest()))
                    of, sha = (depth, node), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(out, ["depth", "node", "ends_sha256"])
            out.clear()
        if sha:
            yield _rows([(*of, sha.hexdigest())], ["depth", "node", "ends_sha256"])

    pieces = ends.select("depth", "node", "conv").repartitionByRange("depth", "node", "conv").sortWithinPartitions("depth", "node", "conv")
    pieces = pieces.mapInArrow(join, "depth long, node long, first long, ids string")
    in_order = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return in_order.mapInArrow(digest, "depth long, node long, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("ids", "ends_sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv, pos, digest, bytes; a null position for a conversation without turns)."""
    turns = cut(turns, "trie-rebuilt")
    full = turns.where("pos is not null")
    lengths = cut(turns.groupBy("conv").agg(F.count("pos").alias("length")), "trie-lengths")
    lowest, n_convs = lengths.agg(F.min("conv"), F.count("*")).first()  # the root's members
    prefixes = named_prefixes(named_blocks(full))
    paths = full.select("conv", (F.col("pos") + 1).alias("depth"), "bytes").join(prefixes, ["conv", "depth"])
    # what each conversation saves where it is a node's smallest member, summed from here to its end
    saved = F.when(F.col("conv") == F.col("node"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    paths = paths.join(lengths, "conv").withColumn("back", F.col("length") - F.col("depth"))
    paths = cut(running(paths, ["conv"], ["back"], (F.col("back") / BLOCK).cast("long"), {"saved": saved}), "trie-paths")
    last = paths.where("back = 0").select("depth", "node", "conv")
    inner = paths.where("back > 0").select("depth", "node").distinct()
    leaves = last.where("conv = node").join(inner, ["depth", "node"], "left_anti").select("conv", F.lit(1).alias("leaf"))
    sums = F.count("*").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    sums = paths.join(leaves, "conv", "left").groupBy("depth", "node").agg(*sums)
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    links = paths.where("conv = node").select("conv", "depth", "node").join(above, ["conv", "depth"], "left")
    nodes = cut(sums.join(links.select("depth", "node", F.coalesce("parent", F.lit(lowest)).alias("parent")), ["depth", "node"]), "trie-nodes")
    if n_convs:
        top = nodes.where("depth = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        root = top.select(
            zero.alias("depth"), F.lit(lowest).alias("node"), F.lit(n_convs).alias("n_convs"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            F.coalesce("saved_tokens", zero).alias("saved_tokens"), none.alias("parent"),
        )
        nodes = nodes.unionByName(root)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    bare = lengths.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(lowest).cast("long").alias("node"), "conv")
    hashes = hashed_members(last.unionByName(bare))
    every = nodes.join(children, ["depth", "node"], "left").join(hashes, ["depth", "node"], "left")
    return every.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )
