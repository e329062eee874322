"""Vector codes and the prefix trie against plain versions on small and odd tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfold.llm import oracles, prefix_trie, vector_codes
from tests.compare import connect, duck_rows, spark_rows

VECTORS = "vec_id long, embedding array<float>, label int, id string, vector int"
TURNS = "conv_id long, turn long, role string, text string, conv string, depth int"


def plain_codes(rows):
    """(vec_id, code, error, label, codebooks) by trying every entry."""
    def whole(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows if whole(v)]
    sizes = defaultdict(int)
    for _, v, _ in kept:
        if v and len(v) % 16 == 0:
            sizes[len(v)] += 1
    if not sizes:
        return [], ""
    length = max(sizes, key=lambda n: (sizes[n], n))
    kept = sorted(((i, v, lab) for i, v, lab in kept if len(v) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = length // 16
    parts = [[[math.floor(x * 256) for x in v[p * w : p * w + w]] for p in range(16)] for _, v, _ in kept]
    books = [[r[p] for r in parts[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(2):
        for p in range(16):
            mine = defaultdict(list)
            for r in parts:
                mine[near(r[p], books[p])[1]].append(r[p])
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for (i, _, lab), r in zip(kept, parts, strict=True):
        at = [near(r[p], books[p]) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in at), sum(d for d, _ in at), lab))
    return out, hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def coded(spark, rows):
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr)


def expected(rows):
    out, digest = plain_codes(rows)
    by = defaultdict(int)
    for _, _, e, lab in out:
        by[lab] += e
    most = 2**63 - 1
    return sorted(((i, c, min(e, most), min(by[lab], most), digest) for i, c, e, lab in out), key=repr)


@pytest.mark.parametrize("length", [16, 32, 80, 96])
def test_codes_equal_every_entry_tried(spark, length):
    rng = np.random.default_rng(length)
    rows = [(int(i), rng.normal(size=length).astype(np.float32).round(1).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(150)]
    assert coded(spark, rows) == expected(rows)


def test_codes_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    vec = lambda n=16: rng.normal(size=n).astype(np.float32).tolist()
    same = vec()
    odd = [(1, None, 1), (2, [*vec()[:15], None], 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 2), (5, [], 1), (6, vec(15), 1), (7, vec(32), 1), (None, vec(), None)]
    rows = odd + [(8, same, None)] * 3 + [(8, vec(), 4), (9, [0.0] * 16, 4), (-3, [-0.001] * 16, 4)]
    assert coded(spark, rows) == expected(rows)
    assert coded(spark, []) == [] == coded(spark, odd[:6])
    huge = rows + [(20, [3e38, -3e38] * 8, 4), (21, [1e12] * 16, 4), (22, [-2e38] * 16, 5)]
    assert coded(spark, huge) == expected(huge)


def test_bounds_leave_few_and_lose_none():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-300, 300, (500, 32)), rng.integers(-300, 300, (64, 32))
    x[:250] = c[rng.integers(0, 64, 250)] + rng.integers(-9, 10, (250, 32))
    c[9] = c[5]
    found = vector_codes.nearest_entries(x, c)
    apart = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (found.entry == apart.argmin(axis=1)).all() and (found.distance == apart.min(axis=1)).all()
    near = vector_codes.nearest_entries(x[:250], c)  # parts that lie close to an entry; of parts as far from all as entries are from each other no bound rids
    assert near.survivors < near.pairs / 10


def test_codes_decode(spark):
    rows = [(i, [float(i % 40)] * 32, 0) for i in range(100)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    books = vector_codes.fit_codebooks(table)
    for r in vector_codes.encode(table, books).collect():
        apart = sum((a - (r["id"] % 40) * 256) ** 2 for a in vector_codes.decode(r["codes"], books))
        assert apart == r["error"] == 0


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((t is not None, t or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = lambda k: [n for n in members if n[: len(k)] == k]
    cost = lambda n: (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for k, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(k)))
        kids = [n for n in members if len(n) == len(k) + 1 and n[:-1] == k]
        leaves = [n for n in below(k) if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), len(kids), len(leaves), sum(map(cost, below(k))), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns_in_order(df)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)


def test_trie_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), "user" if t % 2 else "bot", f"text {rng.integers(0, 2)}") for c in range(60) for t in range(rng.integers(1, 12))]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    long = "ü" * 300_000
    rows = [(None, 1, "a", "b"), (0, None, None, None), (0, 1, "", ""), (0, 1, "a", "bc"), (0, 1, "ab", "c"), (0, 1, "ab", "c"), (1, 1, "ab", "c"), (7, 3, "x", long), (8, 3, "x", long), (-3, 2, "x", "y"), (-8, 2, "x", "y")]
    rows += [(5, 0, "u", "again")] * 40 + [(6, t, "u", "deep") for t in range(150)] + [(9, t, "u", "deep") for t in range(149)]
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "a", "b")])


def test_repeats_beyond_a_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "REPEATS", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = [(c, 1, "u", "same") for c in range(9) for _ in range(8)]
    assert trie(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize(("name", "run"), [("OP12", lambda s, d: vector_codes.vector_codes(s.read.parquet(f"{d}/embeddings.parquet"))),
                                           ("OP13", lambda s, d: prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns_in_order(s.read.parquet(f"{d}/conversations.parquet")))))])
def test_query_equals_sql(spark, sf, name, run):
    assert spark_rows(run(spark, sf)) == duck_rows(connect(sf), getattr(oracles, name))


def test_names_are_dense(spark):
    keys = spark.range(1000).select((F.col("id") % 137).alias("a"), (F.col("id") % 2).alias("b"))
    names = prefix_trie.dense_names(keys, ["a", "b"], 1000)
    assert sorted(r["name"] for r in names.collect()) == list(range(274))
