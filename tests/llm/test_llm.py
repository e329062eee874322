import hashlib
import math
import random
import re
import string

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larkfold.llm import decontamination, image_copies, language_id, lm_scoring, mixing, setsketch, sharding, suffix_dedup, url_filter, warc
from larkfold.llm.common import cut, fresh_path
from larkfold.llm.components import components
from larkfold.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, duck_rows, spark_rows

#: Extra columns whose names the operators use inside.
CLASH = ", ".join(f"`{c}` string" for c in ("key", "id", "n", "g", "block", "score", "component", "bucket", "_rn", "size", "spans", "part", "regs", "cid", "target"))
N_CLASH = CLASH.count("string")


def words(r, n):
    return " ".join("".join(r.choices(string.ascii_lowercase[:6], k=r.randint(1, 4))) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls, empty, short, long, repeated and near-equal texts."""
    r = random.Random(7)
    base = words(r, 60)
    near = base.split()
    near[30] = "changed"
    long = words(r, 4000)
    texts = [None, "", "   \n", "one", "one", "One two three four", base, base, " ".join(near), base.upper(), long, long[:9000] + words(r, 300), "é" * 300, "x" * 500, "x" * 500, "12 34 !!", base[:200] + words(r, 30)]
    return [(i, t, ("en", "fr", None)[i % 3], ("s1", None, "s2")[i % 3]) for i, t in enumerate(texts)] + [(6, base, "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, *["?"] * N_CLASH) for d in odd_documents()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def sql_docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(connect(sf), ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# 1


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?q#f", "http://www.example.com/en/1", "http://net/es/", "http://m.net/fr/a", "http://xnet/fr/a", "http://u@h.co.uk:80/p", "a://b://c/d", "http://h?x/y", "http://h\n.com/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = spark.createDataFrame([(4, True), (999, True), (None, True), (5, None)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, out).collect()}
    assert len(got) == len(urls)
    assert [got[i]["host"] for i in range(4)] == ["", "", "", ""]
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[5]["rule"] == "www.example.com/en/" and got[6]["rule"] == "net/es/" and got[7]["rule"] == "net/fr/" and got[8]["rule"] is None
    assert (got[9]["host"], got[10]["host"], got[11]["host"], got[11]["path"]) == ("u@h.co.uk:80", "b:", "h", "")
    assert got[12]["host"] == "h\n.com"
    assert url_filter.judge_urls(pages.where("false"), out).count() == 0


def test_reputation_blocks_a_bad_host_and_shrinks_a_thin_one(spark):
    rows = [(i, "http://bad.a.com/x") for i in range(60)] + [(100 + i, "http://good.b.com/x") for i in range(300)] + [(500, "http://thin.b.com/")]
    outcomes = [(i, True) for i in range(60)] + [(100 + i, i % 50 == 0) for i in range(300)] + [(500, True)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"), rules=())
    verdict = {r["host"]: r["verdict"] for r in got.collect()}
    assert verdict == {"bad.a.com": "block", "good.b.com": "allow", "thin.b.com": "allow"}


def test_beta_quantiles():
    """Against the definition: the integral of the density up to the quantile is the tail."""
    for a, b in ((0.3, 2.0), (1.0, 1.0), (2.5, 0.7), (40.0, 60.0), (3000.0, 200.0)):
        (x,) = url_filter.beta_quantile(0.05, np.array([a]), np.array([b]))
        p = max(1.0, 1 / a)  # points y ** p, which takes a pole at 0 away
        y = (np.arange(200_000) + 0.5) / 200_000 * x ** (1 / p)
        logs = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * p * np.log(y) + (b - 1) * np.log1p(-(y**p))
        assert np.mean(np.exp(logs) * p * y ** (p - 1)) * x ** (1 / p) == pytest.approx(0.05, rel=1e-3)
    assert url_filter.beta_quantile(0.05, np.array([0.0, 5.0]), np.array([5.0, 0.0])).tolist() == [0.0, 1.0]


def test_strength_is_that_of_the_prior(spark):
    """Hosts drawn from beta priors of strength 20 around domains of very different rates."""
    r = np.random.default_rng(4)
    rows = [(float(n), float(r.binomial(n, r.beta(20 * m, 20 * (1 - m)))), m) for m in (0.1, 0.5, 0.8) for n in r.integers(5, 200, 2000).tolist()]
    assert url_filter._strength(spark.createDataFrame(rows, "n double, bad double, parent double")) == pytest.approx(20, rel=0.1)
    assert url_filter._strength(spark.createDataFrame([], "n double, bad double, parent double")) == url_filter.STRONGEST


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\n\ncom\nco.uk \n*.ck\n!www.ck\n")
    hosts = ["a.b.com", "com", "x.y.co.uk", "co.uk", "a.b.foo.ck", "foo.ck", "x.www.ck", "www.ck", "u@h.b.com:80", "", "a..b", "localhost", "1.2.3.4"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in url_filter.with_suffix_and_domain(df, url_filter.suffix_rules(spark, str(tmp_path / "rules.dat"))).collect()}
    assert got == {
        "a.b.com": ("com", "b.com"), "com": ("com", "com"), "x.y.co.uk": ("co.uk", "y.co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.foo.ck": ("foo.ck", "b.foo.ck"), "foo.ck": ("foo.ck", "foo.ck"),
        "x.www.ck": ("ck", "www.ck"), "www.ck": ("ck", "www.ck"), "u@h.b.com:80": ("com", "b.com"), "": ("", ""), "a..b": ("b", ".b"), "localhost": ("localhost", "localhost"), "1.2.3.4": ("4", "3.4"),
    }


def test_a_hot_host_and_null_ids(spark):
    rows = [(i % 900 or None, "http://hot.com/" + str(i)) for i in range(3000)] + [(5000 + i, f"http://h{i}.net/") for i in range(20)]
    got = url_filter.judge_urls(spark.createDataFrame([(*r, "?") for r in rows], "page_id long, url string, host string"), spark.createDataFrame([(1, True), (1, True)], "page_id long, bad boolean"), rules=())
    assert sorted((r["page_id"] or 0, r["host"], r["path"]) for r in got.collect()) == sorted((i or 0, u.split("/")[2], "/" + u.split("/")[3]) for i, u in rows)


# 2


def picture(seed, h=90, w=100):
    r = np.random.default_rng(seed)
    return np.kron(r.integers(0, 255, (h // 5, w // 5)), np.ones((5, 5))).astype(np.uint8)


def test_image_copies(spark):
    a, b = picture(1), picture(2)
    edited = a.copy()
    edited[40:60, 40:60] = 128
    rows = [(1, a), (2, b), (3, a[5:85, 10:95]), (4, edited), (5, np.rot90(a)), (6, np.full((50, 50), 9)), (7, picture(3)), (8, b)]
    data = [(i, image_copies.encode_pgm(x), "?") for i, x in rows] + [(9, None, "?"), (10, b"junk", "?"), (11, b"P5 9 9 255\n", "?")]
    df = spark.createDataFrame(data, "image_id long, image binary, keys string")
    got = {r["image_id"]: r["copy_of"] for r in image_copies.image_copies(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 2, 9: 9, 10: 10, 11: 11}
    assert image_copies.image_copies(df.where("false")).count() == 0


def image_groups(spark, images):
    df = spark.createDataFrame([(i, image_copies.encode_pgm(x)) for i, x in images], "image_id long, image binary")
    return {r["image_id"]: r["copy_of"] for r in image_copies.image_copies(df).collect()}


def test_small_crops_of_common_parts_are_copies(spark):
    """The crop is a fifth of its originals, and other images share that part: its descriptors are the commoner ones of all but the crop."""
    rows = []
    for s in range(6):
        whole = picture(100 + s, 200, 200)
        whole[:90, :90] = picture(s % 2, 90, 90)
        rows.append((10 + s, whole))
    crops = [(1, picture(0, 90, 90)[5:85, 5:85]), (2, picture(1, 90, 90)[:85, 5:90])]
    got = image_groups(spark, rows + crops)
    assert {i: got[i] for i, _ in rows} == {10 + s: 1 + s % 2 for s in range(6)} and got[1] == 1 and got[2] == 2


def turned(a, degrees):
    h, w = a.shape
    t = math.radians(degrees)
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    yy = np.clip(math.cos(t) * (y - cy) - math.sin(t) * (x - cx) + cy, 0, h - 1.001)
    xx = np.clip(math.sin(t) * (y - cy) + math.cos(t) * (x - cx) + cx, 0, w - 1.001)
    i, j = yy.astype(int), xx.astype(int)
    fy, fx = yy - i, xx - j
    b = a.astype(float)
    return ((1 - fy) * ((1 - fx) * b[i, j] + fx * b[i, j + 1]) + fy * ((1 - fx) * b[i + 1, j] + fx * b[i + 1, j + 1])).astype(np.uint8)


def test_recall_against_all_pairs(spark):
    """Quarters cut out, turns, noise, coarser grey levels and half size: what the tables find of all pairs that are copies by all-pairs comparison."""
    r = np.random.default_rng(8)
    rows = []
    for s in range(10):
        a = picture(700 + s, 200, 200)
        y, x = r.integers(0, 101, 2)
        edits = [a, a[y : y + 100, x : x + 100], turned(a, 15), np.rot90(a), np.clip(a + r.normal(0, 12, a.shape), 0, 255).astype(np.uint8), (a // 16 * 16).astype(np.uint8), a.reshape(100, 2, 100, 2).mean(axis=(1, 3)).astype(np.uint8)]
        rows += [(10 * s + k, e) for k, e in enumerate(edits)]
    keys = dict(zip([i for i, _ in rows], image_copies.describe([np.asarray(e, np.uint8) for _, e in rows]), strict=True))
    truth = [(i, j) for i in keys for j in keys if i < j and image_copies.is_copy(keys[i], keys[j])]
    assert all(i // 10 == j // 10 for i, j in truth) and sum(i % 10 == 0 for i, _ in truth) >= 54  # nine in ten edits are copies of their original
    got = image_groups(spark, rows)
    assert sum(got[i] == got[j] for i, j in truth) >= 0.9 * len(truth)
    assert all(got[i] // 10 == i // 10 for i in got)


def test_noisy_copies_are_found(spark):
    r = np.random.default_rng(5)
    rows = []
    for s in range(40):
        a = picture(300 + s)
        rows += [(2 * s, a), (2 * s + 1, np.clip(a + r.normal(0, 28, a.shape), 0, 255))]
    truth = {2 * s for s in range(40) if image_copies.is_copy(*image_copies.describe([rows[2 * s][1], rows[2 * s + 1][1].astype(np.uint8)]))}
    got = image_groups(spark, rows)
    assert len(truth) >= 10 and sum(got[i + 1] == i for i in truth) >= 0.99 * len(truth)


def test_small_and_equal_images(spark):
    a = picture(7, 20, 100)
    rows = [(1, a), (2, a[:, 5:]), (3, picture(8, 20, 100)), (4, np.full((50, 50), 9)), (5, np.full((50, 50), 9)), (6, np.full((50, 40), 9)), (7, a), (7, picture(9)), (8, picture(9))]
    assert image_groups(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 1, 8: 1}


def test_furniture_makes_no_pairs_outside_its_task(spark):
    """Pages that share a part that makes them no copies: as a bucket they give no pair, and many pairs at once are judged as one by one."""
    part = picture(50, 30, 60)
    rows = []
    for s in range(30):
        whole = picture(900 + s, 90, 60)
        whole[:30] = part
        rows.append((s, whole))
    rows += [(30 + s, rows[s][1][:, 5:]) for s in range(3)]
    keys = image_copies.describe([a for _, a in rows])
    pairs = [(i, j) if len(keys[i]) <= len(keys[j]) else (j, i) for i in range(33) for j in range(i)]
    truth = [image_copies.is_copy(keys[i], keys[j]) for i, j in pairs]
    assert 3 <= sum(truth) < 10
    assert image_copies.are_copies([keys[i].tobytes() for i, _ in pairs], [keys[j].tobytes() for _, j in pairs]).tolist() == truth
    likely = image_copies.may_be_copies([image_copies.brief(keys[i]) for i, _ in pairs], [image_copies.brief(keys[j]) for _, j in pairs])
    assert all(likely[np.array(truth)]) and likely.sum() < 20
    members = [{"id": i, "n": len(k), "probe": True, "brief": image_copies.brief(k)} for i, k in enumerate(keys)]
    lists = pa.array([members], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("probe", pa.bool_()), ("brief", pa.binary())])))
    met = [(a, b) for batch in image_copies._met(iter([pa.RecordBatch.from_arrays([lists], names=["all"])])) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
    assert {frozenset(p) for p in met} == {frozenset(p) for p, on in zip(pairs, likely.tolist(), strict=True) if on}
    got = image_groups(spark, rows)
    assert all(got[30 + s] == s for s in range(3))


def test_a_bucket_with_many_images(spark, monkeypatch):
    """Buckets of more than FEW images go by leaders, those of less are met whole: the groups are the same."""
    r = np.random.default_rng(3)
    rows = [(20 * s + k, np.clip(picture(40 + s, 60, 60) + r.normal(0, 2, (60, 60)), 0, 255)) for s in range(3) for k in range(12)]
    whole = image_groups(spark, rows)
    monkeypatch.setattr(image_copies, "FEW", 2)
    assert image_groups(spark, rows) == whole and len(set(whole.values())) == 3


def test_byteplot_holds_every_byte(spark):
    df = spark.createDataFrame([("é" * 50,), ("",), (None,)], "h string").select("h", image_copies.byteplot(F.col("h")).alias("i"))
    got = {r["h"]: image_copies.decode_pgm(bytes(r["i"]) if r["i"] is not None else None) for r in df.collect()}
    assert got["é" * 50].tobytes().rstrip(b"\0") == ("é" * 50).encode() and got[""] is None and got[None] is None


# 3


def near_duplicates_by_definition(rows):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_of_odd_documents(docs, none):
    got = sorted(tuple(r)[:4] for r in setsketch.near_duplicates(docs).collect())
    assert got == near_duplicates_by_definition([d[:2] for d in odd_documents()])
    assert setsketch.near_duplicates(none).count() == 0


def test_a_family_of_copies(spark):
    """Edits of one text, some too far from it, and texts around one passage: links equal brute force."""
    r = random.Random(3)
    base = [words(r, 1) + str(i) for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(len(w))] = f"e{r.random()}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:60]) + " " + words(r, 20 + i)) for i in range(40)]
    got = sorted(tuple(x)[:4] for x in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_duplicates_by_definition(rows)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[1000:])
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge_registers(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
    j, _ = setsketch.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))
    assert j[0] == pytest.approx(1 / 3, abs=0.15)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (9, 5)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(3, 3), (4, 3), (5, 3), (9, 3), (20, 20), (21, 20)]
    assert components(links.where("false")).count() == 0


# 4


def test_mix_is_near_its_targets(spark, sf):
    q = mixing.fair_queue(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("taken", F.size("finish") * F.col("size"))
    got = q.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.size("finish")).alias("n")).collect()
    for r in got:
        assert abs(r["t"] - r["target"]) <= r["most"] and r["n"] <= 3
    assert sum(r["t"] for r in got) <= round(sum(r["target"] for r in got))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = mixing.mix_sources(docs)
    assert s.columns == docs.columns and s.groupBy("doc_id").count().orderBy("doc_id").collect() == q.where("size(finish) > 0").select("doc_id", F.size("finish").cast("long").alias("count")).orderBy("doc_id").collect()
    finish, times = dict(q.select("doc_id", "finish").collect()), []
    for (d,) in s.select("doc_id").collect():
        times.append(finish[d].pop(0))
    assert times == sorted(times)


@pytest.mark.parametrize("seed", range(6))
def test_mix_is_truncated_at_the_budget(spark, seed):
    """Every service in order of finish time, with a running total, against the closed form; few large documents straddle their targets."""
    r = random.Random(seed)
    rows = [(i, r.choice((0, 1, 5, 40, 300)), r.choice("abcd") if r.random() < 0.8 else None) for i in range(r.choice((3, 12, 60)))]
    df = spark.createDataFrame(rows, "doc_id long, n int, source string")
    queue = mixing.fair_queue(df, size=F.col("n"), ranges=4).collect()
    services, budget = [], sum(n for _, n, _ in rows)
    for name in {s for _, _, s in rows}:
        mine = sorted((x for x in rows if x[2] == name), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())
        target = next(x["target"] for x in queue if x["source"] == name)
        end = 0
        for e in range(3):
            for d, n, _ in mine:
                end += n
                if target > 0 and end - n / 2 <= target:
                    services.append((end / target, name is None, name or "", e, end, d, n))
    services.sort()
    taken, total = {}, 0
    for *_, d, n in services:
        total += n
        if total <= budget:
            taken[d] = taken.get(d, 0) + n
    assert {x["doc_id"]: len(x["finish"]) * x["size"] for x in queue if x["size"]} == {d: taken.get(d, 0) for d, n, _ in rows if n}


def test_mix_of_odd_documents(docs, none):
    a = sorted(map(str, mixing.fair_queue(docs).collect()))
    assert len(a) == len(odd_documents()) and a == sorted(map(str, mixing.fair_queue(docs.repartition(2)).collect()))
    assert mixing.fair_queue(none).count() == 0 == mixing.mix_sources(none).count()
    clash = docs.withColumns({c: F.lit("?") for c in ("source_size", "finish", "_end", "_k", "_r", "_o", "row", "_id")})
    assert mixing.mix_sources(clash).columns == clash.columns and mixing.mix_sources(clash).count() == mixing.mix_sources(docs).count()


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(1480 * 2 / 3), None: pytest.approx(1480 / 3)}


def test_mix_of_null_ids_equals_sql(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i % 50, words(random.Random(i), 1 + i % 17), ("s1", "s2", None)[i % 7 % 3]) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(map(str, con.execute(ORACLE_SQL["op4_weighted_fair_mix"]).fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES["op4_weighted_fair_mix"](spark, str(tmp_path)).collect())
    assert len(got) == 200 and got == want


# 5


def test_shards(spark, docs, none):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = sharding.shard_documents(df).collect()
    counts = np.bincount([r["shard"] for r in rows], minlength=24)
    assert len(counts) == 24 and counts.min() > 600 and counts.max() < 1100
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows) and 500 < sum(r["grown_shard"] == 24 for r in rows) < 1200
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    odd = sharding.shard_documents(docs).collect()
    assert len(odd) == len(odd_documents())
    import zlib

    for r, (d, t, *_) in [(r, o) for r in odd for o in odd_documents() if o[0] == r["doc_id"]]:
        assert r["size"] == 8 + len((t or "").encode()) and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert sharding.shard_documents(none).count() == 0


def test_weights_move_keys_only_into_what_grows(spark):
    tree, leaves = sharding.topology(24)
    heavier, _ = sharding.topology(24, weights={sharding.region(0): 2.0})
    df = spark.range(5000).select(sharding.tree_shard(F.col("id"), tree, leaves).alias("a"), sharding.tree_shard(F.col("id"), heavier, leaves).alias("b"))
    rows = df.collect()
    assert all(r["a"] == r["b"] or r["b"] % 2 == 0 and r["a"] % 2 == 1 for r in rows) and any(r["a"] != r["b"] for r in rows)


def descend(key, n):
    """The shard of a key, from the definition: Spark's xxhash64 of (long key, int child) is XXH64 of one after the other, each seeded with what came before."""
    tree, leaves = sharding.topology(n)
    start = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), 42).intdigest()
    node = 0
    while node in tree:
        draws = []
        for child, weight in tree[node]:
            h = xxhash.xxh64(child.to_bytes(4, "little"), start).intdigest()
            draws.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, child))
        node = min(draws)[1]
    return leaves[node]


def test_shards_by_definition_and_law_at_every_count(spark):
    keys = [*range(-20, 400), None]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long").withColumn("text", F.lit("t"))
    for n in [*range(1, 26), 60]:
        got = {r["doc_id"]: r for r in sharding.shard_documents(df, n).collect()}
        assert {k: (r["shard"], r["grown_shard"]) for k, r in got.items()} == {k: (descend(k, n), descend(k, n + 1)) for k in keys}
        assert all(r["grown_shard"] in (r["shard"], n) for r in got.values())
        for shard in range(n):
            slots = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
            assert slots == list(range(len(slots)))


# 6


def test_archive_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://e/", "é" * 1000), (5, "http://e/", "é" * 1000)]
    df = spark.createDataFrame([(*p, "?") for p in pages], "page_id long, url string, html string, payload string")
    path = fresh_path(spark, "warc-test")
    warc.write_archive(df, path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == 6 and spark.read.parquet(f"{path}/payloads").count() == 3
    import base64

    for r in got:
        html = next((h or "").encode() for i, _, h in pages if i == r["page_id"])
        assert bytes(r["payload"]) == html
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert r["payload_digest"] == digest and lines["WARC-Payload-Digest"] == f"sha1:{digest}"
        body = html if r["record_type"] == "response" else b""
        assert rest == body + b"\r\n\r\n" and int(lines["Content-Length"]) == len(body)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(2, "response", None), (1, "revisit", 2), (3, "revisit", 4), (4, "response", None)} <= kinds
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"bad")).write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="corrupt payload"):
        warc.read_archive(spark, f"{path}-bad").collect()
    assert warc.archive_digest(spark, df.where("false")).count() == 0


def test_archive_of_null_ids(spark):
    pages = [(None, "http://a/", "only null"), (None, "http://b/", "only null"), (None, "http://c/", "shared"), (7, "http://d/", "shared"), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-null")
    warc.write_archive(df, path)
    got = warc.read_archive(spark, path).collect()
    assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(h or "" for _, _, h in pages)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert all(bytes(r["record"]).endswith(bytes(r["payload"]) + b"\r\n\r\n") for r in got)


# 7


def test_repeats_of_the_test_table(spark, sf):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == suffix_dedup.brute_force(sql_docs(spark, sf))


def test_repeats_of_odd_documents(spark, docs, none):
    unique = [d[:2] for d in odd_documents()][:-1]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect())
    want = suffix_dedup.brute_force(unique)
    assert got == sorted([(k, *v) for k, v in want.items()] + [(6, *want[6])])
    assert suffix_dedup.remove_repeats(none).count() == 0
    nulls = spark.createDataFrame([(None, "a" * 300), (1, "a" * 90)], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(nulls).collect()) == [(90, 0), (300, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_random_repeats(spark, seed):
    """Few letters, shared pieces, periods and zero bytes."""
    r = random.Random(seed)
    pool = ["".join(r.choices("ab\0", k=r.randint(50, 260))) for _ in range(6)]
    rows = [(i, "".join(r.choice(pool)[r.randint(0, 40) :] if r.random() < 0.7 else "".join(r.choices("abc", k=90)) for _ in range(4))) for i in range(30)]
    rows.append((50, "ab" * 400))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == suffix_dedup.brute_force(rows)


@pytest.mark.parametrize("often", [1, 4])
def test_hot_grams_in_parts_of_their_own(spark, monkeypatch, often):
    """A line of 60 bytes and a passage of 150 in ever new surroundings; with ``often`` 1 every sampled gram counts as hot."""
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    r = random.Random(11)
    line, passage = "".join(r.choices("abcdefgh", k=60)), "".join(r.choices("abcdefgh", k=150))
    fill = lambda n: "".join(r.choices("stuvwxyz", k=n))
    rows = [(i, fill(r.randint(0, 60)) + (passage if i % 3 == 0 else line) + r.choice([fill(30), "same tail " * 6, ""]) + line[: r.randint(0, 60)]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(suffix_dedup._parts(df, 300, 8).hot) > 0
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == suffix_dedup.brute_force(rows)


def test_parts_answer_for_every_split():
    grams = sorted([b"x" * 32] * 50 + [b"%032d" % i for i in range(50)])
    p = suffix_dedup.Parts(grams, 8)
    assert list(p.hot) == [b"x" * 32] and p.width[0] >= 2 and len(p) == p.first[0] + 2 * p.width[0]
    sides = [p.splits(i) for i in range(len(p))]
    assert sides.count((0, suffix_dedup.HALF)) == sides.count((suffix_dedup.HALF, suffix_dedup.LEFT)) == p.width[0] and sides[0] == (0, suffix_dedup.LEFT)
    assert suffix_dedup.Parts([], 8).splits(0) == (0, suffix_dedup.LEFT)
    many = suffix_dedup.Parts(grams, 3 * suffix_dedup.RANGES)
    right = np.frombuffer(b"".join(g + bytes(68) for g in grams), np.uint8).reshape(-1, 100)
    assert many.subs == 3 and (many.of(right) < many.first[0]).all()


def test_long_text_in_pieces(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choices("abcd", k=5000)).encode()
    whole = suffix_dedup.document_anchors([(1, text)])
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert sorted(suffix_dedup.document_anchors([(1, text)])["pos"]) == sorted(whole["pos"])


def test_loser_tree_merges_with_prefixes():
    r = np.random.default_rng(2)
    runs = []
    for n in (0, 1, 50, 33, 7):
        m = np.zeros((n, suffix_dedup.LENGTH), np.uint8)
        m[:, :6] = r.integers(97, 99, (n, 6))
        m = m[np.argsort(suffix_dedup._text(m))] if n else m
        runs.append((memoryview(m.tobytes()), suffix_dedup.shared_prefix(m).tobytes()))
    at = lambda q, i: bytes(q[suffix_dedup.LENGTH * i : suffix_dedup.LENGTH * (i + 1)])
    out = [(at(runs[w][0], i), s) for w, i, s in suffix_dedup.merge_runs(runs)]
    strings = [x for x, _ in out]
    assert strings == sorted(at(q, i) for q, p in runs for i in range(len(p)))
    both = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, suffix_dedup.LENGTH)
    assert [s for _, s in out] == suffix_dedup.shared_prefix(both).tolist()


# 8


def test_language_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    r = language_id.language_id(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in r) >= 0.97 * len(r)


def test_language_model_is_bounded_over_all_languages(spark, monkeypatch):
    from larkfold.llm import language_id as LI

    rows = [(i, f"{w} {w}{w} {w} {i}", f"l{j}") for j, w in enumerate(("abc", "mno", "xyz", "ghj")) for i in range(j * 100, j * 100 + 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(LI.fit_language_model(docs, landmarks=5).landmarks) == 20
    monkeypatch.setattr(LI, "MARKS", 8)
    monkeypatch.setattr(LI, "ROWS", 40)
    model = LI.fit_language_model(docs)
    assert len(model.landmarks) == 8 and model.languages == ["l0", "l1", "l2", "l3"]
    got = LI.identify(docs, model).join(docs, "doc_id").where("lang_pred = lang").count()
    assert got == len(rows)


def test_language_of_odd_documents(docs, none):
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (0, 1, 2, 15))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language_id.language_id(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_id(unlabelled).collect()} == {"und"}


def test_predictions_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit_language_model(df)
    texts = [r[0] for r in df.orderBy("doc_id").select("text").limit(40).collect()] + [d[1] for d in odd_documents()] + [" -- x", "Ärger, œuvre"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.language_id(rows, model).collect()}
    for i, (name, score) in enumerate(language_id.brute_force(texts, model)):
        assert got[i]["lang_pred"] == name and got[i]["score"] == pytest.approx(score, abs=1e-3)


def test_an_id_that_repeats_is_drawn_once(spark):
    rows = [(1, "ab cd", "x")] * 3000 + [(2, "ef gh", "y"), (3, "ij", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df, sample=5)
    assert model is None or len(model.landmarks) <= 3


def test_grams_of_pieces_equal_the_whole(monkeypatch):
    text = words(random.Random(9), 500)
    whole = language_id.gram_sets([text, None, "ab"])
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert (language_id.gram_sets([text, None, "ab"]) == whole).all()


def test_gram_presence_by_definition():
    g = language_id.gram_sets(["Ab, b"])[0]
    assert g[1] and g[2] and g[: language_id.CLASSES].sum() == 2
    bigrams = {(1, 2), (2, 0), (0, 2)}
    have = {divmod(i, language_id.CLASSES) for i in np.flatnonzero(g[language_id.CLASSES : language_id.CLASSES + language_id.CLASSES**2])}
    assert have - {(2, 0)} == bigrams - {(2, 0)}


# 9


def test_losses_equal_brute_force(spark, docs, none):
    target = spark.createDataFrame([(6,), (10,), (999,), (None,)], "i long")
    unique = [d[:2] for d in odd_documents()][:-1]
    rows = spark.createDataFrame(unique, "doc_id long, text string")
    draws = dict(rows.select("doc_id", lm_scoring.draw()).collect())
    for ids in ({6, 10}, {6}, {10}, set(range(17)), set()):
        want = lm_scoring.brute_force(unique, ids, draws)
        got = lm_scoring.cross_entropy_difference(rows, target.where(F.col("i").isin(*ids, 999) | F.col("i").isNull()) if ids <= {6, 10} else spark.createDataFrame([(i,) for i in ids], "i long"))
        for r in got.collect():
            n, *losses = want[r["doc_id"]]
            assert r["n_tokens"] == n
            assert (r["target_loss"], r["background_loss"], r["corpus_loss"]) == ((None,) * 3 if not n else tuple(pytest.approx(x) for x in losses))
    assert lm_scoring.cross_entropy_difference(docs, target).count() == len(odd_documents())
    assert lm_scoring.cross_entropy_difference(none, target).count() == 0


# 10


def test_decontamination_by_definition(spark, docs, none):
    r = random.Random(2)
    long = odd_documents()[10][1].split()
    items = [("a", " ".join(long[50:75])), ("b", "one two"), ("c", "One!"), ("d", None), ("e", "..."), (None, "two"), ("f", words(r, 30)), ("g", "É" * 300)]
    bench = spark.createDataFrame([(*i, "?") for i in items], "item_id string, text string, n string")
    rows = [d[:2] for d in odd_documents()]
    want = decontamination.brute_force(rows, items)
    for size in (decontamination.MAX_WINDOWS, 3):  # in one block and in several
        got = decontamination.decontaminate(docs, bench, max_windows=size).collect()
        assert len(got) == len(rows) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, bench.where("false")).collect())


def test_offsets_map_to_the_original(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = "Éé -- " + item.upper().replace(" ", ",  ") + "! tail"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = decontamination.scan_documents(df, spark.createDataFrame([("i", item)], "item_id string, text string")).first()
    (c,) = r["char_spans"]
    assert text[c["start"] : c["end"]] == item.upper().replace(" ", ",  ") and r["item_ids"] == ["i"]


def test_items_without_an_id_are_found(spark):
    df = spark.createDataFrame([(1, "say alpha beta"), (2, "gamma alpha beta"), (None, "alpha beta"), (3, "delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "say"), ("g", "gamma")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.decontaminate(df, bench).collect()}
    assert got == {1: (3, 1, True), 2: (3, 2, True), None: (2, 1, True), 3: (0, 0, False)}


# the pipeline


def test_stages_keep_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    a, b, c, d, e = (words(r, 60) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (5, b), (6, c), (6, c), (6, d), (None, e)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(None, " ".join(e.split()[20:35]))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda x: sorted(map(str, x.select("doc_id", "text").collect()))
    assert stages["language_id"](spark, df, "").count() == len(rows)
    two = cut(stages["near_duplicates"](spark, df, ""), "t2")
    assert [str(x) for x in pairs(two)] == pairs(spark.createDataFrame([(None, a), (5, b), (6, c), (6, d), (None, e)], "doc_id long, text string"))
    three = cut(stages["decontamination"](spark, two, str(tmp_path)), "t3")
    assert three.count() == 4 and three.where(F.col("text") == e).isEmpty()
    four = cut(stages["mixing"](spark, three, ""), "t4")
    assert pairs(four) == pairs(three)
    assert stages["sharding"](spark, four, "").count() == 4


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty, very long and repeated texts, names that the operators use inside, and no rows at all."""
    names = ("score", "lang_pred", "n_words", "size", "row", "key", "place", "rank", "kept", "component_id", "finish", "target", "shard", "word_spans", "source_size", "g", "block")
    long = words(random.Random(5), 60_000)
    odd = [(d, t, lang, s) for d, t, lang, s in odd_documents()] + [(None, None, None, None), (70, long, "en", "s1"), (71, long, "fr", None)]
    rows = [(*r, None if r[1] is None else len(r[1]), *["?"] * len(names)) for r in odd]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    spark.createDataFrame([("a", "one two three four"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema).repartition(3)
    pairs = lambda x: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in x.select("doc_id", "text").collect())
    for start, full in ((docs, True), (docs.where("false"), False)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, at, str(tmp_path)), f"odd-{name}")
            if name == "sharding":
                assert out.count() == at.count() and out.columns[0] == "doc_id"
                break
            assert out.columns == docs.columns
            have, kept = pairs(at), pairs(out)
            if name == "language_id":
                assert all(t.strip() and any(c.isalpha() for c in t) for _, t in kept)
                assert {p for p in have if any(c.isalpha() for c in p[1])} - set(kept) <= {p for p in have if len(p[1]) <= 500 and len(set(p[1])) < 3 or len(p[1].split()) < 5}
            elif name == "near_duplicates":
                groups = near_duplicates_by_definition([(i, t) for i, (_, t) in enumerate(have)])  # in order of ids, so a place is as good
                assert kept == sorted(have[i] for i, _, _, k in groups if k)
            elif name == "decontamination":
                assert kept == [p for p in have if "one two three four" not in " ".join(re.findall(r"[a-z0-9]+", p[1].lower()))]
            elif name == "mixing" and full:
                assert {p: kept.count(p) for p in kept}.keys() <= set(have) and all(kept.count(p) <= 3 * have.count(p) for p in kept)
            assert full or not kept
            at = out


def test_pipeline_stages_by_definition(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns = df.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    one = cut(stages["language_id"](spark, df, sf), "t1")
    assert one.columns == columns
    gone = df.join(one, "doc_id", "left_anti").count()
    assert gone <= 0.02 * df.count()
    two = cut(stages["near_duplicates"](spark, one, sf), "t2")
    kept = {d for d, _, _, k in near_duplicates_by_definition([tuple(r) for r in one.select("doc_id", "text").collect()]) if k}
    assert two.columns == columns and sorted(r[0] for r in two.select("doc_id").collect()) == sorted(kept)
    three = cut(stages["decontamination"](spark, two, sf), "t3")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = decontamination.brute_force([tuple(r) for r in two.select("doc_id", "text").collect()], items)
    assert three.columns == columns and {r[0] for r in three.select("doc_id").collect()} == {d for d, x in clean.items() if not x[4]}
    four = cut(stages["mixing"](spark, three, sf), "t4")
    assert four.columns == columns and four.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    five = stages["sharding"](spark, four, sf)
    assert five.count() == four.count()
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, five.collect()))


