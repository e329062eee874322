"""Top-k search holds a small product at a time, and keeps its best across chunks, batches and blocks."""

import random

from larkfold.operators import search


def test_chunks_and_blocks_keep_the_best_and_break_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 7)
    monkeypatch.setattr(search, "BLOCK", 4)
    r = random.Random(3)
    vs = [(i, [float(r.choice([-1, 0, 1, 2])) for _ in range(2)]) for i in r.sample(range(200), 200)]  # many ties
    df = spark.createDataFrame(vs, "id long, v array<double>").repartition(2)
    got = {}
    for q in search.top_k(df, df.where("id % 10 = 0"), "id", "v", 3).orderBy("place").collect():
        got.setdefault(q["query_id"], []).append((round(q["cosine"], 9), q["match_id"]))
    size = lambda a: max(1e-30, sum(x * x for x in a) ** 0.5)
    for i, v in vs:
        if i % 10 == 0:
            best = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)) / size(v) / size(w), 9), j) for j, w in vs if j != i)[:3]
            assert [-c for c, _ in got[i]] == [c for c, _ in best] and len({j for _, j in got[i]}) == 3


def test_a_task_shuffles_k_rows_a_query(spark):
    """10 batches in one task: before, each of them sent its own k."""
    df = spark.range(500).selectExpr("id", "array(cast(id % 7 as double), cast(id % 11 as double)) AS v").coalesce(1)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        plan = search.top_k(df, df.where("id < 5"), "id", "v", 3)
        found = plan._jdf.queryExecution().analyzed()
        while found.nodeName() != "MapInArrow":
            found = found.children().head()
        rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, found).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert rows == 15
