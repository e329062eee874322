"""Top-k cosine search of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go out at once: a block of vectors of bounded size; and rows that meet a block in one product (a matrix of 8 MB).
BLOCK, ROWS = 4096, 256


def _best(found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query, in order, and the ids that they still name."""
    found = found[:, np.lexsort((ids[found[2].astype(int)], -found[1], found[0]))]
    start = np.searchsorted(found[0], found[0], "left")
    found = found[:, np.arange(found.shape[1]) - start < k]
    named, found[2] = np.unique(found[2].astype(int), return_inverse=True)
    return found, ids[named]


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, match_id, cosine, place): the k most similar other rows of each query; ties go to the smaller id.

    Queries go out in blocks; ``ROWS`` rows meet a block in one matrix product, and a task keeps its k best for each query as it goes, so it holds one
    product and k rows a query of a block, and what is shuffled is k rows a query and task. Exact.
    """
    spark = rows.sparkSession
    found = None
    for block in batched(queries.select(key, vector).toLocalIterator(), BLOCK):
        ids = np.array([r[0] for r in block])
        m = np.array([r[1] for r in block], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        held = spark.sparkContext.broadcast((ids, m))

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, qm = held.value
            best = np.empty((3, 0))  # place of the query, similarity, and the place of the id in ``ids``
            ids, least = np.empty(0, np.int64), np.full(len(q), -np.inf)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    own = some.column(0).to_numpy()
                    x = np.array(some.column(1).to_pylist(), np.float64)
                    sim = qm @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).T
                    sim[q[:, None] == own[None, :]] = -np.inf
                    a, b = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
                    if not len(a):
                        continue
                    best, ids = _best(np.hstack([best, [a, sim[a, b], len(ids) + b]]), np.concatenate([ids, own]), k)
                    of = best[0].astype(int)
                    full = np.flatnonzero(np.bincount(of, minlength=len(q)) == k)
                    least[full] = best[1][np.searchsorted(of, full, "right") - 1]
            if best.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(q[best[0].astype(int)]), pa.array(ids[best[2].astype(int)]), pa.array(best[1])], names=["query_id", "match_id", "cosine"])

        part = rows.select(F.col(key).cast("long"), vector).mapInArrow(near, "query_id long, match_id long, cosine double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, match_id long, cosine double, place int")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "match_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
