"""Documents dealt to groups of bounded size, travelling in compressed blocks.

Operators that need whole texts beside what an exchange found out about them deal the documents to groups by a hash of
their id. A block holds what one Arrow batch has for one group, as a compressed Arrow stream: about a third of the bytes
that rows of text take in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")
_CODEC = pa.Codec("zstd", compression_level=1)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups


def _groups(batch: pa.RecordBatch, groups: int) -> np.ndarray:
    """The group of each row: by its id, without one by a hash of its text."""
    ids = batch.column(0)
    if not ids.null_count:
        return group_of(ids.to_numpy(), groups)
    keys = ids.fill_null(0).to_numpy().copy()
    if batch.num_columns > 1:
        none = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        keys[none] = [xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in batch.column(1).take(pa.array(none)).cast(pa.binary()).to_pylist()]
    return group_of(keys, groups)


def pack(df: DataFrame, groups: int) -> DataFrame:
    """(g int, block binary) from rows whose first column is a long id and whose second one, if any, is a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            of = _groups(batch, groups)
            order = np.argsort(of, kind="stable")
            batch = batch.take(pa.array(order))
            edges = np.flatnonzero(np.concatenate(([True], np.diff(of[order]) != 0, [True])))
            g, blocks = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                g.append(int(of[order[a]]))
                blocks.append(_stream(batch.slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(blocks, pa.binary())], names=["g", "block"])

    return df.mapInArrow(run, "g int, block binary")


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw).to_pybytes()


def unsqueeze(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little")).to_pybytes()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, byte by byte of all, compressed."""
    step = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text of a table, for sizing groups."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0
