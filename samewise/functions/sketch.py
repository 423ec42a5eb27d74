"""Counts of hashes in a fixed number of counters, packed, added up by an aggregation and broadcast: how often a hash occurs, or
more, since several share a counter. Good for an order from the rarest and for dropping what occurs once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIZE, CHUNKS = 1 << 22, 16


def level(count: np.ndarray | int) -> np.ndarray:
    """Counts in steps of some 9 %, in a byte; 0 for one or none."""
    return np.minimum(8 * np.log2(np.maximum(count, 1)), 255).astype(np.uint8)


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(11)).astype(np.int64) & (SIZE - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE, np.uint32)
    for batch in batches:
        counts += np.bincount(place(batch.column(0).flatten().to_numpy()), minlength=SIZE).astype(np.uint32)
    if counts.any():
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    added: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            added[chunk] = added.get(chunk, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
    packed = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in (np.minimum(y, 0xFFFFFFFF) for y in added.values())]
    yield pa.RecordBatch.from_arrays([pa.array(list(added), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def counts(lists: DataFrame) -> np.ndarray:
    """The counters of the hashes in ``lists``, a table of one column of lists of them."""
    out = np.zeros(SIZE, np.uint32)
    step = SIZE // CHUNKS
    for x in lists.mapInArrow(_counted, "chunk int, counts binary").repartition("chunk").mapInArrow(_added, "chunk int, counts binary").collect():
        out[x["chunk"] * step : (x["chunk"] + 1) * step] = np.frombuffer(zlib.decompress(x["counts"]), np.uint32)
    return out
