"""A bitmap of hashes that is broadcast to drop, where they lie, the rows that can't join. It is of bounded size whatever the
number of hashes: more of them let more rows pass, and never drop one that joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 27  # 16 MB


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for each hash in ``column`` (long) of a materialised table, sixteen times as many bits as rows, FILTER_BITS at
    most. Its words are put together by an aggregation."""
    size = min(FILTER_BITS, max(1 << 10, 1 << (16 * hashes.count() - 1).bit_length()))
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(size - 1)), 6)
    words = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be one of the bitmap's."""
    place = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
