"""Exact deduplication of a stream of records: the first record of each content passes, copies within the watermark's
reach don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize


def first_of_each_content(records: DataFrame, time_col: str, within: str = "1 day", normalized: bool = False) -> DataFrame:
    """``records`` (id, content, time) without later rows of a content that was seen; state older than ``within`` is
    dropped, so copies further apart both pass. Rows with a null id or content are left out."""
    content = normalize(F.col("content")) if normalized else F.col("content")
    rows = records.where("id is not null and content is not null").withColumn("hash", content_hash(content))
    return rows.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["hash"])
