"""Exact duplicates: records of one content, by hash. Hashes are taken where texts lie; texts move only where an id
occurs more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize
from ..session import HOT_ROWS, lookup, materialise, small


def _known(records: DataFrame) -> DataFrame:
    return records.where("id is not null and content is not null").select("id", "content")


def prepared(records: DataFrame, normalized: bool = False) -> DataFrame:
    """``id, content, raw`` of each distinct id; rows with a null id or content are no records. Of rows that repeat an
    id the smallest content is taken."""
    rows = _known(records).groupBy("id").agg(F.min("content").alias("raw"))
    return rows.select("id", (normalize(F.col("raw")) if normalized else F.col("raw")).alias("content"), "raw")


def hashed(records: DataFrame) -> DataFrame:
    return records.select("id", content_hash(F.col("content")).alias("hash"))


def identified(records: DataFrame, normalized: bool = False) -> DataFrame:
    """``id, hash, raw`` of each id that ``prepared`` gives: its content's hash, and a hash of the text as it is.

    Only hashes are shuffled. Ids whose rows carry different texts are read once more, for the smallest text."""
    rows = _known(records)
    text = normalize(F.col("content")) if normalized else F.col("content")
    seen = rows.select("id", F.struct(content_hash(text).alias("hash"), F.xxhash64("content").alias("raw")).alias("h"))
    seen = materialise(seen.groupBy("id").agg(F.min("h").alias("h"), F.max("h").alias("other")))
    sure = seen.where("h = other").select("id", "h.hash", "h.raw")
    unsure = seen.where("h <> other").select("id")
    if unsure.isEmpty():
        return sure
    rest = prepared(rows.join(unsure, "id", "left_semi"), normalized)
    return sure.union(rest.select("id", content_hash(F.col("content")), F.xxhash64("raw")))


def group_stats(ids: DataFrame) -> DataFrame:
    """``hash, rep, n, normalized_match`` for each content of ``ids`` (as identified): its smallest id, how many have it,
    and whether their raw texts differ."""
    return ids.groupBy("hash").agg(F.min("id").alias("rep"), F.count("*").alias("n"), (F.min("raw") != F.max("raw")).alias("normalized_match"))


def duplicate_groups(ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hash, id, rep, n, normalized_match``: the members of each group of two or more. A content of more than
    ``hot_rows`` records isn't brought together."""
    groups = group_stats(ids).where("n > 1")
    members = ids.select("hash", "id")
    if ids.count() <= hot_rows:
        return members.join(groups, "hash")
    groups = materialise(groups)
    found = lookup(members, groups.select("*", F.col("n").alias("size")), "hash", hot_rows)
    return found.select("hash", "id", "rep", F.col("size").alias("n"), "normalized_match")


def unique_records(records: DataFrame, ids: DataFrame, normalized: bool = False) -> DataFrame:
    """``id, content``: of each content the record of the smallest id; ``ids`` as identified from ``records``. Texts stay where
    they are, but for those of ids that occur more than once, while there are at most BROADCAST_ROWS of these and of
    records that stand back."""
    rows = _known(records)
    groups = small(materialise(ids.groupBy("hash").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("hash", "rep")))
    rest = small(materialise(ids.join(groups, "hash").where("id <> rep").select("id")))
    repeated = small(materialise(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")))
    rows = rows.join(rest, "id", "left_anti")
    once = rows.join(repeated, "id", "left_anti").select("id", (normalize(F.col("content")) if normalized else F.col("content")).alias("content"))
    return once.union(prepared(rows.join(repeated, "id", "left_semi"), normalized).select("id", "content"))
