"""Queries of the operators in this subpackage; the SQL that gives the same rows is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .p1_near_duplicates import near_groups, near_pairs
from .p2_shared_spans import fuzzy_passages, shared_spans
from .p3_groups import pair_groups
from .p4_format_duplicates import format_duplicates
from .p5_distinctive_terms import outstanding_terms, term_scores
from .p6_tokens import tokenize
from .p7_leaks import leaks
from .p8_personal_data import mentions, redacted

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(table(spark, folder, "records"), table(spark, folder, "docs"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class, group and number of links of each record and doc."""
    return near_groups(table(spark, folder, "records"), table(spark, folder, "docs"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "containment_pairs")
    return pairs.select("superset", F.explode(F.col("extra.text")).alias("text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "records"), _lines(spark, folder))


def p2_shared_words(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each record are shared."""
    found = shared_spans(table(spark, folder, "records"), _lines(spark, folder))
    return found.groupBy("id").agg(F.sum(F.col("end_word") - F.col("start_word")).alias("shared_words"), F.count("*").alias("stretches"))


def p2_passages(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_passages(table(spark, folder, "records"), _lines(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_groups(table(spark, folder, "containment_pairs"))


def p3_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return pair_groups(table(spark, folder, "containment_pairs")).groupBy("group_id").agg(F.count("*").alias("members"))


def _same_in_another_format(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records").select(F.lit("records").alias("src"), "id", F.col("content").alias("text"))
    docs = table(spark, folder, "docs").select(F.lit("docs").alias("src"), "id", "text")
    return format_duplicates(records.union(docs))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _same_in_another_format(spark, folder).select("src", "keep_id", "id")


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _same_in_another_format(spark, folder).where("id = keep_id").select("src", "keep_id", "copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return outstanding_terms(table(spark, folder, "records")).select("id", "term")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The ten terms that the model ranks first for each record."""
    return term_scores(table(spark, folder, "records"), top=10).select("id", "term", "rank", F.round("p", 6).alias("p"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize(table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each item leaked into each document: tiles may stand in any order."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which tiles of five words or more, in any order, cover at least half of an item."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least=5, coverage=0.5)
    return found.select("doc_id", "item_id", "tiles", F.round("coverage", 6).alias("coverage"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(table(spark, folder, "documents"))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_shared_words, p2_passages, p3_found, p3_group_sizes, p4_found, p4_copies, p5_found, p5_terms, p6_ids, p7_found, p7_coverage, p7_reordered, p8_found, p8_redacted)}
