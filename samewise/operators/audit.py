"""An independent check of what a report claims about exact duplicates and containment.

It shares no code with the operators it checks: contents are compared themselves, hashes are computed here, order is
proved by the length of a longest common subsequence, recorded differences by deleting them, normalisation is written
anew. Contents are read afresh by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_again(c: Column) -> Column:
    """No byte-order mark in front, LF line ends, no blanks or tabs at the ends of lines."""
    bom = F.lit("﻿")
    c = F.when(F.startswith(c, bom), F.substring(c, 2, 2**31 - 1)).otherwise(c)
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.rtrim(x, F.lit(" \t"))), "\n")


def common_length(a: list[str], b: list[str]) -> int:
    """The length of a longest common subsequence, a row of the table at a time."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(v, len(codes)) for v in lines], np.int64) for lines in (a, b))
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        hit = np.where(y == v, row[:-1] + 1, row[1:])
        row = np.concatenate(([0], np.maximum.accumulate(np.maximum(hit, row[1:]))))
    return int(row[-1])


def _contained(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, ok`` of ``pairs`` (*keys, sub, full): whether all lines of sub are a subsequence of full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            lines = [(s.split("\n"), f.split("\n")) for s, f in zip(rows["sub"], rows["full"], strict=True)]
            yield rows[keys].assign(ok=[common_length(s, f) == len(s) for s, f in lines])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "sub", "full").mapInPandas(run, f"{kinds}, ok boolean")


def _failures(df: DataFrame, kind: str, a: str, b: str) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))


def audit_groups(claims: DataFrame, contents: DataFrame) -> DataFrame:
    """Failures of ``claims`` (hash, id): members that aren't there, groups of differing contents or of another hash."""
    known = claims.join(contents, "id", "left")
    missing = known.where("content is null")
    fresh = known.groupBy("hash").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.min("id").alias("id"))
    bad = fresh.where((F.col("lo") != F.col("hi")) | (F.sha2("lo", 256) != F.col("hash")))
    return _failures(missing, "missing_record", "id", "hash").union(_failures(bad, "exact_duplicate_group", "id", "hash")).distinct()


def audit_pairs(claims: DataFrame, contents: DataFrame) -> DataFrame:
    """Failures of ``claims`` (subset, superset, extra, final_supersets): records that aren't there, supersets that don't
    contain the subset, recorded differences that don't add up, final supersets that don't contain the subset."""
    ids = F.concat(F.array("subset", "superset"), F.coalesce("final_supersets", F.array().cast("array<string>")))
    named = claims.select(F.explode(ids).alias("id")).where("id is not null").distinct()
    missing = named.join(contents, "id", "left_anti")
    sub, full = (contents.select(F.col("id").alias(k), F.col("content").alias(c)) for k, c in (("subset", "sub"), ("superset", "full")))
    pairs = claims.join(sub, "subset").join(full, "superset")
    one = pairs.groupBy("subset", "superset").agg(F.first("sub").alias("sub"), F.first("full").alias("full"))
    proved = _contained(one, ["subset", "superset"])
    bad = proved.where(~F.col("ok"))
    good = pairs.join(proved.where("ok").select("subset", "superset"), ["subset", "superset"])
    lines, claimed = F.split("full", "\n", -1), F.coalesce("extra", F.array().cast("array<struct<line:int,text:string>>"))
    there = F.forall(claimed, lambda e: F.coalesce(F.get(lines, e["line"]) == e["text"], F.lit(False)))
    rest = F.filter(lines, lambda x, i: ~F.array_contains(F.transform(claimed, lambda e: e["line"]), i))
    wrong = good.where(~(there & (rest == F.split("sub", "\n", -1))))
    ends = good.select("subset", "sub", F.explode("final_supersets").alias("superset")).distinct().join(full, "superset")
    lost = _contained(ends, ["subset", "superset"]).where(~F.col("ok"))
    return (
        _failures(missing, "missing_record", "id", "id").union(_failures(bad, "containment_pair", "subset", "superset"))
        .union(_failures(wrong, "containment_extra_mismatch", "subset", "superset")).union(_failures(lost, "containment_final_superset", "subset", "superset")).distinct()
    )


def audit_completeness(claims: DataFrame, contents: DataFrame) -> DataFrame:
    """Records of equal contents that aren't together in one claimed group, each with the hash of the content."""
    keyed = contents.select("id", F.sha2("content", 512).alias("key")).join(claims.select("id", F.col("hash").alias("claimed")).distinct(), "id", "left")
    stats = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count("claimed").alias("named"), F.min("claimed").alias("x"), F.max("claimed").alias("y"))
    bad = stats.where("n > 1 and (named < n or x <> y)").select("key")
    return _failures(keyed.join(bad, "key", "left_semi"), "missed_exact_duplicate", "id", "key")


def audit(groups: DataFrame, pairs: DataFrame, contents: DataFrame, complete: bool = True) -> DataFrame:
    """All failures ``type, a, b``; none means that nothing the report would drop is lost."""
    found = audit_groups(groups, contents).union(audit_pairs(pairs, contents))
    return found.union(audit_completeness(groups, contents)) if complete else found


def claims_checked(groups: DataFrame, pairs: DataFrame, contents: DataFrame, complete: bool = True) -> int:
    """How many claims an audit re-derives: groups, pairs, final supersets and, if complete, records."""
    n = groups.select("hash").distinct().count() + pairs.count()
    n += pairs.select(F.coalesce(F.sum(F.size(F.coalesce("final_supersets", F.array()))), F.lit(0))).first()[0]
    return n + (contents.count() if complete else 0)
