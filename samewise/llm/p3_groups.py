"""Problem 3: pairwise matches consolidated into groups.

Method: hash-to-min. Every vertex keeps a cluster, at first itself and its neighbours; each round it sends the whole
cluster to the cluster's smallest member and that member to all others, until nothing changes. Clusters are kept as
rows (vertex, member), never as one value; the smallest member of a cluster is found by an aggregation that combines
before the shuffle, and a vertex of more than ``hot_rows`` rows gets it by broadcast, so that no task holds a large cluster.

Ids are numbered in their order first, so the rounds move two integers a row and the smallest number is the smallest id.

Defined results: a null id is left out, a row whose ids are all null gives nothing; an id that is only linked to
itself or to nothing is its own group; repeated rows, both directions and self-links change nothing; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import HOT_ROWS, lookup, materialise, release

#: Unicode white space, as removed around ids.
_SPACE = "[\\t-\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def spelled(c: Column) -> Column:
    """An id without surrounding white space, with slashes for backslashes and without leading ``./``."""
    c = F.translate(F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", ""), "\\", "/")
    return F.regexp_replace(c, r"^(\./)+", "")


def hash_to_min(edges: DataFrame, max_rounds: int = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``v, group`` for each vertex of ``edges`` (a, b), both whole numbers: group is the smallest linked vertex."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    both = both.union(both.select(F.col("u").alias("v"), F.col("v").alias("u")))
    cluster = materialise(both.union(both.select("v", F.col("v").alias("u"))).distinct())
    state = None
    for _ in range(max_rounds):
        mark = F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))
        least = materialise(cluster.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"), mark.alias("h")))
        *seen, most = least.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if seen == state:
            release(cluster)
            return least.select("v", F.col("m").alias("group"))
        state = seen
        # no vertex's rows are brought together if it has very many, as the smallest one of a large group has
        known = lookup(cluster, least.drop("h"), "v", hot_rows) if most and most > hot_rows else cluster.join(least.select("v", "m"), "v")
        new = materialise(known.select(F.col("m").alias("v"), "u").union(known.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        release(cluster, least)
        cluster = new
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def link_groups(linked: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id, group_id`` from ``linked`` (ids array<string>): the ids of a row are linked; group_id is the smallest."""
    rows = linked.select(F.array_distinct(F.filter("ids", lambda x: x.isNotNull())).alias("ids")).where("size(ids) > 0")
    # a row is a star from its first id; an id alone is linked to itself
    pairs = materialise(rows.select(F.col("ids")[0].alias("x"), F.explode("ids").alias("y")).distinct())
    many = pairs.count() > hot_rows
    ends = pairs.select(F.col("x").alias("id"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(pairs.select("y", F.lit(0), F.lit(1)))
    ids = ends.groupBy("id").agg(F.sum("x").alias("as_x"), F.sum("y").alias("as_y"))
    # numbers in the order of the ids: partitions are ranges, and the partition's number is the high part
    ids = materialise(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("k"), "as_x", "as_y"))
    edges = pairs
    for end, number in (("x", "a"), ("y", "b")):
        table = ids.select(F.col("id").alias(end), F.col("k").alias(number), F.col(f"as_{end}").alias("n"))
        edges = lookup(edges, table, end, hot_rows) if many else edges.join(table.drop("n"), end)
    groups = hash_to_min(edges.select("a", "b"), hot_rows=hot_rows)
    release(pairs)
    named = groups.join(ids.select("id", F.col("k").alias("v")), "v")
    first = ids.select(F.col("k").alias("group"), F.col("id").alias("group_id"))
    if many:
        first = materialise(groups.groupBy("group").agg(F.count("*").alias("n")).join(first, "group"))
    return (lookup(named, first, "group", hot_rows) if many else named.join(first, "group")).select("id", "group_id")


def pair_groups(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups of all ids of ``pairs`` (subset, superset, final_supersets), spelled alike."""
    ids = F.concat(F.array("subset", "superset"), F.coalesce("final_supersets", F.array().cast("array<string>")))
    return link_groups(pairs.select(F.transform(ids, spelled).alias("ids")), hot_rows)
