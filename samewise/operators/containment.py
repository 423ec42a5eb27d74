"""Order-preserving containment of records by lines.

If A is a subsequence of B, every line of A is in B, the rarest line of A too. So the records that have A's rarest line
are the only ones that can contain it: one equi-join gives all candidates. Guards are part of the join. ``contained``
compares lists of the lines' hashes in the join itself, so texts don't move; lines are ordered by approximate counts,
where any order is exact. Texts move for the extra lines only, those of contained records and of what contains them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sketch as K
from ..functions import text as X
from ..session import lookup, materialise, small

MIN_LINES, MAX_RATIO = 5, 20.0
PART_ROWS = 5000  # holders of one line that meet in one task


def with_lines(records: DataFrame) -> DataFrame:
    """``id, ls, nb``: lines and how many aren't empty."""
    return records.select("id", X.lines(F.col("content")).alias("ls")).withColumn("nb", X.nonblank(F.col("ls")))


def candidates(split: DataFrame, min_lines: int = MIN_LINES, max_ratio: float = MAX_RATIO, part_rows: int = PART_ROWS) -> DataFrame:
    """``subset, superset``: pairs that may be contained, from ``split`` (id, ls, nb) of records of distinct contents.

    The holders of a line that more than ``part_rows`` records have meet the records it is the rarest line of in parts."""
    each = split.select("id", "nb", F.size("ls").alias("n_lines"), F.explode(F.array_distinct(F.transform("ls", lambda x: F.xxhash64(x)))).alias("h"))
    held = materialise(each.groupBy("h").agg(F.count("*").alias("n")))
    each = lookup(each, held.withColumn("df", F.col("n")), "h")
    probe = each.where(F.col("nb") >= min_lines).groupBy("id", "nb", "n_lines").agg(F.min(F.struct("df", "h")).alias("rare"))
    parts = lambda df: F.ceil(df / part_rows).cast("int")
    probe = probe.where("rare.df > 1").select(
        F.col("id").alias("subset"), F.col("nb").alias("sub_nb"), F.col("n_lines").alias("sub_n"), F.col("rare.h").alias("h"), F.explode(F.sequence(F.lit(0), parts(F.col("rare.df")) - 1)).alias("part")
    )
    each = each.withColumn("part", F.pmod(F.xxhash64("id"), parts(F.col("df"))).cast("int"))
    # a subset without any nonblank line times an infinite ratio is no bound: it never fits
    most = F.col("sub_nb") * F.lit(float(max_ratio))
    fits = (F.col("subset") != F.col("id")) & (F.col("sub_nb") <= F.col("nb")) & ~F.isnan(most) & (F.col("nb") <= most) & (F.col("sub_n") <= F.col("n_lines"))
    return probe.join(each, ["h", "part"]).where(fits).select("subset", F.col("id").alias("superset"))


def classified(a: Column, b: Column, min_lines: int = 0, max_ratio: float = float("inf")) -> Column:
    """How two texts are related: identical, a_subset_of_b, b_subset_of_a or neither. The smaller one must have ``min_lines``
    nonblank lines or more, the larger one at most ``max_ratio`` times as many; null if a text is null."""

    def judged(s: Column) -> Column:
        la, lb, na, nb = s["la"], s["lb"], s["na"], s["nb"]

        def fits(small: Column, large: Column) -> Column:
            wide = F.lit(True) if max_ratio == float("inf") else large <= small * F.lit(float(max_ratio))
            return (small <= large) & (small >= min_lines) & wide & ((small > 0) if max_ratio == float("inf") else F.lit(True))

        return F.when(fits(na, nb) & X.is_subsequence(la, lb), "a_subset_of_b").when(fits(nb, na) & X.is_subsequence(lb, la), "b_subset_of_a").otherwise("neither")

    la, lb = X.lines(a), X.lines(b)
    counted = F.struct(la.alias("la"), lb.alias("lb"), X.nonblank(la).alias("na"), X.nonblank(lb).alias("nb"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("string")).when(a == b, "identical").otherwise(X.let(counted, judged))


def _rows(lists: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> pa.Array:
    """The lists of the rows ``at``, one after another."""
    size = np.diff(bounds)[at]
    ends = np.cumsum(size)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(lists[np.repeat(bounds[at] - (ends - size), size) + np.arange(size.sum())]))


def _line_rows(shared: Callable[[], tuple], part_rows: int, min_lines: int | None):
    """``id, nb, hs, h, parts``: with ``min_lines`` the rarest line of each record, if others may have it; else each line that
    may be another record's rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, probed = shared()
        for batch in batches:
            ids, nb, column = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            bounds = column.offsets.to_numpy()
            bounds = bounds.astype(np.int64) - bounds[0]
            lists = column.flatten().to_numpy()
            of = np.repeat(np.arange(len(nb)), np.diff(bounds))
            count = counts[K.place(lists)]
            order = np.lexsort((lists, count, of))
            new = np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (lists[order][1:] != lists[order][:-1]))) if len(order) else np.zeros(0, bool)
            at = order[new]
            if min_lines is not None:
                first = np.concatenate(([True], of[at][1:] != of[at][:-1])) if len(at) else np.zeros(0, bool)
                at = at[first]
                at = at[(count[at] > 1) & (nb[of[at]] >= min_lines)]
            else:
                at = at[(count[at] > 1) & (probed[K.place(lists[at])] > 0)]
            parts = np.ceil(count[at] / part_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[at])), pa.array(nb[of[at]]), _rows(lists, bounds, of[at]), pa.array(lists[at]), pa.array(parts)], ["id", "nb", "hs", "h", "parts"])

    return run


def contained(records: DataFrame, min_lines: int = MIN_LINES, max_ratio: float = MAX_RATIO, part_rows: int = PART_ROWS) -> DataFrame:
    """``subset, superset``: of two records (id, content) of different content the one that is contained, and the one that
    contains it."""
    schema = "id string, nb int, hs array<long>, h long, parts int"
    split = with_lines(records).select("id", "nb", F.transform("ls", lambda x: F.xxhash64(x)).alias("hs"))
    split = materialise(split)
    context = records.sparkSession.sparkContext
    counts = context.broadcast((K.counts(split.select(F.array_distinct("hs"))), None))
    probe = split.mapInArrow(_line_rows(lambda: counts.value, part_rows, min_lines), schema)
    both = context.broadcast((counts.value[0], K.counts(probe.select(F.array("h")))))
    each = split.mapInArrow(_line_rows(lambda: both.value, part_rows, None), schema).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    probe = probe.select(F.col("id").alias("subset"), F.col("nb").alias("sub_nb"), F.col("hs").alias("sub"), "h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    most = F.col("sub_nb") * F.lit(float(max_ratio))
    fits = (F.col("subset") != F.col("id")) & (F.col("sub_nb") <= F.col("nb")) & ~F.isnan(most) & (F.col("nb") <= most) & (F.size("sub") <= F.size("hs"))
    met = probe.join(each.drop("parts"), ["h", "part"]).where(fits & (F.col("sub") != F.col("hs")) & X.is_subsequence(F.col("sub"), F.col("hs")))
    return met.select("subset", F.col("id").alias("superset"))


def with_extra(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``subset, superset, extra`` of ``pairs`` (subset, superset; materialised): extra are the lines that the latter has more
    (array of line and text)."""
    for side in ("subset", "superset"):
        wanted = small(materialise(pairs.select(F.col(side).alias("id")).distinct()))
        lines = records.join(wanted, "id", "left_semi").select(F.col("id").alias(side), X.lines(F.col("content")).alias(f"{side}_lines"))
        pairs = pairs.join(lines, side)
    sub, full = F.col("subset_lines"), F.col("superset_lines")
    return pairs.where(X.is_subsequence(sub, full) & (sub != full)).select("subset", "superset", X.extra_lines(sub, full).alias("extra"))


def containment_pairs(records: DataFrame, min_lines: int = MIN_LINES, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``subset, superset, extra``: of two records of different content the one that is contained, the one that
    contains it, and the lines that the latter has more (array of line and text)."""
    return with_extra(records, materialise(contained(records, min_lines, max_ratio)))


def final_supersets(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``subset, superset, final_superset``: from each pair's superset on, the records contained in no other."""
    edges = materialise(pairs.select("subset", "superset").distinct())
    up = edges.select(F.col("subset").alias("at"), F.col("superset").alias("next"))
    reach = seen = edges.select(F.col("superset").alias("start"), F.col("superset").alias("at")).distinct()
    for _ in range(max_rounds):
        reach = reach.join(up, "at").select("start", F.col("next").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        reach = materialise(reach)
        if reach.isEmpty():
            break
        seen = materialise(seen.union(reach))
    sinks = seen.join(edges.select(F.col("subset").alias("at")).distinct(), "at", "left_anti")
    sinks = sinks.select(F.col("start").alias("superset"), F.col("at").alias("final_superset"))
    return edges.join(sinks, "superset").select("subset", "superset", "final_superset")


def survivors(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records that are contained in no other."""
    return records.join(small(materialise(pairs.select(F.col("subset").alias("id")).distinct())), "id", "left_anti")
