"""What follows a report: which records could be set aside and for what, how well clusters agree with known groups, and
variants kept as differences from one text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge3 import edit_script, split_lines


def actions(groups: DataFrame, pairs: DataFrame, finals: DataFrame) -> DataFrame:
    """``id, reason, keep``: each record that another one stands for, with the smallest such id. Nothing is deleted.

    ``groups`` (id, rep), ``pairs`` (subset) and ``finals`` (subset, final_superset); a copy's reason is its
    representative, even where that is contained in turn."""
    copies = groups.where("id <> rep").select("id", F.lit("exact_duplicate").alias("reason"), F.col("rep").alias("keep"))
    ends = finals.groupBy("subset").agg(F.min("final_superset").alias("keep"))
    inside = pairs.select("subset").distinct().join(ends, "subset").select(F.col("subset").alias("id"), F.lit("contained").alias("reason"), "keep")
    return copies.union(inside)


def b_cubed(clusters: DataFrame, known: DataFrame) -> DataFrame:
    """One row ``items, precision, recall`` of ``clusters`` (component, id) against ``known`` (family, id): for each item
    how much of its cluster is of its family, and how much of its family in its cluster, on average."""
    both = known.join(clusters, "id", "left").withColumn("component", F.coalesce("component", "id"))
    cell = both.groupBy("family", "component").agg(F.count("*").alias("n"))
    family = cell.groupBy("family").agg(F.sum("n").alias("f"))
    component = cell.groupBy("component").agg(F.sum("n").alias("c"))
    joined = cell.join(family, "family").join(component, "component")
    n = F.sum("n")
    return joined.agg(n.alias("items"), (F.sum(F.col("n") * F.col("n") / F.col("c")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("f")) / n).alias("recall"))


def delta(base: str, text: str) -> str:
    """The changed stretches of lines that turn ``base`` into ``text``, as JSON."""
    b = split_lines(text)
    return json.dumps([[i, j, b[p:q]] for i, j, p, q in edit_script(split_lines(base), b)], ensure_ascii=False)


def undo_delta(base: str, change: str) -> str:
    """The text that ``delta`` was made of."""
    a, out, at = split_lines(base), [], 0
    for i, j, lines in json.loads(change):
        out += a[at:i] + lines
        at = j
    return "".join(out + a[at:])


def variants(texts: DataFrame) -> DataFrame:
    """``id, base_id, delta, delta_chars, intact`` of ``texts`` (id, base_id, base, content): each text as a difference from
    its base, and whether undoing it gives the text again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [delta(b, t) for b, t in zip(rows["base"], rows["content"], strict=True)]
            intact = [undo_delta(b, d) == t for b, d, t in zip(rows["base"], found, rows["content"], strict=True)]
            yield rows[["id", "base_id"]].assign(delta=found, delta_chars=[len(d) for d in found], intact=intact)

    return texts.select("id", "base_id", "base", "content").mapInPandas(run, "id string, base_id string, delta string, delta_chars long, intact boolean")
