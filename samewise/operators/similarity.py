"""TF-IDF vectors, cosine pairs above a threshold, and clusters of them.

Pairs are found by a prefix filter: terms are ordered from the rarest, and of each normalised vector only the shortest
prefix is kept beyond which the rest has a norm below the threshold. By the Cauchy-Schwarz inequality two vectors of at
least that cosine share a term of both prefixes.

What two vectors share comes, in the order, from their first shared term on. So for a pair of that cosine the product of
the two weights of that term, plus the product of the norms of what follows it on either side, reaches the threshold: a
condition of the join itself, which leaves few pairs to be shuffled. Those are scored on whole vectors. Vectors with a
term of very many meet in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialise
from .components import components

THRESHOLD = 0.65
SLACK = 1e-9
PART_ROWS = 5000  # vectors with one term that meet in one task


class Embedder:
    """Inverse document frequencies of a corpus (id, content), applicable to other texts too."""

    def __init__(self, corpus: DataFrame, tokenizer=X.tokens):
        self.tokenizer = tokenizer
        self.size = corpus.count()
        self.df = self.counts(corpus).groupBy("term").agg(F.count("*").alias("df"))

    def counts(self, texts: DataFrame) -> DataFrame:
        """``id, len, term, tf``: len is the number of tokens. Counted within each row, so nothing is shuffled."""
        found = texts.select("id", self.tokenizer(F.col("content")).alias("ts"))
        return found.select("id", F.size("ts").alias("len"), F.explode(X.counted(F.col("ts"))).alias("t")).select("id", "len", F.col("t.unit").alias("term"), F.col("t.times").alias("tf"))

    def transform(self, texts: DataFrame) -> DataFrame:
        """``id, term, w, df``; a term the corpus lacks has the greatest weight there is."""
        rows = self.counts(texts).join(self.df, "term", "left")
        idf = F.log(F.lit(self.size + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
        return rows.select("id", "term", (F.col("tf") / F.col("len") * idf).alias("w"), F.coalesce("df", F.lit(0)).alias("df"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine_edges(vectors: DataFrame, threshold: float = THRESHOLD, part_rows: int = PART_ROWS) -> DataFrame:
    """``a, b, score`` (a < b) of the pairs of ``vectors`` (id, term, w, df) of at least that cosine."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive: pairs that share no term aren't seen")
    lengths = materialise(norms(vectors).withColumn("n", F.monotonically_increasing_id()))
    unit = vectors.join(lengths, "id").select("n", F.xxhash64("term").alias("t"), "df", (F.col("w") / F.col("norm")).alias("w"))
    from_common = Window.partitionBy("n").orderBy(F.desc("df"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = unit.withColumn("square", F.sum(F.col("w") * F.col("w")).over(from_common))
    prefix = ranked.where(F.col("square") >= threshold * threshold - SLACK)
    prefix = prefix.select("t", "n", "w", F.sqrt(F.greatest(F.col("square") - F.col("w") * F.col("w"), F.lit(0.0))).alias("rest"), F.ceil(F.greatest(F.col("df"), F.lit(1)) / part_rows).cast("int").alias("parts"))
    prefix = prefix.withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
    one = prefix.select("t", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), *(F.col(c).alias(f"{c}_a") for c in ("n", "w", "rest")))
    two = prefix.select("t", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("n", "w", "rest")))
    near = F.col("w_a") * F.col("w_b") + F.col("rest_a") * F.col("rest_b") >= threshold - SLACK
    met = one.join(two, ["t", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("n_a") < F.col("n_b"))) & near)
    pairs = met.select(F.least("n_a", "n_b").alias("n_a"), F.greatest("n_a", "n_b").alias("n_b")).distinct()
    found = _scored(pairs, unit, lengths)
    return found.where(F.col("score") >= threshold)


def _scored(pairs: DataFrame, unit: DataFrame, lengths: DataFrame) -> DataFrame:
    """``a, b, score`` of ``pairs`` (n_a, n_b) by whole vectors."""
    whole = unit.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("v")).join(lengths.select("n", "id"), "n")
    for side in "ab":
        pairs = pairs.join(whole.select(F.col("n").alias(f"n_{side}"), F.col("v").alias(f"v_{side}"), F.col("id").alias(f"id_{side}")), f"n_{side}")
    common = F.array_intersect(F.map_keys("v_a"), F.map_keys("v_b"))
    score = F.aggregate(common, F.lit(0.0), lambda s, t: s + F.element_at("v_a", t) * F.element_at("v_b", t))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), score.alias("score"))


def member_scores(vectors: DataFrame, members: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``component, a, b, score`` of all pairs within each cluster of ``members`` (component, id), below the threshold too, so as
    many rows as that makes: quadratic in a cluster. Members of a large cluster meet in parts. Pairs without a common
    term have a score of 0."""
    lengths = materialise(norms(vectors).withColumn("n", F.monotonically_increasing_id()))
    unit = vectors.join(lengths, "id").select("n", F.xxhash64("term").alias("t"), (F.col("w") / F.col("norm")).alias("w"))
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    each = members.join(lengths.select("id", "n"), "id").join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
    one = each.select("component", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), F.col("n").alias("n_a"))
    two = each.select("component", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.col("n").alias("n_b"))
    met = one.join(two, ["component", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("n_a") < F.col("n_b")))
    return _scored(met.select("n_a", "n_b"), unit, lengths).join(members.withColumnRenamed("id", "a"), "a").select("component", "a", "b", "score")


def top_pairs(edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most similar pairs, by the score rounded to four places."""
    return edges.select("a", "b", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "a", "b").limit(n)


def clusters(edges: DataFrame) -> DataFrame:
    """``component, id``: groups of records linked by edges."""
    return components(edges.select("a", "b")).select("component", "id")


def cluster_quality(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, size, links, weakest, density``: signs of clusters that hold together only by chains."""
    linked = edges.join(members.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.count("*").alias("links"), F.min("score").alias("weakest"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.join(linked, "component").select("component", "size", "links", "weakest", (F.col("links") * 2 / (F.col("size") * (F.col("size") - 1))).alias("density"))
