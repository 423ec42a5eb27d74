"""Problem 5: how distinctive a term is of a record.

Method: a parsimonious language model. Each record's words come from a mixture of the record's own term distribution
and the background, the distribution of terms in the whole collection. Expectation-maximisation, record by record,
takes from the record's distribution what the background explains:

    E: e_t = n_t * w * p_t / ((1 - w) * P(t | collection) + w * p_t)      M: p_t = e_t / sum(e)

These rounds approach the greatest likelihood, slowly. It is concave in p, so its maximum, the converged p, is taken directly:
with r_t = (1 - w) / w * P(t | collection) it is p_t = max(0, n_t / x - r_t), x being such that the p_t add up to 1. The terms
of p above 0 are the first ones by n_t / r_t, as many as leave n_t / r_t above x.

The converged p_t ranks the terms of a record, and decides which of them are looked at as outstanding: a term above 0 has
n_t = x * (p_t + r_t), one of p 0 has at most that, so n_t * ln(N / m_t) can reach a floor only if
p_t >= floor / (x * ln(N / m_t)) - r_t. Terms below that bound are dropped, the others are checked exactly.

Background probabilities of the ``frequent`` terms that most records hold are broadcast; those of all other terms are joined,
by terms of more than ``hot_rows`` records as a broadcast too (see session.lookup).

Terms are words of letters and digits, lower-cased, of two characters or more. Defined results: null ids and contents
are left out; a content without terms gives no rows but counts as a record; repeated rows of an id count once; texts
are taken whole; ties of probability are ordered by the term; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import HOT_ROWS, lookup, materialise, once_by
from . import _text as T

FREQUENT = 20_000  # terms broadcast to every worker
WEIGHT = 0.1  # of the record's own distribution
ROUNDS = 20_000  # of expectation-maximisation that come close to the maximum; for comparison only
_TERM = re.compile(r"[^\W_]{2,}")
_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))


def count_terms(text: str) -> Counter:
    """How often each term occurs in a text."""
    if not text.isascii():
        return Counter(_TERM.findall(text.lower()))
    found = Counter(text.lower().translate(_ASCII).split())
    for term in [t for t in found if len(t) < 2]:
        del found[term]
    return found


def _count(texts: list[str]) -> tuple[list[list[str]], list[list[int]]]:
    found = [count_terms(t) for t in texts]
    return [list(f) for f in found], [list(f.values()) for f in found]


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of texts how many hold a term and how often it occurs: terms are combined before any shuffle. The
    empty term, which no text has, stands for the texts themselves."""
    for batch in batches:
        held, occur = Counter({"": batch.num_rows}), Counter()
        for text in batch.column(0).to_pylist():
            found = count_terms(text)
            held.update(found.keys())
            occur.update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64()), pa.array([occur[t] for t in held], pa.int64())], ["term", "m", "c"]
        )


def maximise(counts: np.ndarray, background: np.ndarray, bounds: np.ndarray, weight: float = WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The converged probability p of each term of each record, and its record's x and its own r; a record's terms lie
    between two bounds, none is empty."""
    n, starts, sizes = counts.astype(float), bounds[:-1], np.diff(bounds)
    spread = lambda x: np.repeat(x, sizes)
    rest = (1 - weight) / weight * background
    of = T.owners(bounds)
    order = np.lexsort((-n / rest, of))
    up_to = lambda x: (s := np.cumsum(x)) - spread(s[starts] - x[starts])
    m, r = n[order], rest[order]
    level = up_to(m) / (1 + up_to(r))  # x, if the terms up to here are those above 0
    last = np.maximum.reduceat(np.where(m > level * r, np.arange(len(m)), -1), starts)
    x = spread(level[last])
    p = np.maximum(n / x - rest, 0.0)
    return p / spread(np.add.reduceat(p, starts)), x, rest


def reachable(p: np.ndarray, x: np.ndarray, rest: np.ndarray, rarity: np.ndarray, floor: float) -> np.ndarray:
    """Which terms the converged p leaves the chance that n * rarity is ``floor`` or more; never drops one that has it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(rarity > 0, floor / (x * rarity) - rest, -np.inf if floor <= 0 else np.inf)
    return p * (1 + 1e-9) + 1e-12 >= least


def term_scores(records: DataFrame, frequent: int = FREQUENT, least_score: float | None = None, hot_rows: int = HOT_ROWS, top: int | None = None) -> DataFrame:
    """``id, term, n, m, records, p, rank`` for every term of every record of ``records`` (id, content).

    n: how often the record has the term; m: how many records hold it; records: how many there are; p: the converged
    probability; rank: by p within the record, from 1. With ``least_score`` only rows of which
    n * ln(records / m) is at least that times ln(records) are given, with ``top`` only those ranked so far; their p and
    rank are those among all terms.
    """
    spark = records.sparkSession
    texts = once_by(records.select("id", "content").where("id is not null and content is not null"), "id")
    held = texts.select("content").mapInArrow(_sum_rows, "term string, m long, c long").groupBy("term").agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
    held = materialise(held)  # a row for each term
    total = next((r["m"] for r in held.where("term = ''").collect()), 0)
    held = held.where("term <> ''")
    length = held.agg(F.sum("c")).first()[0]
    known = spark.sparkContext.broadcast({r["term"]: (r["m"], r["c"]) for r in held.orderBy(F.desc("m"), "term").limit(frequent).collect()})

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            ids, terms = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = count_terms(text)
                rare = [t for t in found if t not in table]  # a difference of views would walk through the table
                ids += [i] * len(rare)
                terms += rare
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string())], ["id", "term"])

    rare = texts.mapInArrow(unknown, "id string, term string")
    rare = lookup(rare, held.select("term", "m", "c", F.col("m").alias("n")), "term", hot_rows)
    joined = rare.groupBy("id").agg(F.collect_list(F.struct("term", "m", "c")).alias("rare"))
    both = texts.join(joined, "id", "left").select("id", "content", F.col("rare.term").alias("rt"), F.col("rare.m").alias("rm"), F.col("rare.c").alias("rc"))
    floor = -np.inf if least_score is None else least_score * np.log(max(total, 1))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts, rts, rms, rcs = (c.to_pylist() for c in part.columns)
                lists, ns = _count(texts)
                flat, m, c = [], [], []
                for ts, rt, rm, rc in zip(lists, rts, rms, rcs, strict=True):
                    own = dict(zip(rt, zip(rm, rc, strict=True), strict=True)) if rt else {}
                    for t in ts:
                        x = table.get(t) or own[t]
                        m.append(x[0])
                        c.append(x[1])
                    flat += ts
                bounds = np.cumsum([0, *map(len, lists)])
                n, m, c = np.fromiter((x for y in ns for x in y), np.int64, len(flat)), np.array(m, np.int64), np.array(c, np.float64)
                full = np.flatnonzero(np.diff(bounds))
                p, x, rest = maximise(n, c / max(length, 1), np.append(bounds[:-1][full], bounds[-1])) if len(flat) else [np.zeros(0)] * 3
                of = T.owners(bounds)
                rarity = np.log(total / np.maximum(m, 1))
                keep = np.flatnonzero(reachable(p, x, rest, rarity, floor))
                keep = keep[n[keep] * rarity[keep] >= floor]
                if least_score is None:
                    by_term = np.array(sorted(range(len(flat)), key=flat.__getitem__), np.int64)
                    order = by_term[np.lexsort((-p[by_term], of[by_term]))]  # stable, so equal p stay in the order of terms
                    rank = np.empty(len(flat), np.int64)
                    rank[order] = np.arange(len(flat)) - bounds[of] + 1
                    keep = keep if top is None else keep[rank[keep] <= top]
                    rank = rank[keep]
                else:
                    rank = np.array([1 + sum(p[j] > p[k] or p[j] == p[k] and flat[j] < flat[k] for j in range(bounds[of[k]], bounds[of[k] + 1])) for k in keep.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[of[k]] for k in keep.tolist()], pa.string()), pa.array([flat[k] for k in keep.tolist()], pa.string()), pa.array(n[keep]), pa.array(m[keep]), pa.array(np.full(len(keep), total)), pa.array(p[keep]), pa.array(rank)],
                    ["id", "term", "n", "m", "records", "p", "rank"],
                )

    return both.mapInArrow(fit, "id string, term string, n long, m long, records long, p double, rank long")


def outstanding_terms(records: DataFrame, least_score: float = 1.7) -> DataFrame:
    """``id, term, p, rank`` of the terms whose n * ln(records / m) is at least ``least_score`` * ln(records).

    The converged probabilities leave few terms; the score is the exact check of those."""
    return term_scores(records, least_score=least_score).select("id", "term", "p", "rank")
