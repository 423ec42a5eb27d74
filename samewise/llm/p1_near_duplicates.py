"""Problem 1: near-duplicate records and docs.

Method: an exact prefix filter. With the elements of all sets in one order and n of them in a set, two sets of similarity
s or more have one in common of the larger one's first n - ceil(s * n) + 1 and the smaller one's first
n - ceil(2s / (1 + s) * n) + 1. The order is from the rarest, by counts of hashes in SKETCH counters; any order is exact,
so counters that several elements share cost time and lose nothing. Of each set only those first elements are shuffled,
packed, with a bitmap of the whole set beside them once for each partition. Sets that meet in an element are candidates
unless their bitmaps differ in too many bits for the similarity (each such bit is an element of one set only); all
candidates are verified on the sets. An element that only one row has meets nothing and isn't sent.

Equal sets are one class, which a hash of 64 bits stands for, and are compared once. An element that more than ``bucket``
classes send isn't expanded into pairs; its classes go through a prefix filter of their own, by exact counts among
themselves, in which the classes of an element meet in parts. Elements are taken as hashes of 48 bits within a text, 40
bits in the order and 32 bits between texts.

Defined results: null ids, contents and lists, null elements, empty sets and records under 20 words give no pairs;
repeated rows of an id count once; texts are taken whole; other columns are ignored; empty tables give no rows.
``near_pairs`` gives all pairs within a class and between two linked ones, whatever their size, so its rows are quadratic in
the copies of a set; ``near_groups`` has one row for each id, with its class, its group and its class's links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import HOT_ROWS as CLASS_ROWS
from ..session import lookup, materialise
from . import _text as T
from ._bitmap import bitmap, passes
from .p3_groups import hash_to_min

SIMILARITY = 0.6
WORDS, SHINGLE = 20, 3
BUCKET = 5000  # classes with one element that meet in one task, as long as they aren't many more
BITS = 512
SKETCH, CHUNKS = 1 << 22, 16  # counters of the order, and in how many parts they are added up
PREFIX_ROWS = 5_000_000  # elements in one partition, about
FLUSH_ROWS = 2_000_000
MEMBERS = 256  # ids of one class that travel together
PART_ROWS = 2000  # classes with one element that meet in one task
HOT_ROWS = 50_000  # rows with one element beyond which it isn't sent to a partition


def shingle_sets(texts: list[str], least_words: int = WORDS, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The set of word shingles of each text (none if it has too few words), laid out one set after another."""
    hashes, bounds = T.letter_words(texts)
    found, at = T.windows(hashes, bounds, size)
    of = T.owners(bounds)[at]
    long = (np.diff(bounds) >= least_words)[of]
    return _as_sets(found[long], of[long], len(texts))


def _as_sets(elements: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements (48 bits) of each of the n sets, and where each set begins. At most 2**16 sets at once."""
    both = np.unique((of.astype(np.uint64) << np.uint64(48)) | (elements >> np.uint64(16)))
    return both & np.uint64((1 << 48) - 1), np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))


def atom_sets(lists: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray]:
    names = [a for x in lists for a in x if a is not None]
    data, begins = T.code_points(names)
    hashes = T.mix(T.span_hashes(T.char_values()[data], begins[:-1], begins[1:]), 41) if names else np.zeros(0, np.uint64)
    sizes = [sum(a is not None for a in x) for x in lists]
    return _as_sets(hashes, np.repeat(np.arange(len(lists)), sizes), len(lists))


def bitmaps(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BITS bits for each set, of which each element sets one."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(elements))))
    on = np.zeros((len(starts), BITS), bool)
    on[of, (T.mix(elements, 52) >> np.uint64(32)).astype(np.int64) % BITS] = True
    return np.packbits(on, 1).view(np.int64)


_ROWS = {
    "named": "src string, id string, cid long, h2 long, size int, chunk int, counts binary",
    "prefix": "p int, classes binary, elements binary, crowded binary",
    "sets": "cid long, elements array<int>",
}
DOCS_AT_ONCE = 10_000
_ENTRY = np.dtype([("cid", np.int64), ("size", np.int32), ("bits", np.uint64, BITS // 64)])
_ROW = np.dtype([("e", np.uint32), ("of", np.uint32)])  # of: the class's place, and in the last bit whether it is of the shorter prefix


def _class_hashes(elements: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(T.mix(elements, k), starts).view(np.int64) for k in (71, 72)]


def _sets(src: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, elements, starts and sizes of the sets that aren't empty, a block at a time."""
    for batch in batches:
        ids, values = batch.column(0), batch.column(1).to_pylist()
        ranges = T.blocks(values) if src == "records" else ((i, min(i + DOCS_AT_ONCE, len(values))) for i in range(0, len(values), DOCS_AT_ONCE))
        for i, j in ranges:
            elements, bounds = (shingle_sets if src == "records" else atom_sets)(values[i:j])
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                yield ids.take(pa.array(full + i)), elements, bounds[full], np.diff(bounds)[full]


def _ordered(src: str, elements: np.ndarray) -> np.ndarray:
    """Hashes of 40 bits, other ones for records than for docs; the last bits are the counter's."""
    return T.mix(elements, 53 if src == "records" else 54) >> np.uint64(24)


def _named_rows(src: str):
    """A row for each set, and the counts of the elements, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for ids, elements, starts, sizes in _sets(src, batches):
            counts += np.bincount((_ordered(src, elements) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            none = [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
            columns = [pa.array([src] * len(ids)), ids, *map(pa.array, _class_hashes(elements, starts)), pa.array(sizes.astype(np.int32)), *none]
            yield pa.RecordBatch.from_arrays(columns, ["src", "id", "cid", "h2", "size", "chunk", "counts"])
        if counts.any():
            packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, CHUNKS)]
            none = [pa.nulls(CHUNKS, k) for k in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], ["src", "id", "cid", "h2", "size", "chunk", "counts"])

    return run


def _level(count: np.ndarray | int) -> np.ndarray:
    """Counts in steps of some 9 %, in a byte; 0 for one or none."""
    return np.minimum(8 * np.log2(np.maximum(count, 1)), 255).astype(np.uint8)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    added: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            added[chunk] = added.get(chunk, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(added), pa.int32()), pa.array([_level(x).tobytes() for x in added.values()], pa.binary())], ["chunk", "levels"])


def _set_rows(src: str, wanted: Callable[[], np.ndarray] | None = None):
    """Sets by class; only those that may be in the bitmap ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, elements, starts, sizes in _sets(src, batches):
            cid = _class_hashes(elements, starts)[0]
            keep = np.ones(len(cid), bool) if wanted is None else passes(wanted(), cid.view(np.uint64))
            short = T.mix(elements[np.repeat(keep, sizes)], 81).astype(np.uint32).view(np.int32)
            bounds = np.concatenate(([0], np.cumsum(sizes[keep])))
            yield pa.RecordBatch.from_arrays([pa.array(cid[keep]), T.list_array(short, bounds, pa.int32())], ["cid", "elements"])

    return run


def _prefix_rows(src: str, levels: Callable[[], np.ndarray], parts: int, similarity: float, hot_rows: int):
    """The first elements of each set in the order, by partition: entries of the classes, rows, and classes that have an
    element of more than ``hot_rows`` rows among them, which isn't sent."""
    hot = _level(hot_rows)

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        entries = np.concatenate([x[0] for x in held])
        e, of, index = (np.concatenate(x) for x in zip(*((x[1], x[2] + b, x[3]) for x, b in zip(held, base, strict=True)), strict=True))
        crowded = np.unique(np.concatenate([x[4] for x in held]))
        first = np.zeros(len(entries), bool)
        first[np.unique(entries["cid"], return_index=True)[1]] = True
        once = first[of]
        e, of, index = e[once], of[once], index[once]
        part = (e * np.uint64(parts)) >> np.uint64(40)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            at = order[cuts[p] : cuts[p + 1]]
            mine = crowded[crowded.view(np.uint64) % np.uint64(parts) == p]
            if len(at) or len(mine):
                own, place = np.unique(of[at], return_inverse=True)
                rows = np.empty(len(at), _ROW)
                rows["e"], rows["of"] = e[at].astype(np.uint32), (place.astype(np.uint32) << np.uint32(1)) | index[at]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (entries[own], rows, mine))], ["p", "classes", "elements", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for _, elements, starts, sizes in _sets(src, batches):
            of = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            hashed = _ordered(src, elements)
            at = levels()[(hashed & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
            ranked = np.sort((of << np.uint64(48)) | (at << np.uint64(40)) | hashed)
            place = np.arange(len(ranked)) - np.repeat(starts - starts[0], sizes)
            longer = sizes - np.ceil(sizes * similarity - 1e-9).astype(np.int64) + 1
            shorter = sizes - np.ceil(sizes * (2 * similarity / (1 + similarity)) - 1e-9).astype(np.int64) + 1
            level = (ranked >> np.uint64(40)).astype(np.uint8)
            sent = (place < np.repeat(longer, sizes)) & (level > 0)
            ranked, of, level, index = ranked[sent], of[sent].astype(np.int64), level[sent], (place < np.repeat(shorter, sizes))[sent]
            entries = np.empty(len(sizes), _ENTRY)
            entries["cid"], entries["size"], entries["bits"] = _class_hashes(elements, starts)[0], sizes, bitmaps(elements, starts - starts[0]).view(np.uint64)
            cold = level <= hot
            held.append((entries, ranked[cold] & np.uint64((1 << 40) - 1), of[cold], index[cold], entries["cid"][np.unique(of[~cold])]))
            kept += len(of)
            if kept > FLUSH_ROWS:
                yield from packed(held)
                held, kept = [], 0
        if held:
            yield from packed(held)

    return run


def _scan(records: DataFrame, docs: DataFrame, rows: str, make: Callable) -> DataFrame:
    out = []
    for src, df, value in (("records", records, "content"), ("docs", docs, "atoms")):
        df = df.select("id", value).where(f"id is not null and {value} is not null")
        out.append(df.mapInArrow(make(src), _ROWS[rows]))
    return out[0].union(out[1])


def _met(similarity: float, bucket: int):
    """Pairs of classes that meet in an element and may be similar, each once in a partition (or in some 2 million), and
    (class, null) for those that have an element of more than ``bucket`` classes."""

    def some(e: np.ndarray, of: np.ndarray, index: np.ndarray, size: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = 1
        bits = entries["bits"]
        while step < len(e):
            at = np.flatnonzero((e[step:] == e[:-step]) & index[:-step])
            if not len(at):
                break
            at = at[size[at] >= similarity * size[at + step] - 1e-9]
            x, y, both = of[at], of[at + step], size[at] + size[at + step]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            near = (both - differ) / 2 * (1 + similarity) >= both * similarity - 1e-9
            yield np.minimum(x, y)[near], np.maximum(x, y)[near]
            step += 1

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray]], cid: np.ndarray) -> pa.RecordBatch:
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        both = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        x, y = cid[(both >> np.uint64(32)).astype(np.int64)], cid[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows, crowded, known = [np.empty(0, _ENTRY)], [np.empty(0, _ROW)], [np.empty(0, np.int64)], 0
        for batch in batches:
            for _, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table, own = np.frombuffer(blobs[0], _ENTRY), np.frombuffer(blobs[1], _ROW).copy()
                own["of"] += np.uint32(2 * known)
                known += len(table)
                tables.append(table)
                rows.append(own)
                crowded.append(np.frombuffer(blobs[2], np.int64))
        entries, rows, crowded = (np.concatenate(x) for x in (tables, rows, crowded))
        del tables
        first = np.zeros(len(entries), bool)
        first[np.unique(entries["cid"], return_index=True)[1]] = True
        rows = rows[first[rows["of"] >> 1]]  # a class's rows are alike wherever it was scanned
        cid, sizes = entries["cid"].copy(), entries["size"].astype(np.int64)
        rows = rows[np.lexsort((sizes[rows["of"] >> 1], rows["e"]))]
        starts = np.flatnonzero(np.concatenate(([True], rows["e"][1:] != rows["e"][:-1]))) if len(rows) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(rows)))
        full = np.repeat(count > bucket, count)
        crowded = np.unique(np.concatenate((crowded, cid[rows["of"][full] >> 1])))
        yield pa.RecordBatch.from_arrays([pa.array(crowded), pa.nulls(len(crowded), pa.int64())], ["a", "b"])
        rows = rows[np.repeat(count > 1, count) & ~full]
        cuts = np.flatnonzero(np.concatenate(([True], rows["e"][1:] != rows["e"][:-1]))) if len(rows) else np.zeros(0, np.int64)
        parts, kept, i = [], 0, 0
        while i < len(rows):
            j = min(i + (1 << 20), len(rows))
            j = int(cuts[k]) if (k := int(np.searchsorted(cuts, j))) < len(cuts) else len(rows)
            of = (rows["of"][i:j] >> 1).astype(np.int64)
            for pair in some(rows["e"][i:j].copy(), of, (rows["of"][i:j] & 1).astype(bool), sizes[of], entries):
                parts.append(pair)
                kept += len(pair[0])
                if kept > 1 << 21:
                    yield batch_of(parts, cid)
                    parts, kept = [], 0
            i = j
        if parts:
            yield batch_of(parts, cid)

    return run


def _prefix_pairs(classes: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """All candidate pairs among ``classes`` by the prefix filter. Classes with one element meet in parts of ``most``."""
    each = classes.join(sets, "cid").select("src", "cid", "size", F.explode("elements").alias("e"))
    rarity = each.groupBy("src", "e").agg(F.count("*").alias("df"))
    ordered = each.join(rarity, ["src", "e"]).groupBy("src", "cid", "size").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    length = F.greatest(F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1, F.lit(1)).cast("int")
    prefix = ordered.select("src", "cid", "size", F.explode(F.slice("es", F.lit(1), length)).alias("p")).select("src", "cid", "size", "p.e", F.ceil(F.col("p.df") / most).alias("parts"))
    prefix = prefix.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    one = prefix.select("src", "e", F.col("cid").alias("x"), F.col("size").alias("size_x"), F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"))
    two = prefix.select("src", "e", F.col("cid").alias("y"), F.col("size").alias("size_y"), F.col("part").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))).alias("i"))
    near = (F.col("size_x") >= similarity * F.col("size_y") - 1e-9) & (F.col("size_y") >= similarity * F.col("size_x") - 1e-9)
    met = one.join(two, ["src", "e", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _near(records: DataFrame, docs: DataFrame, similarity: float, bucket: int, hot_rows: int, part_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows ``src, id, cid`` of all sets, materialised, the classes and the links of near_classes."""
    spark = records.sparkSession
    named = materialise(_scan(records, docs, "named", _named_rows))
    counts = named.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_levels, "chunk int, levels binary").collect()
    named = named.where("chunk is null")
    levels = np.zeros(SKETCH, np.uint8)
    for x in counts:
        levels[x["chunk"] * (SKETCH // CHUNKS) :][: SKETCH // CHUNKS] = np.frombuffer(x["levels"], np.uint8)
    shared = spark.sparkContext.broadcast(levels)
    elements = named.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil((1 - similarity) * elements / PREFIX_ROWS))
    prefixes = _scan(records, docs, "prefix", lambda src: _prefix_rows(src, lambda: shared.value, parts, similarity, hot_rows))
    found = materialise(prefixes.repartitionById(parts, "p").mapInArrow(_met(similarity, bucket), "a long, b long").distinct())
    classes = named.groupBy("src", "cid", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"))
    crowded = found.where("b is null").select(F.col("a").alias("cid"))
    candidates = found.where("b is not null")
    meets = spark.sparkContext.broadcast(bitmap(materialise(found.select(F.explode(F.array("a", "b")).alias("cid")).where("cid is not null").distinct()), "cid"))
    sets = _scan(records, docs, "sets", lambda src: _set_rows(src, lambda: meets.value)).groupBy("cid").agg(F.first("elements").alias("elements"))
    if not crowded.isEmpty():
        light = materialise(classes.select("cid", "src", "size"))
        candidates = candidates.union(_prefix_pairs(light.join(crowded.distinct(), "cid", "left_semi"), sets, similarity, part_rows)).distinct()
    for side in ("a", "b"):
        candidates = candidates.join(sets.select(F.col("cid").alias(side), F.col("elements").alias(f"e_{side}")), side)
    common, both = F.size(F.array_intersect("e_a", "e_b")).alias("common"), (F.size("e_a") + F.size("e_b")).alias("both")
    links = candidates.select("a", "b", common, both).where(F.col("common") * (1 + similarity) >= F.col("both") * similarity - 1e-9)
    return named.select("src", "id", "cid"), classes, links.select("a", "b", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity"))


def near_classes(records: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET, hot_rows: int = HOT_ROWS, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets ``cid, src, h2, n, rep, size``, and the verified links between them ``a, b, similarity``."""
    return _near(records, docs, similarity, bucket, hot_rows, part_rows)[1:]


def class_members(named: DataFrame, classes: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``src, id`` and the columns of its class for each id that has a set (named: src, id, cid), once. A class of more than
    ``class_rows`` rows isn't brought together."""
    return lookup(named.distinct(), classes, ["src", "cid"], class_rows)


def all_pairs(members: DataFrame, links: DataFrame, most: int = MEMBERS) -> DataFrame:
    """``src, id_a, id_b`` for all pairs of ``members`` (src, cid, n, id; n: at least the members of its class) within a
    class and of two linked ones (a, b), each once.

    Members travel in parts of some ``most`` ids, so no task holds a whole class; pairs are written out part by part."""
    parts = members.withColumn("parts", F.ceil(F.col("n") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    parts = materialise(parts.groupBy("src", "cid", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("parts").alias("parts")))
    inner = parts.where("size(ids) > 1").select("src", "ids", F.posexplode("ids").alias("k", "x"))
    inner = inner.select("src", "x", F.explode(F.slice("ids", F.col("k") + 2, F.size("ids"))).alias("y"))
    sizes = parts.groupBy("cid").agg(F.first("parts").alias("parts"))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(k)
    met = links.select("a", "b").join(sizes.select(F.col("cid").alias("a"), numbers("i")), "a").join(sizes.select(F.col("cid").alias("b"), numbers("j")), "b")
    large = parts.where("part > 0").select(F.col("cid").alias("a"), F.col("part").alias("i"), F.col("cid").alias("b"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("j"))
    cells = met.select("a", "i", "b", "j").union(large)
    x = parts.select("src", F.col("cid").alias("a"), F.col("part").alias("i"), F.col("ids").alias("xs"))
    y = parts.select(F.col("cid").alias("b"), F.col("part").alias("j"), F.col("ids").alias("ys"))
    outer = cells.join(x, ["a", "i"]).join(y, ["b", "j"]).select("src", F.explode("xs").alias("x"), "ys").select("src", "x", F.explode("ys").alias("y"))
    return inner.select("src", "x", "y").union(outer).select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_pairs(records: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET, hot_rows: int = HOT_ROWS, members: int = MEMBERS, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``src, id_a, id_b`` for pairs of records (id, content) and of docs (id, atoms) of that similarity or more."""
    named, classes, links = _near(records, docs, similarity, bucket, hot_rows, PART_ROWS)
    known = class_members(named, classes.select("src", "cid", "n", F.col("n").alias("of")), class_rows)
    return all_pairs(known.select("src", "cid", F.col("of").alias("n"), "id"), links, members)


def near_groups(records: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``src, id, class_id, group_id, links`` for each id that has a set: its class's and its group's smallest id, and
    the number of other classes its class is linked with."""
    named, classes, links = _near(records, docs, similarity, BUCKET, HOT_ROWS, PART_ROWS)
    classes, links = materialise(classes), materialise(links)
    linked = links.select("a", "b").union(classes.select("cid", "cid"))
    groups = hash_to_min(linked).withColumnsRenamed({"v": "cid"})
    degree = links.select(F.col("a").alias("cid")).union(links.select("b")).groupBy("cid").agg(F.count("*").alias("links"))
    found = classes.join(groups, "cid").join(degree, "cid", "left")
    first = found.groupBy("group").agg(F.min("rep").alias("group_id"))
    found = found.join(first, "group").select("src", "cid", "n", F.col("rep").alias("class_id"), "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    return class_members(named, materialise(found)).select("src", "id", "class_id", "group_id", "links")
