"""Scalar functions over text as Column expressions: normalisation, lines, tokens, units of segmentation, shingles,
order-preserving containment and the typed comparison of unit lists. All stay inside Spark SQL.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the byte-order mark and Unicode's own included.
SPACE = "[\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Words that carry no weight in similarity.
STOPWORDS = (
    "a an the is are was were be been being and or but if then else for to of in on at by with from as this that these those it its it's"
).split()


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def unify_line_ends(c: Column) -> Column:
    """Without a leading byte-order mark, and with LF for CRLF and CR."""
    return F.regexp_replace(F.regexp_replace(c, "\\A\\uFEFF", ""), "\r\n?", "\n")


def normalize(c: Column) -> Column:
    """unify_line_ends, and no spaces or tabs before a line's end."""
    return F.regexp_replace(unify_line_ends(c), "[ \\t]+(?=\\n|\\z)", "")


def lines(c: Column) -> Column:
    """All lines; a final line feed gives a last empty one, and an empty text one empty line."""
    return F.split(c, "\n", -1)


def nonblank(units: Column) -> Column:
    """How many lines aren't empty; lines of white space count."""
    return F.size(F.filter(units, lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Runs of two or more of a-z and 0-9 of the lower-cased text, without stopwords."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{2,})"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS))


def unicode_tokens(c: Column) -> Column:
    """Runs of two or more letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]{2,})"), F.lit(1))


def clean(c: Column) -> Column:
    """White space collapsed to single spaces, none around."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "), F.lit(" "))


def _units(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, clean), lambda x: x != "")


def paragraph(c: Column) -> Column:
    """What blank lines separate."""
    return _units(F.split(unify_line_ends(c), "\n[ \\t]*\n", -1))


def paragraph_or_line(c: Column) -> Column:
    """Paragraphs; if there is only one, lines, if there is more than one."""
    paragraphs, by_line = paragraph(c), _units(F.split(unify_line_ends(c), "\n", -1))
    return F.when(F.size(paragraphs) > 1, paragraphs).when(F.size(by_line) > 1, by_line).otherwise(paragraphs)


def sentence(c: Column) -> Column:
    """What is between a full stop, question or exclamation mark and the next, whatever the lines."""
    return F.filter(F.split(clean(unify_line_ends(c)), f"(?<=[.!?]){SPACE}+", -1), lambda x: x != "")


STRATEGIES: dict[str, Callable[[Column], Column]] = {"paragraph": paragraph, "line_fallback": paragraph_or_line, "sentence": sentence}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(c: Column, width: int = 5) -> Column:
    """Runs of ``width`` words of a-z and 0-9, repeated ones included; fewer words give none."""

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, width), " "))

    return let(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), runs)


def counted(units: Column) -> Column:
    """The distinct units of a list with how often each occurs: ``array<struct<unit, times>>``, by one sort."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        whole = let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("unit"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("times"))))
        return F.when(F.size(s) > 0, whole)

    return let(F.sort_array(units), runs)


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.split(F.lower(c), "[^A-Za-z0-9_]+", -1))


def _set_jaccard(x: Column, y: Column) -> Column:
    return let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))


def token_jaccard(a: Column, b: Column) -> Column:
    """Common part of the union of two texts' words; an empty word at either end counts, as splitting leaves it."""
    return let(F.struct(_word_set(a).alias("x"), _word_set(b).alias("y")), lambda s: _set_jaccard(s["x"], s["y"]))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether every unit of a is in b in the same order, by one greedy pass."""
    matched = F.aggregate(b, F.lit(0), lambda i, v: F.when(F.get(a, i) == v, i + 1).otherwise(i))
    return matched == F.size(a)


def extra_lines(sub: Column, full: Column) -> Column:
    """The units of ``full`` that the greedy pass doesn't match, with their places, counted from 0."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<struct<line:int,text:string>>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        hit = F.coalesce(F.get(sub, s["i"]) == v, F.lit(False))
        more = F.concat(s["out"], F.array(F.struct(s["at"].alias("line"), v.alias("text"))))
        return F.struct(F.when(hit, s["i"] + 1).otherwise(s["i"]).alias("i"), (s["at"] + 1).alias("at"), F.when(hit, s["out"]).otherwise(more).alias("out"))

    return F.aggregate(full, start, step, lambda s: s["out"])


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many units two lists share, repeated ones as often as in both."""
    times = lambda units, x: F.size(F.filter(units, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def only_in(a: Column, b: Column) -> Column:
    """The units of a that b doesn't have, repeated ones included."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def classify_units(a: Column, b: Column, min_units: int = 3, min_words: int = 0, near: float = 0.8, related: float = 0.3) -> Column:
    """How two unit lists are related: ``struct<v, subset, type, shared>``.

    v: collapse (the same, or one in the other in order; subset 'a' or 'b'), review (type reorder, conflict or
    additive) or separate; shared: the common part of the shorter list, for reviews.
    """
    n, m = F.size(a), F.size(b)

    def verdict(v: str, subset: str | None = None, kind: Column | None = None, part: Column | None = None) -> Column:
        text = lambda x: F.lit(x).cast("string")
        return F.struct(text(v).alias("v"), text(subset).alias("subset"), (text(None) if kind is None else kind).alias("type"), (F.lit(None) if part is None else part).cast("double").alias("shared"))

    def contested() -> Column:
        sets = F.struct(F.transform(only_in(a, b), _word_set).alias("x"), F.transform(only_in(b, a), _word_set).alias("y"))
        return let(sets, lambda s: F.exists(s["x"], lambda x: F.exists(s["y"], lambda y: _set_jaccard(x, y) >= near)))

    def tiny(small: Column) -> Column:
        return (F.size(small) < min_units) | (F.size(F.split(F.array_join(small, " "), " ", -1)) < min_words)

    shared = F.try_divide(multiset_overlap(a, b).cast("double"), F.least(n, m).cast("double"))
    in_part = let(
        F.coalesce(shared, F.lit(0.0)),
        lambda p: F.when(p < related, verdict("separate")).otherwise(verdict("review", kind=F.when(contested(), "conflict").otherwise("additive"), part=p)),
    )
    return (
        F.when(a == b, verdict("collapse"))
        .when((n < m) & is_subsequence(a, b), F.when(tiny(a), verdict("separate")).otherwise(verdict("collapse", "a")))
        .when((m < n) & is_subsequence(b, a), F.when(tiny(b), verdict("separate")).otherwise(verdict("collapse", "b")))
        .when((n == m) & (F.sort_array(a) == F.sort_array(b)), verdict("review", kind=F.lit("reorder"), part=F.lit(1.0)))
        .otherwise(in_part)
    )


def path_id(c: Column) -> Column:
    """A path as an id: no white space around, slashes for backslashes, no leading ``./``."""
    edge = f"[{SPACE[1:-1].replace(chr(92) + 'uFEFF', '')}]+"
    c = F.translate(F.regexp_replace(c, f"\\A{edge}|{edge}\\z", ""), "\\", "/")
    return F.regexp_replace(c, "\\A(\\./)+", "")


def extension(path: Column) -> Column:
    """The last dot of the name and what follows, empty if there is none or the name only begins with it."""
    return F.regexp_extract(path, "[^/](\\.[^./]*)\\z", 1)
