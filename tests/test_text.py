import pytest
from pyspark.sql import functions as F

from samewise.functions import text as X


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,out", [("﻿a  \r\nb\t\rc", "a\nb\nc"), ("", ""), (None, None), (" \t", ""), ("a\n\n", "a\n\n"), ("a\u00a0", "a\u00a0"), ("x﻿", "x﻿")])
def test_normalize(spark, raw, out):
    assert one(spark, raw, X.normalize) == out


@pytest.mark.parametrize("raw,out", [("a\n", ["a", ""]), ("", [""]), (None, None), ("a\r\nb", ["a\r", "b"])])
def test_lines(spark, raw, out):
    assert one(spark, raw, X.lines) == out


def test_tokens(spark):
    assert one(spark, "The CAT's  hat-2 a réaux x9", X.tokens) == ["cat", "hat", "aux", "x9"]
    assert one(spark, "Größe ñ réaux", X.unicode_tokens) == ["größe", "réaux"]
    assert one(spark, "", X.tokens) == []


def test_segments(spark):
    wrapped = "One two\nthree. Four\nfive!\n\nSix\n"
    crlf = wrapped.replace("\n", "\r\n")
    assert one(spark, wrapped, X.paragraph) == one(spark, crlf, X.paragraph) == ["One two three. Four five!", "Six"]
    assert one(spark, crlf, X.sentence) == ["One two three.", "Four five!", "Six"]
    tight = "a b\nc d\ne"
    assert one(spark, tight, X.paragraph) == ["a b c d e"]
    assert one(spark, tight, X.paragraph_or_line) == ["a b", "c d", "e"]
    assert one(spark, " \n", X.paragraph_or_line) == []


def test_shingles(spark):
    assert one(spark, "a b c d e f", X.shingles) == ["a b c d e", "b c d e f"]
    assert one(spark, "a b c d", X.shingles) == []


def pair(spark, a, b, make, kind="array<string>"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(make(F.col("a"), F.col("b")).alias("y")).first()["y"]


def test_subsequence(spark):
    for a, b, ok in [(["a", "b"], ["a", "x", "b"], True), (["b", "a"], ["a", "b"], False), ([], [], True), ([], ["a"], True), (["a", "a"], ["a"], False)]:
        assert pair(spark, a, b, X.is_subsequence) is ok


def test_extra_lines(spark):
    found = pair(spark, ["a", "b"], ["h", "a", "x", "b", "b"], X.extra_lines)
    assert [tuple(r) for r in found] == [(0, "h"), (2, "x"), (4, "b")]


def test_token_jaccard_keeps_empty_ends(spark):
    assert pair(spark, "a b.", "a b", X.token_jaccard, "string") == pytest.approx(2 / 3)
    assert pair(spark, "A b", "b a", X.token_jaccard, "string") == 1.0


def test_classify_units(spark):
    words = " ".join(f"w{k}" for k in range(30))
    base = ["one two", words, "three four", "five six"]
    say = lambda a, b, **o: tuple(pair(spark, a, b, lambda x, y: X.classify_units(x, y, **o)))
    assert say(base, base)[0] == "collapse"
    assert say(base, [*base, "more"])[:2] == ("collapse", "a")
    assert say([*base, "more"], base)[:2] == ("collapse", "b")
    assert say(base[:2], base)[0] == "separate"
    assert say(base, [*base, "more"], min_words=100)[0] == "separate"
    assert say(base, base[::-1]) == ("review", None, "reorder", 1.0)
    assert say(base, ["one two", words.replace("w7", "zz"), "three four", "five six"]) == ("review", None, "conflict", 0.75)
    assert say(base, ["one two", "x y z", "three four", "five six"])[2] == "additive"
    assert say(base, ["q", "r", "s", "five six"])[0] == "separate"
    assert say([], base)[0] == "separate"


def test_path_id_and_extension(spark):
    assert one(spark, " ./././a\\b.md\n", X.path_id) == "a/b.md"
    assert [one(spark, p, X.extension) for p in ("a/b.tar.gz", ".hidden", "x/.y", "noext", "a.b/c")] == [".gz", "", "", "", ""]


def test_counted(spark):
    assert [tuple(r) for r in one(spark, ["b", "a", "b"], X.counted, "array<string>")] == [("a", 1), ("b", 2)]
    assert one(spark, [], X.counted, "array<string>") is None and one(spark, None, X.counted, "array<string>") is None
