import os
import random

import pytest

from samewise.llm import p6_tokens as P
from tests.conftest import rows

needs_files = pytest.mark.skipif(not os.path.exists(P.vocabulary_path()), reason="no vocabulary here")


@pytest.fixture(scope="module")
def tokens():
    return P.read_ranks(P.vocabulary_path())


def by_merging(word, ranks):
    """The plain way: merge the pair of least rank again and again."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_small_vocabularies_as_by_merging():
    """Also repeated letters, where a merge may meet itself."""
    rng = random.Random(3)
    for _ in range(40):
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 25:
            corpus = [bytes(rng.choice(b"aabc") for _ in range(rng.randint(2, 9))) for _ in range(6)]
            ranks = {t: k for k, t in enumerate(tokens)}
            parts = [[tokens[k] for k in by_merging(w, ranks)] for w in corpus]
            pairs = [p[k] + p[k + 1] for p in parts for k in range(len(p) - 1)]
            if pairs and (new := rng.choice(pairs)) not in ranks:
                tokens.append(new)
        ranks, automaton = {t: k for k, t in enumerate(tokens)}, P.Automaton(tokens)
        for _ in range(200):
            word = bytes(rng.choice(b"aabc") for _ in range(rng.randint(1, 14)))
            assert list(automaton.encode(word)) == by_merging(word, ranks), (tokens, word)
            assert automaton.decode(automaton.encode(word)) == word


@needs_files
def test_as_public_tokenizers(spark, tokens, folder):
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(-1, ""), (-2, None), (-3, "<|endoftext|>"), (-4, "a" * 5000 + " \r\n\t  x"), (-5, "\U0001f600́  'll"), (-5, "\U0001f600́  'll"), (None, "x")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.withColumn("ids", docs.text)
    found = P.tokenize(docs, "doc_id", "text").collect()
    truth = sorted((repr(r["doc_id"]), public.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in found) == truth
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    automaton = P.Automaton(tokens)
    assert all(automaton.decode(r["ids"]).decode() == text[r["doc_id"]] for r in found)


@needs_files
def test_empty_table(spark):
    found = P.tokenize(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert rows(found, "doc_id") == [] and found.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
