"""Texts of megabytes through the operators that hold a text's words or tokens."""

import random
from collections import Counter

import pytest

from siteloom.llm import exact_dedup, near_text, packing, queries, ranked_search, simhash, spelling, token_cache


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(250_000)]
    other = words[:]
    other[1000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "  ".join(words)), (4, "x" * 1_500_000), (5, "short text")]
    assert min(len(t) for _, t in rows[:4]) > 1_400_000
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_duplicates_of_long_texts(long_docs):
    kept = {x.doc_id: x.keep_id for x in exact_dedup.exact_duplicates(long_docs).collect()}
    assert kept == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    for found in (simhash.near_duplicates(long_docs, words=3), near_text.near_duplicates(long_docs)):
        assert {x.doc_id: x.component for x in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_tokens_of_long_texts(long_docs, tmp_path):
    pieces = packing.token_pieces(long_docs, queries.TOKENIZER, queries.RANKS, queries.public_tokenizers.PATTERN, ids=False)
    held = Counter()
    for x in pieces.select("id", "length").collect():
        held[x.id] += x.length
    totals = {x.id: x.doc_tokens for x in pieces.filter("start = 0").collect()}
    assert dict(held) == totals and min(totals[1], totals[2], totals[3]) > 500_000
    counts = {x.doc_id: x.n_tokens for x in token_cache.count_tokens(long_docs, queries.PIECES, f"file://{tmp_path}/cache").collect()}
    assert counts[1] > 500_000 and counts[3] > counts[1]


def test_words_of_long_texts(spark, long_docs):
    assert spelling.words(long_docs, letters=1, least=1).filter("word = 'w'").first().n >= 749_998
    items = spark.createDataFrame([(1, "changed short")], "item_id long, text string")
    assert sorted(x.doc_id for x in ranked_search.search(long_docs, items).collect()) == [2, 5]
