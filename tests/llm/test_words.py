"""Spelling variants, ranked search and cached token counts, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from siteloom.llm import common, queries, ranked_search, spelling, token_cache

# Spelling variants


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    forms, found = {}, {}
    for w, n in counts.items():
        near = sorted((-m, x) for x, m in counts.items() if _near(w, x))
        best = near[0] if near and -near[0][0] >= 2 * n else None
        forms[w] = best[1] if best else None
        found[w] = [forms[w], None, n, len(near), -best[0] if best else None]
    for w in counts:
        end = w
        while forms[end] is not None:
            end = forms[end]
        found[w][1] = end
    return {w: tuple(x) for w, x in found.items()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    counts = {}
    while len(counts) < 500:
        word = "".join(rng.choice(["an", "na", "e", "é", "tt", "t", "ß"]) for _ in range(rng.randrange(1, 5)))
        counts[word] = rng.choice([3, 5, 6, 10, 12, 24, 50, 100])
    for n, word in ((400, "ab"), (200, "abc"), (100, "abcd"), (50, "abcde"), (25, "abcdef"), (12, "abcdefg")):
        counts[word] = n
    rows = spark.createDataFrame([*counts.items(), (None, 4)], "word string, n long").withColumn("form", common.F.lit("x"))
    got = spelling.variants(rows).collect()
    assert len(got) == len(counts)
    assert {x.word: tuple(x[1:]) for x in got} == _variants(counts)
    assert {x.word: x.root for x in got}["abcdefg"] == "ab"


def test_each_near_pair_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(200)})
    got = [tuple(sorted((x.a, x.b))) for x in spelling.near_pairs(spark.createDataFrame([(x, 3) for x in words], "word string, n long")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and _near(a, b)}


def test_words_lose_letters_by_chance(spark, docs):
    given = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10, "Garçon × GARÇON 漢garçon " * 40), (11, "a" * 3_000_000 + " garçon")], "doc_id long, text string")
    )
    want = Counter()
    for doc_id, text in given.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    got = {x.word: x.n for x in spelling.words(given, letters=4, least=2, slips=3).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 4 and n >= 2}


def test_variants_of_nothing(no_docs):
    assert spelling.variants(spelling.words(no_docs)).count() == 0


# Ranked search

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def _ranking(rows, query, k):
    held = [(i, Counter(_terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    scored = []
    for i, c in held:
        m = 10 + 90 * c.total() * n_docs // n_terms
        score = 0
        for term in set(_terms(query)) & c.keys():
            df = sum(term in x for _, x in held)
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * m))
        scored.append((-score, i is None, i or 0))
    return [(None if no_id else i, -s) for s, no_id, i in sorted(scored) if s][:k]


@pytest.mark.parametrize(("block", "terms"), [(1 << 22, 1 << 18), (300, 1)])
def test_search_equals_brute_force(spark, docs, monkeypatch, block, terms):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", terms)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "THE"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(100, 400)]
    rows += [(i, rows[5][1]) for i in range(400, 430)]  # more equal scores than places
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = [(1, rows[5][1]), (2, "the quick, BROWN fox w3"), (3, None), (4, "nothing-like-it"), (None, "w1 w2"), (5, "w7"), (5, "w8 w7")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for x in ranked_search.search(given, asked, k=10).orderBy("rank").collect():
        got.setdefault(x.item_id, []).append((x.doc_id, x.score))
        assert x.rank == len(got[x.item_id])
    plain = [(x.doc_id, x.text) for x in given.collect()]
    want = {i: _ranking(plain, t, 10) for i, t in [*items[:2], (None, "w1 w2"), (5, "w7 w8")]}
    assert got == want


def test_reading_stops_at_the_best_positions():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = []
    for i in range(5000):
        terms = np.flatnonzero(rng.random(6) < 0.5) if i % 500 else np.arange(6)
        rows.append({"id": i, "n": 30 if i % 500 else 9, "terms": terms.tolist(), "tfs": [int(x) for x in rng.integers(1, 3, len(terms)) + (60 if i % 500 == 0 else 0)]})
    batch = pa.Table.from_pylist(rows, pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))]))
    block = ranked_search.Block(batch, np.full(6, 700), 5000, 140_000)
    best, all_ = ranked_search.Best(5), ranked_search.Best(5)
    read = ranked_search.best_positions(block, np.arange(6), best)
    assert read <= 6 * ranked_search.DEPTH * ranked_search.GROWTH
    sums = np.array([block.row_impacts[a:b].sum() for a, b in zip(block.row_ends, block.row_ends[1:], strict=False)])
    all_.add(sums, block.no_id, block.ids)
    assert best.ids.tolist() == all_.ids.tolist() and best.scores.tolist() == all_.scores.tolist()
    assert (block.mark == -1).all()
    # With a k-th score beyond all bounds nothing is read.
    assert ranked_search.best_positions(block, np.arange(6), best) <= read
    best.scores += 10**12
    assert ranked_search.best_positions(block, np.arange(6), best) == 0


def test_long_texts_are_tokenised_in_parts(monkeypatch):
    text = ("Mot é-漢字_x9 " * 50).encode()
    want = ranked_search.terms(text)
    monkeypatch.setattr(ranked_search, "PART_BYTES", 7)
    assert ranked_search.terms(text) == want
    assert want["é".encode()] == 50 and want[b"x9"] == 50 and want[b"mot"] == 50


def test_search_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "quick")], "item_id long, text string")
    assert ranked_search.search(no_docs, items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


# Token counts


def _count(text):
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    return len(pieces.encode(text or ""))


def test_counts_equal_the_library(spark, docs, sf_dir):
    given = common.read_table(spark, sf_dir, "documents")
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in queries.op13_token_counts(spark, sf_dir).collect()}
    for doc_id, text in given.select("doc_id", "text").collect():
        n = _count(text)
        assert got.pop(doc_id) == (len((text or "").encode()), n, n > 4096)
    assert not got


@pytest.mark.parametrize("small", [0, 10**6])
def test_only_misses_are_encoded(spark, docs, no_docs, tmp_path, monkeypatch, small):
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (small,))
    cache = f"file://{tmp_path}/cache"
    folder = f"{cache}/tokenizer={token_cache.version(queries.PIECES)}"
    want = Counter((x.doc_id, _count(x.text)) for x in docs.collect())
    few = docs.filter("doc_id < 6")
    first = token_cache.count_tokens(few, queries.PIECES, cache)
    assert first.count() == few.count()
    stored = {bytes(x.digest) for x in spark.read.parquet(folder).collect()}
    found = token_cache.count_tokens(docs, queries.PIECES, cache)
    assert Counter((x.doc_id, x.n_tokens) for x in found.collect()) == want
    rows = [bytes(x.digest) for x in spark.read.parquet(folder).collect()]
    # What the first call stored wasn't stored again, and nothing else is missing.
    assert len(rows) == len(set(rows)) == docs.select(token_cache.content("text")).distinct().count()
    assert stored < set(rows)
    # A digest that lies there twice is read once, and a third call encodes nothing.
    spark.read.parquet(folder).write.mode("append").parquet(folder)
    monkeypatch.setattr(token_cache, "_encoded", None)
    again = token_cache.count_tokens(docs, queries.PIECES, cache)
    assert Counter((x.doc_id, x.n_tokens) for x in again.collect()) == want
    assert token_cache.count_tokens(no_docs, queries.PIECES, cache).count() == 0


@pytest.mark.parametrize("size", [common.BROADCAST_BYTES, 0])
def test_misses_are_encoded_once_whether_sent_or_shuffled(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    texts = ["the same words", None, "", "other words", "the same words", "été"]
    given = [(i % 7 if i % 3 else None, texts[i % len(texts)]) for i in range(60)] + [(1, "only once")]
    rows = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    cache = f"file://{tmp_path}/cache"
    got = sorted(((x.doc_id, x.n_tokens) for x in token_cache.count_tokens(rows, queries.PIECES, cache).collect()), key=str)
    assert got == sorted(((i, _count(t)) for i, t in given), key=str)
    # Equal rows in several tasks may be encoded by each, anything else once.
    stored = spark.read.parquet(f"{cache}/tokenizer={token_cache.version(queries.PIECES)}")
    assert stored.select("digest").distinct().count() == 5 and stored.count() <= 5 * 3


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    assert token_cache._can_cut(queries.PIECES)
    rng = random.Random(7)
    texts = ["".join(rng.choices(["a", "the", " ", "  ", "▁", "\n", "é", "漢", " \t", "<s>", "ing"], k=300)) for _ in range(30)]
    texts += ["ab " * 200, " " * 300, "x" * 300, "", " a", "a "]
    want = [_count(x) for x in texts]
    for size in (1, 20):
        monkeypatch.setattr(token_cache, "CUT", size)
        assert token_cache.counter(queries.PIECES)(texts) == want
        assert all(" ".join(token_cache.cut(x, size)) == x for x in texts)
    assert len(token_cache.cut("ab " * 200, 20)) > 5


def test_json_tokenizers_count_too():
    from tokenizers import Tokenizer

    texts = ["don't stop", "", "été " * 9]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        got = token_cache.counter(public_tokenizers.path(name))(texts)
        assert got == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
