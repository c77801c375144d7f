import random

import pytest

import corpus_pipeline
from siteloom.llm import common, near_text, simhash
from siteloom.operators import components


def _similar(x, y):
    a, b = (set(near_text.shingles(t).tolist()) for t in (x, y))
    return len(a & b) * 5 >= 4 * len(a | b)


def test_stage_links_what_brute_force_links(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(9999)}" for _ in range(120)]
        for _ in range(7):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(120)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(own))
    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _similar(texts[i], texts[j]):
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    assert len(set(component)) not in (8, len(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component for x in near_text.near_duplicates(docs).collect()}
    assert got == dict(enumerate(component))
    left = sorted(x.doc_id for x in corpus_pipeline.near(spark, docs, "").collect())
    assert left == sorted(set(component))


def test_near_stage_leaves_no_similar_pair(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents").dropDuplicates(["text"])
    texts = [x.text for x in corpus_pipeline.near(spark, docs, "").collect()]
    sets = [set(near_text.shingles(x).tolist()) for x in texts]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if a and len(a & b) * 5 >= 4 * len(a | b)]


@pytest.mark.parametrize(("whole", "block"), [(1 << 13, 1 << 11), (0, 3)])
def test_groups_are_compared_in_blocks(spark, monkeypatch, whole, block):
    """A chain of texts, each like the next one only, and texts like none: leaders leave much to the blocks."""
    monkeypatch.setattr(components, "WHOLE_GROUP", whole)
    monkeypatch.setattr(components, "BLOCK_SETS", block)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * i : 8 * i + 100]) for i in range(30)]
    rng = random.Random(5)
    for k in range(30):
        own = words[:100]
        for at in range(k % 4, 100, 9):
            own[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _similar(texts[i], texts[j]):
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component for x in near_text.near_duplicates(docs).collect()} == dict(enumerate(component))


@pytest.mark.parametrize("small", [0, 10**6])
def test_few_and_many_suspects_alike(spark, docs, monkeypatch, small):
    """Tables that are sent to all workers and tables that are shuffled give the same, with rows that have no id."""
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (small,))
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*words, f"x{i}"])) for i in range(5)] + [(90 + i, " ".join([*words[:59], f"y{i}"])) for i in range(5)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [(x.doc_id, x.component) for x in near_text.near_duplicates(given).collect()]
    assert len(found) == given.count()
    assert {c for i, c in found if i is not None and i >= 90} == {90}
    assert sorted(c for i, c in found if i is None) == [1] + [90] * 5
    left = corpus_pipeline.near(spark, given.withColumn("lang", common.F.lit("en")), "")
    assert sorted(x.doc_id for x in left.collect() if x.doc_id is not None and x.doc_id >= 90) == [90]


def test_texts_count_for_what_is_sent_to_all(spark, monkeypatch):
    rows = common.materialize(spark.createDataFrame([("x" * 50, 1)] * 3, "id string, n int"), "rows")
    assert common.broadcast_if_small(rows) is not rows
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert common.broadcast_if_small(rows) is rows
    assert common.broadcast_if_small(rows.select("n"), 2) is not None


def test_near_duplicates_odd_rows(docs, no_docs):
    found = [(x.doc_id, x.component) for x in near_text.near_duplicates(docs).collect()]
    assert len(found) == docs.count()
    assert {c for i, c in found if i in (1, 2, None)} == {1}
    assert {c for i, c in found if i in (3, 4, 5)} == {3}
    assert near_text.near_duplicates(no_docs).count() == 0


def test_simhash_finds_candidates_by_itself(spark):
    """Without min-wise keys, pairs within 3 bits are linked if their sets are similar enough, and others aren't."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join([*base[:300], "other", *base[301:]])]
    prints = [simhash.fingerprint_of(near_text.shingles(x)) for x in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3 and _similar(texts[i], texts[j])]
    assert len({j for _, j in near}) > 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.component for x in near_text.near_duplicates(docs, minwise=0).collect()}
    assert all(found[i] == found[j] for i, j in near)
    assert all(i // 3 == c // 3 for i, c in found.items())
