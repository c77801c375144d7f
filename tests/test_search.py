import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import graph, reads, search
from siteloom.plans.shared import shared_path


def test_index_gives_what_a_scan_gives(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(120)] + ["Alpha beta, GAMMA!"] * 12 + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("bucket", F.lit("x"))
    path = shared_path(spark, "index")
    search.build_index(rows, "TextContent", path)
    for asked in (["alpha"], ["beta", "GAMMA", "alpha"], ["w3", "nowhere"], ["nowhere"]):
        for limit in (1, 5, 500):
            want = [tuple(x) for x in reads.search_text(rows.fillna("", "text"), asked, limit).collect()]
            got = [tuple(x) for x in search.search_index(spark, path, "TextContent", asked, limit).collect()]
            assert [(i, pytest.approx(s)) for i, s in want] == got
    kept = search.kept_blocks(spark, path, "TextContent", ["alpha"], 2)
    every = spark.read.parquet(f"{path}/TextContent/postings").filter(F.col("term") == "alpha")
    assert kept.count() < every.count() / 2
    kept = search.kept_blocks(spark, path, "TextContent", ["alpha", "beta", "gamma"], 5)
    # Only the buckets of the words are read.
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_a_frequent_word_is_cut_in_many_tasks(spark, monkeypatch):
    """No task holds all postings of a word; blocks are whole but for the ends of ranges, and searches are the same."""
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "TASK_POSTINGS", 50)
    rng = random.Random(4)
    texts = ["common " + " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(f"d{i:03d}", x) for i, x in enumerate(texts)], "id string, text string")
    path = shared_path(spark, "index")
    search.build_index(rows, "TextContent", path)
    stored = spark.read.parquet(f"{path}/TextContent/postings").withColumn("task", F.shiftright("block", 33))
    own = stored.filter("term = 'common'").orderBy("block").collect()
    assert len({x.task for x in own}) > 3
    assert sum(x.held for x in own) == 400 == len({p.id for x in own for p in x.postings}) and all(x.held == len(x.postings) <= 8 for x in own)
    weights = [p.w for x in own for p in x.postings]
    assert weights == sorted(weights, reverse=True) and all(x.top == x.postings[0].w for x in own)
    assert len(own) <= 400 / 8 + len({x.task for x in own})
    for asked in (["common"], ["alpha", "common", "gamma"]):
        want = [tuple(x) for x in reads.search_text(rows, asked, 7).collect()]
        assert [(i, pytest.approx(s)) for i, s in want] == [tuple(x) for x in search.search_index(spark, path, "TextContent", asked, 7).collect()]


def test_words_are_counted_without_another_shuffle(spark, monkeypatch):
    """Texts are shuffled by id and postings into ranges; words aren't shuffled between these."""
    monkeypatch.setattr(search, "TASK_ROWS", 1)
    plans = []
    real = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (1, "a")], "id long, description string")
    path = shared_path(spark, "index")
    search.build_index(rows, "Page", path)
    assert [x.count("Exchange hashpartitioning") for x in plans] == [1]
    assert sorted((x.term, x.df) for x in spark.read.parquet(f"{path}/Page/terms").collect()) == [("a", 1), ("b", 1)]
    assert [(x.n, round(x.mean, 6)) for x in spark.read.parquet(f"{path}/Page/totals").collect()] == [(3, round(4 / 3, 6))]


def test_unknown_tables_and_missing_indexes(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, description string")
    path = shared_path(spark, "index")
    with pytest.raises(ValueError):
        search.search_index(spark, path, "Nothing", ["a"])
    with pytest.raises(ValueError):
        search.build_index(rows, "Nothing", path)
    assert search.search_index(spark, path, "Page", ["a"]) is None
    search.build_index(rows.limit(0), "Page", path)
    assert search.search_index(spark, path, "Page", ["a"]).count() == 0


def test_planted_communities_are_found_and_connected(spark):
    rng = random.Random(8)
    group = {f"v{i:02d}": i % 4 for i in range(48)}
    edges = [(a, b) for a in group for b in group if a < b and rng.random() < (0.6 if group[a] == group[b] else 0.03)]
    got = {x.id: x.module for x in graph.modules(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert len(set(got.values())) == 4
    assert {frozenset(v for v in got if got[v] == m) for m in got.values()} == {frozenset(v for v in group if group[v] == g) for g in range(4)}
    for m in set(got.values()):
        left, seen = [next(v for v in got if got[v] == m)], set()
        while left:
            v = left.pop()
            seen.add(v)
            left += [b if a == v else a for a, b in edges if v in (a, b) and got[a] == got[b] and (b if a == v else a) not in seen]
        assert seen == {v for v in got if got[v] == m}


def test_graph_bundle(spark):
    rows = [("h.org/a", "h.org/a/x"), ("h.org/a/x", "h.org/a/y"), ("h.org/a/y", "h.org/a")]
    found = graph.graph_bundle(spark.createDataFrame(rows, "src string, dst string"), "h.org/a")
    assert [(x.id, x.depth, x.module_label) for x in found["pages"].collect()] == [("h.org/a", 0, "A"), ("h.org/a/x", 1, "A"), ("h.org/a/y", 2, "A")]
    assert [x.cycle for x in found["cycles"].collect()] == [["h.org/a", "h.org/a/x", "h.org/a/y"]]
