import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from siteloom.llm import common, exact_dedup, queries, simhash
from siteloom.operators import components


def test_rice_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(100, 1 << 44, n))
        assert (exact_dedup.rice_decode(len(values), 100, *exact_dedup.rice_encode(values, 100)) == values).all()


def test_exact_duplicates_equal_brute_force(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    groups = defaultdict(list)
    for x in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", x.text or "")].append(x.doc_id)
    want = {
        i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    }
    got = {x.doc_id: tuple(x)[1:] for x in exact_dedup.exact_duplicates(docs, owners=3).collect()}
    assert got == want


def test_exact_duplicates_odd_rows(docs, no_docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = defaultdict(list)
    for x in rows:
        by_id[x.doc_id].append(x)
    assert by_id[2][0].keep_id == 1 and by_id[2][0].group_size == 3 and not by_id[2][0].kept
    assert not by_id[None][0].kept
    assert [x.keep_id for x in by_id[3] + by_id[4]] == [3, 3] and by_id[5][0].keep_id == 5
    assert sorted(x.kept for x in by_id[6]) == [False, True]  # a repeated row stays once
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def _brute_components(fingerprints):
    parent = {f: f for f in fingerprints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {f: find(f) for f in known}


@pytest.mark.parametrize("small_bucket", [2, 1024])
def test_links_have_all_components(spark, monkeypatch, small_bucket):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6).tolist()
    points = set(centres)
    for c in centres:
        for _ in range(60):
            p = c
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                p ^= 1 << int(bit)
            points.add(p)
    keys = np.array(sorted(points), np.uint64)
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small_bucket)
    rows = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "fp long")
    keyed = rows.select(simhash.F.explode(simhash._variants("fp")).alias("key"), "fp").toArrow().sort_by("key")
    found = list(simhash._links(iter(keyed.to_batches(max_chunksize=97))))
    a = np.concatenate([x["a"].to_numpy() for x in found]).view(np.uint64)
    b = np.concatenate([x["b"].to_numpy() for x in found]).view(np.uint64)
    want = _brute_components(keys.tolist())
    got = {int(x): int(y) for x, y in zip(*components.stars(a, b), strict=True)}
    assert {k: got.get(k, k) for k in want} == want


def test_op9_equals_brute_force(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    own = {x.doc_id: simhash.fingerprint(x.text, 3) for x in docs}
    roots = _brute_components(set(own.values()))
    low = {}
    for i, f in own.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    want = {i: (f"{f:016x}", low[roots[f]]) for i, f in own.items()}
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op9_simhash_components(spark, sf_dir).collect()}
    assert got == want


def test_without_duplicates_keeps_rows(docs, no_docs):
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(x.doc_id for x in rows) == [1, 3, 5, 6, 7, 8, 9]
    assert {x.shard for x in rows} == {7} and exact_dedup.without_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_exact_duplicates_with_and_without_broadcast(docs, monkeypatch, limit):
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (limit,))
    found = {(x.doc_id, x.keep_id, x.group_size) for x in exact_dedup.exact_duplicates(docs).collect()}
    assert {x for x in found if x[0] in (1, 2, 6)} == {(1, 1, 3), (2, 1, 3), (6, 6, 2)}
    assert sorted(x.doc_id for x in exact_dedup.without_duplicates(docs).collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_fingerprint_is_the_contract():
    text = "A b\tC d e b c d"
    words = [x.lower() for x in text.split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 3) == want
    assert simhash.fingerprint("one two", 3) == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


def test_near_duplicates_odd_rows(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    found = defaultdict(set)
    for x in rows:
        found[x.doc_id].add(x.component)
    assert found[2] == found[None] == {1}
    assert found[3] == found[4] == found[5] == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, x) for x in range(200, 260)]
    rows = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    got = {x.node: x.root for x in components.connected_components(rows.repartition(7)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 260)]}
    assert components.connected_components(rows.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, components.FEW_LINKS])
def test_few_links_need_no_rounds(spark, monkeypatch, few):
    stored = []
    keep = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    monkeypatch.setattr(components, "FEW_LINKS", few)
    links = [(x, x + 1) for x in range(300)] + [(5000, x) for x in range(1000, 1200)] + [(7, 7), (None, 9), (9001, -9000), (-9000, 9001)]
    rows = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = sorted(tuple(x) for x in components.connected_components(rows).collect())
    assert got == sorted([(x, 0) for x in range(301)] + [(x, 1000) for x in [*range(1000, 1200), 5000]] + [(-9000, -9000), (9001, -9000)])
    assert stored == ["component-links", "component-roots"] if few else len(stored) > 2
