"""Cut vertices, spanning forests and ranges against brute force."""

import random

import pytest

from siteloom.operators import cuts, graph
from siteloom.plans import shared


def _parts(nodes, pairs):
    root = {v: v for v in nodes}

    def top(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in pairs:
        if a in root and b in root:
            root[top(a)] = top(b)
    return {v: top(v) for v in nodes}


def _cuts(pairs):
    nodes = {v for p in pairs for v in p}
    whole = len(set(_parts(nodes, pairs).values()))
    return {v for v in nodes if len(set(_parts(nodes - {v}, pairs).values())) > whole}


def _stored(spark, pairs):
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    return shared.materialize(spark.createDataFrame(pairs, "x long, y long"), "test-pairs")


def _shapes():
    rng = random.Random(7)
    yield "sparse", [(rng.randrange(60), rng.randrange(60)) for _ in range(62)]
    yield "dense", [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    # Cycles that share single vertices, a hub with leaves and a tail, and two more components.
    yield "cactus", [(10 * k + i, 10 * k + (i + 1) % 10) for k in range(4) for i in range(10)] + [(0, 15), (15, 23), (23, 39)] + [(5, 100 + i) for i in range(30)] + [(200, 201), (201, 202), (300, 301)]
    # A long path with chords that leave some of its vertices uncovered.
    yield "chords", [(i, i + 1) for i in range(250)] + [(10, 40), (35, 90), (120, 121), (130, 249)]


@pytest.mark.parametrize("name,pairs", list(_shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_cut_vertices(spark, name, pairs):
    pairs = [p for p in pairs if p[0] != p[1]]
    assert {x.id for x in cuts.cut_vertices(_stored(spark, pairs)).collect()} == _cuts(pairs)


def test_forest_and_subtrees(spark):
    rng = random.Random(3)
    pairs = {(min(p), max(p)) for p in ((rng.randrange(50), rng.randrange(50)) for _ in range(70)) if p[0] != p[1]}
    stored = _stored(spark, pairs)
    forest = shared.materialize(cuts.spanning_forest(stored), "test-forest")
    kept = [tuple(x) for x in forest.collect()]
    nodes = {v for p in pairs for v in p}
    want = _parts(nodes, pairs)
    assert set(kept) <= pairs and len(kept) == len(set(kept)) == len(nodes) - len(set(want.values()))
    assert len(set(_parts(nodes, kept).values())) == len(set(want.values()))
    rows = {x.id: x for x in cuts.rooted_forest(forest).collect()}
    smallest = {}
    for v in sorted(nodes):
        smallest.setdefault(want[v], v)
    assert rows.keys() == nodes - set(smallest.values())
    for v, row in rows.items():
        assert (min(v, row.parent), max(v, row.parent)) in kept
        inside = {w for w in rows if row.first <= rows[w].first <= row.last}
        for w in rows:
            up = w
            while up in rows and up != v:
                up = rows[up].parent
            assert (w in inside) == (up == v)


def test_range_extremes(spark):
    rng = random.Random(5)
    values = {p: (rng.randrange(10**6), rng.randrange(10**6)) for p in rng.sample(range(9000), 5000)}
    spans = [(i, *sorted((rng.randrange(9000), rng.randrange(9000)))) for i in range(300)] + [(300, 4, 4), (301, 63, 64), (302, 0, 8999), (303, 64, 127)]
    v = spark.createDataFrame([(p, lo, hi) for p, (lo, hi) in values.items()], "pos long, lo long, hi long")
    s = shared.materialize(spark.createDataFrame(spans, "id long, a long, b long"), "test-spans")
    want = {}
    for i, a, b in spans:
        held = [values[p] for p in range(a, b + 1) if p in values]
        if held:
            want[i] = (min(x for x, _ in held), max(x for _, x in held))
    assert {x.id: (x.lo, x.hi) for x in cuts.range_extremes(v, s).collect()} == want


def test_long_path_takes_few_rounds(spark, monkeypatch):
    n, stored = 10_000, []
    plain = shared.materialize

    def counted(df, name):
        stored.append(name)
        return plain(df, name)

    monkeypatch.setattr(cuts, "materialize", counted)
    edges = spark.range(n - 1).selectExpr("concat('p', id) AS src", "concat('p', id + 1) AS dst")
    found = graph.articulation_points(edges)
    assert found.count() == n - 2 and found.filter(f"id in ('p0', 'p{n - 1}')").isEmpty()
    # Rounds: contractions of the forest, links of the tour followed, levels of ranges.
    rounds = sum(stored.count(name) for name in ("forest-least", "tour-links", "blocks"))
    assert rounds < 40, stored


def test_ids_nulls_loops(spark):
    rows = [("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), (None, "c"), ("c", None), ("z", "z"), ("c", "d"), ("b", "c")]
    df = spark.createDataFrame(rows, "src string, dst string")
    assert sorted(x.id for x in graph.articulation_points(df).collect()) == ["b", "c"]
    assert {x.id: x.root for x in graph.components(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    loops = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert graph.articulation_points(loops).count() == 0
