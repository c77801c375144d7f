"""What hangs on a graph goes first, and jobs of many rounds send few tables to all workers."""

import random

import pytest

from siteloom.operators import cuts, graph
from siteloom.plans import shared

KINDS = {
    "pair": [("a", "b")],
    "ring with tails": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("t", "u"), ("b", "s"), ("b", "r"), ("y", "z"), ("self", "self")],
}


def _random(seed):
    draw = random.Random(seed)
    tree = [(f"n{draw.randrange(i)}", f"n{i}") for i in range(1, 60) if i % 13]
    return tree + [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(8)]


def _parts(edges, without=None):
    near = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            if x != without:
                near.setdefault(x, set()).update({y} - {without})
    roots = {}
    for start in sorted(near):
        waiting = [] if start in roots else [start]
        while waiting:
            x = waiting.pop()
            if x not in roots:
                roots[x] = start
                waiting += near[x]
    return roots


@pytest.mark.parametrize("edges", [KINDS["pair"], KINDS["ring with tails"], _random(1)])
def test_components_and_cuts_equal_brute_force(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    roots = _parts(edges)
    assert {x.id: x.root for x in graph.components(df).collect()} == roots
    parts = len(set(roots.values()))
    alone = lambda v: all(v not in e or e[0] == e[1] for e in edges)
    want = {v for v in roots if not alone(v) and len(set(_parts(edges, v).values())) > parts}
    found = [x.id for x in graph.articulation_points(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_trees_need_no_search_for_cuts_or_components(spark, monkeypatch):
    met = []
    search = graph.connected_components
    monkeypatch.setattr(cuts, "cut_vertices", lambda pairs: pytest.fail("a tree has only leaves"))
    monkeypatch.setattr(graph, "connected_components", lambda links, *x: met.append(links.count()) or search(links, *x))
    edges = [("r", f"a{i}") for i in range(5)] + [(f"a{i % 5}", f"b{i}") for i in range(30)]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert graph.articulation_points(df).count() == 6
    assert {x.root for x in graph.components(df).collect()} == {"a0"} and met == [0]


def test_rounds_send_few_tables_to_all_workers(spark, monkeypatch):
    before = [spark.conf.get(x, None) for x in shared.THRESHOLDS]
    met = set()
    stored = graph.materialize
    told = lambda df, name: met.add(tuple(spark.conf.get(x) for x in shared.THRESHOLDS)) or stored(df, name)
    monkeypatch.setattr(graph, "materialize", told)
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    # One pass over two links; what it finds is tested elsewhere.
    graph.modules(df, tolerance=10.0)
    assert met == {(shared.ROUND_BROADCAST,) * 2}
    assert [spark.conf.get(x, None) for x in shared.THRESHOLDS] == before
