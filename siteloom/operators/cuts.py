"""Cut vertices of undirected graphs of any depth, in rounds that grow with the logarithm of their size.

A spanning forest is found by contraction, its Euler tour is ranked by pointer jumping, and places on the tour
tell who lies in whose subtree, so nothing walks the forest level by level. Vertices are whole numbers. Each
round is a written table; tables that a join reads on both sides are stored, so that Spark can split a hub's rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.components import connected_components
from siteloom.operators.ordered import numbered
from siteloom.plans.shared import Levels, discard, materialize

#: Places of a block, which bounds the arrays that ranges of places are read from.
BLOCK = 64


def _turned(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows and the same with ``a`` and ``b`` exchanged."""
    other = {a: b, b: a}
    return df.unionByName(df.select(*(F.col(c).alias(other.get(c, c)) for c in df.columns)))


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """The edges (x, y) of a spanning forest of the stored, distinct pairs (x, y), x < y; at least one pair.

    Every part of the graph takes its least edge by a hash, parts that are so linked become one, and of
    the edges between two parts the least stays. The number of parts falls by half a round at least.
    """
    edge = F.struct(F.xxhash64("x", "y").alias("h"), "x", "y")
    left = materialize(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), edge.alias("edge")), "forest-left")
    found = Levels(pairs.sparkSession, "forest")
    for k in count():
        least = _turned(left, "a", "b").groupBy("a").agg(F.min(F.struct("edge", "b")).alias("least"))
        least = materialize(least.select("a", "least.b", "least.edge.x", "least.edge.y"), "forest-least")
        found.add(least.select("x", "y").distinct(), k)
        parts = connected_components(least)
        moved = left.join(parts, left.a == parts.node).select(F.col("root").alias("a"), "b", "edge")
        moved = moved.join(parts, moved.b == parts.node).select("a", F.col("root").alias("b"), "edge").filter("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("edge").alias("edge"))
        moved = materialize(moved, "forest-left")
        discard(left, least, parts)
        left = moved
        if left.isEmpty():
            discard(left)
            return found.all()


def _ranked(chain: DataFrame) -> DataFrame:
    """(p, d) of the stored links (p, nxt, d), where d is 1, or 0 at the end of a list, whose nxt is -p: the steps to the end.

    A round follows four links. What has come to its end points to -p, a key of its own that meets nothing.
    """
    while not chain.filter("nxt > 0").isEmpty():
        ahead = chain.select(F.col("p").alias("at"), F.col("nxt").alias("further"), F.col("d").alias("more"))
        now = chain
        for _ in range(3):
            onward = F.when(F.col("further") > 0, F.col("further")).otherwise(-F.col("p"))
            now = now.join(ahead, now.nxt == ahead["at"], "left").select("p", onward.alias("nxt"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        now = materialize(now, "tour-links")
        discard(chain)
        chain = now
    return chain.select("p", "d")


def rooted_forest(forest: DataFrame) -> DataFrame:
    """(id, parent, first, last) of every vertex but the roots, which are the smallest vertices of their trees.

    The subtree of a vertex is the vertices whose ``first`` lies from its ``first`` to its ``last``.
    """
    arcs = _turned(forest.select(F.col("x").alias("u"), F.col("y").alias("v")), "u", "v")
    arcs = materialize(numbered(arcs, [], [F.col("u"), F.col("v")], "p"), "tour-arcs")
    roots = connected_components(forest, "x", "y")
    own = arcs.groupBy("u").agg(F.min("p").alias("s"), F.max("p").alias("e"))
    own = materialize(own.join(roots, own.u == roots.node).drop("node"), "tour-starts")
    # Whoever comes in by an arc goes out by the one after its reverse, and round again; at a root that ends the tour.
    after = F.when(F.col("p") < F.col("e"), F.col("p") + 1).when(F.col("u") != F.col("root"), F.col("s"))
    turns = arcs.join(own, "u").select(F.col("v").alias("u"), F.col("u").alias("v"), "root", after.alias("nxt"))
    tour = materialize(arcs.join(turns, ["u", "v"]), "tour")
    steps = tour.select("p", F.coalesce("nxt", -F.col("p")).alias("nxt"), F.col("nxt").isNotNull().cast("long").alias("d"))
    ranks = _ranked(materialize(steps, "tour-links"))
    placed = numbered(tour.drop("nxt").join(ranks, "p"), [], [F.col("root"), F.desc("d")], "t")
    placed = materialize(placed.select("u", "v", "t"), "tour-places")
    back = placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("t").alias("last"))
    down = placed.join(back, ["u", "v"]).filter("t < last")
    found = materialize(down.select(F.col("v").alias("id"), F.col("u").alias("parent"), F.col("t").alias("first"), "last"), "rooted")
    discard(arcs, roots, own, tour, placed)
    return found


def range_extremes(values: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, lo, hi) of the stored spans (id, a, b): the least lo and greatest hi of the values (pos, lo, hi) from a to b.

    Places are unique and go in blocks of 64. A span reads the blocks that hold its ends; the whole blocks between
    are a span of blocks, read in the same way at the next level, of which there are log64 of the places. The tables of
    the upper levels, where many spans meet few blocks, are small enough for Spark to broadcast by their size.
    """
    found = Levels(spans.sparkSession, "extremes")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    for k in count():
        held = F.collect_list(F.struct("pos", "lo", "hi")).alias("held")
        blocks = materialize(values.groupBy(block("pos").alias("block")).agg(held, F.min("lo").alias("lo"), F.max("hi").alias("hi")), "blocks")
        ends = spans.select("id", "a", "b", block("a").alias("_p"), block("b").alias("_q"))
        pieces = ends.select("id", "a", "b", F.explode(F.array_distinct(F.array("_p", "_q"))).alias("block"))
        inside = F.filter("held", lambda x: (x["pos"] >= F.col("a")) & (x["pos"] <= F.col("b")))
        read = pieces.join(blocks.select("block", "held"), "block").select("id", inside.alias("held")).filter("size(held) > 0")
        found.add(read.select("id", F.array_min("held.lo").alias("lo"), F.array_max("held.hi").alias("hi")), k)
        spans = materialize(ends.filter("_q - _p > 1").select("id", (F.col("_p") + 1).alias("a"), (F.col("_q") - 1).alias("b")), "spans")
        values = blocks.select(F.col("block").alias("pos"), "lo", "hi")
        if spans.isEmpty():
            return found.all().groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def cut_vertices(pairs: DataFrame) -> DataFrame:
    """(id) of the vertices whose removal splits their component (Tarjan and Vishkin), of the stored, distinct pairs
    (x, y), x < y; at least one pair.

    Tree edges that lie on a common cycle are joined; a vertex with tree edges of two blocks is a cut vertex.
    """
    forest = materialize(spanning_forest(pairs), "forest")
    tree = rooted_forest(forest)
    top = tree.join(tree.select(F.col("id").alias("parent")), "parent", "left_anti")
    top = top.groupBy(F.col("parent").alias("id")).agg((F.min("first") - 1).alias("first"), F.max("last").alias("last"))
    places = materialize(tree.select("id", "first", "last").unionByName(top), "places")
    x, y = (places.select(*(F.col(c).alias(f"{c}_{n}") for c in places.columns)) for n in "xy")
    other = pairs.join(forest, ["x", "y"], "left_anti")
    other = materialize(other.join(x, F.col("x") == x.id_x).join(y, F.col("y") == y.id_y).drop("id_x", "id_y"), "other")
    touch = other.select(F.col("x").alias("id"), F.col("first_y").alias("to")).unionByName(other.select(F.col("y").alias("id"), F.col("first_x").alias("to")))
    touch = touch.groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    values = tree.join(touch, "id", "left").select(F.col("first").alias("pos"), F.least("first", "lo").alias("lo"), F.greatest("first", "hi").alias("hi"))
    reach = materialize(range_extremes(values, tree.select("id", F.col("first").alias("a"), F.col("last").alias("b"))), "reach")
    # A tree edge is named by its lower end. Edges of unrelated vertices join theirs, and so does an edge
    # with the one above it if its subtree reaches outside of the upper vertex's own.
    unrelated = other.filter("last_x < first_y or last_y < first_x").select(F.col("x").alias("a"), F.col("y").alias("b"))
    upper = tree.select(F.col("id").alias("parent"), "first", "last")
    above = tree.select("id", "parent").join(reach, "id").join(upper, "parent").filter("lo < first or hi > last")
    blocks = connected_components(unrelated.unionByName(above.select(F.col("id").alias("a"), F.col("parent").alias("b"))))
    named = tree.join(blocks, tree.id == blocks.node, "left").select("id", "parent", F.coalesce("root", "id").alias("block"))
    sides = named.select("id", "block").unionByName(named.select(F.col("parent").alias("id"), "block"))
    found = sides.groupBy("id").agg(F.min("block").alias("_l"), F.max("block").alias("_h")).filter("_l <> _h").select("id")
    found = materialize(found, "cuts")
    discard(forest, tree, places, other, reach, blocks)
    return found
