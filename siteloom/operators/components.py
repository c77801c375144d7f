"""Connected components: of an edge table, and of sets that are alike by their Jaccard similarity.

Components of edges are found by alternating large and small stars. In the large-star step each node links
its larger neighbours to its smallest neighbour, in the small-star step its smaller neighbours and itself. Both
keep the components and end with every node linked to the smallest node of its component after a few
rounds. Before each round every task reduces the edges that it holds to stars, so that a few tasks need few rounds.
A step joins edges with one minimum per node. The minima are written and read back, so both sides of the join
are plain shuffles and Spark can split a hub's edges among tasks. Edges that are few once every task has reduced its own
need no rounds: one task reduces what is left.

Sets meet by keys that they share. A key with many sets makes no rows for its pairs. In two rounds each set is
compared with one set of its key. Keys that then still hold sets of two components are compared in blocks: sets
that such keys connect are a group (where a group is large, each key is one), a group is dealt to blocks of
bounded size, and a task gets the sets of two blocks and compares all pairs of different components within
itself. So every pair that shares a key is verified or already linked by others.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.plans.shared import discard, materialize

#: Links that a task holds before it reduces them to stars.
HELD_LINKS = 1 << 20
#: Links that are left to one task, a quarter of what any task may hold. More of them go through rounds.
FEW_LINKS = HELD_LINKS // 4
#: Groups of up to so many sets are compared whole, larger ones key by key.
WHOLE_GROUP = 1 << 13
#: Sets and elements that a block should hold.
BLOCK_SETS, BLOCK_ELEMENTS = 1 << 11, 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, from each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
    while (label[label] != label).any():
        label = label[label]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads links (u, v); yields stars of what it holds at a time."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate((a, batch["u"].to_numpy()))
        b = np.concatenate((b, batch["v"].to_numpy()))
        if len(a) > HELD_LINKS:
            a, b = stars(a, b)
            if len(a) > HELD_LINKS // 2:
                yield pa.record_batch({"u": pa.array(a), "v": pa.array(b)})
                a, b = a[:0], b[:0]
    a, b = stars(a, b)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.record_batch({"u": pa.array(a[part]), "v": pa.array(b[part])})


def _rooted_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads all links (u, v), FEW_LINKS at most; yields (node, root) of every node."""
    held = list(batches)
    if not held:
        return
    a, b = stars(*(np.concatenate([x[c].to_numpy() for x in held]) for c in ("u", "v")))
    roots = np.unique(b)
    a, b = np.concatenate((a, roots)), np.concatenate((b, roots))
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.record_batch({"node": pa.array(a[part]), "root": pa.array(b[part])})


def _stored(edges: DataFrame) -> DataFrame:
    return materialize(edges.mapInArrow(_reduced, "u long, v long").distinct(), "components")


def _minimum(edges: DataFrame) -> DataFrame:
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "component-minima")


def _next_round(edges: DataFrame) -> DataFrame:
    """``edges`` holds (u, v) with u > v, and so does what comes back. What was stored on the way goes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both)
    low = least.select("u", F.least("m", "u").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    large = materialize(large, "component-stars")
    low = _minimum(large)
    near = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    found = _stored(near.unionByName(low.select("u", F.col("m").alias("v"))))
    discard(edges, least, large, low)
    return found


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("under"), F.lit(0).alias("over"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("under"), F.lit(1).alias("over")))
    counts = ends.groupBy("n").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
    return counts.filter("under > 1 or under = 1 and over = 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in a link of whole numbers; root is the smallest node.

    Links to oneself and links that hold a null are left out, repeated links count once.
    """
    ends = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.filter(f"{a} <> {b}").select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
    own = materialize(edges.mapInArrow(_reduced, "u long, v long"), "component-links")
    if own.count() <= FEW_LINKS:
        found = materialize(own.coalesce(1).mapInArrow(_rooted_stars, "node long, root long"), "component-roots")
        discard(own)
        return found
    edges = _stored(own)
    discard(own)
    while not _are_stars(edges):
        edges = _next_round(edges)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = materialize(nodes.unionByName(roots), "component-roots")
    discard(edges)
    return found


# Sets that are alike


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) that are similar enough: their union is known from what they share and both sizes."""
    p, q = least.numerator, least.denominator
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_a"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").filter((p + q) * shared >= p * (F.size("_a") + F.size("_b"))).select("a", "b")


def _linked_pairs(sets: list[np.ndarray], roots: np.ndarray, least: Fraction) -> tuple[list[int], list[int]]:
    """Positions of pairs with a similarity of ``least`` or more and different roots.

    An inverted index of the hashes counts what a text shares with every later one.
    """
    p, q = least.numerator, least.denominator
    sizes = np.array([len(x) for x in sets])
    hashes, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    posted = owner[np.argsort(at, kind="stable")]
    ends = np.cumsum(np.bincount(at, minlength=len(hashes)))
    starts = np.concatenate(([0], ends[:-1]))
    place = np.cumsum(sizes) - sizes
    a, b = [], []
    for i in range(len(sets)):
        own = at[place[i] : place[i] + sizes[i]]
        own = own[ends[own] - starts[own] > 1]
        if not len(own):
            continue
        shared = np.bincount(np.concatenate([posted[x:y] for x, y in zip(starts[own], ends[own], strict=True)]), minlength=len(sets))
        near = np.flatnonzero(((p + q) * shared >= p * (sizes + sizes[i])) & (roots != roots[i]))
        near = near[near > i]
        a += [i] * len(near)
        b += near.tolist()
    return a, b


def _compare(least: Fraction):
    """Reads the sets (node, root, hashes) of two blocks; yields stars (a, b) of their links."""

    def run(group: pa.Table) -> pa.Table:
        nodes, first = np.unique(group["node"].to_numpy(), return_index=True)
        roots = group["root"].to_numpy()[first]
        hashes = group["hashes"].combine_chunks()
        sets = [hashes[int(i)].values.to_numpy() for i in first]
        x, y = _linked_pairs(sets, roots, least) if len(sets) > 1 else ([], [])
        a, b = stars(nodes[x], nodes[y]) if x else (nodes[:0], nodes[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocked_links(left: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Links between sets of different roots that share a key of ``left`` (key, node, size, root)."""
    first = materialize(left.groupBy("key").agg(F.min("node").alias("first")), "near-first")
    grouped = connected_components(left.join(first, "key").select(F.col("node").alias("a"), F.col("first").alias("b")))
    large = grouped.groupBy("root").agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE_GROUP)
    large = materialize(large.select(F.col("root").alias("gid"), F.lit(True).alias("_large")), "near-large")
    own = left.join(grouped.select("node", F.col("root").alias("gid")), "node").join(large, "gid", "left")
    by = F.struct(F.coalesce("_large", F.lit(False)).alias("large"), F.when(F.col("_large"), F.col("key")).otherwise(F.col("gid")).alias("id"))
    own = materialize(own.select(by.alias("by"), "node", "size", "root").distinct(), "near-groups")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int")
    # A group of one component has no pair left.
    blocks = own.groupBy("by").agg(parts.alias("parts"), F.min("root").alias("_l"), F.max("root").alias("_h"))
    blocks = materialize(blocks.filter("_l <> _h").select("by", "parts"), "near-blocks")
    dealt = own.join(blocks, "by").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Block k meets every block from itself on, so each pair of blocks is one task's.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))
    )
    tasks = dealt.select("by", "node", "root", F.explode(meets).alias("meet"))
    found = tasks.join(sets, "node").select("by", "meet", "node", "root", "hashes")
    return found.groupBy("by", "meet").applyInArrow(_compare(least), "a long, b long")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the keys that still hold texts of two components, with their root."""
    roots = connected_components(links)
    rooted = materialize(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    parts = rooted.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h").select("key")
    return materialize(rooted.join(materialize(parts, "near-parts"), "key", "left_semi"), "near-left")


def similar_components(members: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """(node, root) of the sets that are linked: pairs of one key with a Jaccard similarity of ``least`` or more.

    members: stored (key, node, size), distinct, of keys that two sets share at least. sets: stored (node, hashes), the
    distinct 64-bit hashes of each set in order.
    """
    p, q = least.numerator, least.denominator
    links = tried = None
    left = members
    for n in range(2):
        first = left.groupBy("key").agg(F.min_by(F.struct("node", "size"), F.xxhash64("node", F.lit(n))).alias("to"))
        first = materialize(first, "near-first")
        near = q * F.least("size", "to.size") >= p * F.greatest("size", "to.size")
        pairs = left.join(first, "key").filter(F.col("node") != F.col("to.node")).filter(near)
        pairs = pairs.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        found = materialize(_verified(pairs, sets, least), "near-links")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        left = _rooted(members, links)
        if left.isEmpty():
            break
    else:
        links = links.unionByName(materialize(_blocked_links(left, sets, least), "near-links"))
    return connected_components(links)
