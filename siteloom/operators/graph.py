"""Graph operators over edge tables (src, dst), as joins and aggregates.

Iterative ones keep their state in the shared folder, a table a round or so, so that plans
stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.operators import cuts
from siteloom.operators.components import connected_components
from siteloom.plans.shared import Levels, discard, few_broadcasts, materialize


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree on the simple digraph; a self loop counts once each way."""
    e = simple_edges(edges)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return into.join(out, "id", "full_outer").fillna(0, ["in_degree", "out_degree"])


def entry_states(edges: DataFrame) -> DataFrame:
    """Vertices that no edge leads to."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def dead_ends(edges: DataFrame) -> DataFrame:
    """Vertices that no edge leads from."""
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def reachable(edges: DataFrame, start: str, max_hops: int = 6) -> DataFrame:
    """Vertices reached in 1 to ``max_hops`` (1 to 10) steps, the start included if on a cycle."""
    e = materialize(simple_edges(edges), "edges")
    frontier = materialize(e.filter(F.col("src") == start).select(F.col("dst").alias("id")).distinct(), "frontier")
    found = frontier
    for _ in range(min(10, max(1, max_hops)) - 1):
        step = e.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(found, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def click_depth(edges: DataFrame, root: str) -> DataFrame:
    """(id, depth): shortest number of steps from the root, null where there is none."""
    e = materialize(simple_edges(edges), "edges")
    known = Levels(e.sparkSession, "depths")
    frontier = known.add(vertices(e).filter(F.col("id") == root).withColumn("depth", F.lit(0)), 0)
    for depth in count(1):
        step = e.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = known.add(step.join(known.all(), "id", "left_anti").withColumn("depth", F.lit(depth)), depth)
        if frontier.isEmpty():
            return vertices(e).join(known.all(), "id", "left")


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, every: int = 5) -> DataFrame:
    """(id, rank); dangling mass is spread evenly. With a tolerance, stops when the ranks change
    by less than n x tolerance in sum, looked at every few rounds."""
    e = materialize(simple_edges(edges), "edges")
    nodes = materialize(vertices(e).join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out")), "id", "left"), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    state = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        shares = e.join(state, e.src == state.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        dangling = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        fresh = state.join(shares, "id", "left").crossJoin(dangling).select(
            "id", "out", F.col("rank").alias("old"),
            ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"),
        )
        fresh = materialize(fresh, "ranks")  # the state is read three times a round
        if i > 1:
            discard(kept)
        kept = fresh
        if i % every == 0:
            if tolerance is not None and fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
                state = fresh
                break
        state = fresh.drop("old")
    return state.select("id", "rank")


def _places(nodes: DataFrame) -> DataFrame:
    """(id, n), stored: whole numbers by the place of a row, in no order."""
    stored = materialize(nodes.select("id"), "places")
    return materialize(stored.withColumn("n", F.monotonically_increasing_id()), "places")


def _by_number(edges: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) with the numbers of their ids."""
    for c in (a, b):
        own = nodes.select(F.col("id").alias(c), F.col("n").alias("_n"))
        edges = edges.join(own, c).drop(c).withColumnRenamed("_n", c)
    return edges.select(a, b)


def _leaves(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The stored pairs (a, b) without what hangs on them, and a table (id, to, cut) a round: the leaves that went, the
    vertex that each hung on, and whether that one had more neighbours. Of two that have only each other one is the leaf.

    Rounds go on as long as each takes away a quarter of the pairs, so their number grows with the logarithm of the graph.
    """
    hung, n = [], pairs.count()
    while n:
        ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("to")))
        # A leaf's only neighbour is its smallest one.
        leaves = ends.groupBy("id").agg(F.count("*").alias("n"), F.min("to").alias("to")).filter("n = 1").select("id", "to")
        leaves = materialize(leaves, "leaves")
        alone = leaves.select(F.col("id").alias("to"), F.col("to").alias("id"), F.lit(False).alias("cut"))
        own = leaves.join(alone, ["id", "to"], "left").filter("cut is null or id > to").select("id", "to", F.coalesce("cut", F.lit(True)).alias("cut"))
        hung.append(materialize(own, "hung"))
        gone = hung[-1].select(F.col("id").alias("gone"))
        rest = pairs.join(gone, F.col("a") == F.col("gone"), "left_anti").join(gone, F.col("b") == F.col("gone"), "left_anti")
        rest = materialize(rest, "pairs")
        discard(leaves, pairs)
        before, n, pairs = n, rest.count(), rest
        if n > before * 3 // 4:
            break
    return pairs, hung


@few_broadcasts
def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the undirected graph; the root is the smallest id.

    What hangs on the graph as a leaf takes the part of its holder, the rest is searched.
    """
    pairs, hung = _leaves(materialize(_undirected(edges), "pairs"))
    nodes = _places(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    found = connected_components(_by_number(pairs, nodes, "a", "b"))
    names = nodes.select(F.col("id").alias("part"), F.col("n").alias("root"))
    known = materialize(nodes.join(found, nodes.n == found.node).join(names, "root").select("id", "part"), "component-parts")
    for leaves in reversed(hung):
        own = leaves.join(known.select(F.col("id").alias("to"), "part"), "to", "left").select("id", F.coalesce("part", "to").alias("part"))
        known = materialize(known.unionByName(own), "component-parts")
    own = vertices(simple_edges(edges)).join(known, "id", "left").select("id", F.coalesce("part", "id").alias("part"))
    own = materialize(own, "component-parts")
    # Parts are called by any of their vertices, so the smallest is found afterwards.
    roots = materialize(own.groupBy("part").agg(F.min("id").alias("root")), "component-names")
    return own.join(roots, "part").select("id", "root")


def ancestors(contains: DataFrame, start: DataFrame, max_hops: int = 8) -> DataFrame:
    """(id, ancestor, distance) over direct (parent, child) edges, to ``max_hops``."""
    step = start.select("id", F.col("id").alias("ancestor"))
    found = None
    for distance in range(1, max_hops + 1):
        step = step.join(contains.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("id", F.col("parent").alias("ancestor")).distinct()
        level = step.withColumn("distance", F.lit(distance))
        found = level if found is None else found.unionByName(level)
    return found.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def components_in(contains: DataFrame, container: str, max_hops: int = 8) -> DataFrame:
    """Everything inside a container, directly or nested."""
    frontier = contains.filter(F.col("parent") == container).select("child", "child_kind")
    found = frontier
    for _ in range(max_hops - 1):
        frontier = contains.join(frontier.select(F.col("child").alias("parent")), "parent").select("child", "child_kind")
        found = found.unionByName(frontier)
    return found.distinct()


def nearest_region(chains: DataFrame, landmarks: DataFrame) -> DataFrame:
    """The landmark with the fewest steps from each component (chains: id, ancestor, distance)."""
    found = chains.join(landmarks, chains.ancestor == landmarks.container)
    return found.groupBy("id").agg(F.min_by("landmark", F.struct("distance", "landmark")).alias("region"))


#: Paths that a growing beam holds at most.
MOST_PATHS = 1 << 17


def simple_cycles(edges: DataFrame, longest: int = 8, most: int = 50, beam: int = 1000, patience: int = 8) -> DataFrame:
    """Cycles of the simple digraph as arrays from their smallest vertex, the first ``most`` in
    order. Vertices without a way in or out are removed first.

    Paths are extended depth first, the first ``beam`` of a length at a time, and only as long as they can still
    begin a cycle that is among the first ``most``: a cycle comes after every path that it begins with. If
    ``patience`` beams leave it open, edges that lie on no closed walk of at most ``longest`` edges are removed, and
    the search begins anew on what is left, with beams that grow.
    """
    e = _cyclic(materialize(simple_edges(edges), "cyclic"), longest)
    found = _first_cycles(e, longest, most, beam, patience)
    return found if found is not None else _first_cycles(_cyclic(_on_short_walks(e, longest), longest), longest, most, beam)


def _cyclic(e: DataFrame, rounds: int) -> DataFrame:
    """Edges less those from vertices without a way in, or to ones without a way out, in so many rounds."""
    n = e.count()
    for _ in range(rounds):
        entered = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = e.select(F.col("src").alias("dst")).distinct()
        e, before = materialize(entered.join(left, "dst", "left_semi").select("src", "dst"), "cyclic"), n
        n = e.count()
        if n == before:
            break
    return e


def _on_short_walks(e: DataFrame, longest: int) -> DataFrame:
    """Edges from whose end a walk of less than ``longest`` edges leads back to their beginning: its first half is among
    what can be reached from the end, its second half among what reaches the beginning."""

    def within(steps: int, start: str, to: str) -> DataFrame:
        known = Levels(e.sparkSession, "walks")
        level = known.add(e.select(F.col(to).alias("v")).distinct().select("v", F.col("v").alias("x")), 0)
        step = e.select(F.col(start).alias("x"), F.col(to).alias("y"))
        for n in range(1, steps + 1):
            grown = level.join(step, "x").select("v", F.col("y").alias("x")).distinct()
            level = known.add(grown.join(known.all(), ["v", "x"], "left_anti"), n)
        return known.all()

    ahead = within((longest - 1) // 2, "src", "dst").select(F.col("v").alias("dst"), "x")
    behind = within(longest - 1 - (longest - 1) // 2, "dst", "src").select(F.col("v").alias("src"), "x")
    kept = e.join(ahead, "dst").join(behind, ["src", "x"]).select("src", "dst").distinct()
    return materialize(kept, "cyclic")


def _first_cycles(e: DataFrame, longest: int, most: int, beam: int, patience: int | None = None) -> DataFrame | None:
    """The first ``most`` cycles; nothing if ``patience`` beams don't tell them."""
    start = e.filter("src <= dst").select(F.array("src", "dst").alias("path"))
    found = materialize(start.filter("path[0] = path[1]").select(F.slice("path", 1, 1).alias("cycle")).orderBy("cycle").limit(most), "cycles")
    step = e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    listed = lambda x: F.array(*map(F.lit, x))
    waiting = [(start.filter("path[0] < path[1]"), 2)] if longest > 1 else []
    for n in count(1):
        if not waiting:
            return found
        if patience is not None and n > patience:
            return None
        paths, length = waiting.pop()
        ends = found.agg(F.count("*"), F.max("cycle")).first()
        own = paths.filter(F.col("path") < listed(ends[1])) if ends[0] == most else paths
        own = materialize(own.orderBy("path").limit(beam), "beam")
        taken = own.agg(F.count("*"), F.max("path")).first()
        if not taken[0]:
            continue
        if taken[0] == beam:
            waiting.append((paths.filter(F.col("path") > listed(taken[1])), length))
        grown = materialize(own.withColumn("at", F.element_at("path", -1)).join(step, "at").filter("next >= path[0]"), "paths")
        closed = grown.filter("next = path[0]").select(F.col("path").alias("cycle"))
        found = materialize(found.unionByName(closed).orderBy("cycle").limit(most), "cycles")
        if length < longest:
            on = (F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))
            waiting.append((grown.filter(on).select(F.concat("path", F.array("next")).alias("path")), length + 1))
        if patience is None:
            beam = min(2 * beam, MOST_PATHS)


def _widest(total: DataFrame | None, n: int, k: int, chance: float) -> float:
    """The widest confidence bound of a vertex after k of n sources: the empirical Bernstein bound of the mean of k
    values from 0 to n / (n - 1), which holds for all vertices at once but for ``chance``."""
    log, top = math.log(3 * n / chance), n / (n - 1)
    each = n / ((n - 1) * (n - 2))
    mean = F.col("d") * each / k
    spread = F.greatest(F.lit(0.0), F.col("squares") * each * each / k - mean * mean)
    spread = (total.agg(F.max(spread)).first()[0] if total is not None else None) or 0.0
    return math.sqrt(2 * spread * log / k) + 3 * top * log / k


def betweenness(edges: DataFrame, batch: int = 256, sources: int | None = None, error: float | None = None, chance: float = 0.1) -> DataFrame:
    """(id, betweenness), directed and normalised, by Brandes' two sweeps. Sources go in batches,
    which bounds the (source, vertex) rows of a sweep.

    For graphs whose every source is too much, ``sources`` sweeps about so many vertices only, drawn by a hash, and
    scales what they give. That is an estimate: with k of n sources its error is at most e with a chance of
    1 - 2 exp(-2 k e^2 (n - 2)^2 / n^2) or more for a vertex (Hoeffding).

    With ``error``, batches of sources are swept in the order of a hash until no vertex's confidence bound, from the mean and
    variance of what its sources gave, is wider; it is looked at after 1, 2, 4, ... batches. The values of all vertices then lie
    within ``error`` but for ``chance``. Where the bounds stay wider, as in small graphs, every source is swept and the result exact.
    """
    e = materialize(simple_edges(edges).filter("src <> dst"), "edges")
    nodes = materialize(vertices(edges), "nodes")
    n = nodes.count()
    swept, share = nodes, 1.0
    if sources is None and error is None:
        # From a vertex without a way out no path leads through any other.
        swept = materialize(nodes.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi"), "sources")
    if sources is not None and sources < n:
        swept = materialize(nodes.filter(F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1 << 30)) < F.lit(int(sources / n * (1 << 30)))), "sources")
        share = n / max(1, swept.count())
    batches = max(1, -(-swept.count() // batch))
    dealt = swept.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(batches)))
    total, looks = None, batches.bit_length()
    for k in range(batches):
        if error is not None and n > 2 and k and not k & (k - 1):
            done = dealt.filter(F.col("_b") < k).count()
            if done and _widest(total, n, done, chance / looks) <= error:
                share *= swept.count() / done
                break
        level = dealt.filter(F.col("_b") == k).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma"))
        seen = Levels(e.sparkSession, "sweep")
        level = seen.add(level, 0)
        levels = [level]
        while True:
            step = level.join(e, level.v == e.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
            level = seen.add(step.join(seen.all().select("s", "v"), ["s", "v"], "left_anti"), len(levels))
            if level.isEmpty():
                break
            levels.append(level)
        below = None
        for level in reversed(levels):
            if below is None:
                now = level.withColumn("delta", F.lit(0.0))
            else:
                into = below.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
                got = into.join(e, into.w == e.dst).groupBy("s", F.col("src").alias("v")).agg(F.sum("share").alias("share"))
                now = level.join(got, ["s", "v"], "left").select("s", "v", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))
            below = materialize(now, "back")
            part = below.filter("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("d"), F.sum(F.col("delta") * F.col("delta")).alias("squares"))
            total = part if total is None else total.unionByName(part)
        total = materialize(total.groupBy("id").agg(F.sum("d").alias("d"), F.sum("squares").alias("squares")), "betweenness")
        discard(seen)
    scale = share / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    return nodes.join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@few_broadcasts
def articulation_points(edges: DataFrame) -> DataFrame:
    """Vertices whose removal splits their component, found in rounds that grow with the logarithm of the graph.

    Whoever has a leaf and another neighbour is one, and no other vertex becomes or ceases to be one with the leaf, so
    leaves go first.
    """
    pairs, hung = _leaves(materialize(_undirected(edges), "pairs"))
    found = [x.filter("cut").select(F.col("to").alias("id")) for x in hung]
    if not pairs.isEmpty():
        nodes = _places(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        pairs = materialize(_by_number(pairs, nodes, "a", "b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), "pairs")
        found.append(nodes.join(cuts.cut_vertices(pairs).select(F.col("id").alias("n")), "n").select("id"))
    if not found:
        return simple_edges(edges).select(F.col("src").alias("id")).limit(0)
    return materialize(reduce(DataFrame.unionByName, found).distinct(), "cuts")


def _moves(both: DataFrame, state: DataFrame, mass: float, turn: Column) -> DataFrame:
    """(id, deg, from, to, gain): for each active vertex whose turn it is the community that it gains most by joining."""
    totals = state.groupBy("c").agg(F.sum("deg").alias("tot"))
    asked = state.filter(F.col("active") & turn).select("id", "deg", F.col("c").alias("own"))
    near = both.join(asked.select(F.col("id").alias("src")), "src", "left_semi").join(state.select(F.col("id").alias("dst"), "c"), "dst")
    near = near.groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("to_c"))
    # The vertex's own community is an option even where it has no neighbour.
    options = near.unionByName(asked.select("id", F.col("own").alias("c"), F.lit(0.0).alias("to_c"))).groupBy("id", "c").agg(F.sum("to_c").alias("to_c"))
    options = options.join(asked, "id").join(totals, "c")
    rest = F.when(F.col("c") == F.col("own"), F.col("tot") - F.col("deg")).otherwise(F.col("tot"))
    gain = F.col("to_c") - F.col("deg") * rest / mass
    found = options.groupBy("id", "deg", "own").agg(
        F.max(F.when(F.col("c") != F.col("own"), F.struct(gain.alias("gain"), "c"))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay")
    )
    more = F.col("best.gain") - F.col("stay")
    return found.select("id", "deg", F.col("own").alias("from"), F.col("best.c").alias("to"), more.alias("gain")).filter(F.col("gain") > 1e-9)


def _joint_gain(both: DataFrame, state: DataFrame, moves: DataFrame, mass: float) -> float:
    """By how much all ``moves`` together change the sum of inner weights less the squares of totals / mass."""
    own = moves.select(F.col("id").alias("src"), F.col("from").alias("a"), F.col("to").alias("b"))
    other = moves.select(F.col("id").alias("dst"), F.col("to").alias("moved"))
    ends = both.join(own, "src").join(state.select(F.col("id").alias("dst"), "c"), "dst").join(other, "dst", "left")
    inner = (F.col("b") == F.coalesce("moved", "c")).cast("int") - (F.col("a") == F.col("c")).cast("int")
    # An edge with one moved end is met from that end only.
    inside = ends.agg(F.coalesce(F.sum(F.col("w") * inner * F.when(F.col("moved").isNull(), 2).otherwise(1)), F.lit(0.0)).alias("x"))
    shift = moves.select(F.col("to").alias("c"), "deg").unionAll(moves.select("from", -F.col("deg"))).groupBy("c").agg(F.sum("deg").alias("d"))
    totals = state.groupBy("c").agg(F.sum("deg").alias("tot")).join(shift, "c")
    squares = totals.agg(F.sum((2 * F.col("tot") + F.col("d")) * F.col("d")).alias("y"))
    x, y = inside.crossJoin(squares).first()
    return x - (y or 0.0) / mass


def _apart(moves: DataFrame) -> DataFrame:
    """The moves that are the best of both their communities, so that no two share one and their gains add up."""
    best = F.max(F.struct("gain", "id")).alias("best")
    tops = moves.select("id", "gain", F.explode(F.array("from", "to")).alias("c")).groupBy("c").agg(best).select("c", F.col("best.id").alias("top"))
    leads, enters = (tops.select(F.col("c").alias(x), F.col("top").alias(f"top_{x}")) for x in ("from", "to"))
    found = moves.join(leads, "from").join(enters, "to").filter("top_from = id and top_to = id")
    return found.select(*moves.columns)


def _moved(both: DataFrame, state: DataFrame, mass: float, seed: int) -> tuple[DataFrame, float]:
    """``state`` after rounds of local moves, and what they gained.

    Vertices are active until no other community is better for them. In a round half of the active ones, by a
    hash, may move, and where they leave or enter, neighbours become active again. A round's moves are taken if
    they gain together, else those that share no community, whose gains add up. It ends when nothing moves
    even if all are asked, or a round gains less than a tenth of the best one, since what is left is cheaper to move as a
    part of larger vertices, or in the next pass.
    """
    between = both.filter("src <> dst")
    gained, best, everyone = 0.0, 0.0, False
    for r in count():
        turn = F.lit(True) if everyone else F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == r % 2
        moves = materialize(_moves(between, state, mass, turn), "moves")
        if moves.isEmpty():
            discard(moves)
            if everyone:
                return state, gained
            everyone = True
            continue
        taken, everyone = moves, False
        gain = _joint_gain(between, state, moves, mass)
        if gain <= 1e-9:
            taken = materialize(_apart(moves), "moves")
            gain = 2 * taken.agg(F.sum("gain")).first()[0]
        wake = between.join(taken.select(F.col("id").alias("src"), F.col("to").alias("at")), "src").select(F.col("dst").alias("id"), "at")
        wake = wake.join(state.select("id", "c"), "id").filter("c <> at").select("id").distinct().withColumn("woken", F.lit(True))
        fresh = state.join(taken.select("id", "to"), "id", "left").join(wake, "id", "left").join(moves.select("id", F.lit(True).alias("tried")), "id", "left")
        # Not asked yet, woken, or willing to move but not taken.
        waits = F.col("woken").isNotNull() | (F.col("active") & ~turn) | (F.col("tried").isNotNull() & F.col("to").isNull())
        fresh = materialize(fresh.select("id", "deg", F.coalesce("to", "c").alias("c"), waits.alias("active")), "state")
        discard(state, moves, *([taken] if taken is not moves else []))
        state, gained, best = fresh, gained + gain, max(best, gain)
        if gain < best / 10:
            return state, gained


@few_broadcasts
def modules(edges: DataFrame, seed: int = 42, tolerance: float = 1e-4) -> DataFrame:
    """(id, module): communities of high modularity, each of them connected, by local moves, contraction and refinement.

    Leaves begin in the community of the vertex that they hang on. In a pass vertices move, communities are contracted to vertices, these move, and so on until none moves; then
    communities that aren't connected are split. The next pass begins with single vertices in the communities found.
    Passes end when one gains less than ``tolerance`` of modularity. No number of levels or rounds is set: modularity grows with
    all that is taken. The partition need not equal any other implementation's.
    """
    pairs = _undirected(edges).withColumn("w", F.lit(1.0))
    links = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(pairs.select("b", "a", "w"))
    links = materialize(links, "weights")
    # Whatever a leaf's holder joins, the leaf gains most by joining it too; of two that have only each other one leads.
    leaves = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).filter("n = 1").select("id", "to")
    leaves = materialize(leaves, "leaves")
    leads = leaves.select(F.col("id").alias("to"), F.col("to").alias("id")).filter("id < to").withColumn("leads", F.lit(True))
    hung = leaves.join(leads, ["id", "to"], "left").filter("leads is null").select("id", "to")
    members = materialize(vertices(edges).join(hung, "id", "left").select("id", F.coalesce("to", "id").alias("module")), "members")
    mass = links.agg(F.sum("w")).first()[0] or 0.0
    if not mass:
        return members
    degrees_ = materialize(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")), "degrees")
    for turn in count():
        state = degrees_.join(members, "id").select("id", "deg", F.col("module").alias("c"), F.lit(True).alias("active"))
        state, gained = _moved(links, materialize(state, "state"), mass, seed + turn)
        found, both, level = materialize(state.select("id", "c"), "found"), links, 0
        while True:
            a, b = (state.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
            joined = both.join(a, "src").join(b, "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w"))
            joined = materialize(joined, "weights")
            if both is not links:
                discard(both)
            both, level = joined, level + 1
            single = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")).select("id", "deg", F.col("id").alias("c"), F.lit(True).alias("active"))
            discard(state)
            state, gain = _moved(both, materialize(single, "state"), mass, seed + turn + level)
            if not gain:
                discard(state, both)
                break
            gained += gain
            found, before = materialize(found.join(state.select(F.col("id").alias("c"), F.col("c").alias("up")), "c").select("id", F.col("up").alias("c")), "found"), found
            discard(before)
        a, b = (found.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
        parts = components(links.join(a, "src").join(b, "dst").filter("c_src = c_dst").select("src", "dst"))
        members, before = materialize(members.join(parts, "id", "left").select("id", F.coalesce("root", "id").alias("module")), "members"), members
        discard(before, found)
        if gained / mass < tolerance:
            return members


def graph_bundle(edges: DataFrame, root: str, longest: int = 4, most: int = 50) -> dict[str, DataFrame]:
    """What a graph is told by: ``pages``, all vertex measures with the label of each module, and ``cycles``, the
    first ``most`` of at most ``longest`` vertices."""
    from siteloom.operators.rules import module_label

    pages = project_graph(edges, root)
    named = module_label(pages.select("module", F.col("id").alias("url"))).withColumnRenamed("label", "module_label")
    return {"pages": pages.join(named, "module", "left").orderBy("id"), "cycles": simple_cycles(edges, longest, most)}


def project_graph(edges: DataFrame, root: str) -> DataFrame:
    """All vertex measures in one row per vertex, by id."""
    e = materialize(simple_edges(edges), "edges")
    cut = articulation_points(e).withColumn("is_articulation_point", F.lit(True))
    found = vertices(e)
    for part in (degrees(e), click_depth(e, root), pagerank(e), betweenness(e), cut, modules(e)):
        found = found.join(part, "id", "left")
    return found.fillna(False, ["is_articulation_point"]).orderBy("id")
