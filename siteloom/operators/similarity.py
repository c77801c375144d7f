"""Component families by shared class names, colour clusters, text search."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import colors
from siteloom.operators.components import similar_components
from siteloom.plans.shared import materialize


def _token_sets(components: DataFrame) -> DataFrame:
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("css_class", F.lit("")), r"\s+"), lambda x: x != "")))
    return components.filter(F.trim(F.coalesce("tag", F.lit(""))) != "").withColumn("tokens", tokens)


def _prefixes(components: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Distinct token sets that aren't empty (tag, component_type, tokens, node), and the keys (key, node, size) that they share:
    any two that are similar enough share a token among each set's rarest ones (prefix filtering)."""
    kind = ["tag", "component_type"]
    sets = _token_sets(components).filter(F.size("tokens") > 0).select(*kind, "tokens").distinct()
    sets = materialize(sets.withColumn("node", _node()), "token-sets")
    words = sets.select(*kind, "node", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    seen = words.groupBy(*kind, "token").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("uses", "token"))
    prefix = words.join(seen, [*kind, "token"]).withColumn("_r", rank).filter("uses > 1")
    prefix = prefix.filter(F.col("_r") <= F.col("size") - F.ceil(F.col("size") * float(threshold)) + 1)
    return sets, materialize(prefix.select(F.xxhash64(*kind, "token").alias("key"), "node", "size").distinct(), "token-keys")


def _node() -> Column:
    return F.xxhash64("tag", "component_type", F.to_json("tokens"))


def class_similarity_pairs(components: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Distinct token sets of one (tag, component_type) with a Jaccard similarity of ``threshold``
    or more: set_a < set_b and the similarity, a row a pair. Equal sets are one set; an empty set is like no
    other. A frequent class name alone pairs nothing. Families don't need the pairs, see ``component_families``."""
    least, kind = Fraction(threshold).limit_denominator(1000), ["tag", "component_type"]
    sets, keys = _prefixes(components, least)
    a, b = (keys.withColumnsRenamed({"node": f"set_{x}", "size": f"size_{x}"}) for x in "ab")
    near = a.join(b, "key").filter((F.col("set_a") < F.col("set_b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")))
    near = near.select("set_a", "set_b").distinct()
    near = near.join(sets.select(*kind, F.col("node").alias("set_a"), F.col("tokens").alias("_a")), "set_a")
    near = near.join(sets.select(F.col("node").alias("set_b"), F.col("tokens").alias("_b")), "set_b")
    same = F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))
    return near.withColumn("similarity", same).filter(F.col("similarity") >= threshold).select(*kind, "set_a", "set_b", "similarity")


def component_families(components: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Members with family_id, for families of two or more; unstyled components of one tag and
    type are a family of their own. Sets are linked without a row for each pair."""
    least = Fraction(threshold).limit_denominator(1000)
    sets, keys = _prefixes(components, least)
    hashes = sets.select("node", F.array_sort(F.transform("tokens", lambda x: F.xxhash64(x))).alias("hashes"))
    roots = similar_components(keys, materialize(hashes, "token-hashes"), least)
    found = _token_sets(components).withColumn("node", _node()).join(roots, "node", "left")
    found = found.withColumn("family_id", F.coalesce("root", "node")).drop("root", "node")
    size = found.groupBy("family_id").agg(F.count("*").alias("members")).filter("members > 1")
    return found.join(size, "family_id")


def common_classes(families: DataFrame) -> DataFrame:
    """Class names that every member of a family has."""
    n = families.groupBy("family_id").agg(F.count("*").alias("n"))
    uses = families.select("family_id", F.explode("tokens").alias("token")).groupBy("family_id", "token").agg(F.count("*").alias("uses"))
    shared = uses.join(n, "family_id").filter("uses = n").groupBy("family_id").agg(F.array_sort(F.collect_list("token")).alias("common_classes"))
    none = F.array().cast("array<string>")
    return n.join(shared, "family_id", "left").select("family_id", F.coalesce("common_classes", none).alias("common_classes"))


def color_clusters(usage: DataFrame, threshold: float = colors.NOTICEABLE) -> DataFrame:
    """(r, g, b, uses, leader): each colour joins the first leader, by descending use, within the
    threshold. Leaders are the first independent set of the threshold graph, found in rounds;
    neighbours meet in cells of Lab space."""
    key = F.expr("r * 65536 + g * 256 + b")
    order = F.struct((-F.col("uses")).alias("u"), key.alias("k"))
    points = materialize(usage.select("r", "g", "b", "uses", key.alias("key"), order.alias("ord"), colors.to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")), "colors")
    cell = [F.floor(F.col(f"lab.{x}") / threshold).cast("int").alias(f"c{x}") for x in ("l", "a", "b")]
    around = F.explode(F.array(*(F.lit(x) for x in (-1, 0, 1))))
    here = points.select("key", "ord", "lab", *cell)
    look = here.withColumn("_x", around).withColumn("_y", around).withColumn("_z", around)
    look = look.select("key", "ord", F.col("lab").alias("lab1"), (F.col("cl") + F.col("_x")).alias("cl"), (F.col("ca") + F.col("_y")).alias("ca"), (F.col("cb") + F.col("_z")).alias("cb"))
    other = here.select(F.col("key").alias("first"), F.col("ord").alias("ord1"), F.col("lab").alias("lab2"), "cl", "ca", "cb")
    near = look.join(other, ["cl", "ca", "cb"]).filter((F.col("ord1") < F.col("ord")) & (colors.distance(F.col("lab1"), F.col("lab2")) <= threshold))
    near = materialize(near.select("key", "first", "ord1"), "near")
    state = materialize(points.select("key", F.lit(None).cast("boolean").alias("leads")), "leaders")
    while True:
        first = state.select(F.col("key").alias("first"), F.col("leads").alias("f"))
        told = near.join(first, "first").groupBy("key").agg(F.max(F.coalesce("f", F.lit(False))).alias("under"), F.max(F.col("f").isNull()).alias("waits"))
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("under", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = materialize(state.join(told, "key", "left").select("key", now.alias("leads")), "leaders")
        if not state.filter("leads is null").limit(1).count():
            break
    led = near.join(state.filter("leads").select(F.col("key").alias("first")), "first", "left_semi").groupBy("key").agg(F.min_by("first", "ord1").alias("lead"))
    found = points.join(state, "key").join(led, "key", "left")
    return found.select("r", "g", "b", "uses", F.when(F.col("leads"), F.col("key")).otherwise(F.col("lead")).alias("leader"))
