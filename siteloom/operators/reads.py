"""Questions to the current tables: filters, joins and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import urls


def visited(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked urls that are Finished or Failed."""
    return asked.join(pages.filter(F.col("status").isin("Finished", "Failed")), "url", "left_semi")


def pending(pages: DataFrame, limit: int | None = None) -> DataFrame:
    found = pages.filter("status = 'Pending'").select("url").orderBy("url")
    return found if limit is None else found.limit(limit)


def edges_in_order(edges: DataFrame) -> DataFrame:
    """Navigations as they were first seen."""
    return edges.orderBy("created_at", "from", "component", "action", "to")


def component_states(components: DataFrame, page_url: str) -> DataFrame:
    """The components of one page."""
    return components.filter(F.col("page_url") == page_url).drop("page_url")


def text_ledger(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the pages that are known, by page and path."""
    return texts.join(pages.select(F.col("url").alias("page_url")), "page_url", "left_semi").orderBy("page_url", "path")


def state_styles_in_order(styles: DataFrame) -> DataFrame:
    return styles.select("page_url", "path", "state", "property", "value").orderBy("page_url", "path", "state", "property")


METRICS = ("module_id", "module_label", "click_depth", "in_degree", "out_degree", "betweenness", "pagerank", "is_articulation_point")


def page_metrics(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every page with all eight measures by url; a page outside of the graph has nulls and an empty label."""
    found = pages.select("url").join(metrics.select("url", *METRICS), "url", "left").fillna("", ["module_label"])
    return found.orderBy("url")


def unfinished_urls(pages: DataFrame) -> DataFrame:
    """What the coverage lists as unfinished: every page that isn't Finished, External ones too."""
    return pages.filter("status <> 'Finished'").select("url").orderBy("url")


def unexplored(pages: DataFrame, limit: int | None = None) -> DataFrame:
    return pending(pages, limit)


def progress_table(pages: DataFrame) -> DataFrame:
    return pages.orderBy((F.col("status") != "Finished").desc(), "url")


def non_empty(pages: DataFrame, column: str) -> DataFrame:
    return pages.filter(F.col(column) != "").select("url", column)


def resume_candidates(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("status") == "Pending") & ~F.contains("url", F.lit("{token}"))).select("url")


def finished_route_shapes(pages: DataFrame) -> DataFrame:
    return pages.filter("status = 'Finished'").select(urls.route_shape(F.col("url")).alias("shape")).distinct()


def integrations(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(~F.col("first_party")).orderBy(F.desc("call_count"), "host", "path_pattern", "method")


def count_visited(pages: DataFrame) -> DataFrame:
    own = F.col("status") != "External"
    return pages.agg(F.count_if(own & (F.col("status") == "Finished")).alias("finished"), F.count_if(own).alias("total"))


def count_unexplored(components: DataFrame, semantic_only: bool = True) -> DataFrame:
    kept = components.filter("layer <> 'pointer'") if semantic_only else components
    return kept.agg(F.count_if(~F.col("interacted")).alias("unexplored"), F.count("*").alias("total"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part * 100 / whole).cast("int")).otherwise(0)


def coverage(pages: DataFrame, components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One row: how much of the pages, components and endpoints was reached (three 1-row tables)."""
    a, b = count_visited(pages), count_unexplored(components)
    c = endpoints.agg(F.count("*").alias("endpoints"), F.count_if("first_party").alias("first_party"))
    return a.crossJoin(b.withColumnRenamed("total", "components")).crossJoin(c).select(
        F.col("finished").alias("pages_finished"), F.col("total").alias("pages"),
        percent(F.col("finished"), F.col("total")).alias("pages_percent"),
        (F.col("components") - F.col("unexplored")).alias("components_used"), "components",
        percent(F.col("components") - F.col("unexplored"), F.col("components")).alias("components_percent"),
        "first_party", "endpoints",
    )


def component_ledger(components: DataFrame, interactions: DataFrame, requests: DataFrame, options: DataFrame) -> DataFrame:
    """Components with their interactions, requests and options as ordered arrays."""
    keys = ["page_url", "path"]
    moved = F.when(F.col("resulting_url") == F.col("page_url"), F.lit("")).otherwise(F.col("resulting_url"))
    seen = interactions.withColumn("resulting_url", moved)

    def listed(df: DataFrame, order: str, columns: list[str], name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
        return df.groupBy(*keys).agg(rows.alias(name))

    parts = [
        listed(seen, "event_seq", ["action", "value", "resulting_url", "visit_id", "step_seq"], "interactions"),
        listed(requests, "event_seq", ["method", "request_path", "status", "failed", "visit_id", "step_seq"], "network_requests"),
        listed(options, "seq", ["text", "selected"], "options"),
    ]
    for part in parts:
        components = components.join(part, keys, "left")
    return components


def flat_component_ledger(ledger: DataFrame) -> DataFrame:
    """The ledger as one list, by page and path."""
    return ledger.orderBy("page_url", "path")


def contract_sources(requests: DataFrame, endpoints: DataFrame, loads: DataFrame, interactions: DataFrame, components: DataFrame, payloads: DataFrame) -> DataFrame:
    """Requests of first-party endpoints with the page that loaded them, the control that triggered them, its page,
    and both bodies; all but the endpoint are optional.

    requests: event_seq, endpoint_id, request_body_hash, response_body_hash, interaction_seq and facts. loads: event_seq,
    loaded_page. interactions: interaction_seq, page_url, path. payloads: hash, content.
    """
    own = requests.join(endpoints.filter("first_party").select("endpoint_id"), "endpoint_id")
    found = own.join(loads.select("event_seq", "loaded_page"), "event_seq", "left")
    found = found.join(interactions.select("interaction_seq", F.col("page_url").alias("_page"), F.col("path").alias("_path")), "interaction_seq", "left")
    known = components.select(F.col("page_url").alias("_page"), F.col("path").alias("_path"), F.lit(True).alias("_known")).distinct()
    found = found.join(known, ["_page", "_path"], "left")
    for side in ("request", "response"):
        body = payloads.select(F.col("hash").alias(f"{side}_body_hash"), F.col("content").alias(f"{side}_body"))
        found = found.join(body, f"{side}_body_hash", "left")
    path = F.when(F.col("_known"), F.col("_path"))
    page = F.coalesce(F.when(F.col("_known"), F.col("_page")), F.col("loaded_page"))
    return found.withColumn("path", path).withColumn("page_url", page).drop("_page", "_path", "_known", "loaded_page", "interaction_seq")


def callers_of(calls: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Distinct (endpoint_id, page_url, path) whose interaction called it."""
    found = calls if endpoint is None else calls.filter(F.col("endpoint_id") == endpoint)
    return found.select("endpoint_id", "page_url", "path").distinct()


def resolved_members(families: DataFrame, components: DataFrame) -> DataFrame:
    """Family members that exist as components; families without any go."""
    return families.select("family_id", F.explode("members").alias("m")).select("family_id", "m.*").join(components, ["page_url", "path"])


def component_redirects(components: DataFrame, interactions: DataFrame, edges: DataFrame) -> DataFrame:
    """Where a component leads: its last interaction's result, else its edge's target."""
    led = interactions.filter("coalesce(resulting_url, '') <> ''").groupBy("page_url", "path")
    led = led.agg(F.max_by("resulting_url", "event_seq").alias("_led"))
    jump = edges.groupBy(F.col("from").alias("page_url"), F.col("component").alias("path")).agg(F.min("to").alias("_jump"))
    found = components.join(led, ["page_url", "path"], "left").join(jump, ["page_url", "path"], "left")
    return found.withColumn("redirect", F.coalesce("_led", "_jump")).drop("_led", "_jump")


def option_redirects(interactions: DataFrame, options: DataFrame) -> DataFrame:
    """Interactions with ``choice``: the text of the option they were made on, else its path."""
    named = options.select("page_url", F.col("option_path").alias("source_path"), F.col("text").alias("_text")).distinct()
    return interactions.join(named, ["page_url", "source_path"], "left").withColumn("choice", F.coalesce("_text", "source_path")).drop("_text")


def disabled_without_text(disabled: DataFrame, texts: DataFrame, px: int = 120) -> DataFrame:
    """Disabled components (page_url, path, x, y) with no text of the page within ``px`` on both axes.

    Both sides are put into cells of ``px``; a component looks into its nine cells only, so the
    band stays an equi-join. Components without a place never report.
    """
    cell = lambda c: F.floor(F.col(c) / px).cast("long")
    near = F.array(*(F.lit(x).cast("long") for x in (-1, 0, 1)))
    placed = disabled.filter("x is not null and y is not null")
    looked = placed.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    looked = looked.withColumn("_cx", cell("x") + F.col("_dx")).withColumn("_cy", cell("y") + F.col("_dy"))
    points = texts.filter("x is not null and y is not null").select(
        "page_url", F.col("x").alias("_tx"), F.col("y").alias("_ty"), cell("x").alias("_cx"), cell("y").alias("_cy")
    )
    close = (F.abs(F.col("x") - F.col("_tx")) <= px) & (F.abs(F.col("y") - F.col("_ty")) <= px)
    hit = looked.join(points, ["page_url", "_cx", "_cy"]).filter(close).select("page_url", "path").distinct()
    return placed.join(hit, ["page_url", "path"], "left_anti")


def pages_with_metrics(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    return pages.join(metrics.select("url", "module_label", "click_depth"), "url", "left")


def interaction_requests(interactions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests of each (page, path, visit, step); where no request of a control carries a step,
    all of its requests."""
    keys = ["page_url", "path"]
    own = requests.withColumn("_stamped", F.max(F.col("visit_id").isNotNull()).over(W.partitionBy(*keys)))
    steps = interactions.select(*keys, "visit_id", "step_seq")
    exact = steps.join(own.drop("_stamped"), [*keys, "visit_id", "step_seq"])
    loose = steps.join(own.filter(~F.col("_stamped")).drop("_stamped", "visit_id", "step_seq"), keys)
    return exact.unionByName(loose)


def remap_frontier(remaining: DataFrame, fresh: DataFrame) -> DataFrame:
    """Remaining components (path, identity) found again: by path, else by the first of equal
    identity (lowest pos); others are left out."""
    known = fresh.select("path", F.lit(True).alias("_same"))
    like = fresh.groupBy("identity").agg(F.min_by("path", "pos").alias("_like"))
    found = remaining.join(known, "path", "left").join(like, "identity", "left")
    now = F.when(F.col("_same"), F.col("path")).otherwise(F.col("_like"))
    return found.withColumn("now", now).filter("now is not null").drop("_same", "_like")


def known_link_targets(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (from, component, to) to known urls, as edges that need no click."""
    return links.join(known.select(F.col("url").alias("to")), "to", "left_semi").withColumn("action", F.lit("LINK"))


def eligible_components(components: DataFrame, interacted: DataFrame, excluded: DataFrame) -> DataFrame:
    found = components.filter("visible").join(interacted, ["page_url", "path"], "left_anti")
    return found.join(excluded, ["page_url", "identity"], "left_anti")


def frontier_anti(candidates: DataFrame, *known: DataFrame) -> DataFrame:
    for other in known:
        candidates = candidates.join(other, "url", "left_anti")
    return candidates


def next_frontier(candidates: DataFrame, visited_urls: DataFrame, base: Column, per_shape: int = 3) -> DataFrame:
    """http candidates (url, pos) in scope, once by clean URL, not visited, and at most
    ``per_shape`` per route shape, prior visits counted."""
    keyed = lambda df: df.withColumn("clean", urls.clean_url(F.col("url"))).withColumn("shape", urls.route_shape(F.col("url")))
    seen = keyed(visited_urls).select("clean", "shape").distinct()
    prior = seen.groupBy("shape").agg(F.count("*").alias("_prior"))
    own = keyed(candidates.filter(F.col("url").rlike("^https?://") & urls.is_in_scope(F.col("url"), base)))
    own = own.groupBy("clean", "shape").agg(F.min(F.struct("pos", "url")).alias("f")).select("clean", "shape", "f.*")
    own = own.join(seen, "clean", "left_anti").join(prior, "shape", "left")
    # By the first limit each task passes on its own first ones only.
    own = own.withColumn("_rank", F.row_number().over(W.partitionBy("shape").orderBy("pos", "url"))).filter(F.col("_rank") <= per_shape)
    return own.filter(F.col("_rank") + F.coalesce("_prior", F.lit(0)) <= per_shape).select("url", "clean", "shape", "pos")


def search_text(rows: DataFrame, words: list[str], limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 ranking of (id, text) for query words: id, score. The inverted index is built of the
    query's words only; lengths and counts are aggregates."""
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    parts = rows.select("id", tokens.alias("t")).withColumn("len", F.size("t"))
    totals = parts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    asked = [x.lower() for x in words]
    found = parts.select("id", "len", F.explode(F.filter("t", lambda x: x.isin(*asked))).alias("word"))
    tf = found.groupBy("id", "word").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(df, "word").crossJoin(totals).groupBy("id").agg(F.round(F.sum(idf * weight), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)
