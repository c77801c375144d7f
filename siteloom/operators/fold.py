"""Current state from append-only event tables, and the normalising steps before them.

Every table may hold many sites: ``site`` names the columns that come before a key. Events are
ordered by ``event_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import labels, urls

PENDING, FINISHED, FAILED, EXTERNAL = "Pending", "Finished", "Failed", "External"


def _last(column: str, where: Column | None = None, seq: str = "event_seq") -> Column:
    order = F.col(seq) if where is None else F.when(where, F.col(seq))
    return F.max_by(F.col(column), order)


def current_pages(events: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """One row per url: status (the last one that isn't Pending, else Pending), component_count
    (of that event, else of the first), description and title (the last that aren't empty),
    visited_at (of the last Finished event)."""
    settled = F.col("status") != PENDING
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return events.groupBy(*site, "url").agg(
        F.coalesce(_last("status", settled), F.lit(PENDING)).alias("status"),
        F.coalesce(_last("components", settled), F.min_by("components", "event_seq")).alias("component_count"),
        F.coalesce(_last("description", has("description")), F.lit("")).alias("description"),
        F.coalesce(_last("title", has("title")), F.lit("")).alias("title"),
        _last("ts", F.col("status") == FINISHED).alias("visited_at"),
    )


def ensure_pages(pages: DataFrame, *references: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` and, as Pending, every url of the references (tables with a column url)."""
    keys = [*site, "url"]
    named = references[0].select(*keys)
    for other in references[1:]:
        named = named.unionByName(other.select(*keys))
    named = named.filter(F.col("url").isNotNull()).distinct()
    defaults = {"status": PENDING, "component_count": 0, "description": "", "title": ""}
    found = pages.join(named, keys, "full_outer")
    return found.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else c for c in pages.columns))


def page_metadata(events: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """The last metadata map of each url, whole."""
    return events.groupBy(*site, "url").agg(_last("metadata").alias("metadata"))


def current_links(links: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """One row per (from, to) with the last label."""
    return links.groupBy(*site, "from", "to").agg(_last("label").alias("label"))


def current_edges(events: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """Navigations by (from, to, component, action) with counts and the runs that saw them."""
    named = F.coalesce(F.col("run_id"), F.lit("")) != ""
    return events.groupBy(*site, "from", "to", "component", "action").agg(
        F.count("*").alias("observation_count"),
        F.min_by("run_id", F.when(named, F.col("event_seq"))).alias("first_seen_run"),
        _last("run_id", named).alias("last_seen_run"),
        F.min("ts").alias("created_at"),
    )


def current_rows(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key, nulls and empty values included (components, texts)."""
    last = F.max_by(F.struct(*columns), "event_seq").alias("_last")
    return events.groupBy(*keys).agg(last).select(*keys, "_last.*")


def with_interactions(components: DataFrame, interactions: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """Components with ``interacted`` and ``interaction_count``."""
    keys = [*site, "page_url", "path"]
    counts = interactions.groupBy(*keys).agg(F.count("*").alias("interaction_count"))
    found = components.join(counts, keys, "left").fillna(0, ["interaction_count"])
    return found.withColumn("interacted", F.col("interaction_count") > 0)


def interaction_targets(interactions: DataFrame) -> DataFrame:
    """Interactions with ``target``: the key of where they led, else their own page."""
    led = F.coalesce(F.col("resulting_url"), F.lit("")) != ""
    return interactions.withColumn("target", F.when(led, urls.route_shape(F.col("resulting_url"))).otherwise(F.col("page_url")))


def parsed_options(events: DataFrame) -> DataFrame:
    """Events with ``options`` (raw JSON in any of three shapes) as an array of rows, and their ``group_name``;
    none where the shape isn't known."""
    told = events.withColumn("_o", labels.option_rows(F.col("options")))
    none = F.array().cast("array<struct<path:string,text:string,selected:boolean>>")
    return told.withColumn("options", F.coalesce("_o.rows", none)).withColumn("group_name", F.coalesce("_o.group_name", F.lit(""))).drop("_o")


def current_options(events: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """Options of each component, all replaced by its last event (column options: array)."""
    keys = [*site, "page_url", "path"]
    last = events.groupBy(*keys).agg(_last("options").alias("options"))
    return last.select(*keys, F.posexplode("options").alias("seq", "o")).select(*keys, "seq", "o.*")


def current_containment(entries: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """Distinct direct (parent, child, child_kind) pairs of nearest-first ancestor chains."""
    chain = F.transform("ancestors", lambda x: x["path"])
    pairs = F.zip_with(
        F.concat(F.array(F.col("path")), F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0)))),
        chain,
        lambda child, parent: F.struct(parent.alias("parent"), child.alias("child")),
    )
    found = entries.filter(F.size("ancestors") > 0).select(*site, "page_url", F.posexplode(pairs).alias("pos", "pair"))
    kind = F.when(F.col("pos") == 0, "component").otherwise("container").alias("child_kind")
    return found.select(*site, "page_url", "pair.parent", "pair.child", kind).distinct()


def current_state_styles(events: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """(page_url, path, state, property, value) of nested maps; the last value, empty ones left out."""
    keys = [*site, "page_url", "path"]
    states = events.select(*keys, "event_seq", F.explode("states").alias("state", "values"))
    flat = states.select(*keys, "event_seq", "state", F.explode("values").alias("property", "value"))
    flat = flat.filter(F.coalesce(F.col("value"), F.lit("")) != "")
    return flat.groupBy(*keys, "state", "property").agg(_last("value").alias("value"))


def load_requests(requests: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """First-party requests that a page's own load fired (no path), with ``loaded_page``."""
    own = requests.filter("is_first_party and path is null and page_url is not null")
    return own.withColumnRenamed("page_url", "loaded_page").drop("path", "visit_id", "step_seq")


def triggered_requests(requests: DataFrame, interactions: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """First-party requests with the interaction of the same page, path, visit and step."""
    keys = [*site, "page_url", "path", "visit_id", "step_seq"]
    own = interactions.select(*keys, F.col("event_seq").alias("interaction_seq"))
    return requests.filter("is_first_party").join(own, keys)


def endpoint_counts(requests: DataFrame, site: tuple[str, ...] = ()) -> DataFrame:
    """Calls of each endpoint, third-party ones included; the earliest event tells the party."""
    pattern = urls.path_pattern(F.col("path"))
    found = requests.withColumn("path_pattern", pattern).groupBy(*site, "method", "host", "path_pattern")
    return found.agg(
        F.count("*").alias("call_count"),
        F.min_by("is_first_party", "event_seq").alias("first_party"),
        F.min_by(urls.path_params(F.col("path")), "event_seq").alias("path_params"),
    )


def payloads(bodies: DataFrame) -> DataFrame:
    """One row per hash, the first write wins."""
    first = F.min_by(F.struct("length", "content"), "event_seq").alias("f")
    return bodies.groupBy("hash").agg(first, F.count("*").alias("uses")).select("hash", "f.*", "uses")


def payload_edges(requests: DataFrame) -> DataFrame:
    """(event_seq, direction, hash) of the bodies that requests have (request_body_hash, response_body_hash)."""
    sides = F.array(*(F.struct(F.lit(x).alias("direction"), F.col(f"{x}_body_hash").alias("hash")) for x in ("request", "response")))
    return requests.select("event_seq", F.inline(sides)).filter("coalesce(hash, '') <> ''")


def replace_partitions(df: DataFrame, path: str, by: str = "site") -> None:
    """Full rebuild of the partitions that ``df`` holds; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_metrics(pages: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """``pages`` with the columns of ``metrics``; pages that it lacks keep their old values."""
    new = [c for c in metrics.columns if c not in keys]
    given = metrics.select(*keys, F.lit(True).alias("_given"), *(F.col(c).alias(f"_new_{c}") for c in new))
    found = pages.join(given, keys, "left")
    old = {c: F.col(c) if c in pages.columns else F.lit(None) for c in new}
    for c in new:
        found = found.withColumn(c, F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(old[c]))
    return found.drop("_given", *(f"_new_{c}" for c in new))


def consolidate_groups(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of a group (columns keys, path, pos) with the path of its first member."""
    first = F.first_value("path").over(W.partitionBy(*keys).orderBy("pos"))
    return members.withColumn("representative", first)


def redirect_members(events: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Events of group members moved to the representative; ``source_path`` keeps the member."""
    chosen = groups.select(*keys, "path", "representative")
    found = events.join(chosen, [*keys, "path"], "left").withColumn("source_path", F.col("path"))
    return found.withColumn("path", F.coalesce("representative", "path")).drop("representative")


def classify_links(links: DataFrame, base: Column, allow_subdomains: bool = False) -> DataFrame:
    """http(s) links by key, once each, targets out of scope as External (columns from, href)."""
    kept = links.filter(F.col("href").rlike("(?i)^https?://"))
    status = F.when(urls.is_in_scope(F.col("href"), base, allow_subdomains), PENDING).otherwise(EXTERNAL)
    found = kept.select("from", urls.route_shape(F.col("href")).alias("url"), status.alias("status"))
    return found.distinct()


def stamp_first_party(requests: DataFrame, base: Column) -> DataFrame:
    return requests.withColumn("is_first_party", urls.is_in_scope(F.col("host"), base, True))


def component_rows(discovered: DataFrame) -> DataFrame:
    """Descriptive columns of raw discovered elements, with defaults for what is missing."""
    text = lambda c, name=None: F.coalesce(F.col(c), F.lit("")).alias(name or c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    box = [F.col(f"rect.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")]
    named = (("class", "css_class"), ("id", "element_id"), ("href", "href"))
    attributes = [F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("")).alias(v) for k, v in named]
    return discovered.select(
        "page_url", "path", *map(text, ("tag", "role", "text", "input_type")), *map(flag, ("visible", "selected")), *box,
        # The fifteen facts.
        *attributes, *map(text, ("placeholder", "label", "name", "form")), *map(flag, ("disabled", "required")),
        *(text(f"style.{c}", c) for c in ("color", "background_color", "font_size", "font_weight", "display", "position")),
    )


def navigation_edges(interactions: DataFrame) -> DataFrame:
    """Interactions that led to another URL than their page's own, as edge events."""
    moved = urls.clean_url(F.col("resulting_url")) != urls.clean_url(F.col("literal_url"))
    led = F.coalesce(F.col("resulting_url"), F.lit("")) != ""
    return interactions.filter(led & moved).select(
        F.col("page_url").alias("from"),
        urls.route_shape(F.col("resulting_url")).alias("to"),
        F.col("path").alias("component"),
        "action", "run_id", "event_seq", "ts",
    )


def touch_sites(runs: DataFrame) -> DataFrame:
    return runs.groupBy("site").agg(F.min("ts").alias("first_crawled"), F.max("ts").alias("last_crawled"))


def without_reset(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Events later than their site's last reset (site, event_seq); the history stays stored."""
    last = resets.groupBy("site").agg(F.max("event_seq").alias("_reset"))
    found = events.join(last, "site", "left")
    return found.filter(F.col("_reset").isNull() | (F.col("event_seq") > F.col("_reset"))).drop("_reset")
