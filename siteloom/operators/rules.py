"""Contracts, catalogues, entities, findings: derived models over the current tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import colors, labels, urls
from siteloom.operators.ordered import numbered
from siteloom.plans.shared import materialize


def _distinct(column: str, name: str | None = None):
    value = F.col(column)
    return F.array_sort(F.collect_set(F.when(value.cast("string") != "", value))).alias(name or column)


# Endpoints


def inferred_requests(requests: DataFrame, by: tuple[str, ...] = ("endpoint_id",)) -> DataFrame:
    """Per first-party endpoint the sorted distinct facts, the span and number of latencies, and the shortest
    bodies; a response example comes from a 2xx answer only. All latencies are in ``endpoint_latencies``."""
    good = F.col("status").between(200, 299)
    shortest = lambda c, where=None: F.min_by(c, F.when((F.coalesce(F.col(c), F.lit("")) != "") & (F.lit(True) if where is None else where), F.struct(F.char_length(c), F.col(c))))
    own = requests.filter("is_first_party")
    names = own.select(*by, F.explode("query_params").alias("_q")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("_q")).alias("query_params"))
    found = own.groupBy(*by).agg(
        _distinct("status", "status_codes"),
        _distinct("auth_scheme", "auth_schemes"),
        _distinct("media_type", "media_types"),
        F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms"), F.count("latency_ms").alias("n_latencies"),
        F.array_sort(F.collect_set(F.when(F.col("path").isNotNull(), F.struct("page_url", "path")))).alias("triggered_by"),
        F.array_sort(F.collect_set(F.when(F.col("path").isNull(), F.col("page_url")))).alias("loaded_by"),
        shortest("request_body").alias("request_example"),
        shortest("response_body", good).alias("response_example"),
    )
    none = F.array().cast("array<string>")
    return found.join(names, list(by), "left").withColumn("query_params", F.coalesce("query_params", none))


def endpoint_latencies(requests: DataFrame, by: tuple[str, ...] = ("endpoint_id",)) -> DataFrame:
    """(by, latency_ms, calls): every latency of the first-party endpoints and how often it occurred."""
    return requests.filter("is_first_party and latency_ms is not null").groupBy(*by, "latency_ms").agg(F.count("*").alias("calls"))


def observed_from(inferred: DataFrame, most: int = 5) -> DataFrame:
    """Where an endpoint was seen from: its first callers and loading pages, and the span of its latencies."""
    span = F.when(F.col("n_latencies") > 0, F.concat_ws("-", "least_ms", "most_ms"))
    return inferred.select("endpoint_id", F.slice("triggered_by", 1, most).alias("callers"), F.slice("loaded_by", 1, most).alias("pages"), span.alias("latency"))


def endpoint_contract(endpoints: DataFrame, requests: DataFrame, endpoint: str) -> DataFrame:
    """Status, scheme and media sets of one endpoint, third-party ones too; no row if unknown."""
    own = endpoints.filter(F.col("endpoint_id") == endpoint).select("endpoint_id")
    return own.join(requests, "endpoint_id", "left").groupBy("endpoint_id").agg(
        _distinct("status", "status_codes"), _distinct("auth_scheme", "auth_schemes"), _distinct("media_type", "media_types")
    )


def merge_shapes(shapes: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, type, required) of JSON object shapes (column shape): a key that some shape of the
    group lacks isn't required. Types are taken from the first in order if they differ."""
    own = shapes.filter("shape is not null and shape <> ''").select(*by, F.from_json("shape", "map<string,string>").alias("m")).filter("m is not null")
    n = own.groupBy(*by).agg(F.count("*").alias("_n"))
    keys = own.select(*by, F.explode("m").alias("key", "type")).groupBy(*by, "key").agg(F.count("*").alias("_k"), F.min("type").alias("type"))
    return keys.join(n, by).select(*by, "key", "type", (F.col("_k") == F.col("_n")).alias("required"))


def contract_fields(shapes: DataFrame, by: list[str]) -> DataFrame:
    """(by, json_path, type, required) of nested shapes, level by level until none is left; list items are
    ``[]``. A key is required if every object at its place has it, items if every list at their place has some.

    Equal shapes at a place are one row with their number, as answers of an endpoint have few shapes."""
    level = shapes.filter("shape is not null and shape <> ''").select(*by, F.lit("$").alias("at"), "shape", F.lit(1).cast("long").alias("_c"))
    is_list, is_object = F.col("shape").startswith("["), F.col("shape").startswith("{")
    found = None
    while True:
        level = level.filter(is_list | is_object).groupBy(*by, "at", "shape").agg(F.sum("_c").alias("_c"))
        level = materialize(level.withColumn("listed", is_list), "shapes")
        if found is not None and level.isEmpty():
            return found
        n = level.groupBy(*by, "at", "listed").agg(F.sum("_c").alias("_n"))
        keys = level.filter(is_object).select(*by, "at", "listed", "_c", F.explode(F.from_json("shape", "map<string,string>")).alias("key", "shape"))
        keys = keys.select(*by, "at", "listed", "_c", F.concat("at", F.lit("."), "key").alias("json_path"), "shape")
        items = level.filter(is_list).select(*by, "at", "listed", "_c", F.concat("at", F.lit("[]")).alias("json_path"), F.explode(F.from_json("shape", "array<string>")).alias("shape"))
        parts = materialize(keys.unionByName(items), "shape-parts")
        kind = F.when(is_object, "object").when(is_list, "array").otherwise(F.col("shape"))
        rows = parts.groupBy(*by, "at", "listed", "json_path").agg(F.min(kind).alias("type"), F.sum("_c").alias("_k")).join(n, [*by, "at", "listed"])
        rows = rows.select(*by, "json_path", "type", (F.col("_k") >= F.col("_n")).alias("required"))
        found = rows if found is None else found.unionByName(rows)
        level = parts.select(*by, F.col("json_path").alias("at"), "shape", "_c")


def shared_schemas(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by, schema_id, uses): equal field lists have one id."""
    listed = fields.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("json_path", "type", "required"))).alias("f"))
    named = listed.withColumn("schema_id", F.sha2(F.to_json("f"), 256))
    return named.join(named.groupBy("schema_id").agg(F.count("*").alias("uses")), "schema_id").select(*by, "schema_id", "uses")


def api_operations(endpoints: DataFrame) -> DataFrame:
    """Templated path, operation id, summary and parameters of (method, host, path_pattern, query_params)."""
    pattern = F.regexp_replace("path_pattern", r"\{id_[0-9]+\}", "{id}")
    found = endpoints.withColumn("path_template", labels.path_template(pattern))
    named = labels.operation(F.col("method"), F.size("query_params") > 0, F.col("path_template"))
    return found.select(
        "method", "host", "path_template", named["operation_id"].alias("operation_id"), named["summary"].alias("summary"),
        F.concat(labels.template_names(F.col("path_template")), "query_params").alias("parameters"),
    )


def api_responses(inferred: DataFrame) -> DataFrame:
    """(endpoint_id, status, security): each observed status, or one null, with the schemes of the endpoint."""
    schemes = F.array_sort(F.transform("auth_schemes", lambda x: labels.security_scheme(x)["name"]))
    return inferred.select("endpoint_id", F.explode_outer("status_codes").alias("status"), F.array_join(schemes, ",").alias("security"))


def meaningful_requests(events: DataFrame, keep) -> DataFrame:
    """Kept request events of each capture batch with what was last seen for their url: status,
    failure and body. ``keep`` is a condition on request events."""
    last = lambda c, kind: F.max_by(c, F.when(F.col("event_type") == kind, F.col("seq")))
    told = events.groupBy("batch", "url").agg(
        last("status", "response").alias("status"), last("failure_text", "request_failed").alias("failure_text"),
        last("headers", "response").alias("response_headers"), last("body", "response").alias("body"),
        F.max(F.col("event_type") == "request_failed").alias("failed"),
    )
    return events.filter((F.col("event_type") == "request") & keep).select("batch", "url", "seq", "method", "resource_type").join(told, ["batch", "url"])


# Pages and modules


def page_landmarks(chains: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Distinct regions per landmark kind and page (chains: page_url, id, ancestor)."""
    found = chains.join(landmarks, chains.ancestor == landmarks.container)
    return found.groupBy("page_url", "landmark").agg(F.countDistinct("container").alias("regions"))


def summarize_modules(metrics: DataFrame) -> DataFrame:
    own = metrics.filter("module_id is not null")
    label = F.when(F.coalesce("module_label", F.lit("")) == "", F.concat(F.lit("Module "), F.col("module_id").cast("string"))).otherwise(F.col("module_label"))
    return own.groupBy(label.alias("label")).agg(
        F.count("*").alias("page_count"),
        F.min_by("url", F.struct(F.col("click_depth").isNull(), F.coalesce("click_depth", F.lit(0)), "url")).alias("entry_page"),
        F.min("click_depth").alias("shallowest_depth"), F.max("click_depth").alias("deepest_depth"),
        F.array_sort(F.collect_list(F.when(F.col("is_articulation_point"), F.col("url")))).alias("articulation_points"),
    ).orderBy(F.desc("page_count"), "label")


def bottlenecks(modules: DataFrame) -> DataFrame:
    return modules.select("label", F.explode("articulation_points").alias("url"))


def hosts_by_traffic(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("host").agg(F.sum("call_count").alias("calls"), F.count("*").alias("endpoints")).orderBy(F.desc("calls"), F.desc("endpoints"), "host")


def depth_histogram(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("click_depth").agg(F.count("*").alias("pages"))


def module_label(pages: DataFrame) -> DataFrame:
    """(module, label): the path segments that all urls of a module begin with, or ``Module``."""
    path = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/"), lambda x: x != "")
    own = pages.select("module", "url", F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))).alias("s"))
    n = own.groupBy("module").agg(F.count("*").alias("n"))
    parts = own.select("module", F.posexplode("s").alias("pos", "x")).groupBy("module", "pos")
    parts = parts.agg(F.count("*").alias("k"), F.countDistinct("x").alias("d"), F.min("x").alias("x")).join(n, "module")
    bad = F.min(F.when((F.col("k") < F.col("n")) | (F.col("d") > 1), F.col("pos"))).over(W.partitionBy("module"))
    kept = parts.withColumn("_bad", bad).filter("_bad is null or pos < _bad")
    named = kept.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    title = F.array_join(F.transform("p", lambda y: F.initcap(F.translate(y["x"], "-_", "  "))), " / ")
    return n.join(named.select("module", title.alias("label")), "module", "left").select("module", F.coalesce("label", F.lit("Module")).alias("label"))


# Components


def color_usage(components: DataFrame, field: str) -> DataFrame:
    rgb = components.select(colors.parse_css_color(F.col(field)).alias("c")).filter("c is not null")
    return rgb.groupBy("c.r", "c.g", "c.b").agg(F.count("*").alias("uses"))


def type_tokens(components: DataFrame) -> DataFrame:
    """(font_size, font_weight, uses, name), largest sizes first, then by weight; sizes that aren't numbers of px last."""
    px = F.coalesce(F.trim(F.replace("font_size", F.lit("px"), F.lit(""))).try_cast("double"), F.lit(-1.0))
    found = components.filter("coalesce(font_size, '') <> ''").groupBy("font_size", "font_weight").agg(F.count("*").alias("uses"))
    found = found.withColumn("_px", px)
    order = [F.col("_px").desc(), F.coalesce("font_weight", F.lit("")), F.col("font_size")]
    named = numbered(found, [], order, "_n")
    return named.withColumn("name", F.concat(F.lit("type-"), F.col("_n").cast("string"))).drop("_n", "_px")


def state_tokens(styles: DataFrame) -> DataFrame:
    """(state, property, value, uses, position): how many controls declare a value, the most declared of each state first."""
    complete = styles.filter("coalesce(state, '') <> '' and coalesce(property, '') <> '' and coalesce(value, '') <> ''")
    found = complete.groupBy("state", "property", "value").agg(F.count("*").alias("uses"))
    return numbered(found, [], [F.col("state"), F.desc("uses"), F.col("property"), F.col("value")], "position")


def token_names(rows: DataFrame, prefix: str, uses: str, *ties: str) -> DataFrame:
    """Rows with a positional name by descending use."""
    found = numbered(rows, [], [F.desc(uses), *(F.col(c) for c in ties)], "_n")
    return found.withColumn("name", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def color_tokens(components: DataFrame, cluster) -> DataFrame:
    """(role, name, value, uses, merged): colour clusters of text and of surfaces, apart even where they are equal.

    A cluster has its leader's value, the uses of all its colours, and the values that it took in; clusters
    are named by their leaders' own uses, the most used first.
    """
    parts = []
    for role, field in (("text", "color"), ("surface", "background_color")):
        found = cluster(color_usage(components, field))
        value, key = colors.to_hex(F.col("r"), F.col("g"), F.col("b")), F.expr("r * 65536 + g * 256 + b")
        leads = key == F.col("leader")
        tokens = found.groupBy("leader").agg(
            F.max(F.when(leads, value)).alias("value"), F.max(F.when(leads, F.col("uses"))).alias("_own"), F.sum("uses").alias("uses"),
            F.array_sort(F.collect_list(F.when(~leads, value))).alias("merged"),
        )
        named = numbered(tokens, [], [F.desc("_own"), F.col("leader")], "_n")
        parts.append(named.select(F.lit(role).alias("role"), F.concat(F.lit(f"{role}-"), F.col("_n").cast("string")).alias("name"), "value", "uses", "merged"))
    return parts[0].unionByName(parts[1])


# What of a control its rebuilt version would take, and the tags that are controls by themselves.
PROPS = ("label", "placeholder", "name", "href", "form", "required", "disabled", "option_labels")
ATOM_TAGS = ("button", "input", "a", "select", "textarea")


def catalog_props(members: DataFrame, props: tuple[str, ...] = PROPS) -> DataFrame:
    """Per family and property that a member has: kind, on how many members, whether it varies, the first example.

    Kinds are string, boolean and list, by the column. Empty texts, false and empty lists aren't there; but they and
    nulls are values each, so a property that some members lack varies.
    """
    kinds = {p: {"boolean": "boolean", "array": "list"}.get(members.schema[p].dataType.typeName(), "string") for p in props}
    told = {"string": lambda p: F.col(p).cast("string"), "boolean": lambda p: F.col(p).cast("string"), "list": lambda p: F.array_join(p, ", ")}
    row = lambda p, k: F.struct(
        F.lit(p).alias("prop"), F.lit(k).alias("kind"), told[k](p).alias("example"), (F.to_json(F.struct(p)) if k == "list" else told[k](p)).alias("value"),
        F.coalesce(F.size(p) > 0 if k == "list" else F.col(p) if k == "boolean" else F.col(p).cast("string") != "", F.lit(False)).alias("there"),
    )
    long = members.select("family_id", "pos", F.inline(F.array(*(row(p, k) for p, k in kinds.items()))))
    # Equal values first, by sums of fixed width; each value tells whether it is there and how it is shown.
    keys = ["family_id", "prop", "kind"]
    values = long.groupBy(*keys, "value", "there", "example").agg(F.count("*").alias("_c"), F.min("pos").alias("pos"))
    there = F.when(F.col("there"), F.struct("pos", "example"))
    found = values.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("there"), F.col("_c"))), F.lit(0)).alias("present"), (F.count("*") > 1).alias("varies"), F.min(there)["example"].alias("example"),
    )
    return found.filter("present > 0")


def catalog_variants(members: DataFrame, common: DataFrame) -> DataFrame:
    """Per family, extra classes and background: count and first text."""
    extra = F.array_join(F.array_sort(F.array_except("tokens", "common_classes")), " ")
    found = members.join(common, "family_id").withColumn("extra_classes", extra)
    return found.groupBy("family_id", "extra_classes", "background_color").agg(F.count("*").alias("count"), F.coalesce(F.min(F.when(F.col("text") != "", F.struct("pos", "text")))["text"], F.lit("")).alias("example"))


def catalog_entries(members: DataFrame) -> DataFrame:
    """Per family its unique name, pages, regions, level and whether it was seen disabled.

    The level is ``atom`` for tags that are controls by themselves, ``atom (in a form)`` where all members are in
    one, and empty where the tag doesn't tell."""
    in_form = F.bool_and(F.coalesce("form", F.lit("")) != "")
    found = members.groupBy("family_id").agg(
        F.min("component_type").alias("component_type"), F.array_sort(F.collect_set("page_url")).alias("used_on"), F.array_sort(F.collect_set(F.nullif("region", F.lit("")))).alias("regions"),
        F.when(~F.bool_and(F.coalesce(F.col("tag").isin(*ATOM_TAGS), F.lit(False))), "").when(in_form, "atom (in a form)").otherwise("atom").alias("level"),
        F.coalesce(F.bool_or("disabled"), F.lit(False)).alias("disabled_observed"), F.count("*").alias("members"),
    )
    found = found.withColumn("name", labels.component_name(F.col("component_type")))
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.desc("members"), "family_id"))
    return found.withColumn("_n", nth).withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.col("_n").cast("string"))).otherwise(F.col("name"))).drop("_n")


def choice_sets(components: DataFrame, keys: list[str]) -> DataFrame:
    """Radio buttons and checkboxes with one name, two or more, in order."""
    kinds = ("radio", "checkbox")
    own = components.filter((F.coalesce("name", F.lit("")) != "") & (F.lower("role").isin(*kinds) | F.lower("input_type").isin(*kinds)))
    found = own.groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("members"))
    return found.filter(F.size("members") >= 2)


def option_families(components: DataFrame, keys: list[str]) -> DataFrame:
    """Options and menu items below one parent, two or more, in order."""
    own = components.filter(F.lower("role").isin(*labels.LIST_ROLES)).withColumn("parent", labels.parent_path(F.col("path"))).filter("parent <> ''")
    found = own.groupBy(*keys, "parent").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("members"))
    return found.filter(F.size("members") >= 2)


def steppers(components: DataFrame, keys: list[str]) -> DataFrame:
    """Per parent the first increment and decrement control, and the first number beside them."""
    own = components.withColumn("container", labels.parent_path(F.col("path"))).withColumn("_k", labels.fold_accents(F.col("text"))).filter("container <> ''")
    up, down = F.col("_k").isin(*labels.INCREMENT), F.col("_k").isin(*labels.DECREMENT)
    number = labels.looks_numeric(F.col("text"))
    first = lambda c, where: F.min_by(c, F.when(where, F.col("pos")))
    found = own.groupBy(*keys, "container").agg(
        first("path", up).alias("increment_path"), first("path", down).alias("decrement_path"),
        first("path", number & ~up & ~down).alias("value_path"), first("text", number & ~up & ~down).alias("current_value"),
    )
    return found.filter("increment_path is not null and decrement_path is not null")


# Entities


def entities(components: DataFrame) -> DataFrame:
    """One row per (page, form) with its named fields in order of their names."""
    name = labels.first_filled("name", "label", "placeholder")
    own = components.filter(labels.is_field(F.col("component_type")) & (F.coalesce("form", F.lit("")) != "")).withColumn("field", name).filter("field <> ''")
    field = F.struct(
        F.col("field"), labels.data_type(F.col("input_type")).alias("data_type"), labels.validation(F.col("input_type"), F.col("required")).alias("validation"), "path"
    )
    found = own.groupBy("page_url", "form").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return found.withColumn("entity", labels.entity_name(F.col("form"), F.col("page_url")))


def observed_values(interactions: DataFrame, keys: list[str]) -> DataFrame:
    value = labels.blank("value")
    own = interactions.filter((F.col("action") == "fill") & (value != ""))
    return own.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("observed_values"))


def entity_tables(found: DataFrame, run_id: str, generator: str) -> dict[str, DataFrame]:
    """``entity``, ``entity_field`` and ``provenance``; every field says what it is derived from."""
    flat = found.select("page_url", "form", "entity", F.explode("fields").alias("f"))
    told = [F.lit("dom").alias("method"), F.lit(1.0).alias("confidence"), F.lit(run_id).alias("run_id"), F.lit(generator).alias("generator")]
    return {
        "entity": found.select("page_url", "form", "entity", F.size("fields").alias("field_count")),
        "entity_field": flat.select("page_url", "form", "f.field", "f.data_type", "f.validation"),
        "provenance": flat.select("page_url", "form", "f.field", F.col("f.path").alias("derived_from"), *told),
    }


def nested_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """Each entity with its fields, and with where it and they are derived from, by name.

    What fields are derived from is told once a name (``sources``), as many fields may share one."""
    keys = ["page_url", "form"]
    sources = tables["provenance"].groupBy(*keys, "field").agg(F.array_sort(F.collect_set("derived_from")).alias("derived_from"))
    sources = sources.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("field", "derived_from"))).alias("sources"))
    fields = tables["entity_field"].groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("field", "data_type", "validation"))).alias("fields"))
    found = tables["entity"].join(fields, keys, "left").join(sources, keys, "left")
    paths = F.array_sort(F.array_distinct(F.flatten(F.transform("sources", lambda x: x["derived_from"]))))
    return found.withColumn("derived_from", paths).orderBy("entity", *keys)


def without_provenance(tables: dict[str, DataFrame]) -> DataFrame:
    """Fields that say no source; has to be empty."""
    return tables["entity_field"].join(tables["provenance"].filter("derived_from is not null"), ["page_url", "form", "field"], "left_anti")


# Findings: (rule, severity, place, detail)


def _finding(df: DataFrame, rule: str, severity: str, place, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), place.alias("place"), detail.alias("detail"))


def _where():
    return F.concat_ws(" — ", "page_url", "path")


def style_conflicts(members: DataFrame) -> DataFrame:
    """Families whose members have two or more backgrounds: their type, how many members, the colours."""
    colors = F.array_sort(F.collect_set(F.nullif("background_color", F.lit("")))).alias("colors")
    found = members.groupBy("family_id").agg(F.min("component_type").alias("component_type"), F.count("*").alias("members"), colors)
    return found.filter(F.size("colors") >= 2)


def naming_conflicts(calls: DataFrame) -> DataFrame:
    """Endpoints that controls of two or more different labels call (endpoint_id, label)."""
    found = calls.filter("coalesce(trim(label), '') <> ''").groupBy("endpoint_id").agg(F.array_sort(F.collect_set(F.trim("label"))).alias("labels"))
    return found.filter(F.size("labels") >= 2)


def semantic_input_types(components: DataFrame) -> DataFrame:
    own = components.filter(F.col("component_type").startswith("text field (text"))
    return own.withColumn("expected", labels.expected_input(F.concat_ws(" ", "name", "placeholder"))).filter("expected is not null")


def usability_findings(styles: DataFrame, names: DataFrame, inputs: DataFrame, unexplained: DataFrame, dead_ends: DataFrame) -> DataFrame:
    """The five rules in one table, by severity, rule and place. Rule names and severities are fixed values."""
    family = F.format_string("%s (%d instances)", "component_type", "members")
    found = _finding(styles, "inconsistent-family-styling", "medium", family, F.array_join("colors", ", "))
    found = found.unionByName(_finding(names, "inconsistent-action-naming", "medium", F.col("endpoint_id"), F.array_join("labels", ", ")))
    found = found.unionByName(_finding(inputs, "missing-semantic-input-type", "medium", _where(), F.col("expected")))
    found = found.unionByName(_finding(unexplained, "unexplained-disabled-control", "low", _where(), F.lit("no text nearby")))
    found = found.unionByName(_finding(dead_ends, "dead-end-screen", "medium", F.col("id"), F.lit("no way on")))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.orderBy(rank, "rule", "place")


# Beginnings of the types that need a name.
NAMED_TYPES = (
    "button", "submit button", "link", "checkbox", "radio button", "toggle switch",
    "tab", "native dropdown (select)", "combobox", "text field",
)


def accessible_name_findings(components: DataFrame) -> DataFrame:
    """Controls of the semantic layer without a name; a placeholder alone is its own rule."""
    kind = F.lower("component_type")
    needs = reduce(Column.__or__, (F.startswith(kind, F.lit(x)) for x in NAMED_TYPES)) & (F.coalesce("layer", F.lit("semantic")) != "pointer")
    own = components.filter(needs & (labels.first_filled("text", "label") == ""))
    held = labels.blank("placeholder") != ""
    return own.select(
        F.when(held, "placeholder-as-only-label").otherwise("missing-accessible-name").alias("rule"),
        F.when(held, "medium").otherwise("high").alias("severity"), _where().alias("place"), F.col("component_type").alias("detail"),
    )


def landmark_findings(landmarks: DataFrame) -> DataFrame:
    """Pages with landmarks but no main one, or with one twice that may be there once."""
    counts = landmarks.groupBy("page_url").agg(F.map_from_entries(F.collect_list(F.struct("landmark", "regions"))).alias("m"))
    n = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    none = _finding(counts.filter(n("main") == 0), "no-main-landmark", "medium", F.col("page_url"), F.lit("main"))
    twice = landmarks.filter(F.col("landmark").isin("banner", "main", "contentinfo") & (F.col("regions") > 1))
    return none.unionByName(_finding(twice, "duplicate-unique-landmark", "low", F.col("page_url"), F.col("landmark")))


# Flows


def move_requests(interactions: DataFrame, requests: DataFrame) -> DataFrame:
    """(from, to, path, event_seq, method, request_path, status, failed): the requests of each move, for ``flow_graph``.

    A request belongs to the interaction of its control, visit and step; that led to the shape of the resulting
    URL, so what one click of a control got stays apart from what the next one got. Interactions outside of visits have none.
    """
    led = interactions.filter("visit_id is not null and visit_id <> ''").select(
        "page_url", "path", "visit_id", F.coalesce("step_seq", F.lit(0)).alias("step_seq"), urls.route_shape(F.coalesce("resulting_url", F.lit(""))).alias("to")
    )
    sent = requests.withColumn("step_seq", F.coalesce("step_seq", F.lit(0)))
    found = sent.join(led.distinct(), ["page_url", "path", "visit_id", "step_seq"])
    return found.select(F.col("page_url").alias("from"), "to", "path", "event_seq", "method", "request_path", "status", "failed")


def flow_graph(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Transitions (from, to, trigger, action) with the outcome of the requests behind them. A
    failure wins over an answer and that over nothing; otherwise the last edge wins."""
    bad = F.coalesce(F.col("failed"), F.lit(False)) | (F.col("status") >= 400)
    rank = F.when(bad, 0).when(F.col("status").isNotNull(), 1).otherwise(2)
    chosen = F.min_by(F.struct("status", F.concat_ws(" ", "method", "request_path").alias("endpoint"), F.coalesce(bad, F.lit(False)).alias("bad")), F.struct(rank, "event_seq"))
    behind = requests.groupBy("from", "to", "path").agg(chosen.alias("r"))
    found = edges.join(behind, ["from", "to", "path"], "left")
    error = F.coalesce(F.col("r.bad"), F.lit(False))
    outcome = F.when(error, "error").when(F.col("r.status").isNotNull(), "ok").otherwise("unknown")
    found = found.withColumn("trigger", labels.trigger_label(F.col("text"), F.col("component_type"), F.col("path"))).withColumn("outcome", outcome)
    best = F.max_by(F.struct("outcome", F.col("r.status").alias("status"), F.col("r.endpoint").alias("endpoint")), F.struct(error, "event_seq"))
    return found.groupBy("from", "to", "trigger", "action").agg(best.alias("b")).select("from", "to", "trigger", "action", "b.*")


def error_branches(flows: DataFrame) -> DataFrame:
    return flows.filter("outcome = 'error'")


def navigation_edge_list(edges: DataFrame) -> DataFrame:
    label = labels.trigger_label(F.col("text"), F.col("component_type"), F.col("path"))
    return edges.select("from", "to", F.substring(label, 1, 40).alias("label"))


def component_tree_leaves(components: DataFrame, texts: DataFrame, regions: DataFrame) -> DataFrame:
    """Component and text leaves of each page, by path.

    components: the ledger (interactions, network_requests, option rows, group_name) with redirect and component_type.
    A component tells its choices, the last value filled in, the outcomes of its requests, where it leads and its
    region; a text has none of them.
    """
    strings = F.array().cast("array<string>")
    filled = F.filter("interactions", lambda x: (x["action"] == "fill") & (F.coalesce(x["value"], F.lit("")) != ""))
    outcome = lambda x: F.when(x["failed"], "FAILED").otherwise(F.coalesce(x["status"].cast("string"), F.lit("?")))
    called = F.transform("network_requests", lambda x: F.concat(x["method"], F.lit(" "), x["request_path"], F.lit(" -> "), outcome(x)))
    a = components.join(regions, ["page_url", "path"], "left").select(
        "page_url", "path", F.lit("component").alias("kind"), F.coalesce(F.nullif(labels.blank("component_type"), F.lit("")), "tag").alias("label"), "text",
        labels.option_choices(F.coalesce("options", F.array().cast("array<struct<path:string,text:string,selected:boolean>>")), F.coalesce("group_name", F.lit(""))).alias("variants"),
        F.get(F.reverse(filled), F.lit(0))["value"].alias("last_value"),
        F.coalesce(called, strings).alias("requests"), "redirect", F.coalesce("region", F.lit("")).alias("region"),
    )
    none = F.lit(None).cast("string")
    b = texts.select(
        "page_url", "path", F.lit("text").alias("kind"), F.col("tag").alias("label"), "text", strings.alias("variants"), none.alias("last_value"),
        strings.alias("requests"), none.alias("redirect"), F.lit("").alias("region"),
    )
    return a.unionByName(b).orderBy("page_url", "kind", "path")


def tree_counts(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("page_url", "region").agg(F.count("*").alias("leaves")).orderBy("page_url", F.col("region") == "", "region")


def families_to_narrate(families: DataFrame, remembered: DataFrame) -> DataFrame:
    """Families (family_id, tag, component_type, texts) with visible text, with the purpose that an
    earlier run found for the same signature, or null."""
    signature = F.sha2(F.to_json(F.struct("tag", "component_type", "texts")), 256)
    own = families.filter(F.size("texts") > 0).withColumn("signature", signature)
    return own.join(remembered.select("signature", "purpose"), "signature", "left")
