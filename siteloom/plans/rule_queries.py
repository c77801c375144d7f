"""Registered queries of rules, contracts, findings, flows and column expressions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import labels, network, urls
from siteloom.operators import fold, graph, reads, rules, similarity
from siteloom.plans import derived as d
from siteloom.plans.fold_queries import ACTS, CALLS, calls, interactions
from siteloom.plans.queries import ENDPOINTS, _containment, _endpoint_requests, query
from siteloom.plans.read_queries import ledger, typed_parts
from siteloom.plans.shared import shared_path, spread
from siteloom.sources import tables


# Controls: parts whose tag, role, type and layer follow from their size.
CONTROLS = """ct AS (SELECT 'page' || (p_partkey % 40) AS page_url, CASE p_partkey % 3 WHEN 0 THEN 'main > p' WHEN 1 THEN 'main > ul > p' ELSE 'p' END || p_partkey AS path, p_partkey AS pos,
    CASE p_size % 6 WHEN 0 THEN 'input' WHEN 1 THEN 'BUTTON' WHEN 2 THEN 'a' WHEN 3 THEN 'select' WHEN 4 THEN 'div' ELSE 'textarea' END AS tag,
    CASE p_partkey % 10 WHEN 0 THEN 'option' WHEN 1 THEN 'combobox' WHEN 2 THEN 'radio' WHEN 3 THEN 'switch' WHEN 4 THEN 'tab' ELSE '' END AS role,
    CASE p_partkey % 7 WHEN 0 THEN 'submit' WHEN 1 THEN 'email' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'date' ELSE '' END AS input_type, CASE WHEN p_partkey % 11 = 0 THEN 'pointer' ELSE 'semantic' END AS layer,
    CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN (p_size || ',50') ELSE p_name END AS text, CASE WHEN p_partkey % 8 = 0 THEN 'Type here' ELSE '' END AS placeholder, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS label,
    CASE WHEN p_partkey % 6 = 0 THEN 'correo' WHEN p_partkey % 6 = 1 THEN 'fecha_' || (p_partkey % 9) ELSE 'n' || (p_partkey % 9) END AS name,
    CASE WHEN p_partkey % 2 = 0 THEN 'form#f' || (p_partkey % 5) ELSE 'main > form' END AS form, p_partkey % 3 = 0 AS required FROM part),
tt AS (SELECT *, CASE WHEN role = 'option' THEN 'list/menu option' WHEN role = 'combobox' THEN 'combobox (searchable dropdown)' WHEN input_type = 'checkbox' THEN 'checkbox' WHEN role = 'radio' THEN 'radio button'
    WHEN role = 'switch' THEN 'toggle switch' WHEN role = 'tab' THEN 'tab' WHEN tag = 'select' THEN 'native dropdown (select)' WHEN tag IN ('input', 'textarea') THEN 'text field (' || coalesce(nullif(input_type, ''), 'text') || ')'
    WHEN tag = 'BUTTON' AND input_type = 'submit' THEN 'submit button' WHEN tag = 'BUTTON' THEN 'button' WHEN tag = 'a' THEN 'link' WHEN layer = 'pointer' THEN 'custom control (component-library element, no native tag/role)' ELSE 'element' END AS component_type FROM ct)"""


def _pick(key, *values, other=""):
    found = F.lit(other)
    for k, v in reversed(list(enumerate(values))):
        found = F.when(key == k, v).otherwise(found)
    return found


def controls(spark, sf_dir):
    p, key, size = d.read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    named = lambda prefix, n: F.concat(F.lit(prefix), (key % n).cast("string"))
    rows = p.select(
        named("page", 40).alias("page_url"), F.concat(_pick(key % 3, "main > p", "main > ul > p", other="p"), key.cast("string")).alias("path"), key.alias("pos"),
        _pick(size % 6, "input", "BUTTON", "a", "select", "div", other="textarea").alias("tag"), _pick(key % 10, "option", "combobox", "radio", "switch", "tab").alias("role"),
        _pick(key % 7, "submit", "email", "checkbox", "date").alias("input_type"), F.when(key % 11 == 0, "pointer").otherwise("semantic").alias("layer"),
        F.when(key % 4 == 0, "").when(key % 13 == 0, F.concat(size.cast("string"), F.lit(",50"))).otherwise(F.col("p_name")).alias("text"), F.when(key % 8 == 0, "Type here").otherwise("").alias("placeholder"),
        F.when(key % 5 == 0, F.col("p_brand")).otherwise("").alias("label"), F.when(key % 6 == 0, "correo").when(key % 6 == 1, named("fecha_", 9)).otherwise(named("n", 9)).alias("name"),
        F.when(key % 2 == 0, named("form#f", 5)).otherwise("main > form").alias("form"), (key % 3 == 0).alias("required"),
    )
    kind = labels.component_type(*(F.col(x) for x in ("tag", "role", "input_type", "layer")))
    return rows.withColumn("component_type", kind)


NAMES = "CASE component_type WHEN 'combobox (searchable dropdown)' THEN 'Combobox' WHEN 'native dropdown (select)' THEN 'NativeDropdownSelect' WHEN 'list/menu option' THEN 'ListMenuOption' WHEN 'custom control (component-library element, no native tag/role)' THEN 'CustomControl' WHEN 'text field (text)' THEN 'TextFieldText' WHEN 'text field (email)' THEN 'TextFieldEmail' WHEN 'text field (date)' THEN 'TextFieldDate' WHEN 'text field (submit)' THEN 'TextFieldSubmit' WHEN 'radio button' THEN 'RadioButton' WHEN 'toggle switch' THEN 'ToggleSwitch' WHEN 'submit button' THEN 'SubmitButton' ELSE upper(component_type[1]) || component_type[2:] END"


@query(f"""WITH {CONTROLS} SELECT pos, component_type, {NAMES} AS component_name, CASE WHEN path LIKE '% > %' THEN regexp_replace(path, ' > [^>]*$', '') ELSE '' END AS parent_path,
    regexp_matches(trim(text), '^[0-9.,+ -]*[0-9][0-9.,+ -]*$') AS looks_numeric, coalesce(nullif(trim(text), ''), component_type) AS trigger_label,
    CASE input_type WHEN 'checkbox' THEN 'boolean' WHEN 'date' THEN 'date' WHEN 'email' THEN 'email' ELSE 'string' END AS data_type,
    concat_ws(', ', CASE WHEN input_type NOT IN ('', 'text') THEN 'type=' || input_type END, CASE WHEN required THEN 'required' END) AS validation,
    CASE WHEN form LIKE 'form#%' THEN substr(form, 6) ELSE page_url || ' form' END AS entity_name, CASE WHEN name = 'correo' THEN 'email' WHEN name LIKE 'fecha%' THEN 'date' END AS expected_input,
    tag IN ('textarea') OR tag = 'input' AND input_type IN ('', 'email') AS is_fillable, concat_ws('|', tag, role, name, form, text) AS identity FROM tt""")
def control_labels(spark, sf_dir):
    c = F.col
    return controls(spark, sf_dir).select(
        "pos", "component_type", labels.component_name(c("component_type")).alias("component_name"), labels.parent_path(c("path")).alias("parent_path"), labels.looks_numeric(c("text")).alias("looks_numeric"),
        labels.trigger_label(c("text"), c("component_type"), c("path")).alias("trigger_label"), labels.data_type(c("input_type")).alias("data_type"), labels.validation(c("input_type"), c("required")).alias("validation"),
        labels.entity_name(c("form"), c("page_url")).alias("entity_name"), labels.expected_input(c("name")).alias("expected_input"), labels.is_fillable(c("tag"), c("input_type")).alias("is_fillable"),
        F.concat_ws("|", labels.identity()["tag"], *(labels.identity()[x] for x in ("role", "name", "form", "text"))).alias("identity"),
    )


@query(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', '', 'g'), E' \t\n\r') AS folded, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]', '', 'g') AS match_key FROM documents WHERE text IS NOT NULL""")
def folded_texts(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", labels.fold_accents(F.col("text")).alias("folded"), labels.match_key(F.col("text")).alias("match_key"))


# Texts with an address, a card number and a long token, and bodies and headers with secrets, made of each order.
@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey % 3000 ELSE o_orderkey % 40 END AS n FROM orders),
    g AS (SELECT *, '{"user": {"name": "old", "password":"x' || c || '", "name": "n' || c || '"}, "list":[{"apiKey": [1]}, "a@b.co", ' || k || '], "empty": {}}' AS given,
        '{"user": {"name": "n' || c || '", "password": "[REDACTED]"}, "list": [{"apiKey": "[REDACTED]"}, "[REDACTED]", ' || k || '], "empty": {}}' AS body FROM o)
    SELECT k, 'mail [REDACTED], card [REDACTED], token [REDACTED] of ' || p AS text,
           body,
           '{"user": {"name": "string", "password": "string"}, "list": [{"apiKey": ["number"]}], "empty": {}}' AS shape,
           CASE WHEN k % 2 = 0 THEN '[REDACTED]' ELSE 'x [REDACTED]' END AS header,
           CASE WHEN k % 4 = 1 THEN strlen(given) ELSE 5 * n END AS length, CASE WHEN k % 4 = 1 THEN strlen(body) ELSE least(5 * n, 8192) END AS excerpt,
           CASE WHEN k % 4 = 1 THEN sha256(body) WHEN n = 0 THEN '' ELSE sha256(repeat('word ', n::INT)) END AS digest,
           CASE WHEN k % 3 = 0 THEN NULL ELSE c END AS latency FROM g""")
def redacted_orders(spark, sf_dir):
    o, key, cust = d.read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("mail a"), cust, F.lit("@x.org, card 4111 1111 1111 1"), F.lpad(cust, 3, "0").substr(1, 3), F.lit(", token "), F.md5(cust), F.lit(" of "), "o_orderpriority")
    body = F.concat(F.lit('{"user": {"name": "old", "password":"x'), cust, F.lit('", "name": "n'), cust, F.lit('"}, "list":[{"apiKey": [1]}, "a@b.co", '), key.cast("string"), F.lit('], "empty": {}}'))
    headers = F.create_map(F.when(key % 2 == 0, "Authorization").otherwise("X-Info"), F.concat(F.lit("x a"), cust, F.lit("@x.org")))
    words = F.repeat(F.lit("word "), F.when(key % 40 == 0, key % 3000).otherwise(key % 40).cast("int"))
    capped = network.truncate_and_hash(F.when(key % 4 == 1, body).otherwise(words))
    start = F.lit(2.0)
    answered = F.when(key % 3 == 0, F.lit(1.0)).otherwise(start + F.col("o_custkey") / 1000)
    return o.select(
        key.alias("k"), network.redact_text(text).alias("text"), network.redact_body(body).alias("body"), network.json_shape(body).alias("shape"), F.map_values(network.redact_headers(headers))[0].alias("header"),
        capped["length"].alias("length"), F.char_length(capped["excerpt"]).cast("long").alias("excerpt"), capped["hash"].alias("digest"), network.latency_ms(start, answered).alias("latency"),
    )


@query("""WITH u AS (SELECT o_orderkey AS k, 'https://api' || (o_custkey % 5) || '.example.com' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/v1/o' || o_orderkey END AS b, o_orderkey % 4 AS q FROM orders)
    SELECT k, regexp_extract(b, 'https://([^/]*)', 1) AS host, CASE WHEN k % 3 = 0 THEN '/' ELSE '/v1/o' || k END AS path, CASE q WHEN 0 THEN [] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['x y'] ELSE ['b'] END AS names FROM u""")
def request_urls(spark, sf_dir):
    o, key = d.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("/v1/o"), key.cast("string")))
    url = F.concat(F.lit("https://api"), (F.col("o_custkey") % 5).cast("string"), F.lit(".example.com"), path, _pick(key % 4, "", "?b=2&a=1&a=3&c=", "?x%20y=1#f", other="?b=1#?z=3"))
    return o.select(key.alias("k"), urls.request_host(url).alias("host"), urls.request_path(url).alias("path"), urls.query_names(url).alias("names"))


@query("""SELECT DISTINCT 'header:x-' || lower(replace(p_brand, '#', '-')) || CASE WHEN p_size % 2 = 0 THEN '-api-key' ELSE '-auth-token' END AS scheme FROM part""")
def key_headers(spark, sf_dir):
    name = F.concat(F.lit("X-"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.when(F.col("p_size") % 2 == 0, "-Api-Key").otherwise("-Auth-Token"))
    return d.read(spark, sf_dir, "part").select(network.auth_scheme(F.create_map(name, F.lit("v"))).alias("scheme")).distinct()


@query("""WITH s AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'cookie' WHEN 1 THEN 'bearer' WHEN 2 THEN 'header:x-api-key' ELSE 'header:' || lower(replace(p_brand, '#', '-')) END AS scheme FROM part)
    SELECT scheme, CASE WHEN scheme = 'cookie' THEN 'sessionCookie' WHEN scheme = 'bearer' THEN 'bearerAuth' WHEN scheme = 'header:x-api-key' THEN 'xApiKey' ELSE replace(replace(scheme, 'header:', ''), '-', '') || 'Key' END AS name,
           CASE WHEN scheme = 'bearer' THEN 'http' ELSE 'apiKey' END AS type, CASE WHEN scheme = 'cookie' THEN 'cookie' WHEN scheme <> 'bearer' THEN 'header' END AS place, CASE WHEN scheme = 'cookie' THEN 'session' ELSE replace(scheme, 'header:', '') END AS parameter FROM s""")
def security_schemes(spark, sf_dir):
    brand = F.concat(F.lit("header:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    schemes = d.read(spark, sf_dir, "part").select(_pick(F.col("p_size") % 4, "cookie", "bearer", "header:x-api-key", other="x").alias("s"), brand.alias("b")).select(F.when(F.col("s") == "x", F.col("b")).otherwise(F.col("s")).alias("scheme")).distinct()
    return schemes.select("scheme", labels.security_scheme(F.col("scheme")).alias("x")).select("scheme", "x.*")


# Groups of controls


@query(f"""WITH {CONTROLS} SELECT page_url, name, list(path ORDER BY pos) AS members FROM tt WHERE role = 'radio' OR input_type = 'checkbox' GROUP BY ALL HAVING count(*) >= 2""")
def choice_sets(spark, sf_dir):
    return rules.choice_sets(controls(spark, sf_dir), ["page_url"]).select("page_url", "name", F.transform("members", lambda x: x["path"]).alias("members"))


@query(f"""WITH {CONTROLS}, x AS (SELECT *, CASE WHEN path LIKE '% > %' THEN regexp_replace(path, ' > [^>]*$', '') ELSE '' END AS parent FROM tt WHERE role = 'option')
    SELECT page_url, parent, list(path ORDER BY pos) AS members FROM x WHERE parent <> '' GROUP BY ALL HAVING count(*) >= 2""")
def option_families(spark, sf_dir):
    return rules.option_families(controls(spark, sf_dir), ["page_url"]).select("page_url", "parent", F.transform("members", lambda x: x["path"]).alias("members"))


@query("""WITH x AS (SELECT c_nationkey AS page_url, 'box' || (c_custkey % 3) AS container, c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN '+' WHEN 1 THEN 'Menos' WHEN 2 THEN ' ' || (c_custkey % 10) || ' ' ELSE 'text' END AS t FROM customer)
    SELECT page_url, container, container || ' > c' || min(pos) FILTER (t = '+') AS increment_path, container || ' > c' || min(pos) FILTER (t = 'Menos') AS decrement_path,
           container || ' > c' || min(pos) FILTER (t LIKE ' %') AS value_path, arg_min(t, pos) FILTER (t LIKE ' %') AS current_value FROM x GROUP BY page_url, container HAVING bool_or(t = '+') AND bool_or(t = 'Menos')""")
def steppers(spark, sf_dir):
    c, key = d.read(spark, sf_dir, "customer"), F.col("c_custkey")
    text = F.when(key % 4 == 2, F.concat(F.lit(" "), (key % 10).cast("string"), F.lit(" "))).otherwise(_pick(key % 4, "+", "Menos", other="text"))
    path = F.concat(F.lit("box"), (key % 3).cast("string"), F.lit(" > c"), key.cast("string"))
    return rules.steppers(c.select(F.col("c_nationkey").alias("page_url"), path.alias("path"), text.alias("text"), key.alias("pos")), ["page_url"])


# Containers and landmarks


@query("""SELECT c_mktsegment AS page_url, CASE WHEN n_nationkey % 2 = 0 THEN 'nav' ELSE 'main' END AS landmark, count(DISTINCT n_nationkey) AS regions FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def page_landmarks(spark, sf_dir):
    return rules.page_landmarks(*_landmarks(spark, sf_dir))


def _landmarks(spark, sf_dir):
    contains, comps = _containment(spark, sf_dir)
    page = d.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("page_url"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "nav").otherwise("main")
    marks = d.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("container"), kind.alias("landmark"))
    return graph.ancestors(contains, comps).join(page, "id"), marks


@query("""WITH l AS (SELECT 'page' || c_nationkey AS page_url, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 4 > 0 THEN 'main' WHEN c_custkey % 3 = 1 THEN 'banner' ELSE 'navigation' END AS landmark, count(DISTINCT c_mktsegment) AS regions FROM customer GROUP BY ALL)
    SELECT 'no-main-landmark' AS rule, 'medium' AS severity, page_url AS place, 'main' AS detail FROM l GROUP BY page_url HAVING count(*) FILTER (landmark = 'main') = 0 UNION ALL SELECT 'duplicate-unique-landmark', 'low', page_url, landmark FROM l WHERE landmark IN ('main', 'banner') AND regions > 1""")
def landmark_findings(spark, sf_dir):
    """One nation in four has no main landmark."""
    c, key = d.read(spark, sf_dir, "customer"), F.col("c_custkey")
    mark = F.when((key % 3 == 0) & (F.col("c_nationkey") % 4 > 0), "main").when(key % 3 == 1, "banner").otherwise("navigation")
    marks = c.groupBy(F.concat(F.lit("page"), F.col("c_nationkey").cast("string")).alias("page_url"), mark.alias("landmark")).agg(F.countDistinct("c_mktsegment").alias("regions"))
    return rules.landmark_findings(marks)


@query(f"""WITH {CONTROLS} SELECT CASE WHEN placeholder <> '' THEN 'placeholder-as-only-label' ELSE 'missing-accessible-name' END AS rule, CASE WHEN placeholder <> '' THEN 'medium' ELSE 'high' END AS severity,
    page_url || ' — ' || path AS place, component_type AS detail FROM tt
    WHERE layer <> 'pointer' AND component_type NOT IN ('element', 'list/menu option') AND component_type NOT LIKE 'custom%' AND trim(text) = '' AND label = ''""")
def name_findings(spark, sf_dir):
    return rules.accessible_name_findings(controls(spark, sf_dir))


@query(f"""WITH {CONTROLS}, {d.PARTS}, {d.TREE}, sf AS (SELECT component_type || ' (' || count(*) || ' instances)' AS f, array_to_string(list_sort(list(DISTINCT background_color)), ', ') AS c FROM pc GROUP BY component_type HAVING count(DISTINCT background_color) > 1),
    nf AS (SELECT o_orderpriority AS e, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ', ') AS l FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1),
    inp AS (SELECT page_url || ' — ' || path AS place, CASE WHEN name = 'correo' THEN 'email' ELSE 'date' END AS e FROM tt WHERE component_type = 'text field (text)' AND (name = 'correo' OR name LIKE 'fecha%')),
    t AS (SELECT 'page' || (s_suppkey % 40) AS page_url, (s_suppkey % 50)::DOUBLE AS x, abs(s_acctbal) AS y FROM supplier),
    dis AS (SELECT page_url || ' — ' || path AS place FROM pc WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_url = pc.page_url AND abs(t.x - pc.x) <= 120 AND abs(t.y - pc.y) <= 120))
    SELECT 'inconsistent-family-styling' AS rule, 'medium' AS severity, f AS place, c AS detail FROM sf UNION ALL SELECT 'inconsistent-action-naming', 'medium', e, l FROM nf UNION ALL SELECT 'missing-semantic-input-type', 'medium', place, e FROM inp
    UNION ALL SELECT 'unexplained-disabled-control', 'low', place, 'no text nearby' FROM dis UNION ALL SELECT DISTINCT 'dead-end-screen', 'medium', dst, 'no way on' FROM tr WHERE dst NOT IN (SELECT src FROM tr)""")
def usability_findings(spark, sf_dir):
    from siteloom.plans.queries import QUERIES

    own = d.part_components(spark, sf_dir).withColumn("family_id", F.col("component_type"))
    styles, names = rules.style_conflicts(own), QUERIES["naming_conflicts"](spark, sf_dir)
    inputs = rules.semantic_input_types(controls(spark, sf_dir))
    return rules.usability_findings(styles, names, inputs, QUERIES["band_anti_join"](spark, sf_dir), graph.dead_ends(d.tree_edges(spark, sf_dir)))


# Entities


ENTITY = CONTROLS + """, ef AS (SELECT page_url, form, coalesce(nullif(trim(name), ''), nullif(trim(label), ''), placeholder) AS field, path,
    CASE input_type WHEN 'checkbox' THEN 'boolean' WHEN 'date' THEN 'date' WHEN 'email' THEN 'email' ELSE 'string' END AS data_type, CASE WHEN form LIKE 'form#%' THEN substr(form, 6) ELSE page_url || ' form' END AS entity
    FROM tt WHERE regexp_matches(component_type, '^(text field|checkbox|radio|combobox|dropdown|select|textarea)'))"""


@query(f"""WITH {ENTITY} SELECT page_url, form, any_value(entity) AS entity, count(*) AS fields, list(field ORDER BY field, data_type) AS names FROM ef GROUP BY ALL""")
def entities(spark, sf_dir):
    found = rules.entities(controls(spark, sf_dir))
    return found.select("page_url", "form", "entity", F.size("fields").cast("long").alias("fields"), F.transform("fields", lambda x: x["field"]).alias("names"))


@query(f"""WITH {ENTITY} SELECT page_url, form, field, path AS derived_from, 'dom' AS method, 1.0::DOUBLE AS confidence, 'run1' AS run_id, 'rules' AS generator FROM ef""")
def provenance(spark, sf_dir):
    parts = rules.entity_tables(rules.entities(controls(spark, sf_dir)), "run1", "rules")
    return parts["provenance"].unionByName(rules.without_provenance(parts).select("page_url", "form", "field", *(F.lit(None).alias(x) for x in ("derived_from", "method")), F.lit(0.0).alias("confidence"), F.lit("").alias("run_id"), F.lit("").alias("generator")))


@query(f"""WITH {ENTITY}, f AS (SELECT page_url, form, entity, field, list_sort(list(DISTINCT path)) AS paths, data_type, count(*) AS n FROM ef GROUP BY ALL), p AS (SELECT page_url, form, list_sort(list(DISTINCT path)) AS derived_from FROM ef GROUP BY ALL)
    SELECT e.page_url, e.form, any_value(e.entity) AS entity, list(e.field ORDER BY e.field) AS fields, any_value(p.derived_from) AS derived_from FROM ef e JOIN p ON p.page_url = e.page_url AND p.form = e.form GROUP BY e.page_url, e.form""")
def nested_entities(spark, sf_dir):
    parts = rules.entity_tables(rules.entities(controls(spark, sf_dir)), "run1", "rules")
    return rules.nested_entities(parts).select("page_url", "form", "entity", F.transform("fields", lambda x: x["field"]).alias("fields"), "derived_from")


# Contracts


@query(f"""WITH {ENDPOINTS}, c AS (SELECT DISTINCT endpoint_id, page_url, path FROM er WHERE is_first_party AND path IS NOT NULL), l AS (SELECT DISTINCT endpoint_id, page_url FROM er WHERE is_first_party AND path IS NULL)
    SELECT endpoint_id, min(latency_ms) || '-' || max(latency_ms) AS latency, (SELECT array_to_string(list(c.page_url || c.path ORDER BY c.page_url, c.path)[:5], ',') FROM c WHERE c.endpoint_id = er.endpoint_id) AS callers,
           (SELECT list(l.page_url ORDER BY l.page_url)[:5] FROM l WHERE l.endpoint_id = er.endpoint_id) AS pages FROM er WHERE is_first_party GROUP BY endpoint_id""")
def observed_from(spark, sf_dir):
    found = rules.observed_from(rules.inferred_requests(_endpoint_requests(spark, sf_dir)))
    return found.select("endpoint_id", "latency", F.array_join(F.transform("callers", lambda x: F.concat(x["page_url"], x["path"])), ",").alias("callers"), "pages")


@query(f"WITH {ENDPOINTS} SELECT endpoint_id, latency_ms, count(*) AS calls FROM er WHERE is_first_party GROUP BY ALL")
def endpoint_latencies(spark, sf_dir):
    return rules.endpoint_latencies(_endpoint_requests(spark, sf_dir))


@query(f"""WITH {ENDPOINTS} SELECT endpoint_id, status, CASE WHEN (SELECT bool_or(auth_scheme <> '') FROM er x WHERE x.endpoint_id = er.endpoint_id) THEN 'bearerAuth' ELSE '' END AS security FROM er WHERE is_first_party GROUP BY ALL""")
def api_responses(spark, sf_dir):
    return rules.api_responses(rules.inferred_requests(_endpoint_requests(spark, sf_dir)))


# Bodies of each order's priority: keys that some lack, named after the order, on the first level, in lists and five levels deep.
@query("""WITH o AS (SELECT o_orderpriority AS endpoint_id, o_orderkey % 3 = 0 AS noted, 's' || o_orderstatus AS s, 'x' || (o_custkey % 7) AS x, 'f' || (o_orderkey % 5) AS f FROM orders),
    r AS (SELECT o.endpoint_id, t.json_path, t.type FROM o, (VALUES ('$.n', 'number'), ('$.l', 'array'), ('$.l[]', 'object'), ('$.m', 'array'), ('$.m[]', 'array'), ('$.m[][]', 'object'), ('$.a', 'object'), ('$.a.b', 'object'), ('$.a.b.c', 'object'), ('$.a.b.c.d', 'object'), ('$.a.b.c.d.e', 'object')) t(json_path, type)
        UNION ALL SELECT endpoint_id, '$.note', 'string' FROM o WHERE noted UNION ALL SELECT endpoint_id, '$.l[].' || s, 'string' FROM o UNION ALL SELECT endpoint_id, '$.m[][].' || x, 'boolean' FROM o UNION ALL SELECT endpoint_id, '$.a.b.c.d.e.' || f, 'number' FROM o),
    n AS (SELECT endpoint_id, count(*) AS n FROM o GROUP BY 1)
    SELECT endpoint_id, json_path, type, count(*) = any_value(n) AS required FROM r JOIN n USING (endpoint_id) GROUP BY ALL""")
def contract_fields(spark, sf_dir):
    return rules.contract_fields(_shapes(spark, sf_dir), ["endpoint_id"])


def _shapes(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    note = F.when(F.col("o_orderkey") % 3 == 0, ', "note": "t"').otherwise("")
    body = F.concat(F.lit('{"n": '), key, note, F.lit(', "l": [{"s'), "o_orderstatus", F.lit('": "v"}, {"other": 1}], "m": [[{"x'), (F.col("o_custkey") % 7).cast("string"), F.lit('": true}]], "a": {"b": {"c": {"d": {"e": {"f'), (F.col("o_orderkey") % 5).cast("string"), F.lit('": '), key, F.lit("}}}}}}"))
    orders = spread(d.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", rows=20_000)
    return orders.select(F.col("o_orderpriority").alias("endpoint_id"), network.json_shape(body).alias("shape"))


@query("""WITH k AS (SELECT c_nationkey AS endpoint_id, list_sort(list(DISTINCT c_mktsegment)) AS f FROM customer GROUP BY 1) SELECT endpoint_id, count(*) OVER (PARTITION BY f) AS uses FROM k""")
def shared_schemas(spark, sf_dir):
    fields = d.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("endpoint_id"), F.col("c_mktsegment").alias("json_path"), F.lit("string").alias("type"), F.lit(True).alias("required")).distinct()
    return rules.shared_schemas(fields, ["endpoint_id"]).select("endpoint_id", "uses")


@query(f"""WITH {d.EVENTS}, t AS (SELECT user_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'string' ELSE 'number' END AS type FROM ev GROUP BY ALL), n AS (SELECT user_id % 7 AS g, count(DISTINCT user_id) AS n FROM ev GROUP BY 1)
    SELECT user_id % 7 AS g, event_type AS key, min(type) AS type, count(*) = any_value(n) AS required FROM t JOIN n ON n.g = user_id % 7 GROUP BY 1, 2""")
def merged_object_shapes(spark, sf_dir):
    """One shape a user with a key for each kind of event, merged by groups of users."""
    ev = d.event_rows(spark, sf_dir)
    kind = F.when(F.col("user_id") % 2 == 0, "string").otherwise("number")
    own = ev.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct(F.col("event_type"), kind)))).alias("shape"))
    return rules.merge_shapes(own.withColumn("g", F.col("user_id") % 7), ["g"])


# Catalogue


@query(f"""WITH {d.PARTS}, m AS (SELECT component_type AS family_id, page_url, pos % 3 AS region, pos FROM pc), f AS (SELECT family_id, list_sort(list(DISTINCT page_url)) AS used_on, ['r1', 'r2'] AS regions, count(*) AS members,
    bool_and(pos % 2 = 0 OR family_id < 'M') AS in_form, bool_or(pos % 5 = 0) AS disabled_observed FROM m GROUP BY 1)
    SELECT family_id, used_on, regions, members, CASE WHEN family_id < 'C' THEN '' WHEN in_form THEN 'atom (in a form)' ELSE 'atom' END AS level, disabled_observed, 'Button' || CASE WHEN row_number() OVER (ORDER BY members DESC, family_id) > 1 THEN (row_number() OVER (ORDER BY members DESC, family_id))::VARCHAR ELSE '' END AS name FROM f""")
def catalog_entries(spark, sf_dir):
    return rules.catalog_entries(_catalogue_members(spark, sf_dir)).select("family_id", "used_on", "regions", "members", "level", "disabled_observed", "name")


def _catalogue_members(spark, sf_dir):
    own = d.part_components(spark, sf_dir).withColumn("family_id", F.col("component_type"))
    form = F.when((F.col("pos") % 2 == 0) | (F.col("family_id") < "M"), "form").otherwise("")
    region = F.when(F.col("pos") % 3 > 0, F.concat(F.lit("r"), (F.col("pos") % 3).cast("string"))).otherwise("")
    own = own.withColumn("tag", F.when(F.col("family_id") < "C", "div").otherwise("button")).withColumn("region", region)
    return own.withColumn("component_type", F.lit("button")).withColumn("form", form).withColumn("disabled", F.col("pos") % 5 == 0)


@query(f"""WITH {d.PARTS}, v AS (SELECT component_type AS family_id, count(*) AS members,
    count(*) FILTER (pos % 2 = 0 OR component_type < 'M') AS formed, count(*) FILTER (pos % 5 = 0) AS disabled FROM pc GROUP BY 1)
    SELECT family_id, members, list_filter([CASE WHEN disabled > 0 THEN 'disabled:' || disabled || ':' || CASE WHEN disabled < members THEN 'varies' ELSE 'same' END END,
        CASE WHEN formed > 0 THEN 'form:' || formed || ':' || CASE WHEN formed < members THEN 'varies' ELSE 'same' END END], lambda x: x IS NOT NULL) AS props FROM v""")
def catalogue_file(spark, sf_dir):
    """The catalogue with properties and variants, written as JSON and read again."""
    own = _catalogue_members(spark, sf_dir)
    tokens = F.array_sort(F.array_distinct(F.filter(F.split("css_class", " "), lambda x: x != "")))
    own = own.withColumn("tokens", tokens)
    data = tables.catalogue_data(rules.catalog_entries(own), rules.catalog_props(own, ("form", "disabled")), rules.catalog_variants(own, similarity.common_classes(own)))
    path = shared_path(spark, "catalogue")
    tables.write_json(data, path)
    kept = spark.read.schema("family_id string, members long, props array<struct<prop:string,present:long,varies:boolean>>, variants array<struct<count:long>>").json(path)
    told = F.transform("props", lambda x: F.concat_ws(":", x["prop"], x["present"].cast("string"), F.when(x["varies"], "varies").otherwise("same")))
    return kept.filter(F.aggregate("variants", F.lit(0).cast("long"), lambda a, x: a + x["count"]) == F.col("members")).select("family_id", "members", told.alias("props"))


TYPE_USES = """tu AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'large' WHEN p_size % 11 = 0 THEN '' ELSE p_size || 'px' END AS font_size, CASE WHEN p_partkey % 2 = 0 THEN '400' ELSE '700' END AS font_weight FROM part)"""


@query(f"""WITH {TYPE_USES} SELECT 'type' AS kind, 'type-' || row_number() OVER (ORDER BY coalesce(try_cast(replace(font_size, 'px', '') AS DOUBLE), -1) DESC, font_weight, font_size) AS name,
        font_size || ' ' || font_weight AS value, count(*) AS uses FROM tu WHERE font_size <> '' GROUP BY font_size, font_weight
    UNION ALL SELECT 'color', 'text-' || row_number() OVER (ORDER BY count(*) DESC, p_size), format('#{{:02x}}0102', p_size), count(*) FROM part GROUP BY p_size
    UNION ALL SELECT 'state', 'hover:color', p_brand, count(*) FROM part GROUP BY p_brand""")
def token_file(spark, sf_dir):
    """Design tokens of three kinds, written as JSON and read again."""
    p = d.read(spark, sf_dir, "part")
    alone = lambda usage: usage.withColumn("leader", F.expr("r * 65536 + g * 256 + b"))
    colours = rules.color_tokens(p.select(F.format_string("rgb(%d, 1, 2)", F.col("p_size").cast("int")).alias("color"), F.lit("none").alias("background_color")), alone)
    states = rules.state_tokens(p.select(F.lit("hover").alias("state"), F.lit("color").alias("property"), F.col("p_brand").alias("value")))
    path = shared_path(spark, "tokens")
    tables.write_json(tables.token_data(colours, rules.type_tokens(typed_parts(spark, sf_dir)), states), path)
    return spark.read.schema("kind string, name string, value string, uses long").json(path)


@query(f"""WITH RECURSIVE {d.LAB_COLORS}, h AS (SELECT *, format('#{{:02x}}{{:02x}}{{:02x}}', r, g, b) AS value FROM led)
    SELECT l.role, l.role || '-' || row_number() OVER (PARTITION BY l.role ORDER BY l.i) AS name, l.value, sum(h.uses)::BIGINT AS uses, coalesce(list_sort(list(h.value) FILTER (h.i <> l.i)), []) AS merged
    FROM h l JOIN h ON h.role = l.role AND h.lead = l.i WHERE l.lead = l.i GROUP BY l.role, l.i, l.value""")
def color_tokens(spark, sf_dir):
    own = d.part_components(spark, sf_dir).withColumn("color", F.format_string("rgb(1, 2, %d)", F.col("pos") % 9 * 3))
    return rules.color_tokens(own, similarity.color_clusters)


# Graph and flows


# From the page of one region: its nations, their customers and their orders; all other pages can't be reached.
@query(f"""WITH {d.TREE}, p AS (SELECT src AS id FROM tr UNION SELECT dst FROM tr), a AS (SELECT dst AS id FROM tr WHERE src = 'r1'), b AS (SELECT dst AS id FROM tr JOIN a ON a.id = src), c AS (SELECT dst AS id FROM tr JOIN b ON b.id = src),
    x AS (SELECT 'r1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b UNION ALL SELECT id, 3 FROM c) SELECT depth AS click_depth, count(*) AS pages FROM p LEFT JOIN x USING (id) GROUP BY 1""")
def depth_histogram(spark, sf_dir):
    depths = graph.click_depth(d.tree_edges(spark, sf_dir), "r1")
    return rules.depth_histogram(depths.withColumnRenamed("depth", "click_depth"))


@query(f"""WITH {d.TREE}, x AS (SELECT src AS url, count(*) AS n FROM tr GROUP BY 1) SELECT left(url, 1) AS label, url FROM x WHERE n > 15""")
def bottlenecks(spark, sf_dir):
    m = d.tree_edges(spark, sf_dir).groupBy(F.col("src").alias("url")).agg(F.count("*").alias("click_depth"))
    m = m.select("url", "click_depth", F.lit(1).alias("module_id"), F.left("url", F.lit(1)).alias("module_label"), (F.col("click_depth") > 15).alias("is_articulation_point"))
    return rules.bottlenecks(rules.summarize_modules(m))


# Each nation's customers link to it, so all measures of the stars are known.
@query("""WITH c AS (SELECT 'h.org/n' || c_nationkey AS hub, 'h.org/n' || c_nationkey || '/c' || c_custkey AS id, 'N' || c_nationkey AS label FROM customer), n AS (SELECT hub, label, count(*) AS n FROM c GROUP BY ALL)
    SELECT hub AS id, 0 AS in_degree, n AS out_degree, CASE WHEN label = 'N1' THEN 0 END AS depth, 0.0::DOUBLE AS betweenness, n > 1 AS is_articulation_point, label AS module_label FROM n
    UNION ALL SELECT id, 1, 0, CASE WHEN label = 'N1' THEN 1 END, 0.0, false, label FROM c""")
def graph_projection(spark, sf_dir):
    """All measures of the pages of each nation, and the label of their module, the path they have in common."""
    hub = F.concat(F.lit("h.org/"), "src")
    edges = d.star_edges(spark, sf_dir).select(hub.alias("src"), F.concat(hub, F.lit("/"), "dst").alias("dst"))
    found = graph.graph_bundle(edges, "h.org/n1")["pages"]
    return found.select("id", "in_degree", "out_degree", "depth", "betweenness", "is_articulation_point", "module_label")


FLOWS = CALLS + """, ed AS (SELECT 'p' || (o_custkey % 9) AS src, 'q' || (o_custkey % 4) AS dst, 'c' || (o_custkey % 5) AS path, o_orderpriority AS text, 'CLICK' AS action, event_seq AS k, event_seq % 2 = 0 AS edge,
    method || ' /' || CASE status WHEN 200 THEN 'F' WHEN 404 THEN 'O' ELSE 'P' END AS endpoint, status, event_seq % 50 = 0 OR status >= 400 AS bad FROM cl),
rk AS (SELECT src, dst, path, arg_min(struct_pack(status := status, endpoint := endpoint, bad := bad), struct_pack(r := CASE WHEN bad THEN 0 ELSE 1 END, k := k)) AS r FROM ed WHERE NOT edge GROUP BY ALL),
fl AS (SELECT e.src, e.dst, e.text AS trigger, e.action, e.k, coalesce(r.bad, false) AS err, CASE WHEN r.bad THEN 'error' WHEN r.status IS NOT NULL THEN 'ok' ELSE 'unknown' END AS outcome, r.status AS status, r.endpoint AS endpoint
    FROM ed e LEFT JOIN rk ON rk.src = e.src AND rk.dst = e.dst AND rk.path = e.path WHERE e.edge),
fg AS (SELECT src, dst, trigger, action, arg_max(struct_pack(outcome := outcome, status := status, endpoint := endpoint), struct_pack(err := err, k := k)) AS b FROM fl GROUP BY ALL)"""


def _flow(spark, sf_dir):
    o = calls(spark, sf_dir).withColumn("request_path", F.concat(F.lit("/"), F.when(F.col("status") == 200, "F").when(F.col("status") == 404, "O").otherwise("P")))
    name = lambda p, n: F.concat(F.lit(p), (F.col("o_custkey") % n).cast("string"))
    rows = o.select(name("p", 9).alias("from"), name("q", 4).alias("to"), name("c", 5).alias("path"), F.col("o_orderpriority").alias("text"), F.lit("t").alias("component_type"), F.lit("CLICK").alias("action"),
                    F.col("event_seq"), "method", "request_path", "status", (F.col("event_seq") % 50 == 0).alias("failed"))
    even = F.col("event_seq") % 2 == 0
    return rules.flow_graph(rows.filter(even).drop("method", "request_path", "status", "failed"), rows.filter(~even))


@query(f"""WITH {FLOWS} SELECT src AS "from", dst AS "to", trigger, action, b.outcome AS outcome, b.status AS status, b.endpoint AS endpoint FROM fg""")
def flow_graph(spark, sf_dir):
    return _flow(spark, sf_dir)


# Clicks of one control that lead to several pages, and what each click got: all by visit and step.
@query(f"""WITH {ACTS}, i AS (SELECT *, event_id % 5 AS m FROM (SELECT *, event_seq AS event_id FROM ia)), s AS (SELECT page_url AS f, path, 'out' || m AS t, event_seq AS k, CASE WHEN m = 0 THEN NULL WHEN m = 1 THEN 422 ELSE 200 + event_seq % 3 END AS status, m = 2 AND event_seq % 20 = 7 AS failed,
        event_seq % 4 = 0 AS silent, ts FROM i),
    w AS (SELECT f, t, path, arg_min(struct_pack(status := status, bad := coalesce(failed OR status >= 400, false), k := k), struct_pack(r := CASE WHEN failed OR status >= 400 THEN 0 WHEN status IS NOT NULL THEN 1 ELSE 2 END, k := k)) AS r FROM s WHERE NOT silent GROUP BY ALL),
    e AS (SELECT DISTINCT f, t, path FROM s)
    SELECT e.f AS "from", e.t AS "to", e.path AS trigger, CASE WHEN r.bad THEN 'error' WHEN r.status IS NOT NULL THEN 'ok' ELSE 'unknown' END AS outcome, r.status::BIGINT AS status, CASE WHEN r IS NOT NULL THEN 'POST /' || r.k END AS endpoint
    FROM e LEFT JOIN w ON w.f = e.f AND w.t = e.t AND w.path = e.path""")
def move_outcomes(spark, sf_dir):
    m = F.col("event_seq") % 5
    acts = interactions(spark, sf_dir).withColumn("resulting_url", F.concat(F.lit("https://out"), m.cast("string"), F.lit("/")))
    edges = acts.groupBy(F.col("page_url").alias("from"), urls.route_shape(F.col("resulting_url")).alias("to"), "path").agg(F.min("event_seq").alias("event_seq"))
    sent = acts.filter("event_seq % 4 <> 0").select(
        "page_url", "path", "visit_id", "step_seq", "event_seq", F.lit("POST").alias("method"), F.concat(F.lit("/"), F.col("event_seq").cast("string")).alias("request_path"),
        F.when(m == 1, 422).when(m > 1, 200 + F.col("event_seq") % 3).cast("long").alias("status"), ((m == 2) & (F.col("event_seq") % 20 == 7)).alias("failed"),
    )
    told = edges.select("*", F.lit("").alias("text"), F.col("path").alias("component_type"), F.lit("CLICK").alias("action"))
    return rules.flow_graph(told, rules.move_requests(acts, sent)).select("from", "to", "trigger", "outcome", "status", "endpoint")


@query(f"""WITH {FLOWS} SELECT src AS "from", dst AS "to", trigger, b.status AS status FROM fg WHERE b.outcome = 'error'""")
def error_branches(spark, sf_dir):
    return rules.error_branches(_flow(spark, sf_dir)).select("from", "to", "trigger", "status")


@query("""SELECT 'n' || c_nationkey AS "from", 'c' || c_custkey AS "to", left(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE repeat(c_name || ' ', 3) || 'end' END, 40) AS label FROM customer""")
def navigation_list(spark, sf_dir):
    c = d.read(spark, sf_dir, "customer")
    long = F.concat(F.repeat(F.concat("c_name", F.lit(" ")), F.lit(3)), F.lit("end"))
    text = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(long)
    e = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("from"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("to"), text.alias("text"), F.col("c_mktsegment").alias("component_type"), F.lit("p").alias("path"))
    return rules.navigation_edge_list(e)


@query(f"""WITH {ACTS}, co AS (SELECT page_url, path, count(*) FILTER (path = 'purchase') AS sent, arg_max(value, event_seq) AS last, array_to_string(list_distinct(list(run_id ORDER BY run_id) FILTER (path = 'view')), ',') AS v FROM ia GROUP BY ALL)
    SELECT page_url, path, 'component' AS kind, path AS label, CASE WHEN path = 'view' THEN len(string_split(v, ',')) ELSE 0 END AS variants, CASE WHEN path = 'click' THEN round(last::DOUBLE, 6) END AS last_value, sent AS requests, CASE WHEN path = 'error' THEN 'main' ELSE '' END AS region FROM co
    UNION ALL SELECT DISTINCT page_url, 't' || path, 'text', 'p', 0, NULL::DOUBLE, 0, '' FROM ia""")
def tree_leaves(spark, sf_dir):
    own = ledger(spark, sf_dir)
    acted = lambda x: F.struct(F.when(F.col("path") == "click", "fill").otherwise(x["action"]).alias("action"), x["value"].alias("value"))
    rows = F.transform("options", lambda x: F.struct(F.lit("o").alias("path"), x["text"].alias("text"), x["selected"].alias("selected")))
    own = own.withColumn("interactions", F.transform("interactions", acted)).withColumn("options", rows).withColumn("group_name", F.lit("g"))
    own = own.withColumn("component_type", F.col("path")).withColumn("tag", F.lit("b")).withColumn("text", F.lit("t")).withColumn("redirect", F.lit(None).cast("string"))
    acts = interactions(spark, sf_dir)
    texts = acts.select("page_url", F.concat(F.lit("t"), "path").alias("path"), F.lit("p").alias("tag"), F.lit("x").alias("text")).distinct()
    regions = acts.filter("path = 'error'").select("page_url", "path").distinct().withColumn("region", F.lit("main"))
    found = rules.component_tree_leaves(own, texts, regions)
    size = lambda c: F.size(c).cast("long").alias(c)
    return found.select("page_url", "path", "kind", "label", size("variants"), F.round(F.col("last_value").cast("double"), 6).alias("last_value"), size("requests"), "region")


@query(f"""WITH {ACTS}, l AS (SELECT DISTINCT page_url, path FROM ia) SELECT page_url, CASE WHEN path = 'error' THEN 'main' ELSE '' END AS region, count(*) AS leaves FROM l GROUP BY ALL""")
def tree_counts(spark, sf_dir):
    own = interactions(spark, sf_dir).select("page_url", "path").distinct()
    return rules.tree_counts(own.withColumn("region", F.when(F.col("path") == "error", "main").otherwise("")))


# Options as they are told


@query("""WITH p AS (SELECT p_partkey AS id, p_brand, p_type, p_size, p_partkey % 3 AS k FROM part)
    SELECT id, CASE k WHEN 0 THEN 'stepper' WHEN 1 THEN 'choice_group' ELSE 'revealed_options' END AS kind, CASE k WHEN 0 THEN NULL ELSE p_type END AS name, CASE k WHEN 0 THEN p_size::VARCHAR END AS current_value,
           CASE k WHEN 0 THEN ['stepper (current value: ' || p_size || ')'] ELSE [p_brand || ' (selected)', p_type] END AS choices FROM p""")
def option_texts(spark, sf_dir):
    p, kind = d.read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    row = lambda path, text, on=False: F.struct(F.lit(path).alias("path"), text.alias("text"), F.lit(on).alias("selected"))
    stepper = F.array(row("b", F.lit("container")), row("u", F.lit("increment")), row("d", F.lit("decrement")), row("v", F.concat(F.lit("value:"), F.col("p_size").cast("string"))))
    choices = lambda path: F.array(row(path, F.col("p_brand"), True), row(path, F.lit("")), row(path, F.col("p_type")))
    rows = F.when(kind == 0, stepper).when(kind == 1, choices("o")).otherwise(choices(""))
    group = F.when(kind == 0, "stepper").otherwise(F.col("p_type"))
    told = labels.described_options(rows, group)
    return p.select(F.col("p_partkey").alias("id"), told["kind"].alias("kind"), told["name"].alias("name"), told["current_value"].alias("current_value"), labels.option_choices(rows, group).alias("choices"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE upper(c_mktsegment) END AS text, CASE WHEN c_custkey % 4 = 0 THEN 'ValueError: no text' END AS failure FROM customer")
def user_texts(spark, sf_dir):
    """A caller's function over prompt rows; where it fails, the deterministic text."""
    from siteloom.registry import with_user_text

    prompt = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    return with_user_text(d.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), prompt.alias("prompt"), F.col("c_name").alias("plain")), "prompt", "plain", _shout).select("id", "text", "failure")


def _shout(prompt: str) -> str:
    if not prompt:
        raise ValueError("no text")
    return prompt.upper()


@query(f"""WITH {d.REQUESTS} SELECT method, host, count(*) AS call_count FROM rq GROUP BY 1, 2""")
def named_query(spark, sf_dir):
    """Another query, found by its name."""
    from siteloom.registry import query as by_name

    return by_name(spark, sf_dir, "endpoint_counts").select("method", "host", "call_count")


@query("SELECT l_suppkey AS host, count(*) AS calls, count(DISTINCT l_partkey) AS endpoints FROM lineitem GROUP BY 1")
def busy_hosts(spark, sf_dir):
    rows = d.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("host"), "l_partkey").agg(F.count("*").alias("call_count"))
    return rules.hosts_by_traffic(rows)


@query(f"""WITH {d.EVENTS}, n AS (SELECT user_id AS run_id, k AS url, count(*) AS interruptions FROM ev WHERE event_type = 'error' GROUP BY ALL) SELECT * FROM n WHERE interruptions > 1""")
def exhausted_pages(spark, sf_dir):
    from siteloom.operators import ordered

    return ordered.requeue_exhausted(d.visit_results(spark, sf_dir), 1)


@query("SELECT 'page' || (p_partkey % 40) AS page_url, p_brand AS tag, count(*) AS n FROM part GROUP BY ALL")
def family_rebuild(spark, sf_dir):
    """Families rebuilt whole, a partition a page, twice over."""
    path = shared_path(spark, "families")
    own = d.part_components(spark, sf_dir).groupBy(F.col("page_url").alias("site"), "tag").agg(F.count("*").alias("n"))
    for _ in range(2):
        fold.replace_partitions(own, path)
    return tables.load_table(spark, path, "tag string, n long, site string").withColumnRenamed("site", "page_url")


@query(f"""WITH {d.REQUESTS} SELECT DISTINCT host AS page_url, method AS path FROM rq WHERE o_orderpriority = '2-HIGH'""")
def endpoint_callers(spark, sf_dir):
    rq = d.requests(spark, sf_dir).select(F.col("o_orderpriority").alias("endpoint_id"), F.col("host").alias("page_url"), F.col("method").alias("path"))
    return reads.callers_of(rq, "2-HIGH").drop("endpoint_id")
