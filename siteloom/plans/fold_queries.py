"""Registered queries of the folds, sources and sinks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import fold, incremental, reads
from siteloom.plans import derived as d
from siteloom.plans.queries import ORACLES, clean_sql, query, shape_sql
from siteloom.plans.shared import materialize, shared_path
from siteloom.sources import tables

# Interactions: events as what a user did with the control of an event type on a page. Purchases lead on.
ACTS = d.EVENTS + """, ia AS (SELECT 'h.example.com/' || k AS page_url, event_type AS path, upper(event_type) AS action, value::VARCHAR AS value,
    CASE WHEN event_type = 'purchase' THEN 'https://www.h.example.com/' || md5(k) || '/' WHEN event_type = 'view' THEN 'http://h.example.com/' || k ELSE '' END AS resulting_url,
    'http://h.example.com/' || k AS literal_url, 'v' || user_id AS visit_id, event_id AS step_seq, event_id AS event_seq, ts, 'run' || (day(ts) % 3) AS run_id FROM ev)"""


def interactions(spark, sf_dir):
    page = F.concat(F.lit("h.example.com/"), "k")
    led = F.when(F.col("event_type") == "purchase", F.concat(F.lit("https://www.h.example.com/"), F.md5("k"), F.lit("/")))
    led = led.when(F.col("event_type") == "view", F.concat(F.lit("http://"), page)).otherwise("")
    return d.event_rows(spark, sf_dir).select(
        page.alias("page_url"), F.col("event_type").alias("path"), F.upper("event_type").alias("action"), F.col("value").cast("string").alias("value"),
        led.alias("resulting_url"), F.concat(F.lit("http://"), page).alias("literal_url"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visit_id"),
        F.col("event_id").alias("step_seq"), F.col("event_id").alias("event_seq"), "ts", F.concat(F.lit("run"), (F.dayofmonth("ts") % 3).cast("string")).alias("run_id"),
    )


@query(f"""WITH {d.EVENTS} SELECT k AS url, arg_max(event_type, event_id) AS name, arg_max(user_id, event_id)::VARCHAR AS content FROM ev GROUP BY k""")
def page_metadata_fold(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir)
    told = fold.page_metadata(ev.select(F.col("k").alias("url"), F.create_map("event_type", F.col("user_id").cast("string")).alias("metadata"), F.col("event_id").alias("event_seq")))
    return told.select("url", F.explode("metadata").alias("name", "content"))


@query(f"""WITH {ACTS}, c AS (SELECT page_url, path, arg_max(value, event_seq) AS text, arg_max(run_id, event_seq) AS role FROM ia WHERE path <> 'error' GROUP BY ALL),
    n AS (SELECT page_url, path, count(*) AS interaction_count FROM ia WHERE path IN ('click', 'view') GROUP BY ALL)
    SELECT c.page_url, c.path, role, round(text::DOUBLE, 6) AS text, coalesce(interaction_count, 0) AS interaction_count, interaction_count IS NOT NULL AS interacted
    FROM c LEFT JOIN n ON n.page_url = c.page_url AND n.path = c.path""")
def component_state(spark, sf_dir):
    acts = interactions(spark, sf_dir)
    rows = fold.current_rows(acts.filter("path <> 'error'").withColumnsRenamed({"value": "text", "run_id": "role"}), ["page_url", "path"], ["role", "text"])
    return fold.with_interactions(rows, acts.filter(F.col("path").isin("click", "view"))).withColumn("text", F.round(F.col("text").cast("double"), 6))


@query("""SELECT source AS page_url, lang AS path, sha256(arg_max(coalesce(text, ''), doc_id)) AS digest, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL""")
def text_state(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").select(F.col("source").alias("page_url"), F.col("lang").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "n_chars", F.col("doc_id").alias("event_seq"))
    return fold.current_rows(docs, ["page_url", "path"], ["text", "n_chars"]).select("page_url", "path", F.sha2("text", 256).alias("digest"), "n_chars")


@query(f"""WITH {ACTS} SELECT event_seq, CASE WHEN resulting_url <> '' THEN {shape_sql("resulting_url")} ELSE page_url END AS target FROM ia""")
def interaction_targets(spark, sf_dir):
    return fold.interaction_targets(interactions(spark, sf_dir)).select("event_seq", "target")


@query(f"""WITH {ACTS} SELECT page_url AS "from", {shape_sql("resulting_url")} AS "to", path AS component, action, run_id, event_seq FROM ia
    WHERE resulting_url <> '' AND {clean_sql("resulting_url")} <> {clean_sql("literal_url")}""")
def navigation_events(spark, sf_dir):
    return fold.navigation_edges(interactions(spark, sf_dir)).drop("ts")


# Options: parts as controls whose raw options have one of three shapes by their size, or none.
@query("""WITH p AS (SELECT p_partkey AS id, 'page' || (p_partkey % 50) AS page_url, 'c' || (p_partkey % 7) AS path, p_size AS n, p_brand AS a, p_type AS b FROM part),
    l AS (SELECT page_url, path, max(id) AS id FROM p GROUP BY ALL), x AS (SELECT p.* FROM p JOIN l USING (id)),
    r AS (SELECT page_url, path, id % 4 AS kind, n, a, b, unnest(CASE id % 4 WHEN 0 THEN ['container', 'increment', 'decrement', 'value:' || n] WHEN 1 THEN [a, b] WHEN 2 THEN [b] ELSE [] END) AS text,
          unnest(CASE id % 4 WHEN 0 THEN [0, 1, 2, 3] WHEN 1 THEN [0, 1] WHEN 2 THEN [0] ELSE [] END) AS seq FROM x)
    SELECT page_url, path, seq, text, kind = 1 AND seq = 0 OR kind = 2 AS selected,
           CASE kind WHEN 0 THEN ['box', 'box > up', 'box > down', 'box > n'][seq + 1] WHEN 1 THEN 'o' || seq ELSE '' END AS option_path FROM r""")
def component_options(spark, sf_dir):
    p = d.read(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    stepper = F.to_json(F.create_map(*map(F.lit, ("container", "box", "increment_path", "box > up", "decrement_path", "box > down", "value_path", "box > n", "current_value")), F.col("p_size").cast("string")))
    option = lambda path, text, on: F.struct(F.lit(path).alias("path"), F.col(text).alias("text"), F.lit(on).alias("selected"))
    group = F.to_json(F.struct(F.lit("size").alias("group"), F.array(option("o0", "p_brand", True), option("o1", "p_type", False)).alias("options")))
    shown = F.to_json(F.struct(F.lit("more").alias("trigger"), F.array(option("x", "p_type", True)).alias("revealed_options")))
    raw = F.when(kind == 0, stepper).when(kind == 1, group).when(kind == 2, shown).otherwise('{"x": 1}')
    rows = p.select(F.concat(F.lit("page"), (F.col("p_partkey") % 50).cast("string")).alias("page_url"), F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string")).alias("path"), raw.alias("options"), F.col("p_partkey").alias("event_seq"))
    key = ["page_url", F.col("path").alias("owner")]
    found = fold.parsed_options(rows).select(*key, F.transform("options", lambda x: F.struct(x["path"].alias("option_path"), x["text"].alias("text"), x["selected"].alias("selected"))).alias("options"), "event_seq")
    return fold.current_options(found.withColumnRenamed("owner", "path")).select("page_url", "path", "seq", "option_path", "text", "selected")


@query("""SELECT DISTINCT c_mktsegment AS page_url, 'n' || c_nationkey AS parent, 'c' || c_custkey AS child, 'component' AS child_kind FROM customer
    UNION SELECT DISTINCT c_mktsegment, 'r' || n_regionkey, 'n' || n_nationkey, 'container' FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def containment(spark, sf_dir):
    rows = d.read(spark, sf_dir, "customer").join(d.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("path")
    chain = F.array(F.struct(name("n", "n_nationkey")), F.struct(name("r", "n_regionkey")))
    return fold.current_containment(rows.select(F.col("c_mktsegment").alias("page_url"), name("c", "c_custkey"), chain.alias("ancestors")))


@query(f"""WITH {d.PARTS}, s AS (SELECT page_url, tag AS path, 'hover' AS state, 'color' AS property, background_color AS value, pos FROM pc
    UNION ALL SELECT page_url, tag, 'focus', 'opacity', CASE WHEN pos % 3 = 0 THEN '' ELSE text END, pos FROM pc)
    SELECT page_url, path, state, property, arg_max(value, pos) AS value FROM s WHERE value <> '' GROUP BY ALL""")
def state_styles(spark, sf_dir):
    return reads.state_styles_in_order(fold.current_state_styles(style_events(spark, sf_dir)))


def style_events(spark, sf_dir):
    own = d.part_components(spark, sf_dir)
    faded = F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("text"))
    states = F.create_map(F.lit("hover"), F.create_map(F.lit("color"), F.col("background_color")), F.lit("focus"), F.create_map(F.lit("opacity"), faded))
    return own.select("page_url", F.col("tag").alias("path"), states.alias("states"), F.col("pos").alias("event_seq"))


# Requests: orders; those of even keys were triggered by a step, the others by a page's load or by nothing.
CALLS = d.REQUESTS + """, cl AS (SELECT * EXCLUDE (path), 'p' || (o_custkey % 9) AS page_url, CASE WHEN event_seq % 2 = 0 THEN 'c' || (o_custkey % 5) END AS path,
    CASE WHEN event_seq % 2 = 0 AND event_seq % 5 <> 0 THEN 'v' || (event_seq % 11) END AS visit_id, CASE WHEN event_seq % 2 = 0 THEN event_seq % 7 END AS step_seq FROM rq),
st AS (SELECT page_url, path, visit_id, step_seq, min(event_seq) AS event_seq FROM cl WHERE visit_id IS NOT NULL AND event_seq % 3 > 0 GROUP BY ALL)"""


def calls(spark, sf_dir):
    rq, even, key = d.requests(spark, sf_dir), F.col("event_seq") % 2 == 0, F.col("event_seq")
    name = lambda p, c, n: F.concat(F.lit(p), (c % n).cast("string"))
    return rq.select(
        *(c for c in rq.columns if c != "path"), F.col("path").alias("request_path"), name("p", F.col("o_custkey"), 9).alias("page_url"), F.when(even, name("c", F.col("o_custkey"), 5)).alias("path"),
        F.when(even & (key % 5 != 0), name("v", key, 11)).alias("visit_id"), F.when(even, key % 7).alias("step_seq"),
    )


def steps(spark, sf_dir):
    own = calls(spark, sf_dir).filter("visit_id is not null and event_seq % 3 > 0")
    return own.groupBy("page_url", "path", "visit_id", "step_seq").agg(F.min("event_seq").alias("event_seq"))


@query(f"WITH {CALLS} SELECT event_seq, page_url AS loaded_page FROM cl WHERE is_first_party AND path IS NULL")
def load_requests(spark, sf_dir):
    return fold.load_requests(calls(spark, sf_dir)).select("event_seq", "loaded_page")


@query(f"""WITH {CALLS} SELECT cl.event_seq, st.event_seq AS interaction_seq FROM cl JOIN st USING (page_url, path, visit_id, step_seq) WHERE is_first_party""")
def triggered_requests(spark, sf_dir):
    return fold.triggered_requests(calls(spark, sf_dir), steps(spark, sf_dir)).select("event_seq", "interaction_seq")


BODIES = """bd AS (SELECT o_orderkey AS event_seq, CASE WHEN o_orderstatus = 'O' THEN md5(o_orderpriority) ELSE '' END AS request_body_hash, md5(o_orderstatus || o_orderpriority) AS response_body_hash,
    o_orderpriority AS sent, o_orderstatus || o_orderpriority AS received FROM orders)"""


def bodies(spark, sf_dir):
    sent, received = F.col("o_orderpriority"), F.concat("o_orderstatus", "o_orderpriority")
    return d.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_seq"), F.when(F.col("o_orderstatus") == "O", F.md5(sent)).otherwise("").alias("request_body_hash"), F.md5(received).alias("response_body_hash"),
        sent.alias("sent"), received.alias("received"),
    )


@query(f"""WITH {BODIES} SELECT event_seq, 'request' AS direction, request_body_hash AS hash FROM bd WHERE request_body_hash <> '' UNION ALL SELECT event_seq, 'response', response_body_hash FROM bd""")
def payload_edges(spark, sf_dir):
    return fold.payload_edges(bodies(spark, sf_dir))


@query("""SELECT sha256(text) AS hash, strlen(arg_min(text, doc_id))::BIGINT AS length, md5(arg_min(text, doc_id)) AS content, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def payload_contents(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").filter("text is not null")
    rows = docs.select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("length"), F.col("text").alias("content"), F.col("doc_id").alias("event_seq"))
    return fold.payloads(rows).withColumn("content", F.md5("content"))


@query("SELECT o_orderstatus AS site, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'old' END AS generation, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2")
def replaced_partitions(spark, sf_dir):
    path = shared_path(spark, "replaced")
    rows = d.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("site"))
    fold.replace_partitions(rows.withColumn("generation", F.lit("old")), path)
    fold.replace_partitions(rows.filter("site = 'O'").withColumn("generation", F.lit("new")), path)
    kept = tables.load_table(spark, path, "o_orderkey long, generation string, site string")
    return kept.groupBy("site", "generation").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("SELECT s_nationkey AS nation, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1")
def table_store(spark, sf_dir):
    path = shared_path(spark, "store")
    tables.save_table(d.read(spark, sf_dir, "supplier").select("s_acctbal", "s_nationkey", (F.col("s_nationkey") % 2).cast("string").alias("site")), path)
    kept = tables.load_table(spark, path, "s_acctbal double, s_nationkey int, site string", "0")
    return kept.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE -1 END AS module_id, c_mktsegment AS module_label FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, c_nationkey, 'm' || c_nationkey FROM customer WHERE c_custkey % 3 = 0""")
def metrics_written(spark, sf_dir):
    c = d.read(spark, sf_dir, "customer")
    pages = c.select(F.col("c_custkey").alias("url"), F.lit(-1).alias("module_id"), F.col("c_mktsegment").alias("module_label"))
    fresh = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("url"), F.col("c_nationkey").alias("module_id"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("module_label"))
    return fold.write_metrics(pages, fresh, ["url"])


@query(f"""WITH {d.PARTS}, g AS (SELECT page_url, tag, path, first_value(path) OVER (PARTITION BY page_url, tag ORDER BY pos) AS representative FROM pc WHERE pos % 2 = 1),
    e AS (SELECT page_url, path, pos FROM pc) SELECT e.pos AS event_seq, coalesce(g.representative, e.path) AS path, e.path AS source_path FROM e LEFT JOIN g ON g.page_url = e.page_url AND g.path = e.path""")
def grouped_members(spark, sf_dir):
    own = d.part_components(spark, sf_dir)
    groups = fold.consolidate_groups(own.filter("pos % 2 = 1").select("page_url", "tag", "path", "pos"), ["page_url", "tag"])
    events = own.select("page_url", "path", F.col("pos").alias("event_seq"))
    return fold.redirect_members(events, groups, ["page_url"]).select("event_seq", "path", "source_path")


@query(f"""WITH {d.REQUESTS} SELECT event_seq, list_reverse(string_split(host, '.'))[1:2] = ['com', 'example'] AND host LIKE '%.example.com' AS is_first_party FROM rq""")
def stamped_requests(spark, sf_dir):
    rq = d.requests(spark, sf_dir).drop("is_first_party")
    return fold.stamp_first_party(rq, F.lit("https://www.example.com/x")).select("event_seq", "is_first_party")


@query("""SELECT 'page' || (p_partkey % 40) AS page_url, 'p' || p_partkey AS path, lower(p_brand) AS tag, '' AS role, p_name AS text, '' AS input_type, p_size > 20 AS visible, false AS selected,
    p_size::DOUBLE AS x, p_retailprice AS y, NULL::DOUBLE AS width, NULL::DOUBLE AS height, p_type AS css_class, '' AS element_id, '' AS href, '' AS placeholder, p_brand AS label, '' AS name, '' AS form,
    p_size > 40 AS disabled, false AS required, 'rgb(1, 2, 3)' AS color, '' AS background_color, p_size || 'px' AS font_size, '' AS font_weight, '' AS display, '' AS position FROM part""")
def component_facts(spark, sf_dir):
    p, none = d.read(spark, sf_dir, "part"), F.lit(None)
    text = none.cast("string")
    raw = p.select(
        F.concat(F.lit("page"), (F.col("p_partkey") % 40).cast("string")).alias("page_url"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.lower("p_brand").alias("tag"),
        text.alias("role"), F.col("p_name").alias("text"), text.alias("input_type"), (F.col("p_size") > 20).alias("visible"), none.cast("boolean").alias("selected"),
        F.struct(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), none.cast("double").alias("width"), none.cast("double").alias("height")).alias("rect"),
        F.create_map(F.lit("class"), F.col("p_type")).alias("attributes"), text.alias("placeholder"), F.col("p_brand").alias("label"), text.alias("name"), text.alias("form"),
        (F.col("p_size") > 40).alias("disabled"), none.cast("boolean").alias("required"),
        F.struct(F.lit("rgb(1, 2, 3)").alias("color"), text.alias("background_color"), F.concat(F.col("p_size").cast("string"), F.lit("px")).alias("font_size"), *(text.alias(x) for x in ("font_weight", "display", "position"))).alias("style"),
    )
    return fold.component_rows(raw)


@query("""WITH e AS (SELECT user_id::VARCHAR AS site, ts, event_type, event_id FROM events)
    SELECT site, min(ts) AS first_crawled, max(ts) AS last_crawled FROM e GROUP BY 1""")
def sites(spark, sf_dir):
    return fold.touch_sites(d.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("site"), "ts"))


@query("""WITH r AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'error' AND user_id % 2 = 0 GROUP BY 1)
    SELECT e.user_id AS site, e.event_id AS event_seq FROM events e LEFT JOIN r USING (user_id) WHERE m IS NULL OR e.event_id > m""")
def after_reset(spark, sf_dir):
    ev = d.read(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("event_seq"), "event_type")
    return fold.without_reset(ev, ev.filter("event_type = 'error' and site % 2 = 0")).drop("event_type")


@query("""WITH r AS (SELECT c_mktsegment AS site, o_orderdate AS t, o_orderkey AS k, o_totalprice AS pages FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t DESC, k DESC) AS n FROM r) SELECT site, k AS run FROM n WHERE n = 1""")
def latest_runs(spark, sf_dir):
    path = shared_path(spark, "runs")
    o = d.read(spark, sf_dir, "orders").join(d.read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    runs = o.select(F.col("c_mktsegment").alias("site"), F.struct("o_orderdate", "o_orderkey").alias("timestamp"), F.col("o_orderkey").alias("run"))
    for even in (True, False):
        tables.record_run(runs.filter((F.col("run") % 2 == 0) == even), path)
    return tables.latest_run(tables.run_index(spark.read.schema(runs.schema).parquet(path))).select("site", "run")


@query(f"""WITH {d.EDGES}, e AS (SELECT DISTINCT src, dst, component, action FROM edge_events), p AS (SELECT DISTINCT src AS url FROM e)
    SELECT url, (SELECT count(*) FROM e WHERE e.src = url) AS n_edges, count(DISTINCT doc_id) AS n_components, count(DISTINCT source) AS n_texts
    FROM p LEFT JOIN documents ON (doc_id % 100)::VARCHAR = url GROUP BY url""")
def graph_export(spark, sf_dir):
    edges = fold.current_edges(d.edge_events(spark, sf_dir))
    docs = d.read(spark, sf_dir, "documents")
    page = (F.col("doc_id") % 100).cast("string").alias("page_url")
    comps = docs.select(page, F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("tag"), "source").withColumnRenamed("source", "text")
    texts = docs.select(page, F.col("source").alias("path"), F.lit("p").alias("tag"), F.lit("").alias("text")).distinct()
    path = shared_path(spark, "export")
    tables.write_json(tables.graph_export(edges.select(F.col("from").alias("url")).distinct(), edges, comps, texts), path)
    kind = "array<struct<path:string,tag:string,text:string>>"
    kept = spark.read.schema(f"url string, edges array<struct<to:string,component:string,action:string>>, components {kind}, text_content {kind}").json(path)
    count = lambda c, name: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long").alias(name)
    return kept.select("url", count("edges", "n_edges"), count("components", "n_components"), count("text_content", "n_texts"))


@query("""WITH l AS (SELECT page_id, url, len(regexp_extract_all(html, '<a[ >]')) AS n FROM pages)
    SELECT 'crawl' AS site, url AS page_url, page_id AS event_seq, n AS links FROM l""")
def snapshot_links(spark, sf_dir):
    """Pages written as nested JSON snapshots and read again by the declared schema."""
    from siteloom.sources import html

    path = shared_path(spark, "snapshots")
    parsed = html.parse_pages(d.read(spark, sf_dir, "pages"), ("links",))
    links = F.transform("links", lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), F.lit("").alias("scheme")))
    tables.write_json(parsed.select(F.lit("crawl").alias("site"), "url", F.col("page_id").alias("event_seq"), links.alias("links")), path)
    rows = tables.snapshot_rows(tables.load_page_states(spark, path), "links")
    return rows.groupBy("site", "page_url", "event_seq").agg(F.count("*").alias("links"))


# Captured network events: of each order a request, and what became of it.
NETWORK = """ne AS (SELECT o_custkey % 50 AS batch, 'https://api.example.com/o/' || (o_orderkey % 400) AS url, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)"""


def network_events(spark, sf_dir):
    o = d.read(spark, sf_dir, "orders")
    base = [(F.col("o_custkey") % 50).cast("string").alias("batch"), F.concat(F.lit("https://api.example.com/o/"), (F.col("o_orderkey") % 400).cast("string")).alias("url")]
    none = F.lit(None).cast("string")
    kind = F.when(F.col("o_orderpriority") < "3", "xhr").when(F.col("o_orderpriority") < "4", "document").otherwise("image")
    sent = o.select(*base, (F.col("o_orderkey") * 2).alias("seq"), F.lit("request").alias("event_type"), F.when(F.col("o_orderstatus") == "O", "POST").otherwise("GET").alias("method"), kind.alias("resource_type"),
                    F.lit(None).cast("long").alias("status"), none.alias("failure_text"), none.alias("body"), F.lit(None).cast("map<string,string>").alias("headers"))
    lost = F.col("o_orderstatus") == "P"
    told = o.select(*base, (F.col("o_orderkey") * 2 + 1).alias("seq"), F.when(lost, "request_failed").otherwise("response").alias("event_type"), none.alias("method"), none.alias("resource_type"),
                    F.when(~lost, 200 + F.col("o_orderkey") % 7).alias("status"), F.when(lost, F.col("o_orderpriority")).alias("failure_text"), none.alias("body"), F.lit(None).cast("map<string,string>").alias("headers"))
    return sent.unionByName(told)


@query(f"""WITH {NETWORK}, t AS (SELECT batch, url, arg_max(200 + k % 7, k) FILTER (s <> 'P') AS status, arg_max(p, k) FILTER (s = 'P') AS failure_text, bool_or(s = 'P') AS failed FROM ne GROUP BY ALL)
    SELECT ne.batch::VARCHAR AS batch, ne.url, k * 2 AS seq, status, failure_text, failed FROM ne JOIN t ON t.batch = ne.batch AND t.url = ne.url WHERE p < '3' OR p < '4' AND s = 'O'""")
def meaningful_requests(spark, sf_dir):
    from siteloom.functions import network
    from siteloom.operators import rules

    path = shared_path(spark, "network")
    tables.write_json(network_events(spark, sf_dir), path)
    events = tables.load_network_events(spark, path)
    found = rules.meaningful_requests(events, network.is_meaningful(F.col("resource_type"), F.col("method")))
    return found.select("batch", "url", "seq", "status", "failure_text", "failed")


@query("""WITH p AS (SELECT event_id, user_id || '/' || json_extract_string(props, '$.k') AS url, event_type FROM events),
    s AS (SELECT url, coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'error')), '') AS last FROM p GROUP BY 1)
    SELECT count(*) FILTER (last = 'purchase') AS finished, count(*) AS total FROM s""")
def stream_coverage(spark, sf_dir):
    """The coverage after the last batch of a stream of page events."""
    from siteloom.streaming import live

    source, out = shared_path(spark, "stream-coverage"), shared_path(spark, "coverage-out")
    events = d.page_events(spark, sf_dir)
    events.repartition(3).write.parquet(source)
    live.live_coverage(live.observation_stream(spark, source, events.schema, files=2), out, shared_path(spark, "coverage-check"))
    rows = spark.read.schema("finished long, total long, batch int").parquet(out)
    return rows.orderBy(F.desc("batch")).limit(1).select("finished", "total")


@query("SELECT event_id, event_type FROM events")
def stream_ingest(spark, sf_dir):
    """Events appended through a stream and read again."""
    from siteloom.streaming import live

    source, out = shared_path(spark, "stream-ingest"), shared_path(spark, "ingested")
    ev = d.read(spark, sf_dir, "events").select("event_id", "event_type")
    ev.repartition(3).write.parquet(source)
    live.append_observations(live.observation_stream(spark, source, ev.schema, files=2), out, shared_path(spark, "ingest-check")).awaitTermination()
    return spark.read.schema(ev.schema).parquet(out)


@query(f"""WITH {d.REQUESTS} SELECT event_seq, host NOT LIKE 'api3%' AS is_first_party FROM rq""")
def stream_stamped(spark, sf_dir):
    """A stream of requests joined with the table of sites."""
    from siteloom.plans.queries import _staged, _streamed
    from siteloom.streaming import live

    rq = d.requests(spark, sf_dir).select("event_seq", "host", F.col("o_orderpriority").alias("site"))
    sites_ = rq.select("site", "host").distinct().select("site", F.when(F.col("host").startswith("api3"), "https://other.org").otherwise(F.concat(F.lit("https://"), "host")).alias("root_url"))
    found = live.stamped(_staged(spark, rq, "stamped"), materialize(sites_, "sites"))
    return _streamed(spark, found.select("event_seq", "is_first_party"), "stamped", "append")


def _in_files(spark, rows, order, files, name):
    """A stream of ``rows`` in as many files by ranges of ``order``, one file a batch, in that order."""
    from siteloom.streaming import live

    path, stored = shared_path(spark, f"stream-{name}"), materialize(rows, name)
    last = stored.agg(F.max(order)).first()[0] or 0
    for part in range(files):
        kept = stored.filter(F.col(order).between(last * part // files + (part > 0), last * (part + 1) // files))
        kept.coalesce(1).write.mode("append").parquet(path)
    return live.observation_stream(spark, path, stored.schema, files=1)


@query(f"""WITH {d.VISITS}, v AS (SELECT visit_id, count(*) AS n, array_to_string(list(step_seq || ':' || action || ':' || page_url ORDER BY step_seq), ',') AS steps FROM steps GROUP BY 1)
    SELECT visit_id, n AS length, steps, n % 3 > 0 AS complete FROM v""")
def stream_traces(spark, sf_dir):
    """Visits assembled from a stream in which steps of a visit come in several batches, the last ones first, and some
    twice. Of one visit in three no step is marked as the last, so it is given up when event time has passed it."""
    from pyspark.sql import Window as W

    from siteloom.plans.queries import _streamed
    from siteloom.streaming import live

    rows = d.visit_steps(spark, sf_dir)
    n = F.count("*").over(W.partitionBy("visit_id"))
    kept = ["visit_id", "step_seq", "page_url", "action", "finished", "ts"]
    rows = rows.withColumn("finished", (F.col("step_seq") == n) & (n % 3 > 0)).withColumn("ts", F.col("ts").cast("timestamp"))
    # Event time runs on by itself: a step of no visit, long after the last one, closes what is open.
    late = rows.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts"))
    late = late.select(F.lit("").alias("visit_id"), F.lit(1).cast("long").alias("step_seq"), F.lit("").alias("page_url"), F.lit("").alias("action"), F.lit(False).alias("finished"), "ts", F.lit(5).cast("long").alias("file"))
    sent = rows.select(*kept, (4 - F.col("step_seq") % 4).alias("file"))
    again = sent.filter("step_seq % 5 = 0").withColumn("file", F.lit(4).cast("long"))
    found = _streamed(spark, live.visit_traces(_in_files(spark, sent.unionByName(again).unionByName(late), "file", 5, "traces"), 30, "60 days"), "traces", "append")
    told = F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["step_seq"].cast("string"), x["action"], x["page_url"])), ",")
    return found.select("visit_id", "length", told.alias("steps"), "complete")


FRONTIER = """fc AS (SELECT event_id AS pos, 'app.example.com/' || event_type || CASE WHEN user_id % 2 = 0 THEN '' ELSE '/more' END || '/' || md5((event_id % 997)::VARCHAR) AS clean FROM events),
fv AS (SELECT DISTINCT 'app.example.com/click/' || md5((event_id % 300)::VARCHAR) AS clean FROM events WHERE event_id % 7 = 0),
ff AS (SELECT clean, substr(clean, 1, length(clean) - 32) || '{token}' AS shape, min(pos) AS pos FROM fc WHERE clean NOT IN (SELECT clean FROM fv) GROUP BY ALL),
fp AS (SELECT 'app.example.com/click/{token}' AS shape, count(*) AS n FROM fv)"""


@query(f"""WITH {FRONTIER} SELECT clean, shape, pos FROM ff LEFT JOIN fp USING (shape) QUALIFY row_number() OVER (PARTITION BY shape ORDER BY pos) + coalesce(n, 0) <= 60""")
def stream_frontier(spark, sf_dir):
    """Links as events show them, over and over in five batches, with and without www. and slashes; every one is
    admitted once, and of each route shape the first 60 at most, with those that were visited before."""
    from siteloom.streaming import live

    ev, base = d.read(spark, sf_dir, "events"), F.lit("https://app.example.com")
    more = F.when(F.col("user_id") % 2 == 0, "").otherwise("/more")
    url = lambda k, kind, host: F.concat(F.lit(host), kind, F.lit("/"), F.md5(k.cast("string")))
    key = F.col("event_id") % 997
    kind = F.concat("event_type", more)
    cand = ev.select(F.when(F.col("event_id") % 3 == 0, F.concat(url(key, kind, "http://www.app.example.com/"), F.lit("/#x"))).otherwise(url(key, kind, "https://app.example.com/")).alias("url"), F.col("event_id").alias("pos"))
    other = ev.filter("event_id % 11 = 0").select(F.concat(F.lit("https://other.org/"), F.col("event_id").cast("string")).alias("url"), F.col("event_id").alias("pos"))
    seen = ev.filter("event_id % 7 = 0").select(url(F.col("event_id") % 300, F.lit("click"), "https://app.example.com/").alias("url"))
    out = shared_path(spark, "frontier")
    live.live_frontier(_in_files(spark, cand.unionByName(other), "pos", 5, "frontier"), base, out, shared_path(spark, "frontier-check"), 60, materialize(seen, "seen"))
    return spark.read.parquet(out).select("clean", "shape", "pos")


def _kept(spark, name, kept, events):
    """The state after three batches of ``events``, which lie in each other's order."""
    table = incremental.StateTable(spark, shared_path(spark, f"kept-{name}"), kept, 16)
    stored = materialize(events, name)
    for part in (1, 0, 2):
        table.append(stored.filter(F.col("event_seq") % 3 == part), (1, 0, 2).index(part))
    return table.current()


@query(ORACLES["current_state_fold"])
def kept_page_state(spark, sf_dir):
    """Pages as three batches of events leave them, each merged into the stored state."""
    return _kept(spark, "pages", incremental.pages_fold(), d.page_events(spark, sf_dir))


@query(ORACLES["nav_edges"])
def kept_edge_counts(spark, sf_dir):
    return _kept(spark, "edges", incremental.edges_fold(), d.edge_events(spark, sf_dir))


@query(f"""WITH {ACTS} SELECT page_url, path, round(arg_max(value::DOUBLE, event_seq), 6) AS text, arg_max(run_id, event_seq) AS role FROM ia WHERE path <> 'error' GROUP BY ALL""")
def kept_components(spark, sf_dir):
    acts = interactions(spark, sf_dir).filter("path <> 'error'").withColumnsRenamed({"value": "text", "run_id": "role"})
    found = _kept(spark, "components", incremental.rows_fold(("page_url", "path"), ("text", "role")), acts)
    return found.withColumn("text", F.round(F.col("text").cast("double"), 6))


@query("""WITH c AS (SELECT 'h.com/' || p_partkey AS url, 'c' || p_size AS path, p_brand AS s, p_type AS prop, p_container AS v FROM (SELECT *, p_name AS p_container FROM part))
    SELECT url || '|' || path AS component_id, url || '|' || path || '|' || s || '|' || prop AS style_id, 'GET h.com/' || prop AS endpoint_id FROM c""")
def identities(spark, sf_dir):
    p = d.read(spark, sf_dir, "part").select(F.concat(F.lit("h.com/"), F.col("p_partkey").cast("string")).alias("u"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("c"), "p_brand", "p_type")
    u, c = F.col("u"), F.col("c")
    endpoint = urls.endpoint_id(F.lit("GET"), F.lit("h.com"), F.concat(F.lit("/"), "p_type"))
    return p.select(urls.component_id(u, c).alias("component_id"), urls.state_style_id(u, c, F.col("p_brand"), F.col("p_type")).alias("style_id"), endpoint.alias("endpoint_id"))
