"""Registered queries of the reads, joins and ordered operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import fold, graph, ordered, reads, rules
from siteloom.plans import derived as d
from siteloom.plans.fold_queries import ACTS, BODIES, CALLS, bodies, calls, interactions, steps, style_events
from siteloom.plans.queries import STATUS, query, shape_sql

PAGES = d.PAGE_EVENTS + """, pg AS (SELECT url, coalesce(arg_max(status, event_seq) FILTER (status <> 'Pending'), 'Pending') AS status,
    coalesce(arg_max(title, event_seq) FILTER (title <> ''), '') AS title FROM pe GROUP BY url)"""


def pages(spark, sf_dir):
    return fold.current_pages(d.page_events(spark, sf_dir))


# Asked are the pages that events of one user in three are about.
@query(f"""WITH {PAGES} SELECT DISTINCT pg.url FROM pg JOIN ev ON pg.url = ev.user_id || '/' || ev.k WHERE status IN ('Finished', 'Failed') AND ev.user_id % 3 = 0""")
def visited_pages(spark, sf_dir):
    asked = d.event_rows(spark, sf_dir).filter("user_id % 3 = 0").select(F.concat_ws("/", F.col("user_id").cast("string"), "k").alias("url")).distinct()
    return reads.visited(pages(spark, sf_dir), asked)


@query(f"WITH {PAGES} SELECT url, status, row_number() OVER (ORDER BY status = 'Finished', url) AS n FROM pg")
def progress(spark, sf_dir):
    """The progress table with the place of each row in it."""
    rows = reads.progress_table(pages(spark, sf_dir)).select("url", "status")
    return ordered.numbered(rows, [], [F.col("status") == "Finished", F.col("url")])


@query(f"WITH {PAGES} SELECT url, title FROM pg WHERE title <> ''")
def page_titles(spark, sf_dir):
    return reads.non_empty(pages(spark, sf_dir), "title")


@query(f"""WITH {d.EDGES}, e AS (SELECT src, dst, component, action, count(*) AS c, min(ts) AS created_at FROM edge_events GROUP BY ALL)
    SELECT src AS "from", dst AS "to", component, action, c AS observation_count FROM e ORDER BY created_at, src, component, action, dst LIMIT 200""")
def first_edges(spark, sf_dir):
    """A report: the 200 navigations that were seen first."""
    found = reads.edges_in_order(fold.current_edges(d.edge_events(spark, sf_dir)))
    return found.limit(200).select("from", "to", "component", "action", "observation_count")


@query(f"WITH {ACTS} SELECT path, arg_max(value, event_seq)::DOUBLE AS text FROM ia WHERE page_url = 'h.example.com/7' GROUP BY path")
def states_of_page(spark, sf_dir):
    rows = fold.current_rows(interactions(spark, sf_dir), ["page_url", "path"], ["value"])
    return reads.component_states(rows, "h.example.com/7").select("path", F.col("value").cast("double").alias("text"))


@query(f"""WITH {PAGES} SELECT user_id || '/' || k AS page_url, event_type AS path, event_id::VARCHAR AS text FROM ev JOIN pg ON pg.url = user_id || '/' || k WHERE pg.status = 'Finished'""")
def page_texts(spark, sf_dir):
    texts = d.event_rows(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), "k").alias("page_url"), F.col("event_type").alias("path"), F.col("event_id").cast("string").alias("text"))
    return reads.text_ledger(pages(spark, sf_dir).filter("status = 'Finished'"), texts)


@query(f"""WITH {d.GRAPH}, o AS (SELECT src AS url, count(*) AS n FROM g GROUP BY 1), i AS (SELECT dst AS url, count(*) AS n FROM g GROUP BY 1), p AS (SELECT DISTINCT k AS url FROM ev UNION SELECT 'lonely')
    SELECT p.url, CASE WHEN o.n IS NOT NULL THEN 1 END AS module_id, CASE WHEN o.n IS NULL THEN '' ELSE 'm' END AS module_label, o.n AS out_degree, i.n AS in_degree, o.n > 20 AS is_articulation_point
    FROM p LEFT JOIN o ON o.url = p.url LEFT JOIN i ON i.url = p.url""")
def page_measures(spark, sf_dir):
    m = graph.degrees(d.simple_edges(spark, sf_dir)).withColumnRenamed("id", "url")
    m = m.select("url", F.lit(1).alias("module_id"), F.lit("m").alias("module_label"), F.lit(None).cast("int").alias("click_depth"), "in_degree", "out_degree",
                 F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("pagerank"), (F.col("out_degree") > 20).alias("is_articulation_point"))
    known = d.event_rows(spark, sf_dir).select(F.col("k").alias("url")).distinct().union(spark.createDataFrame([("lonely",)], "url string"))
    return reads.page_metrics(known, m).select("url", "module_id", "module_label", "out_degree", "in_degree", "is_articulation_point")


@query(f"""WITH {d.REQUESTS} SELECT method, host, count(*) AS call_count FROM rq GROUP BY 1, 2 HAVING NOT bool_and(is_first_party)""")
def integrations(spark, sf_dir):
    return reads.integrations(fold.endpoint_counts(d.requests(spark, sf_dir))).select("method", "host", "call_count")


@query(f"WITH {PAGES} SELECT url FROM pg WHERE status = 'Pending' ORDER BY url LIMIT 40")
def unexplored(spark, sf_dir):
    return reads.unexplored(pages(spark, sf_dir), 40)


@query(f"WITH {PAGES} SELECT url FROM pg WHERE status <> 'Finished'")
def unfinished(spark, sf_dir):
    return reads.unfinished_urls(pages(spark, sf_dir))


@query(f"""WITH {PAGES}, t AS (SELECT CASE WHEN length(url) % 2 = 0 THEN url || '/{{token}}' ELSE url END AS url, status FROM pg) SELECT url FROM t WHERE status = 'Pending' AND url NOT LIKE '%{{token}}%'""")
def resumed(spark, sf_dir):
    named = F.when(F.char_length("url") % 2 == 0, F.concat("url", F.lit("/{token}"))).otherwise(F.col("url"))
    return reads.resume_candidates(pages(spark, sf_dir).withColumn("url", named))


@query(f"""WITH {STATUS}, t AS (SELECT 'h.com/' || left(url, 2) || '/' || md5(url) AS url FROM p WHERE status = 'Finished') SELECT DISTINCT {shape_sql("url")} AS shape FROM t""")
def finished_shapes(spark, sf_dir):
    named = F.concat(F.lit("h.com/"), F.left("url", F.lit(2)), F.lit("/"), F.md5("url"))
    return reads.finished_route_shapes(pages(spark, sf_dir).withColumn("url", named))


# The ledger: controls with what was done on them, what they called and their options.
LEDGER = ACTS + """, co AS (SELECT DISTINCT page_url, path FROM ia), op AS (SELECT DISTINCT page_url, path, run_id AS text, right(run_id, 1)::INT AS seq FROM ia WHERE path = 'view')"""


def ledger(spark, sf_dir):
    acts = interactions(spark, sf_dir)
    keys = acts.select("page_url", "path").distinct()
    sent = acts.filter("path = 'purchase'").select(
        "page_url", "path", F.lit("POST").alias("method"), F.concat(F.lit("/"), "run_id").alias("request_path"), (200 + F.col("event_seq") % 300).alias("status"),
        (F.col("event_seq") % 5 == 0).alias("failed"), "visit_id", "step_seq", "event_seq",
    )
    options = acts.filter("path = 'view'").select("page_url", "path", F.col("run_id").alias("text"), F.right("run_id", F.lit(1)).cast("int").alias("seq"), F.lit(False).alias("selected")).distinct()
    return reads.component_ledger(keys, acts, sent, options)


@query(f"""WITH {LEDGER}, i AS (SELECT page_url, path, count(*) AS n_interactions, arg_max(action, event_seq) AS last_action, arg_max(resulting_url, event_seq) AS last_result FROM ia GROUP BY ALL),
    o AS (SELECT page_url, path, array_to_string(list(text ORDER BY seq), ',') AS options FROM op GROUP BY ALL),
    r AS (SELECT page_url, path, count(*) AS n_requests, count(*) FILTER (event_seq % 5 = 0) AS n_failed FROM ia WHERE path = 'purchase' GROUP BY ALL)
    SELECT co.page_url, co.path, n_interactions, last_action, CASE WHEN last_result = co.page_url THEN '' ELSE last_result END AS last_result, coalesce(options, '') AS options,
           coalesce(n_requests, 0) AS n_requests, coalesce(n_failed, 0) AS n_failed
    FROM co LEFT JOIN i USING (page_url, path) LEFT JOIN o USING (page_url, path) LEFT JOIN r USING (page_url, path)""")
def component_ledger(spark, sf_dir):
    found = reads.flat_component_ledger(ledger(spark, sf_dir))
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    last = F.element_at("interactions", -1)
    failed = F.coalesce(F.filter("network_requests", lambda x: x["failed"]), F.slice("network_requests", 1, 0))
    return found.select(
        "page_url", "path", size("interactions").alias("n_interactions"), last["action"].alias("last_action"), last["resulting_url"].alias("last_result"),
        F.coalesce(F.array_join(F.transform("options", lambda x: x["text"]), ","), F.lit("")).alias("options"), size("network_requests").alias("n_requests"), size(failed).alias("n_failed"),
    )


SOURCES = CALLS + ", " + BODIES + """, en AS (SELECT DISTINCT o_orderpriority AS endpoint_id, is_first_party FROM rq), cm AS (SELECT DISTINCT page_url, path FROM st WHERE path <> 'c0'),
    pl AS (SELECT request_body_hash AS hash, min(sent) AS content FROM bd WHERE request_body_hash <> '' GROUP BY 1 UNION SELECT response_body_hash, min(received) FROM bd GROUP BY 1)"""


@query(f"""WITH {SOURCES}, ti AS (SELECT cl.event_seq, st.event_seq AS i, st.page_url, st.path FROM cl JOIN st USING (page_url, path, visit_id, step_seq))
    SELECT cl.event_seq, cl.o_orderpriority AS endpoint_id, coalesce(cm.page_url, CASE WHEN cl.path IS NULL THEN cl.page_url END) AS page_url, cm.path, p.content AS request_body, q.content AS response_body
    FROM cl JOIN en ON en.endpoint_id = cl.o_orderpriority AND en.is_first_party LEFT JOIN ti ON ti.event_seq = cl.event_seq LEFT JOIN cm ON cm.page_url = ti.page_url AND cm.path = ti.path
    JOIN bd ON bd.event_seq = cl.event_seq LEFT JOIN pl p ON p.hash = bd.request_body_hash LEFT JOIN pl q ON q.hash = bd.response_body_hash""")
def contract_sources(spark, sf_dir):
    own, st, bd = calls(spark, sf_dir), steps(spark, sf_dir), bodies(spark, sf_dir)
    by = fold.triggered_requests(own.withColumn("is_first_party", F.lit(True)), st).select("event_seq", "interaction_seq")
    requests = own.select("event_seq", F.col("o_orderpriority").alias("endpoint_id")).join(by, "event_seq", "left").join(bd.drop("sent", "received"), "event_seq")
    endpoints = own.select(F.col("o_orderpriority").alias("endpoint_id"), F.col("is_first_party").alias("first_party")).distinct()
    loads = fold.load_requests(own.withColumn("is_first_party", F.lit(True)))
    comps = st.filter("path <> 'c0'").select("page_url", "path").distinct()
    pay = fold.payloads(bd.select(F.col("request_body_hash").alias("hash"), F.col("sent").alias("content"), F.lit(0).alias("length"), "event_seq").filter("hash <> ''")
                        .unionByName(bd.select(F.col("response_body_hash").alias("hash"), F.col("received").alias("content"), F.lit(0).alias("length"), "event_seq")))
    found = reads.contract_sources(requests, endpoints, loads, st.withColumnRenamed("event_seq", "interaction_seq"), comps, pay)
    return found.select("event_seq", "endpoint_id", "page_url", "path", "request_body", "response_body")


@query(f"""WITH {CALLS} SELECT st.event_seq AS interaction_seq, cl.event_seq AS request_seq FROM st JOIN cl USING (page_url, path, visit_id, step_seq)""")
def stamped_calls(spark, sf_dir):
    """Requests of interactions; every control here has stamped ones, so loose requests belong to none."""
    st = steps(spark, sf_dir)
    sent = calls(spark, sf_dir).filter("path is not null").select("page_url", "path", "visit_id", "step_seq", F.col("event_seq").alias("request_seq"))
    found = reads.interaction_requests(st, sent)
    return found.join(st, ["page_url", "path", "visit_id", "step_seq"]).select(F.col("event_seq").alias("interaction_seq"), "request_seq")


@query(f"""WITH {CALLS}, lo AS (SELECT page_url || '-' || (event_seq % 3) AS page_url, path, CASE WHEN event_seq % 3 > 0 THEN visit_id END AS visit_id, step_seq, event_seq FROM cl WHERE path IS NOT NULL),
    sp AS (SELECT page_url, path, 'v1' AS visit_id, 1 AS step_seq FROM lo GROUP BY ALL), h AS (SELECT page_url, path, bool_or(visit_id IS NOT NULL) AS stamped FROM lo GROUP BY ALL)
    SELECT sp.page_url, sp.path, lo.event_seq AS request_seq FROM sp JOIN h USING (page_url, path) JOIN lo USING (page_url, path) WHERE NOT h.stamped OR lo.visit_id = 'v1' AND lo.step_seq = 1""")
def loose_calls(spark, sf_dir):
    """One interaction a control; where no request of the control is stamped, all are its."""
    own = calls(spark, sf_dir).filter("path is not null")
    third = F.col("event_seq") % 3
    sent = own.select(F.concat_ws("-", "page_url", third.cast("string")).alias("page_url"), "path", F.when(third > 0, F.col("visit_id")).alias("visit_id"), "step_seq", F.col("event_seq").alias("request_seq"))
    acts = sent.select("page_url", "path").distinct().select("page_url", "path", F.lit("v1").alias("visit_id"), F.lit(1).cast("long").alias("step_seq"))
    return reads.interaction_requests(acts, sent).select("page_url", "path", "request_seq")


# Families of parts by type; of every third part the control is gone.
@query(f"""WITH {d.PARTS} SELECT component_type AS family_id, page_url, path, text FROM pc WHERE pos % 3 > 0""")
def family_members(spark, sf_dir):
    own = d.part_components(spark, sf_dir)
    families = own.groupBy(F.col("component_type").alias("family_id")).agg(F.collect_list(F.struct("page_url", "path")).alias("members"))
    return reads.resolved_members(families, own.filter("pos % 3 > 0").select("page_url", "path", "text"))


@query(f"""WITH {ACTS}, co AS (SELECT DISTINCT page_url, path FROM ia), led AS (SELECT page_url, path, arg_max(resulting_url, event_seq) AS led FROM ia WHERE resulting_url <> '' GROUP BY ALL),
    j AS (SELECT page_url, path, min(visit_id) AS jump FROM ia WHERE path IN ('click', 'view') GROUP BY ALL)
    SELECT co.page_url, co.path, coalesce(led, jump) AS redirect FROM co LEFT JOIN led USING (page_url, path) LEFT JOIN j USING (page_url, path)""")
def component_redirects(spark, sf_dir):
    acts = interactions(spark, sf_dir)
    edges = acts.filter(F.col("path").isin("click", "view")).select(F.col("page_url").alias("from"), F.col("visit_id").alias("to"), F.col("path").alias("component"))
    return reads.component_redirects(acts.select("page_url", "path").distinct(), acts, edges)


@query(f"""WITH {ACTS} SELECT event_seq, CASE WHEN path = 'view' THEN 'option ' || run_id ELSE path || run_id END AS choice FROM ia""")
def option_choices(spark, sf_dir):
    acts = interactions(spark, sf_dir).withColumn("source_path", F.concat("path", "run_id"))
    options = acts.filter("path = 'view'").select("page_url", F.col("source_path").alias("option_path"), F.concat(F.lit("option "), "run_id").alias("text")).distinct()
    return reads.option_redirects(acts, options).select("event_seq", "choice")


@query(f"""WITH {d.PARTS}, f AS (SELECT path, text AS identity, pos FROM pc WHERE pos % 2 = 0), l AS (SELECT identity, arg_min(path, pos) AS like_path FROM f GROUP BY 1)
    SELECT pc.path, CASE WHEN f.path IS NOT NULL THEN f.path ELSE l.like_path END AS now FROM pc LEFT JOIN f ON f.path = pc.path LEFT JOIN l ON l.identity = pc.text WHERE f.path IS NOT NULL OR l.like_path IS NOT NULL""")
def frontier_remapped(spark, sf_dir):
    own = d.part_components(spark, sf_dir).withColumnRenamed("text", "identity")
    return reads.remap_frontier(own.select("path", "identity"), own.filter("pos % 2 = 0").select("path", "identity", "pos")).select("path", "now")


@query(f"""WITH {PAGES}, m AS (SELECT url, length(url) AS depth FROM pg WHERE status <> 'Pending') SELECT pg.url, pg.status, CASE WHEN m.url IS NOT NULL THEN 'm' || depth END AS module_label, depth AS click_depth FROM pg LEFT JOIN m USING (url)""")
def pages_with_metrics(spark, sf_dir):
    p = pages(spark, sf_dir)
    m = p.filter("status <> 'Pending'").select("url", F.concat(F.lit("m"), F.char_length("url").cast("string")).alias("module_label"), F.char_length("url").cast("long").alias("click_depth"))
    return reads.pages_with_metrics(p.select("url", "status"), m)


@query(f"""WITH {PAGES}, c AS (SELECT DISTINCT k || '/' || user_id AS url FROM ev UNION SELECT DISTINCT user_id || '/' || k FROM ev)
    SELECT url FROM c WHERE url NOT IN (SELECT url FROM pg WHERE status = 'Finished') AND url NOT IN (SELECT url FROM pg WHERE status = 'Failed')""")
def frontier_left(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))
    cand = ev.select(F.concat_ws("/", "k", "user_id").alias("url")).union(ev.select(F.concat_ws("/", "user_id", "k").alias("url"))).distinct()
    p = pages(spark, sf_dir)
    return reads.frontier_anti(cand, p.filter("status = 'Finished'").select("url"), p.filter("status = 'Failed'").select("url"))


@query(f"""WITH {d.PARTS}, u AS (SELECT DISTINCT page_url, path FROM pc WHERE x > 30), e AS (SELECT DISTINCT page_url, tag FROM pc WHERE y > 1500)
    SELECT page_url, path FROM pc WHERE pos % 4 > 0 AND (page_url, path) NOT IN (SELECT page_url, path FROM u) AND (page_url, tag) NOT IN (SELECT page_url, tag FROM e)""")
def eligible_components(spark, sf_dir):
    own = d.part_components(spark, sf_dir).withColumn("visible", F.col("pos") % 4 > 0).withColumnRenamed("tag", "identity")
    used, excluded = own.filter("x > 30").select("page_url", "path"), own.filter("y > 1500").select("page_url", "identity").distinct()
    return reads.eligible_components(own, used, excluded).select("page_url", "path")


@query(f"""WITH {d.TREE}, known AS (SELECT DISTINCT src AS url FROM tr) SELECT src AS "from", dst AS "to", 'LINK' AS action FROM tr WHERE dst IN (SELECT url FROM known)""")
def known_targets(spark, sf_dir):
    e = d.tree_edges(spark, sf_dir)
    links = e.select(F.col("src").alias("from"), F.lit("a").alias("component"), F.col("dst").alias("to"))
    return reads.known_link_targets(links, e.select(F.col("src").alias("url")).distinct()).select("from", "to", "action")


SHARED_TEXTS = """fx AS (SELECT component_type AS family_id, list_sort(list(DISTINCT text))[:3] AS texts, count(*) AS n FROM pc GROUP BY 1)"""


@query(f"""WITH {d.PARTS}, {SHARED_TEXTS} SELECT family_id, CASE WHEN n % 2 = 0 THEN 'purpose of ' || family_id END AS purpose FROM fx""")
def narrated_families(spark, sf_dir):
    own = d.part_components(spark, sf_dir)
    fam = own.groupBy(F.col("component_type").alias("family_id")).agg(F.slice(F.array_sort(F.collect_set("text")), 1, 3).alias("texts"), F.count("*").alias("n"))
    fam = fam.withColumn("tag", F.lit("b")).withColumn("component_type", F.col("family_id"))
    nothing = F.lit(None).cast("string")
    known = rules.families_to_narrate(fam.filter("n % 2 = 0"), fam.limit(0).select(nothing.alias("signature"), nothing.alias("purpose")))
    remembered = known.select("signature", F.concat(F.lit("purpose of "), "family_id").alias("purpose"))
    return rules.families_to_narrate(fam, remembered).select("family_id", "purpose")


# Ordered


@query(f"""WITH {d.VISITS}, o AS (SELECT visit_id, step_seq, CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END || ' /' || action AS subject, CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 = 1 THEN 'sent' ELSE 'answered ' || (200 + event_id % 300) END AS outcome FROM steps WHERE action = 'purchase'),
    t AS (SELECT visit_id, arg_min(page_url, step_seq) AS a, coalesce(arg_max(target, step_seq) FILTER (navigated), arg_min(page_url, step_seq)) AS b FROM steps GROUP BY 1)
    SELECT visit_id, step_seq, subject, outcome FROM o UNION ALL SELECT visit_id, NULL, b, 'page' FROM t WHERE a <> b""")
def trace_assertions(spark, sf_dir):
    rows = d.visit_steps(spark, sf_dir)
    key = F.col("event_id")
    sent = rows.filter("action = 'purchase'").select("visit_id", "step_seq", F.when(key % 2 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "action").alias("request_path"), (key % 4 == 0).alias("failed"), F.when(key % 4 > 1, 200 + key % 300).alias("status"))
    return ordered.trace_assertions(ordered.traces(rows), sent)


@query(f"""WITH {d.EVENTS}, s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, '[' || string_agg('{{"k":"' || k || '","event_type":"' || event_type || '"}}', ',' ORDER BY k, event_type) || ']' AS ids FROM ev WHERE event_type <> 'error' GROUP BY ALL)
    SELECT user_id, day, left(sha1(ids), 10) AS signature FROM s""")
def snapshot_signatures(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir)
    rows = ev.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") != "error").alias("visible"), F.struct("k", "event_type").alias("identity"))
    return ordered.snapshot_signature(rows, ["user_id", "day"])


@query(f"""WITH {d.EVENTS}, b AS (SELECT user_id, k AS path, max(CASE event_type WHEN 'click' THEN 1 ELSE 0 END) = 1 AS was FROM ev WHERE day(ts) < 16 GROUP BY ALL), a AS (SELECT user_id, k AS path, max(CASE event_type WHEN 'view' THEN 1 ELSE 0 END) = 1 AS visible FROM ev WHERE day(ts) >= 16 GROUP BY ALL)
    SELECT a.user_id, a.path, a.visible FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.path = a.path WHERE a.path::INT % 2 = 0 AND (b.path IS NULL OR NOT was AND visible)""")
def revealed_options(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir)
    seen = lambda when, kind: ev.filter(when).groupBy("user_id", F.col("k").alias("path")).agg(F.max(F.col("event_type") == kind).alias("visible"))
    role = F.when(F.col("path").cast("int") % 2 == 0, "option").otherwise("button")
    return ordered.revealed_options(seen("day(ts) < 16", "click"), seen("day(ts) >= 16", "view").withColumn("role", role), ["user_id"]).select("user_id", "path", "visible")


@query("""WITH p AS (SELECT 'page' || (p_partkey % 10) AS page_url, 'c' || lpad(p_partkey::VARCHAR, 8, '0') AS path, p_partkey AS id, p_name, p_type, p_size FROM part),
    k AS (SELECT *, id % 5 AS kind, CASE id % 5 WHEN 0 THEN 'sbox' || (p_size % 6) WHEN 1 THEN 'g' || p_type ELSE path END AS single FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_url, single ORDER BY path) AS nth FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY path) AS n, count(*) OVER (PARTITION BY page_url) AS m FROM f WHERE nth = 1)
    SELECT page_url, path, CASE kind WHEN 0 THEN 'stepper control (increment/decrement)' WHEN 1 THEN 'choice group (dropdown/menu/radio/checkbox)' ELSE 'button' END AS type,
           CASE kind WHEN 0 THEN p_name WHEN 1 THEN 'group ''' || p_type || '''' WHEN 2 THEN '(no accessible label found on this element)' ELSE p_name END AS text,
           CASE kind WHEN 0 THEN p_size::VARCHAR END AS current_value, CASE kind WHEN 1 THEN p_name END AS choices, m > 60 AS truncated FROM o WHERE n <= 60""")
def page_facts(spark, sf_dir):
    p, kind = d.read(spark, sf_dir, "part"), F.col("p_partkey") % 5
    row = lambda path, text, on=False: F.struct(F.lit(path).alias("path"), text.alias("text"), F.lit(on).alias("selected"))
    box = F.struct(F.concat(F.lit("box"), (F.col("p_size") % 6).cast("string")).alias("path"), F.lit("container").alias("text"), F.lit(False).alias("selected"))
    stepper = F.array(box, row("u", F.lit("increment")), row("d", F.lit("decrement")), row("v", F.concat(F.lit("value:"), F.col("p_size").cast("string"))))
    rows = F.when(kind == 0, stepper).when(kind == 1, F.array(row("o", F.col("p_name"), True), row("q", F.lit(""))))
    comps = p.select(
        F.concat(F.lit("page"), (F.col("p_partkey") % 10).cast("string")).alias("page_url"), F.format_string("c%08d", "p_partkey").alias("path"), F.when(kind != 2, F.col("p_name")).alias("text"), F.lit("button").alias("component_type"),
        F.lit(True).alias("interacted"), F.coalesce(rows, F.slice(stepper, 1, 0)).alias("options"), F.when(kind == 0, "stepper").when(kind == 1, F.col("p_type")).otherwise("").alias("group_name"),
    )
    return ordered.page_facts(comps).select("page_url", "path", "type", "text", "current_value", F.array_join("choices", ",").alias("choices"), "truncated")


@query("""WITH u AS (SELECT p_size * 5 AS v, count(*) AS uses FROM part GROUP BY 1) SELECT v, uses, 'color-' || row_number() OVER (ORDER BY uses DESC, v) AS name FROM u""")
def color_names(spark, sf_dir):
    rows = d.read(spark, sf_dir, "part").groupBy((F.col("p_size") * 5).alias("v")).agg(F.count("*").alias("uses"))
    return rules.token_names(rows, "color-", "uses", "v")


@query("""WITH u AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'large' WHEN p_size % 11 = 0 THEN '' ELSE p_size || 'px' END AS font_size, CASE WHEN p_partkey % 2 = 0 THEN '400' ELSE '700' END AS font_weight FROM part),
    c AS (SELECT font_size, font_weight, count(*) AS uses FROM u WHERE font_size <> '' GROUP BY ALL)
    SELECT *, 'type-' || row_number() OVER (ORDER BY coalesce(try_cast(replace(font_size, 'px', '') AS DOUBLE), -1) DESC, font_weight, font_size) AS name FROM c""")
def type_scale(spark, sf_dir):
    return rules.type_tokens(typed_parts(spark, sf_dir))


def typed_parts(spark, sf_dir):
    size = F.when(F.col("p_size") % 7 == 0, "large").when(F.col("p_size") % 11 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("px")))
    return d.read(spark, sf_dir, "part").select(size.alias("font_size"), F.when(F.col("p_partkey") % 2 == 0, "400").otherwise("700").alias("font_weight"))


@query(f"""WITH {d.PARTS}, s AS (SELECT page_url, tag AS path, 'hover' AS state, 'color' AS property, background_color AS value, pos FROM pc
    UNION ALL SELECT page_url, tag, 'focus', 'opacity', CASE WHEN pos % 3 = 0 THEN '' ELSE text END, pos FROM pc), l AS (SELECT page_url, path, state, property, arg_max(value, pos) AS value FROM s WHERE value <> '' GROUP BY ALL)
    SELECT state, property, value, count(*) AS uses, row_number() OVER (ORDER BY state, count(*) DESC, property, value) AS position FROM l GROUP BY state, property, value""")
def state_tokens(spark, sf_dir):
    return rules.state_tokens(fold.current_state_styles(style_events(spark, sf_dir)))
