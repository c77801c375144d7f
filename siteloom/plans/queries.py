"""The registered queries of the crawl-graph operators, each with DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import colors, labels, network, urls
from siteloom.operators import fold, graph, ordered, reads, rules, search, similarity
from siteloom.plans import derived as d
from siteloom.plans.shared import materialize, shared_path, spread
from siteloom.sources import html
from siteloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


# URLs and links


def clean_sql(x: str) -> str:
    bare = f"regexp_replace(string_split({x}, '#')[1], '/+$', '')"
    return rf"regexp_replace(regexp_replace({bare}, '^https?://', ''), '^www\.', '')"


def opaque_sql(x: str) -> str:
    mixed = f"(regexp_matches({x}, '[a-z]') AND regexp_matches({x}, '[A-Z]'))"
    return f"(regexp_matches({x}, '^[A-Za-z0-9_-]{{16,}}$') AND (regexp_matches({x}, '[0-9]') OR {mixed}))"


def host_sql(x: str) -> str:
    return f"string_split({clean_sql(x)}, '/')[1]"


def shape_sql(x: str) -> str:
    named = f"CASE WHEN i > 1 AND {opaque_sql('p')} THEN '{{token}}' ELSE p END"
    return f"array_to_string(list_transform(string_split({clean_sql(x)}, '/'), lambda p, i: {named}), '/')"


@query(f"""SELECT page_id, {clean_sql("url")} AS clean, {shape_sql("url")} AS shape, {host_sql("url")} AS host,
           replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_') AS slug FROM pages""")
def url_keys(spark, sf_dir):
    u = F.col("url")
    return d.read(spark, sf_dir, "pages").select(
        "page_id", urls.clean_url(u).alias("clean"), urls.route_shape(u).alias("shape"), urls.host_of(u).alias("host"), urls.slugify(u).alias("slug")
    )


def _links(spark, sf_dir):
    rows = html.extract_links(html.parse_pages(d.read(spark, sf_dir, "pages"), ("links",)))
    seq = F.col("page_id") * 100_000 + F.col("pos")
    return rows.select(urls.route_shape(F.col("url")).alias("from"), urls.route_shape(F.col("href")).alias("to"), F.col("text").alias("label"), seq.alias("event_seq"))


def plain_sql(x: str) -> str:
    """Markup off, character references of the pages decoded, white space as one space."""
    bare = rf"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        bare = f"replace({bare}, '{name}', '{char}')"
    return rf"trim(regexp_replace({bare}, '[\s\x0B]+', ' ', 'g'))"


ANCHOR = r"""'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'"""
LINKS = f"""raw AS (
    SELECT page_id, url, unnest(regexp_extract_all(html, {ANCHOR}, 1, 's')) AS href,
           unnest(regexp_extract_all(html, {ANCHOR}, 2, 's')) AS label,
           unnest(range(len(regexp_extract_all(html, {ANCHOR}, 1, 's')))) AS pos FROM pages),
lr AS (SELECT page_id, url, pos, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS href, {plain_sql("label")} AS label FROM raw),
lk AS (SELECT {shape_sql("url")} AS src, {shape_sql("href")} AS dst, label, page_id * 100000 + pos AS event_seq FROM lr)"""


@query(f"WITH {LINKS} SELECT src AS \"from\", dst AS \"to\", arg_max(label, event_seq) AS label FROM lk GROUP BY ALL")
def link_table(spark, sf_dir):
    return fold.current_links(_links(spark, sf_dir))


@query(f"""WITH {LINKS} SELECT dst AS id, count(DISTINCT src) AS in_degree FROM lk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def link_top_targets(spark, sf_dir):
    links = fold.current_links(_links(spark, sf_dir)).select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return graph.degrees(links).filter("in_degree > 0").orderBy(F.desc("in_degree"), "id").limit(20).select("id", "in_degree")


@query(f"""WITH l AS (SELECT page_id, {host_sql("url")} AS h, {shape_sql("url")} AS shape FROM pages)
    SELECT shape AS url, CASE WHEN bool_or(list_reverse(string_split(h, '.'))[1:2] = ['com', 'example']) THEN 'Pending' ELSE 'External' END AS status
    FROM l GROUP BY shape""")
def link_scope(spark, sf_dir):
    links = d.read(spark, sf_dir, "pages").select(F.lit("start").alias("from"), F.col("url").alias("href"))
    return fold.classify_links(links, F.lit("https://app.example.com"), True).select("url", "status")


@query(f"WITH {LINKS} SELECT page_id, pos::INT AS pos, href, label AS text, split_part(href, ':', 1) AS scheme FROM lr")
def page_links_resolved(spark, sf_dir):
    parsed = html.parse_pages(d.read(spark, sf_dir, "pages"), ("links",))
    return html.extract_links(parsed).select("page_id", "pos", "href", "text", "scheme")


# As in a browser, these names are references without a semicolon, too.
HEAD = r"""regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '&(amp|lt|gt|quot|copy|middot);?', '&\1;', 'g')"""


@query(f"""SELECT page_id, {plain_sql(HEAD)} AS head,
           len(regexp_extract_all(html, '<a[ >]')) AS links, len(regexp_extract_all(html, '<meta [^>]*(?:name|property)=')) AS metadata FROM pages""")
def page_meta(spark, sf_dir):
    parsed = html.parse_pages(d.read(spark, sf_dir, "pages"), ("links", "metadata", "texts"))
    head = F.get(F.filter("texts", lambda x: x["tag"] == "h1"), F.lit(0))["text"]
    return parsed.select("page_id", F.coalesce(head, F.lit("")).alias("head"), F.size("links").cast("long").alias("links"), F.size("metadata").cast("long").alias("metadata"))


@query()
def page_structure(spark, sf_dir):
    parsed = html.parse_pages(d.read(spark, sf_dir, "pages"))
    return parsed.select("page_id", *(F.size(x).alias(f"n_{x}") for x in html.PARTS)).join(html.extract_description(parsed).drop("url"), "page_id")


# A page of each customer: metadata with a repeated name, prose with and without controls in it, a labelled form in landmarks.
def _customer_pages(spark, sf_dir, parts):
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    described = F.when(key % 3 == 0, F.concat(F.lit("<meta name=Description content='About "), seg, F.lit("'>"))).otherwise("")
    page = F.concat(
        F.lit("<html><head><meta charset=utf-8>"), described, F.lit("<meta property=og:type content=a><meta name=k content=old><meta name=k content='"), seg,
        F.lit("'></head><body><header><h1>Page "), key.cast("string"), F.lit("</h1></header><main id=m><p>Short</p><p>Customer of\n <b>bold</b>  segment "), seg,
        F.lit("</p><form id=f aria-label=Ask><label for=q>Your  name</label><input id=q name=n placeholder=Who required><button "),
        F.when(key % 2 == 0, "disabled").otherwise("class='b c'"), F.lit(">Go &amp; <i>on</i></button><label>Size<select name=s></select></label></form><ul><li>one</li><li><a href=/x>two</a></li></ul></main></body></html>"),
    )
    customers = spread(d.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    rows = customers.select(key.alias("page_id"), F.lit("https://h.org/").alias("url"), page.alias("html"))
    return html.parse_pages(rows, parts)


@query("""WITH c AS (SELECT c_custkey AS page_id, c_mktsegment AS seg FROM customer)
    SELECT page_id, 'Description' AS name, 'About ' || seg AS content FROM c WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'og:type', 'a' FROM c UNION ALL SELECT page_id, 'k', seg FROM c""")
def page_metadata(spark, sf_dir):
    found = html.extract_metadata(_customer_pages(spark, sf_dir, ("metadata",)))
    return found.select("page_id", F.explode("metadata").alias("name", "content"))


@query("""WITH c AS (SELECT c_custkey AS page_id, c_mktsegment AS seg FROM customer)
    SELECT page_id, 0 AS pos, 'body > header > h1' AS path, 'h1' AS tag, 'Page ' || page_id AS text FROM c UNION ALL SELECT page_id, 1, 'body > main#m > p:nth-of-type(1)', 'p', 'Short' FROM c
    UNION ALL SELECT page_id, 2, 'body > main#m > p:nth-of-type(2)', 'p', 'Customer of segment ' || seg FROM c UNION ALL SELECT page_id, 3, 'body > main#m > ul > li:nth-of-type(1)', 'li', 'one' FROM c""")
def page_prose(spark, sf_dir):
    """Prose outside of controls, each element with its own text only."""
    return html.extract_texts(_customer_pages(spark, sf_dir, ("texts",))).drop("url")


@query("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN 'About ' || c_mktsegment ELSE 'Page ' || c_custkey || ' - Customer of segment ' || c_mktsegment END AS description FROM customer""")
def page_descriptions(spark, sf_dir):
    return html.extract_description(_customer_pages(spark, sf_dir, ("metadata", "texts"))).drop("url")


@query("""WITH c AS (SELECT c_custkey AS page_id, c_custkey % 2 = 0 AS even FROM customer), f AS (SELECT 'body > main#m > form#f' AS f)
    SELECT page_id, f || ' > input#q' AS path, 'input' AS tag, '' AS text, 'Your name' AS label, 'Who' AS placeholder, 'n' AS name, f AS form, '' AS css_class, '' AS href, false AS disabled, true AS required FROM c, f
    UNION ALL SELECT page_id, f || ' > button', 'button', 'Go & on', '', '', '', f, CASE WHEN even THEN '' ELSE 'b c' END, '', even, false FROM c, f
    UNION ALL SELECT page_id, f || ' > label:nth-of-type(2) > select', 'select', '', 'Size', '', 's', f, '', '', false, false FROM c, f
    UNION ALL SELECT page_id, 'body > main#m > ul > li:nth-of-type(2) > a', 'a', 'two', '', '', '', '', '', '/x', false, false FROM c""")
def page_controls(spark, sf_dir):
    found = html.extract_components(_customer_pages(spark, sf_dir, ("controls",)))
    return found.select("page_id", "path", "tag", "text", "label", "placeholder", "name", "form", "css_class", "href", "disabled", "required")


@query("""WITH k AS (SELECT 'body > main#m > form#f' AS f, unnest([' > input#q', ' > button', ' > label:nth-of-type(2) > select']) AS own),
    r AS (SELECT f || own AS component_path, 1 AS distance, f AS path, 'form' AS tag, 'form' AS landmark FROM k UNION ALL SELECT f || own, 2, 'body > main#m', 'main', 'main' FROM k
    UNION ALL SELECT 'body > main#m > ul > li:nth-of-type(2) > a', 1, 'body > main#m > ul', 'ul', '' UNION ALL SELECT 'body > main#m > ul > li:nth-of-type(2) > a', 2, 'body > main#m', 'main', 'main')
    SELECT c_custkey AS page_id, r.* FROM customer, r""")
def page_ancestors(spark, sf_dir):
    """The structural elements around each control, nearest first, with their landmarks."""
    found = html.extract_ancestors(_customer_pages(spark, sf_dir, ("controls",)))
    return found.select("page_id", "component_path", "distance", "path", "tag", "landmark")


# Pages of customers, whose style sheets tell controls by what is around and before them.
@query("""WITH c AS (SELECT c_custkey AS page_id, 'c' || c_nationkey AS v, c_custkey % 3 AS k, c_mktsegment AS seg FROM customer)
    SELECT page_id, 'nav > a' AS path, 'hover' AS state, 'color' AS property, v AS value FROM c
    UNION ALL SELECT page_id, 'main > a:nth-of-type(1)', 'hover', 'color', 'wide' FROM c
    UNION ALL SELECT page_id, 'main > a:nth-of-type(2)', 'hover', 'color', 'wide' FROM c
    UNION ALL SELECT page_id, 'main > a:nth-of-type(2)', 'focus', 'outline', 'next' FROM c
    UNION ALL SELECT page_id, 'main > div > p > button', 'hover', 'opacity', '0.5' FROM c WHERE k <> 1
    UNION ALL SELECT page_id, 'main > div > p > button', 'focus', 'color', seg FROM c WHERE k = 2
    UNION ALL SELECT page_id, 'main > input', 'focus', 'border-color', CASE WHEN k = 0 THEN 'late' ELSE 'mail' END FROM c""")
def page_state_styles(spark, sf_dir):
    c, kind = spread(d.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey"), F.col("c_custkey") % 3
    css = F.concat(
        F.lit("nav > a:hover, nav a.none:focus { color: c"), F.col("c_nationkey").cast("string"), F.lit("; margin: 0 } main a:hover { color: wide } a.x + a:focus { outline: next } "),
        F.lit("@media (max-width: 9px) { a:hover { color: small } } .card:not(.k1) button:hover { opacity: 0.5 } [data-k='2'] > p > button:focus { color: "), "c_mktsegment",
        F.lit(" } input[type^=em]:focus-visible { border-color: mail } .k0 ~ input:focus { border-color: late } nav + nav a:hover { color: never } a:unknown(x):hover { color: never }"),
    )
    body = F.concat(
        F.lit("<nav><a href=a>a</a></nav><main><a class=x href=b>b</a><a href=c>c</a><div class='card k"), kind.cast("string"), F.lit("' data-k="), kind.cast("string"),
        F.lit("><p><button>d</button></p></div><input type=email></main>"),
    )
    pages = c.select(F.col("c_custkey").alias("page_id"), F.lit("https://h.org/").alias("url"), F.concat(F.lit("<style>"), css, F.lit("</style>"), body).alias("html"))
    return html.extract_state_styles(html.parse_pages(pages, ("styles",))).select("page_id", "path", "state", "property", "value")


@query(f"WITH {d.TREE} SELECT DISTINCT src AS url, 'Pending' AS status FROM tr UNION SELECT dst, 'Pending' FROM tr")
def pending_pages(spark, sf_dir):
    e = d.tree_edges(spark, sf_dir)
    pages = e.select(F.col("src").alias("url")).distinct().withColumn("status", F.lit("Pending"))
    return fold.ensure_pages(pages, e.select(F.col("dst").alias("url"))).select("url", "status")


# Navigation graph


@query(f"""WITH {d.EDGES} SELECT src AS "from", dst AS "to", component, action, count(*) AS observation_count,
    arg_min(run_id, event_seq) AS first_seen_run, arg_max(run_id, event_seq) AS last_seen_run, min(ts) AS created_at
    FROM edge_events GROUP BY src, dst, component, action""")
def nav_edges(spark, sf_dir):
    return fold.current_edges(d.edge_events(spark, sf_dir))


@query(f"WITH {d.TREE} SELECT src AS id FROM tr EXCEPT SELECT dst FROM tr")
def entry_states(spark, sf_dir):
    return graph.entry_states(d.tree_edges(spark, sf_dir))


@query(f"WITH {d.TREE} SELECT dst AS id FROM tr EXCEPT SELECT src FROM tr")
def dead_ends(spark, sf_dir):
    return graph.dead_ends(d.tree_edges(spark, sf_dir))


@query(f"WITH {d.GRAPH} SELECT src AS id FROM g UNION SELECT dst FROM g")
def states(spark, sf_dir):
    return graph.vertices(d.simple_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {d.TREE}, r(id, n) AS (SELECT dst, 1 FROM tr WHERE src = 'r1'
    UNION SELECT tr.dst, r.n + 1 FROM r JOIN tr ON tr.src = r.id WHERE r.n < 4) SELECT DISTINCT id FROM r""")
def reachable_within_k(spark, sf_dir):
    return graph.reachable(d.tree_edges(spark, sf_dir), "r1", 4)


@query(f"""WITH RECURSIVE {d.TREE}, r(id, n) AS (SELECT 'r0', 0 UNION SELECT tr.dst, r.n + 1 FROM r JOIN tr ON tr.src = r.id WHERE r.n < 25),
    v AS (SELECT src AS id FROM tr UNION SELECT dst FROM tr)
    SELECT v.id, min(r.n)::INT AS depth FROM v LEFT JOIN r ON r.id = v.id GROUP BY v.id""")
def click_depth(spark, sf_dir):
    return graph.click_depth(d.tree_edges(spark, sf_dir), "r0")


@query(f"""WITH {d.GRAPH}, o AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM g GROUP BY 1)
    SELECT coalesce(i.id, o.id) AS id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM i FULL JOIN o ON i.id = o.id""")
def degree_table(spark, sf_dir):
    return graph.degrees(d.simple_edges(spark, sf_dir))


def _rank_sql(graph_sql: str, name: str, rounds: int, digits: int) -> str:
    """PageRank by a fixed number of rounds over the edge table ``name``."""
    steps = [f"""WITH {graph_sql}, h AS MATERIALIZED (SELECT DISTINCT src, dst FROM {name}), v AS MATERIALIZED (SELECT src AS id FROM h UNION SELECT dst FROM h),
    n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v),
    od AS MATERIALIZED (SELECT v.id, count(h.src) AS out FROM v LEFT JOIN h ON h.src = v.id GROUP BY 1), r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM v, n)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(s.got, 0) + l.loose / n) AS rank FROM v CROSS JOIN n
        CROSS JOIN (SELECT coalesce(sum(rank), 0) AS loose FROM r{i - 1} JOIN od USING (id) WHERE out = 0) l
        LEFT JOIN (SELECT h.dst AS id, sum(r.rank / od.out) AS got FROM h JOIN r{i - 1} r ON r.id = h.src JOIN od ON od.id = h.src GROUP BY 1) s ON s.id = v.id)""")
    return ", ".join(steps) + f" SELECT id, round(rank, {digits}) AS rank FROM r{rounds}"


@query(_rank_sql(d.TREE, "tr", 5, 10))
def pagerank_fixed_rounds(spark, sf_dir):
    return graph.pagerank(d.tree_edges(spark, sf_dir), rounds=5, tolerance=None).select("id", F.round("rank", 10).alias("rank"))


@query(_rank_sql(d.EDGES, "edge_events", 60, 7))
def pagerank(spark, sf_dir):
    return graph.pagerank(d.simple_edges(spark, sf_dir), tolerance=1e-13).select("id", F.round("rank", 7).alias("rank"))


@query(f"""WITH RECURSIVE {d.RINGS}, p(path, nxt) AS (SELECT [src], dst FROM ring WHERE src <= dst
    UNION ALL SELECT list_append(p.path, h.src), h.dst FROM p JOIN ring h ON h.src = p.nxt
    WHERE p.nxt > p.path[1] AND NOT list_contains(p.path, p.nxt) AND h.dst >= p.path[1] AND len(p.path) < 8)
    SELECT path AS cycle FROM p WHERE nxt = path[1] ORDER BY cycle LIMIT 50""")
def bounded_cycles(spark, sf_dir):
    return graph.simple_cycles(d.ring_edges(spark, sf_dir))


# Each region's pages are a tree, so labels settle within six steps.
@query(f"""WITH {d.TREE}, b AS MATERIALIZED (SELECT src AS x, dst AS y FROM tr UNION SELECT dst, src FROM tr), l0 AS (SELECT DISTINCT x AS id, x AS root FROM b), {
    ", ".join(f"l{i} AS MATERIALIZED (SELECT l.id, least(l.root, min(o.root)) AS root FROM l{i - 1} l JOIN b ON b.x = l.id JOIN l{i - 1} o ON o.id = b.y GROUP BY l.id, l.root)" for i in range(1, 8))
    } SELECT * FROM l7""")
def graph_components(spark, sf_dir):
    return graph.components(d.tree_edges(spark, sf_dir))


# In a tree all vertices with two neighbours or more are cut vertices.
@query(f"""WITH {d.TREE}, b AS (SELECT src AS id, dst AS o FROM tr UNION SELECT dst, src FROM tr) SELECT id FROM b GROUP BY id HAVING count(*) > 1""")
def articulation_points(spark, sf_dir):
    return graph.articulation_points(d.tree_edges(spark, sf_dir))


# Wheels, whose vertices all have several neighbours, with their hubs in a line and a page hung to every third customer.
@query("""SELECT 'hub ' || c_mktsegment AS id FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0""")
def cut_vertices(spark, sf_dir):
    hung = d.read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0")
    hung = hung.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("dst"))
    return graph.articulation_points(d.wheel_edges(spark, sf_dir).unionByName(hung))


def _betweenness_sql(depth: int = 8) -> str:
    steps = [f"WITH {d.GRAPH}, p0 AS (SELECT src AS s, src AS v, 0 AS n, 1.0::DOUBLE AS sigma FROM g UNION SELECT dst, dst, 0, 1.0 FROM g)"]
    for i in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT s, v FROM p{k}" for k in range(i))
        steps.append(f"""p{i} AS MATERIALIZED (SELECT p.s, g.dst AS v, {i} AS n, sum(p.sigma) AS sigma FROM p{i - 1} p JOIN g ON g.src = p.v
            WHERE (p.s, g.dst) NOT IN ({before}) GROUP BY 1, 2)""")
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(depth + 1))
    return ", ".join(steps) + f""", a AS MATERIALIZED ({every}), c AS (SELECT count(*)::DOUBLE AS c FROM p0),
    t AS (SELECT x.v AS id, sum(x.sigma * y.sigma / z.sigma) AS b FROM a x JOIN a y ON y.s = x.v JOIN a z ON z.s = x.s AND z.v = y.v AND z.n = x.n + y.n
          WHERE x.n > 0 AND y.n > 0 GROUP BY 1)
    SELECT p0.s AS id, round(coalesce(b, 0) / ((c - 1) * (c - 2)), 9) AS betweenness FROM p0 CROSS JOIN c LEFT JOIN t ON t.id = p0.s"""


@query(_betweenness_sql())
def betweenness(spark, sf_dir):
    return graph.betweenness(d.simple_edges(spark, sf_dir)).select("id", F.round("betweenness", 9).alias("betweenness"))


# Communities of stars are the stars; a community is told by its smallest member.
@query("""WITH s AS (SELECT 'n' || c_nationkey AS hub, 'c' || c_custkey AS id FROM customer), a AS (SELECT hub, id FROM s UNION SELECT hub, hub FROM s)
    SELECT id, min(id) OVER (PARTITION BY hub) AS community FROM a""")
def graph_modules(spark, sf_dir):
    found = graph.modules(d.star_edges(spark, sf_dir))
    return found.join(found.groupBy("module").agg(F.min("id").alias("community")), "module").select("id", "community")


@query("""SELECT 'c' || c_custkey AS id, min('c' || c_custkey) OVER (PARTITION BY c_mktsegment) AS community, c_mktsegment AS planted FROM customer
    UNION ALL SELECT 'hub ' || c_mktsegment, min('c' || c_custkey), c_mktsegment FROM customer GROUP BY c_mktsegment""")
def planted_modules(spark, sf_dir):
    """Five wheels whose hubs are linked: cycles all over, and most vertices have as many links as any other."""
    found = graph.modules(d.wheel_edges(spark, sf_dir))
    named = found.groupBy("module").agg(F.min("id").alias("community"), F.max(F.when(F.col("id").startswith("hub "), F.substr("id", F.lit(5)))).alias("planted"))
    return found.join(named, "module").select("id", "community", "planted")


@query(f"""WITH {d.TREE}, x AS (SELECT src AS url, count(*) AS n FROM tr GROUP BY 1)
    SELECT left(url, 1) AS label, count(*) AS page_count, arg_min(url, struct_pack(n := n, url := url)) AS entry_page, min(n) AS shallowest_depth,
           max(n) AS deepest_depth, coalesce(list_sort(list(url) FILTER (n > 15)), []) AS articulation_points FROM x GROUP BY 1""")
def module_summary(spark, sf_dir):
    m = d.tree_edges(spark, sf_dir).groupBy(F.col("src").alias("url")).agg(F.count("*").alias("click_depth"))
    m = m.select("url", "click_depth", F.lit(1).alias("module_id"), F.substring("url", 1, 1).alias("module_label"), (F.col("click_depth") > 15).alias("is_articulation_point"))
    return rules.summarize_modules(m)


# Modules whose pages share their brand only, and of one page each, which share their whole path.
@query(f"""WITH {d.PARTS}, x AS (SELECT tag AS module, ['shop-' || lower(replace(tag, '#', '-')), lower(component_type), path] AS s FROM pc UNION ALL SELECT path, ['type', lower(component_type)] FROM pc),
    n AS (SELECT module, count(*) AS n, count(DISTINCT s) AS k, count(DISTINCT s[2]) AS types, min(s) AS s FROM x GROUP BY 1),
    t AS (SELECT module, CASE WHEN k = 1 THEN s WHEN types = 1 THEN s[:2] ELSE s[:1] END AS s FROM n)
    SELECT module, array_to_string(list_transform(s, lambda y: array_to_string(list_transform(string_split(replace(y, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')), ' / ') AS label FROM t""")
def module_labels(spark, sf_dir):
    p = d.part_components(spark, sf_dir)
    brand = F.concat(F.lit("shop-"), F.lower(F.replace("tag", F.lit("#"), F.lit("-"))))
    a = p.select(F.col("tag").alias("module"), F.concat_ws("/", F.lit("https://h.example.com"), brand, F.lower("component_type"), "path").alias("url"))
    b = p.select(F.col("path").alias("module"), F.concat_ws("/", F.lit("h.example.com"), F.lit("type"), F.lower("component_type")).alias("url"))
    return rules.module_label(a.unionByName(b))


# Pages


@query(f"""WITH {d.PAGE_EVENTS} SELECT url, coalesce(arg_max(status, event_seq) FILTER (status <> 'Pending'), 'Pending') AS status,
    coalesce(arg_max(components, event_seq) FILTER (status <> 'Pending'), arg_min(components, event_seq)) AS component_count,
    coalesce(arg_max(description, event_seq) FILTER (description <> ''), '') AS description,
    coalesce(arg_max(title, event_seq) FILTER (title <> ''), '') AS title,
    arg_max(ts, event_seq) FILTER (status = 'Finished') AS visited_at FROM pe GROUP BY url""")
def current_state_fold(spark, sf_dir):
    return fold.current_pages(d.page_events(spark, sf_dir))


STATUS = d.PAGE_EVENTS + ", p AS (SELECT url, coalesce(arg_max(status, event_seq) FILTER (status <> 'Pending'), 'Pending') AS status FROM pe GROUP BY url)"


@query(f"""WITH {STATUS}, c AS (SELECT k, bool_or(event_type = 'click') AS used FROM ev GROUP BY k), e AS (SELECT DISTINCT event_type FROM ev)
    SELECT (SELECT count(*) FROM p WHERE status = 'Finished') AS pages_finished, (SELECT count(*) FROM p) AS pages,
           (SELECT round_even(100.0 * count(*) FILTER (status = 'Finished') / count(*), 0)::INT FROM p) AS pages_percent,
           (SELECT count(*) FROM c WHERE used) AS components_used, (SELECT count(*) FROM c) AS components,
           (SELECT round_even(100.0 * count(*) FILTER (used) / count(*), 0)::INT FROM c) AS components_percent,
           (SELECT count(*) FROM e WHERE event_type <> 'error') AS first_party, (SELECT count(*) FROM e) AS endpoints""")
def coverage(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir)
    comps = ev.groupBy("k").agg(F.max(F.col("event_type") == "click").alias("interacted")).withColumn("layer", F.lit("semantic"))
    ends = ev.select("event_type").distinct().withColumn("first_party", F.col("event_type") != "error")
    return reads.coverage(fold.current_pages(d.page_events(spark, sf_dir)), comps, ends)


@query(f"WITH {STATUS} SELECT url FROM p WHERE status = 'Pending' ORDER BY url LIMIT 25")
def pending_top(spark, sf_dir):
    return reads.pending(fold.current_pages(d.page_events(spark, sf_dir)), 25)


@query(f"WITH {STATUS} SELECT status, count(*) AS pages FROM p GROUP BY 1")
def page_status_counts(spark, sf_dir):
    return fold.current_pages(d.page_events(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("pages"))


@query(f"""WITH {STATUS}, cand AS (SELECT 'https://app.example.com/' || event_type || '/' || md5(user_id || '/' || k) AS url, min(event_id) AS pos FROM ev GROUP BY 1),
    done AS (SELECT 'https://app.example.com/click/' || md5(url) AS url FROM p WHERE status = 'Finished'), prior AS (SELECT {shape_sql("url")} AS shape, count(*) AS n FROM done GROUP BY 1),
    x AS (SELECT url, {clean_sql("url")} AS clean, {shape_sql("url")} AS shape, pos FROM cand WHERE url NOT IN (SELECT url FROM done))
    SELECT x.* FROM x LEFT JOIN prior USING (shape) QUALIFY row_number() OVER (PARTITION BY shape ORDER BY pos, url) + coalesce(prior.n, 0) <= 3""")
def next_frontier(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir)
    base = F.lit("https://app.example.com")
    token = F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "k"))
    cand = ev.groupBy(F.concat_ws("/", base, "event_type", token).alias("url")).agg(F.min("event_id").alias("pos"))
    done = fold.current_pages(d.page_events(spark, sf_dir)).filter("status = 'Finished'").select(F.concat_ws("/", base, F.lit("click"), F.md5("url")).alias("url"))
    return reads.next_frontier(cand, done, base, 3)


# Visits


@query(f"""WITH {d.VISITS} SELECT visit_id, count(*) AS length, arg_min(page_url, step_seq) AS start_page,
    coalesce(arg_max(target, step_seq) FILTER (navigated), arg_min(page_url, step_seq)) AS end_page,
    array_to_string(list(action ORDER BY step_seq), ',') AS actions FROM steps GROUP BY visit_id""")
def traces(spark, sf_dir):
    found = ordered.traces(d.visit_steps(spark, sf_dir))
    return found.select("visit_id", "length", "start_page", "end_page", F.array_join("steps.action", ",").alias("actions"))


@query(f"""WITH {d.VISITS} SELECT visit_id, arg_min(action || ' ' || label, step_seq) || ' on ' || coalesce(arg_max(target, step_seq) FILTER (navigated), arg_min(page_url, step_seq)) AS title
    FROM steps GROUP BY visit_id HAVING bool_or(navigated OR requests > 0)""")
def observable_trace_titles(spark, sf_dir):
    return ordered.trace_titles(ordered.observable_traces(ordered.traces(d.visit_steps(spark, sf_dir))))


@query(f"""WITH {d.RESULTS}, c AS (SELECT *, count(*) FILTER (NOT interrupted) OVER w AS done, sum(found) OVER w AS seen FROM vr
    WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT *, CASE WHEN done >= 20 THEN 'pages' WHEN seen >= 1500 THEN 'nodes' WHEN elapsed_minutes >= 20000 THEN 'minutes' END AS reason FROM c)
    SELECT run_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM x WHERE reason IS NOT NULL GROUP BY run_id""")
def budget_cut(spark, sf_dir):
    return ordered.budget_cut(d.visit_results(spark, sf_dir), pages=20, nodes=1500, minutes=20000)


@query(f"""WITH {d.RESULTS} SELECT run_id AS crawl_id, seq, round(CASE WHEN min(value) OVER w > 0 THEN value / min(value) OVER w ELSE 1 END, 6) AS ratio
    FROM vr WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def slowdown_ratio(spark, sf_dir):
    nav = d.visit_results(spark, sf_dir).select(F.col("run_id").alias("crawl_id"), "seq", F.col("value").alias("elapsed_seconds"))
    return ordered.slowdown_ratio(nav).select("crawl_id", "seq", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH RECURSIVE {d.RESULTS}, b(crawl_id, seq, fastest, wait, broken) AS (SELECT DISTINCT run_id, 0::BIGINT, 'inf'::DOUBLE, 0.0::DOUBLE, false FROM vr
    UNION ALL SELECT b.crawl_id, v.seq, least(b.fastest, v.value),
      CASE WHEN least(b.fastest, v.value) > 0 AND v.value / least(b.fastest, v.value) > 2 THEN least(greatest(b.wait, v.value * 0.5), 30) ELSE b.wait / 2 END,
      b.broken OR least(b.fastest, v.value) > 0 AND v.value / least(b.fastest, v.value) >= 4 FROM b JOIN vr v ON v.run_id = b.crawl_id AND v.seq = b.seq + 1)
    SELECT crawl_id, round(arg_max(fastest, seq), 6) AS fastest, round(arg_max(wait, seq), 6) AS wait, arg_max(broken, seq) AS broken FROM b GROUP BY 1""")
def backoff_state(spark, sf_dir):
    nav = d.visit_results(spark, sf_dir).select(F.col("run_id").alias("crawl_id"), "seq", F.col("value").alias("elapsed_seconds"))
    return ordered.backoff_state(nav).select("crawl_id", F.round("fastest", 6).alias("fastest"), F.round("wait", 6).alias("wait"), "broken")


@query(f"""WITH {d.RESULTS} SELECT run_id AS crawl_id, round(min(value), 6) AS fastest, 0.0::DOUBLE AS wait, false AS broken FROM vr GROUP BY 1""")
def backoff_off(spark, sf_dir):
    """Without a ceiling only the fastest time is kept, however slow a site becomes."""
    nav = d.visit_results(spark, sf_dir).select(F.col("run_id").alias("crawl_id"), "seq", F.col("value").alias("elapsed_seconds"))
    return ordered.backoff_state(nav, ceiling=None).select("crawl_id", F.round("fastest", 6).alias("fastest"), "wait", "broken")


@query(f"""WITH {d.RESULTS}, i AS (SELECT run_id, url, count(*) AS n FROM vr WHERE interrupted GROUP BY ALL HAVING count(*) > 1)
    SELECT run_id, count(*) AS visits, count(DISTINCT CASE WHEN NOT interrupted THEN url END) AS unique_pages,
           count(*) FILTER (interrupted) AS requeued, (SELECT count(*) FROM i WHERE i.run_id = vr.run_id) AS gave_up FROM vr GROUP BY run_id""")
def run_totals(spark, sf_dir):
    return ordered.run_totals(d.visit_results(spark, sf_dir), most=1)


SNAPSHOTS = d.EVENTS + """, snap AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list_distinct(list(k))) AS ids FROM ev GROUP BY ALL)"""


def _snapshots(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir)
    return ev.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_set("k")).alias("identities"))


@query(f"""WITH {SNAPSHOTS}, x AS (SELECT *, lag(ids) OVER w AS before, lag(day) OVER w AS previous FROM snap WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, previous, day, round(len(list_intersect(before, ids)) / len(before), 6) AS overlap FROM x
    WHERE before IS NOT NULL AND len(list_intersect(before, ids)) / len(before) < 0.5""")
def state_transitions(spark, sf_dir):
    found = ordered.state_transitions(_snapshots(spark, sf_dir), "user_id", "day")
    return found.withColumn("overlap", F.round("overlap", 6))


# Requests

SEGMENTS = "list_filter(string_split(path, '/'), lambda s: s <> '')"
PATTERN_SQL = f"'/' || array_to_string(list_transform({SEGMENTS}, lambda s: CASE WHEN {opaque_sql('s')} THEN '{{id}}' ELSE s END), '/')"


@query(f"""WITH {d.REQUESTS} SELECT method, host, {PATTERN_SQL} AS path_pattern, count(*) AS call_count,
    arg_min(is_first_party, event_seq) AS first_party, ['id'] AS path_params FROM rq GROUP BY 1, 2, 3""")
def endpoint_counts(spark, sf_dir):
    return fold.endpoint_counts(d.requests(spark, sf_dir))


@query(f"WITH {d.REQUESTS} SELECT event_seq, {PATTERN_SQL} AS pattern, ['id'] AS params FROM rq")
def endpoint_templates(spark, sf_dir):
    path = F.col("path")
    return d.requests(spark, sf_dir).select("event_seq", urls.path_pattern(path).alias("pattern"), urls.path_params(path).alias("params"))


def _endpoint_requests(spark, sf_dir):
    rq = d.requests(spark, sf_dir)
    none = F.lit(None).cast("string")
    page = F.concat(F.lit("page"), (F.col("o_custkey") % 9).cast("string"))
    return rq.select(
        "o_orderpriority", F.col("o_orderpriority").alias("endpoint_id"), "is_first_party", "status", "latency_ms",
        F.array(F.concat(F.lit("q"), (F.col("event_seq") % 4).cast("string"))).alias("query_params"),
        F.when(F.col("method") == "GET", "bearer").otherwise("").alias("auth_scheme"), F.lit("application/json").alias("media_type"),
        page.alias("page_url"), F.when(F.col("event_seq") % 2 == 0, F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string"))).alias("path"),
        none.alias("request_body"), F.concat(F.lit('{"n":'), F.col("event_seq").cast("string"), F.lit("}")).alias("response_body"),
    )


ENDPOINTS = d.REQUESTS + """, er AS (SELECT o_orderpriority AS endpoint_id, is_first_party, status, latency_ms, 'q' || (event_seq % 4) AS q,
    CASE WHEN method = 'GET' THEN 'bearer' ELSE '' END AS auth_scheme, 'page' || (o_custkey % 9) AS page_url,
    CASE WHEN event_seq % 2 = 0 THEN 'c' || (o_custkey % 5) END AS path, '{"n":' || event_seq || '}' AS body FROM rq)"""


@query(f"""WITH {ENDPOINTS} SELECT endpoint_id, list_sort(list(DISTINCT q)) AS query_params, list_sort(list(DISTINCT status)) AS status_codes,
    coalesce(list_sort(list(DISTINCT auth_scheme) FILTER (auth_scheme <> '')), []) AS auth_schemes, ['application/json'] AS media_types,
    count(*) AS n_latencies, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms, count(DISTINCT page_url || path) AS n_callers,
    list_sort(list(DISTINCT page_url) FILTER (path IS NULL)) AS loaded_by,
    arg_min(body, struct_pack(n := length(body), b := body)) FILTER (status BETWEEN 200 AND 299) AS response_example
    FROM er WHERE is_first_party GROUP BY endpoint_id""")
def inferred_requests(spark, sf_dir):
    found = rules.inferred_requests(_endpoint_requests(spark, sf_dir))
    return found.select(
        "endpoint_id", "query_params", "status_codes", "auth_schemes", "media_types", "n_latencies", "least_ms", "most_ms",
        F.size("triggered_by").cast("long").alias("n_callers"),
        "loaded_by", "response_example",
    )


@query(f"""WITH {ENDPOINTS} SELECT endpoint_id, list_sort(list(DISTINCT status)) AS status_codes,
    coalesce(list_sort(list(DISTINCT auth_scheme) FILTER (auth_scheme <> '')), []) AS auth_schemes, ['application/json'] AS media_types
    FROM er WHERE endpoint_id = '5-LOW' GROUP BY 1""")
def endpoint_contract(spark, sf_dir):
    rq = _endpoint_requests(spark, sf_dir)
    return rules.endpoint_contract(rq.select("endpoint_id").distinct(), rq, "5-LOW")


@query("""SELECT DISTINCT o_orderpriority AS endpoint_id, c_mktsegment AS page_url, 's' || l_suppkey AS path FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey""")
def callers_of(spark, sf_dir):
    t = {x: d.read(spark, sf_dir, x) for x in ("orders", "lineitem", "customer", "supplier")}
    calls = t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey"))
    calls = calls.join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))
    calls = calls.select(F.col("o_orderpriority").alias("endpoint_id"), F.col("c_mktsegment").alias("page_url"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"))
    return reads.callers_of(calls)


@query("""SELECT sha256(text) AS hash, strlen(arg_min(text, doc_id))::BIGINT AS length, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def payload_dedup(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").filter("text is not null")
    bodies = docs.select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("length"), F.lit("").alias("content"), F.col("doc_id").alias("event_seq"))
    return fold.payloads(bodies).select("hash", "length", "uses")


# Word characters beyond ASCII end a card number for Spark; here they are spelled out.
EDGE = r"[\p{L}\p{N}_]"


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[REDACTED]', 'g') AS t FROM documents)
    SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM a""")
def redacted_mail(spark, sf_dir):
    clean = F.regexp_replace("text", network.EMAIL, network.REDACTED)
    return d.read(spark, sf_dir, "documents").select("doc_id", F.char_length(clean).cast("long").alias("chars"), F.sha2(clean, 256).alias("digest"))


@query()
def redacted_documents(spark, sf_dir):
    body = network.truncate_and_hash(F.col("text")).alias("b")
    return d.read(spark, sf_dir, "documents").select("doc_id", body).select("doc_id", F.char_length("b.excerpt").alias("chars"), "b.length", "b.hash")


@query(f"""WITH {d.EVENTS} SELECT event_id, CASE event_type WHEN 'click' THEN 'bearer' WHEN 'view' THEN 'header:x-api-key' WHEN 'error' THEN 'cookie' ELSE '' END AS auth,
    CASE WHEN event_type = 'signup' THEN 'text/html' ELSE '' END AS media FROM ev""")
def auth_and_media(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "click", "Authorization").when(kind == "view", "X-Api-Key").when(kind == "error", "Cookie").otherwise("Content-Type")
    value = F.when(kind == "click", "Bearer abc").when(kind == "signup", "Text/HTML; charset=utf-8").when(kind == "purchase", "").otherwise("v")
    headers = F.create_map(name, value)
    return d.event_rows(spark, sf_dir).select("event_id", network.auth_scheme(headers).alias("auth"), network.media_type(headers).alias("media"))


@query(f"""WITH {d.EVENTS}, s AS (SELECT event_type, json_object('k', 'number') AS shape FROM ev WHERE k IS NOT NULL)
    SELECT event_type, 'k' AS key, 'number' AS type, true AS required FROM s GROUP BY 1""")
def merged_shapes(spark, sf_dir):
    ev = d.read(spark, sf_dir, "events").select("event_type", network.json_shape(F.col("props")).alias("shape"))
    return rules.merge_shapes(ev, ["event_type"])


@query(f"""WITH {d.REQUESTS}, e AS (SELECT DISTINCT method, host FROM rq)
    SELECT method, host, '/orders/{{orderId}}/items' AS path_template, CASE method WHEN 'POST' THEN 'createItem' ELSE 'getItem' END AS operation_id,
           CASE method WHEN 'POST' THEN 'Create item' ELSE 'Get item' END AS summary, ['orderId'] AS parameters FROM e""")
def api_operations(spark, sf_dir):
    found = fold.endpoint_counts(d.requests(spark, sf_dir)).withColumn("query_params", F.array().cast("array<string>"))
    return rules.api_operations(found)


@query(f"""WITH l AS (SELECT {host_sql("url")} AS host, count(*) AS calls FROM pages GROUP BY 1),
    t AS (SELECT *, row_number() OVER (ORDER BY calls DESC, host) AS n FROM l)
    SELECT CASE WHEN n <= 15 THEN host ELSE 'other' END AS host, sum(calls)::BIGINT AS calls FROM t GROUP BY 1""")
def host_traffic_topk(spark, sf_dir):
    ends = d.read(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host"), F.lit(1).alias("call_count"))
    return ordered.top_with_rest(rules.hosts_by_traffic(ends), "host", "calls")


# Components


@query(f"""WITH {d.PARTS}, s AS (SELECT DISTINCT tag, component_type, tokens FROM pc)
    SELECT a.tag, a.component_type, count(*) AS pairs FROM s a JOIN s b ON a.tag = b.tag AND a.component_type = b.component_type AND a.tokens < b.tokens
    WHERE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.5 GROUP BY ALL""")
def family_pairs(spark, sf_dir):
    found = similarity.class_similarity_pairs(d.part_components(spark, sf_dir))
    return found.groupBy("tag", "component_type").agg(F.count("*").alias("pairs"))


@query(f"""WITH RECURSIVE {d.PARTS}, s AS (SELECT DISTINCT tag, component_type, tokens FROM pc),
    l AS (SELECT a.tag, a.component_type, a.tokens AS x, b.tokens AS y FROM s a JOIN s b ON a.tag = b.tag AND a.component_type = b.component_type
          WHERE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.5),
    r(tag, component_type, x, root) AS (SELECT tag, component_type, x, x FROM l UNION
          SELECT l.tag, l.component_type, l.y, r.root FROM r JOIN l ON l.tag = r.tag AND l.component_type = r.component_type AND l.x = r.x),
    m AS (SELECT tag, component_type, x, min(root) AS root FROM r GROUP BY ALL)
    SELECT pc.tag, pc.component_type, count(*) AS members, min(pos) AS first FROM pc JOIN m ON m.tag = pc.tag AND m.component_type = pc.component_type AND m.x = pc.tokens
    GROUP BY pc.tag, pc.component_type, m.root HAVING count(*) > 1""")
def families(spark, sf_dir):
    found = similarity.component_families(d.part_components(spark, sf_dir))
    return found.groupBy("family_id", "tag", "component_type").agg(F.count("*").alias("members"), F.min("pos").alias("first")).drop("family_id")


def _typed(spark, sf_dir):
    """Parts with their type as the family; one in three has no text."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.split("css_class", " "), lambda x: x != "")))
    own = d.part_components(spark, sf_dir).withColumn("text", F.when(F.col("pos") % 3 > 0, F.col("text")).otherwise(""))
    return own.withColumn("family_id", F.col("component_type")).withColumn("tokens", tokens)


@query(f"""WITH {d.PARTS}, n AS (SELECT component_type, count(*) AS n FROM pc GROUP BY 1),
    t AS (SELECT component_type, unnest(tokens) AS token FROM pc), u AS (SELECT component_type, token, count(*) AS c FROM t GROUP BY ALL),
    cm AS (SELECT n.component_type, coalesce(list(token) FILTER (u.c = n.n), []) AS common FROM n LEFT JOIN u USING (component_type) GROUP BY 1)
    SELECT pc.component_type AS family_id, array_to_string(list_sort(list_filter(tokens, lambda x: NOT list_contains(common, x))), ' ') AS extra_classes,
           background_color, count(*) AS count, coalesce(arg_min(text, pos) FILTER (pos % 3 > 0), '') AS example FROM pc JOIN cm USING (component_type) GROUP BY ALL""")
def variant_table(spark, sf_dir):
    own = _typed(spark, sf_dir)
    return rules.catalog_variants(own, similarity.common_classes(own))


# Of each family: a text that all have, one that some lack, one that none has, booleans and lists.
@query("""WITH p AS (SELECT p_type AS family_id, p_partkey AS pos, p_size, p_brand, p_name FROM part),
    l AS (SELECT family_id, pos, 'label' AS prop, 'string' AS kind, family_id AS shown, family_id AS value, true AS there FROM p
    UNION ALL SELECT family_id, pos, 'placeholder', 'string', CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_size > 40 THEN 'size' END, p_size > 40 FROM p
    UNION ALL SELECT family_id, pos, 'required', 'boolean', 'true', 'true', true FROM p
    UNION ALL SELECT family_id, pos, 'disabled', 'boolean', (p_size = 1)::VARCHAR, (p_size = 1)::VARCHAR, p_size = 1 FROM p
    UNION ALL SELECT family_id, pos, 'option_labels', 'list', CASE WHEN p_size % 2 = 0 THEN p_brand || ', ' || p_name ELSE '' END, CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_name ELSE '' END, p_size % 2 = 0 FROM p)
    SELECT family_id, prop, kind, count(*) FILTER (there) AS present, count(DISTINCT value) + bool_or(value IS NULL)::INT > 1 AS varies, arg_min(shown, pos) FILTER (there) AS example
    FROM l GROUP BY ALL HAVING bool_or(there)""")
def prop_table(spark, sf_dir):
    size = F.col("p_size")
    members = d.read(spark, sf_dir, "part").select(
        F.col("p_type").alias("family_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("label"), F.when(size > 40, "size").alias("placeholder"),
        F.lit("").alias("name"), F.lit(None).cast("string").alias("href"), F.lit("").alias("form"), F.lit(True).alias("required"), (size == 1).alias("disabled"),
        F.when(size % 2 == 0, F.array("p_brand", "p_name")).otherwise(F.array().cast("array<string>")).alias("option_labels"),
    )
    return rules.catalog_props(members)


@query(f"WITH {d.PARTS} SELECT component_type AS family_id, list_sort(list(DISTINCT background_color)) AS colors FROM pc GROUP BY 1 HAVING count(DISTINCT background_color) >= 2")
def style_conflicts(spark, sf_dir):
    return rules.style_conflicts(_typed(spark, sf_dir)).select("family_id", "colors")


@query("""SELECT o_orderpriority AS endpoint_id, list_sort(list(DISTINCT c_mktsegment)) AS labels FROM orders JOIN customer ON c_custkey = o_custkey
    GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 2""")
def naming_conflicts(spark, sf_dir):
    calls = d.read(spark, sf_dir, "orders").join(d.read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rules.naming_conflicts(calls.select(F.col("o_orderpriority").alias("endpoint_id"), F.col("c_mktsegment").alias("label")))


@query(f"""WITH {d.PARTS}, t AS (SELECT 'page' || (s_suppkey % 40) AS page_url, (s_suppkey % 50)::DOUBLE AS x, abs(s_acctbal) AS y FROM supplier)
    SELECT page_url, path FROM pc WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_url = pc.page_url AND abs(t.x - pc.x) <= 120 AND abs(t.y - pc.y) <= 120)""")
def band_anti_join(spark, sf_dir):
    sup = d.read(spark, sf_dir, "supplier")
    texts = sup.select(F.concat(F.lit("page"), (F.col("s_suppkey") % 40).cast("string")).alias("page_url"), (F.col("s_suppkey") % 50).cast("double").alias("x"), F.abs("s_acctbal").alias("y"))
    return reads.disabled_without_text(d.part_components(spark, sf_dir), texts).select("page_url", "path")


@query(f"""WITH {d.PARTS} SELECT p_size * 5 AS r, ((p_partkey % 50) * 5)::INT AS g, 40 AS b, count(*) AS uses,
    format('#{{:02x}}{{:02x}}{{:02x}}', p_size * 5, ((p_partkey % 50) * 5)::INT, 40) AS hex FROM part GROUP BY ALL""")
def color_usage(spark, sf_dir):
    found = rules.color_usage(d.part_components(spark, sf_dir), "background_color")
    return found.withColumn("hex", colors.to_hex(F.col("r"), F.col("g"), F.col("b")))


@query(f"""WITH RECURSIVE {d.LAB_COLORS} SELECT x.r, x.g, x.b, x.uses, y.r * 65536 + y.g * 256 + y.b AS leader FROM led x JOIN led y ON y.role = x.role AND y.i = x.lead WHERE x.role = 'surface'""")
def color_clusters(spark, sf_dir):
    return similarity.color_clusters(rules.color_usage(d.part_components(spark, sf_dir), "background_color"))


@query("""WITH RECURSIVE c AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL
    SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), a(id, ancestor, distance) AS (SELECT child, parent, 1 FROM c WHERE child LIKE 'c%'
    UNION ALL SELECT a.id, c.parent, a.distance + 1 FROM a JOIN c ON c.child = a.ancestor) SELECT * FROM a""")
def container_ancestors(spark, sf_dir):
    return graph.ancestors(*_containment(spark, sf_dir))


def _containment(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cust = d.read(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"), F.lit("component").alias("child_kind"))
    nat = d.read(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"), F.lit("container").alias("child_kind"))
    return cust.unionByName(nat), cust.select(F.col("child").alias("id"))


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'nav' ELSE r_name END AS region FROM customer
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def nearest_region(spark, sf_dir):
    contains, comps = _containment(spark, sf_dir)
    reg = d.read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("container"), F.col("r_name").alias("landmark"))
    nav = d.read(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("container"), F.lit("nav").alias("landmark"))
    return graph.nearest_region(graph.ancestors(contains, comps), reg.unionByName(nav))


@query("""SELECT 'c' || c_custkey AS child, 'component' AS child_kind FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT 'n' || n_nationkey, 'container' FROM nation WHERE n_regionkey = 1""")
def components_in_region(spark, sf_dir):
    return graph.components_in(_containment(spark, sf_dir)[0], "r1")


@query(f"""WITH {d.EVENTS} SELECT user_id, event_type AS field, list_sort(list(DISTINCT k)) AS observed_values FROM ev GROUP BY ALL""")
def entity_fields(spark, sf_dir):
    ev = d.event_rows(spark, sf_dir).select("user_id", F.col("event_type").alias("field"), F.lit("fill").alias("action"), F.col("k").alias("value"))
    return rules.observed_values(ev, ["user_id", "field"])


@query("""WITH x AS (SELECT source, doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) / 5)::INT AS chunk FROM documents)
    SELECT * FROM x""")
def prompt_chunks(spark, sf_dir):
    return ordered.chunked(d.read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"]).drop("n_chars")


@query("""WITH s AS (SELECT source, lang || (n_chars % 40) AS t, min(doc_id) AS pos FROM documents GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, t) AS n FROM s)
    SELECT source, list(t ORDER BY n) FILTER (n <= 20) AS texts, greatest(count(*) - 20, 0) AS omitted FROM r GROUP BY source""")
def first_texts(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").select("source", "doc_id", F.concat("lang", (F.col("n_chars") % 40).cast("string")).alias("t"))
    return ordered.first_texts(docs, "source", "t", "doc_id")


@query("""WITH tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
    n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok), w AS (SELECT id, len(t) AS len, unnest(t) AS word FROM tok),
    tf AS (SELECT id, word, count(*) AS tf, first(len) AS len FROM w WHERE word IN ('the', 'token', 'email') GROUP BY ALL),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
    SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
    FROM tf JOIN df USING (word), n GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def text_search(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return reads.search_text(docs, ["the", "token", "email"])


def _bm25_sql(table: str, rows: str, words: tuple[str, ...], limit: int) -> str:
    asked = ", ".join(f"'{x}'" for x in words)
    return f"""SELECT '{table}' AS source, * FROM (WITH tok AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM ({rows})),
    n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok), w AS (SELECT id, len(t) AS len, unnest(t) AS word FROM tok),
    tf AS (SELECT id, word, count(*) AS tf, first(len) AS len FROM w WHERE word IN ({asked}) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
    SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
    FROM tf JOIN df USING (word), n GROUP BY id ORDER BY score DESC, id LIMIT {limit})"""


SEARCHED = (
    ("TextContent", "SELECT doc_id AS id, text AS t FROM documents", ("the", "token", "email"), 10),
    ("Component", "SELECT p_partkey AS id, p_name AS t FROM part", ("blue", "widget"), 10),
    ("Page", "SELECT c_custkey AS id, c_name || ' in ' || c_mktsegment AS t FROM customer", ("building", "machinery"), 10),
    ("ComponentFamily", "SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderstatus AS t FROM orders", ("urgent", "o"), 10),
)


@query(" UNION ALL ".join(_bm25_sql(*x) for x in SEARCHED))
def indexed_search(spark, sf_dir):
    """The four prose columns indexed by term, and a search in each."""
    path, found = shared_path(spark, "search-index"), None
    for table, rows, words, limit in SEARCHED:
        name = rows.rsplit(" ", 1)[1]
        d.read(spark, sf_dir, name).createOrReplaceTempView(f"searched_{name}")
        own = spark.sql(rows.replace(f"FROM {name}", f"FROM searched_{name}")).withColumnRenamed("t", search.TARGETS[table])
        search.build_index(own, table, path)
        best = search.search_index(spark, path, table, list(words), limit).select(F.lit(table).alias("source"), "id", "score")
        found = best if found is None else found.unionAll(best)
    return found


# Streams: all files that are there, through the streaming form, to the batch answer


def _staged(spark, df, name, keep=False):
    """``df`` as files of a stream, in its own partitions if they are to be kept."""
    path = shared_path(spark, f"stream-{name}")
    (df if keep else df.repartition(4)).write.parquet(path)
    return live.observation_stream(spark, path, df.schema, files=2)


def _streamed(spark, df, name, mode="complete"):
    """Runs a stream to its end; the last batch of a complete result, or all of an append one."""
    out, check = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-check")
    keep = "overwrite" if mode == "complete" else "append"
    live.run_available_to(df, check, lambda batch, n: batch.write.mode(keep).parquet(out), mode)
    return spark.read.schema(df.schema).parquet(out)


@query(ORACLES["nav_edges"])
def stream_edge_counts(spark, sf_dir):
    return _streamed(spark, live.live_edges(_staged(spark, d.edge_events(spark, sf_dir), "edges")), "edges")


@query(ORACLES["current_state_fold"])
def stream_page_state(spark, sf_dir):
    return _streamed(spark, live.live_pages(_staged(spark, d.page_events(spark, sf_dir), "pages")), "pages")


@query(ORACLES["endpoint_counts"])
def stream_endpoint_counts(spark, sf_dir):
    return _streamed(spark, live.live_endpoints(_staged(spark, d.requests(spark, sf_dir), "requests")), "requests")


@query("SELECT event_id, event_type FROM events")
def stream_redelivery(spark, sf_dir):
    ev = d.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return _streamed(spark, live.once(_staged(spark, ev.union(ev), "twice"), "60 days"), "twice", "append").select("event_id", "event_type")


@query(f"""WITH RECURSIVE {d.RESULTS}, b(crawl_id, seq, fastest, wait, broken, ratio) AS (SELECT DISTINCT run_id, 0::BIGINT, 'inf'::DOUBLE, 0.0::DOUBLE, false, 0.0::DOUBLE FROM vr
    UNION ALL SELECT b.crawl_id, v.seq, least(b.fastest, v.value), CASE WHEN least(b.fastest, v.value) > 0 AND v.value / least(b.fastest, v.value) > 2 THEN least(greatest(b.wait, v.value * 0.5), 30) ELSE b.wait / 2 END,
      b.broken OR least(b.fastest, v.value) > 0 AND v.value / least(b.fastest, v.value) >= 4, CASE WHEN least(b.fastest, v.value) > 0 THEN v.value / least(b.fastest, v.value) ELSE 1 END FROM b JOIN vr v ON v.run_id = b.crawl_id AND v.seq = b.seq + 1)
    SELECT crawl_id::VARCHAR AS crawl_id, seq, round(ratio, 6) AS ratio, round(wait, 6) AS wait, broken FROM b WHERE seq > 0""")
def stream_slowdown(spark, sf_dir):
    nav = d.visit_results(spark, sf_dir).select(F.col("run_id").cast("string").alias("crawl_id"), "seq", F.col("value").alias("elapsed_seconds"))
    # A crawl's navigations come in order, as they happen: here in four files, one after the other.
    path, stored = shared_path(spark, "stream-nav"), materialize(nav, "nav")
    last = stored.agg(F.max("seq")).first()[0] or 0
    for part in range(4):
        stored.filter(F.col("seq").between(last * part // 4 + 1, last * (part + 1) // 4)).coalesce(1).write.mode("append").parquet(path)
    found = _streamed(spark, live.slowdown_monitor(live.observation_stream(spark, path, stored.schema, files=1)), "nav", "append")
    return found.select("crawl_id", "seq", F.round("ratio", 6).alias("ratio"), F.round("wait", 6).alias("wait"), "broken")
