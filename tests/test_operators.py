import itertools
import random

import pytest
from pyspark.sql import functions as F

from siteloom import registry
from siteloom.operators import fold, graph, ordered, reads, rules, similarity
from siteloom.plans.shared import shared_path
from siteloom.sources import html, tables
from siteloom.streaming import live

PAGE = "url string, status string, components long, description string, title string, event_seq long, ts timestamp"


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


# Folds


def test_pending_never_clobbers(spark):
    events = [("a", "Pending", 0, "", "t", 1), ("a", "Finished", 5, "d", "", 2), ("a", "Pending", 9, "", "", 3), ("b", "Pending", 2, None, None, 1), ("b", "Pending", 7, None, None, 2)]
    df = spark.createDataFrame([(*x, None) for x in events], PAGE)
    got = rows_of(fold.current_pages(df))
    assert got == [("a", "Finished", 5, "d", "t", None), ("b", "Pending", 2, "", "", None)]
    known = fold.ensure_pages(fold.current_pages(df), spark.createDataFrame([("a",), ("c",), (None,)], "url string"))
    assert [x[:3] for x in rows_of(known)] == [("a", "Finished", 5), ("b", "Pending", 2), ("c", "Pending", 0)]
    assert fold.current_pages(df.limit(0)).count() == 0


def test_edges_keep_runs(spark):
    rows = [("a", "b", "c", "GO", "", 1), ("a", "b", "c", "GO", "r1", 2), ("a", "b", "c", "GO", "r2", 3), ("a", "b", "c", "GO", "", 4)]
    df = spark.createDataFrame([(*x, None) for x in rows], "`from` string, `to` string, component string, action string, run_id string, event_seq long, ts timestamp")
    assert rows_of(fold.current_edges(df)) == [("a", "b", "c", "GO", 4, "r1", "r2", None)]


def test_last_event_replaces_all(spark):
    df = spark.createDataFrame([("p", "x", "old", 1, 1), ("p", "x", None, None, 2)], "page_url string, path string, text string, width int, event_seq long")
    assert rows_of(fold.current_rows(df, ["page_url", "path"], ["text", "width"])) == [("p", "x", None, None)]


def test_containment_is_direct(spark):
    df = spark.createDataFrame([("p", "c", [("b",), ("a",)]), ("p", "d", [("b",), ("a",)]), ("p", "e", [])], "page_url string, path string, ancestors array<struct<path:string>>")
    assert rows_of(fold.current_containment(df)) == [("p", "a", "b", "container"), ("p", "b", "c", "component"), ("p", "b", "d", "component")]


def test_state_styles_and_options(spark):
    df = spark.createDataFrame([("p", "x", {"hover": {"color": "red", "opacity": ""}}, 1), ("p", "x", {"hover": {"color": "blue"}}, 2)], "page_url string, path string, states map<string,map<string,string>>, event_seq long")
    assert rows_of(fold.current_state_styles(df)) == [("p", "x", "hover", "color", "blue")]
    df = spark.createDataFrame([("p", "x", [("a", True), ("b", False)], 1), ("p", "x", [("c", True)], 2)], "page_url string, path string, options array<struct<text:string,selected:boolean>>, event_seq long")
    assert rows_of(fold.current_options(df)) == [("p", "x", 0, "c", True)]


def test_metrics_keep_old_values(spark):
    pages = spark.createDataFrame([("a", 1), ("b", 2)], "url string, depth int")
    fresh = spark.createDataFrame([("a", 9, "m")], "url string, depth int, label string")
    assert rows_of(fold.write_metrics(pages, fresh, ["url"])) == [("a", 9, "m"), ("b", 2, None)]


def test_groups_and_navigation(spark):
    members = spark.createDataFrame([("p", "g", "x", 0), ("p", "g", "y", 1)], "page_url string, name string, path string, pos int")
    groups = fold.consolidate_groups(members, ["page_url", "name"])
    events = spark.createDataFrame([("p", "y", 1), ("p", "z", 2)], "page_url string, path string, event_seq long")
    got = fold.redirect_members(events, groups.drop("name"), ["page_url"]).select("path", "source_path")
    assert rows_of(got) == [("x", "y"), ("z", "z")]
    inter = spark.createDataFrame([("a.com", "http://a.com", "b", "CLICK", "http://a.com/x", "r", 1), ("a.com", "http://a.com", "b", "CLICK", "https://www.a.com/", "r", 2)], "page_url string, literal_url string, path string, action string, resulting_url string, run_id string, event_seq long").withColumn("ts", F.lit(None).cast("timestamp"))
    assert [x[:2] for x in rows_of(fold.navigation_edges(inter))] == [("a.com", "a.com/x")]


def test_reset_hides_history(spark):
    events = spark.createDataFrame([("s", 1), ("s", 5), ("t", 1)], "site string, event_seq long")
    resets = spark.createDataFrame([("s", 3)], "site string, event_seq long")
    assert rows_of(fold.without_reset(events, resets)) == [("s", 5), ("t", 1)]


# Reads


def test_external_pages_do_not_count(spark):
    pages = spark.createDataFrame([("a", "Finished"), ("b", "External"), ("c", "Pending")], "url string, status string")
    assert rows_of(reads.count_visited(pages)) == [(1, 2)]
    assert rows_of(reads.count_visited(pages.limit(0))) == [(0, 0)]
    assert [x.url for x in reads.progress_table(pages).collect()] == ["b", "c", "a"]


def test_unstamped_requests_fall_back(spark):
    inter = spark.createDataFrame([("p", "x", "v", 1), ("p", "y", "v", 2)], "page_url string, path string, visit_id string, step_seq long")
    req = spark.createDataFrame([("p", "x", "v", 1, "one"), ("p", "x", None, None, "none"), ("p", "y", None, None, "loose")], "page_url string, path string, visit_id string, step_seq long, request_path string")
    assert [x[-1] for x in rows_of(reads.interaction_requests(inter, req))] == ["one", "loose"]


def test_frontier_moves_to_equal_identity(spark):
    rest = spark.createDataFrame([("a", "i"), ("b", "j"), ("c", "k")], "path string, identity string")
    fresh = spark.createDataFrame([("a", "z", 0), ("q", "j", 2), ("r", "j", 1)], "path string, identity string, pos int")
    got = {x.path: x.now for x in reads.remap_frontier(rest, fresh).collect()}
    assert got == {"a": "a", "b": "r"}


def test_next_frontier_counts_prior_visits(spark):
    t = ["A1b2C3d4E5f6G7h8" + x for x in "abcd"]
    cand = spark.createDataFrame([(f"https://h.com/o/{x}", i) for i, x in enumerate(t)] + [("https://else.com", 9), ("mailto:x", 10), ("https://h.com/p#f", 11), ("https://h.com/p", 12)], "url string, pos int")
    done = spark.createDataFrame([(f"https://h.com/o/{t[0]}",)], "url string")
    got = [x.url for x in reads.next_frontier(cand, done, F.lit("h.com"), 3).orderBy("pos").collect()]
    assert got == [f"https://h.com/o/{t[1]}", f"https://h.com/o/{t[2]}", "https://h.com/p#f"]


def test_ledger_and_redirects(spark):
    comps = spark.createDataFrame([("p", "x"), ("p", "y")], "page_url string, path string")
    inter = spark.createDataFrame([("p", "x", "CLICK", "", "q", "v", 2, 7), ("p", "x", "FILL", "t", "p", "v", 1, 5)], "page_url string, path string, action string, value string, resulting_url string, visit_id string, step_seq long, event_seq long")
    req = spark.createDataFrame([], "page_url string, path string, method string, request_path string, status long, failed boolean, visit_id string, step_seq long, event_seq long")
    opt = spark.createDataFrame([("p", "y", 0, "o", True)], "page_url string, path string, seq int, text string, selected boolean")
    got = {x.path: x for x in reads.component_ledger(comps, inter, req, opt).collect()}
    assert [x.resulting_url for x in got["x"].interactions] == ["", "q"] and got["y"].interactions is None and got["y"].options[0].text == "o"
    edges = spark.createDataFrame([("p", "z", "y")], "`from` string, `to` string, component string")
    assert {x.path: x.redirect for x in reads.component_redirects(comps, inter, edges).collect()} == {"x": "q", "y": "z"}


# Ordered


def test_backoff_and_budget(spark):
    nav = spark.createDataFrame([("c", i, x) for i, x in enumerate([2.0, 1.0, 3.0, 1.0])], "crawl_id string, seq long, elapsed_seconds double")
    assert rows_of(ordered.backoff_state(nav)) == [("c", 1.0, 0.75, False)]
    assert rows_of(ordered.backoff_state(nav, ceiling=None)) == [("c", 1.0, 0.0, False)]
    visits = spark.createDataFrame([("r", 1, 3, False, 0.0), ("r", 2, 3, True, 1.0), ("r", 3, 3, False, 2.0)], "run_id string, seq long, found long, interrupted boolean, elapsed_minutes double")
    assert rows_of(ordered.budget_cut(visits, pages=2, nodes=9)) == [("r", 3, "pages")]
    assert rows_of(ordered.budget_cut(visits, minutes=1)) == [("r", 2, "minutes")]


def test_snapshots(spark):
    df = spark.createDataFrame([("p", 1, ["a", "b"]), ("p", 2, ["a"]), ("p", 3, ["z"])], "page string, n int, identities array<string>")
    assert rows_of(ordered.state_transitions(df, "page", "n")) == [("p", 2, 3, 0.0)]
    empty = df.select(ordered.overlap_ratio(F.array().cast("array<string>"), F.col("identities")).alias("o")).first().o
    assert empty == 1.0
    comps = spark.createDataFrame([(1, True, "x"), (1, True, "y"), (2, True, "y"), (2, True, "x"), (2, False, "w")], "s int, visible boolean, identity string")
    assert len({x.signature for x in ordered.snapshot_signature(comps, ["s"]).collect()}) == 1


# Graph


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)})


def parts(nodes, pairs):
    left, count = set(nodes), 0
    while left:
        todo, count = [left.pop()], count + 1
        while todo:
            x = todo.pop()
            for a, b in pairs:
                for y in (b,) * (a == x) + (a,) * (b == x):
                    if y in left:
                        left.discard(y)
                        todo.append(y)
    return count


@pytest.mark.parametrize("seed", [1, 2])
def test_articulation_points(spark, seed):
    edges = random_edges(14, 15, seed)
    nodes = {x for e in edges for x in e}
    pairs = [e for e in edges if e[0] != e[1]]
    whole = parts(nodes, pairs)
    want = {v for v in nodes if parts(nodes - {v}, [e for e in pairs if v not in e]) > whole - (not any(v in e for e in pairs))}
    got = {x.id for x in graph.articulation_points(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_betweenness_depth_and_cycles(spark):
    edges = random_edges(7, 14, 3)
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = sorted({x for e in edges for x in e})
    out = {v: sorted({b for a, b in edges if a == v and b != v}) for v in nodes}

    def shortest(s):
        dist, paths, level = {s: 0}, {s: [[s]]}, [s]
        while level:
            nxt = []
            for v in level:
                for w in out[v]:
                    if w not in dist:
                        dist[w], paths[w] = dist[v] + 1, []
                        nxt.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += [p + [w] for p in paths[v]]
            level = nxt
        return dist, paths

    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        _, paths = shortest(s)
        for t, ps in paths.items():
            for p in ps:
                for v in p[1:-1]:
                    want[v] += 1 / len(ps)
    n = len(nodes)
    got = {x.id: x.betweenness for x in graph.betweenness(df, batch=5).collect()}
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in want.items()})
    dist, _ = shortest(nodes[0])
    assert {x.id: x.depth for x in graph.click_depth(df, nodes[0]).collect()} == {v: dist.get(v) for v in nodes}
    known = set(edges)
    cycles = {c for k in range(1, 5) for c in itertools.permutations(nodes, k) if c[0] == min(c) and all((a, b) in known for a, b in zip(c, c[1:] + c[:1], strict=True))}
    assert {tuple(x.cycle) for x in graph.simple_cycles(df, longest=4, most=10_000).collect()} == cycles


def test_pagerank_sums_to_one(spark):
    df = spark.createDataFrame(random_edges(12, 25, 4), "src string, dst string")
    assert sum(x["rank"] for x in graph.pagerank(df).collect()) == pytest.approx(1)


def test_modules_beat_singletons(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    edges = clique("a") + clique("b") + [("a0", "b0")]
    got = {x.id: x.module for x in graph.modules(spark.createDataFrame(edges, "src string, dst string")).collect()}
    m, degree = len(edges), {v: sum(v in e for e in edges) for v in got}
    q = lambda c: sum(c[a] == c[b] for a, b in edges) / m - sum((sum(degree[v] for v in c if c[v] == k) / (2 * m)) ** 2 for k in set(c.values()))
    assert q(got) > max(q({v: v for v in got}), q(dict.fromkeys(got, 0)), 0.3)


def test_empty_graph(spark):
    df = spark.createDataFrame([], "src string, dst string")
    for f in (graph.degrees, graph.pagerank, graph.components, graph.articulation_points, graph.betweenness, graph.modules, graph.simple_cycles):
        assert f(df).count() == 0


# Similarity, rules


def test_families(spark):
    rows = [("a", "btn x"), ("b", "btn y x"), ("c", "card"), ("d", ""), ("e", None), ("f", "btn x")]
    df = spark.createDataFrame([(p, "div", "t", c) for p, c in rows], "path string, tag string, component_type string, css_class string")
    found = similarity.component_families(df)
    groups = {}
    for x in found.collect():
        groups.setdefault(x.family_id, set()).add(x.path)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "f"], ["d", "e"]]
    assert sorted(x.common_classes for x in similarity.common_classes(found).collect()) == [[], ["btn", "x"]]


def test_color_clusters_follow_the_greedy_order(spark):
    rng = random.Random(5)
    usage = [(*(rng.randrange(100, 112) for _ in range(3)), rng.randrange(1, 6)) for _ in range(60)]
    usage = list({x[:3]: x for x in usage}.values())
    df = spark.createDataFrame(usage, "r int, g int, b int, uses long")
    lab = {tuple(x)[:3]: x.lab for x in df.select("r", "g", "b", similarity.colors.to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).collect()}
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(lab[p], lab[q], strict=True)) ** 0.5
    leaders, want = [], {}
    for c in sorted((x for x in usage), key=lambda x: (-x[3], x[:3])):
        own = next((x for x in leaders if far(x, c[:3]) <= 2.3), None)
        if own is None:
            leaders.append(own := c[:3])
        want[c[:3]] = own[0] * 65536 + own[1] * 256 + own[2]
    assert {tuple(x)[:3]: x.leader for x in similarity.color_clusters(df).collect()} == want


def test_shapes_merge_without_order(spark):
    rows = [("e", '{"a": "number", "b": "string"}'), ("e", '{"a": "number"}'), ("e", ""), ("e", None)]
    df = spark.createDataFrame(rows, "e string, shape string")
    assert rows_of(rules.merge_shapes(df, ["e"])) == [("e", "a", "number", True), ("e", "b", "string", False)]
    nested = spark.createDataFrame([("e", '{"a": {"b": ["string"]}, "l": [{"k": "number"}]}')], "e string, shape string")
    fields = rules.contract_fields(nested, ["e"])
    want = [("$.a", "object"), ("$.a.b", "array"), ("$.a.b[]", "string"), ("$.l", "array"), ("$.l[]", "object"), ("$.l[].k", "number")]
    assert rows_of(fields) == [("e", *x, True) for x in want]
    deep = '{"x": ' * 12 + '"number"' + "}" * 12
    lists = spark.createDataFrame([("e", deep), ("f", '{"m": [[{"k": "string"}]]}'), ("f", '{"m": []}'), ("g", "[]")], "e string, shape string")
    found = rows_of(rules.contract_fields(lists, ["e"]))
    assert ("e", "$" + ".x" * 12, "number", True) in found and ("f", "$.m[][].k", "string", True) in found
    assert ("f", "$.m[]", "array", False) in found and not [x for x in found if x[0] == "g"]
    assert rules.shared_schemas(fields, ["e"]).first().uses == 1


def test_failure_wins_in_flows(spark):
    edges = spark.createDataFrame([("a", "b", "x", "go", "t", "CLICK", 1), ("a", "b", "y", "go", "t", "CLICK", 2)], "`from` string, `to` string, path string, text string, component_type string, action string, event_seq long")
    req = spark.createDataFrame([("a", "b", "x", "POST", "/o", 422, False, 1), ("a", "b", "x", "POST", "/o", 201, False, 2), ("a", "b", "y", "POST", "/o", 201, False, 3)], "`from` string, `to` string, path string, method string, request_path string, status long, failed boolean, event_seq long")
    got = rules.flow_graph(edges, req)
    assert rows_of(got) == [("a", "b", "go", "CLICK", "error", 422, "POST /o")] and rules.error_branches(got).count() == 1


def test_entities_say_their_source(spark):
    df = spark.createDataFrame([("p", "form#f", "i1", "text field (email)", "mail", "", "", "email", True), ("p", "form#f", "i2", "button", "b", "", "", "", False), ("p", "", "i3", "checkbox", "c", "", "", "", False)], "page_url string, form string, path string, component_type string, name string, label string, placeholder string, input_type string, required boolean")
    found = rules.entities(df)
    assert [(x.entity, len(x.fields)) for x in found.collect()] == [("f", 1)]
    assert rules.without_provenance(rules.entity_tables(found, "r", "g")).count() == 0


def test_groups_of_controls(spark):
    rows = [("box > a", "", "", "", "+", 0), ("box > b", "", "", "", "2", 1), ("box > c", "", "", "", "-", 2), ("f > r1", "radio", "", "n", "", 3), ("f > r2", "", "radio", "n", "", 4), ("ul > o1", "option", "", "", "", 5), ("ul > o2", "menuitem", "", "", "", 6)]
    df = spark.createDataFrame([("p", *x) for x in rows], "page_url string, path string, role string, input_type string, name string, text string, pos int")
    assert rows_of(rules.steppers(df, ["page_url"])) == [("p", "box", "box > a", "box > c", "box > b", "2")]
    assert [x.name for x in rules.choice_sets(df, ["page_url"]).collect()] == ["n"] and [x.parent for x in rules.option_families(df, ["page_url"]).collect()] == ["ul"]


def test_accessibility(spark):
    df = spark.createDataFrame([("p", "a", "button", "", "", "", "semantic"), ("p", "b", "text field (text)", None, "", "mail", "semantic"), ("p", "c", "button", "", "", "", "pointer"), ("p", "d", "link", "t", "", "", "semantic")], "page_url string, path string, component_type string, text string, label string, placeholder string, layer string")
    assert [x[0] for x in rows_of(rules.accessible_name_findings(df))] == ["missing-accessible-name", "placeholder-as-only-label"]
    more = spark.createDataFrame([("p", x, x, "", "", "", "semantic") for x in ("list/menu option", "element", "radio button", "toggle switch")], df.schema)
    assert {x.detail for x in rules.accessible_name_findings(more).collect()} == {"radio button", "toggle switch"}
    marks = spark.createDataFrame([("p", "navigation", 2), ("q", "main", 2)], "page_url string, landmark string, regions long")
    assert [x[0::2] for x in rows_of(rules.landmark_findings(marks))] == [("duplicate-unique-landmark", "q"), ("no-main-landmark", "p")]


def test_module_labels(spark):
    df = spark.createDataFrame([("m", "h.com/user-area/a"), ("m", "https://h.com/user-area/b?x"), ("n", "h.com"), ("n", "h.com/z")], "module string, url string")
    assert rows_of(rules.module_label(df)) == [("m", "User Area"), ("n", "Module")]


# Sources, streaming, registry

HTML = """<html><head><meta name=description content="About"><meta property=og:t content=1><meta name=description content="Last">
<style>.b:hover, a:focus {color: red} .b:hover {color: blue; margin: 0}</style></head><body><nav><a href="/x">Go</a></nav>
<main><h1>Title</h1><p>Some text that is long enough.</p><form id=f><label for=m>Mail</label><input id=m name=mail required>
<button class=b disabled><img alt="Send"></button></form><a href="#top">no</a></main>"""


def test_page_extraction(spark):
    pages = spark.createDataFrame([(1, "https://h.com/p/q", HTML), (2, "u", None)], "page_id long, url string, html string")
    parsed = html.parse_pages(pages)
    assert [x.href for x in html.extract_links(parsed).collect()] == ["https://h.com/x"]
    assert html.extract_metadata(parsed).first().metadata == {"description": "Last", "og:t": "1"}
    assert {x.page_id: x.description for x in html.extract_description(parsed).collect()} == {1: "About", 2: ""}
    got = {x.tag: x for x in html.extract_components(parsed).collect()}
    assert got["input"].label == "Mail" and got["input"].required and got["button"].text == "Send" and got["button"].disabled and got["button"].form == "body > main > form#f"
    assert [x.text for x in html.extract_texts(parsed).collect()] == ["Title", "Some text that is long enough."]
    near = html.extract_ancestors(parsed).filter("component_path = 'body > main > form#f > input#m'").orderBy("distance").collect()
    assert [x.tag for x in near] == ["form", "main"] and near[1].landmark == "main"
    styles = {(x.path.split(" > ")[-1], x.state, x.value) for x in html.extract_state_styles(parsed).collect()}
    assert ("button", "hover", "blue") in styles and ("a", "focus", "red") in {(p.split(":")[0], s, v) for p, s, v in styles}


def test_pages_of_any_depth_and_size():
    page = html.parse_page("<div>" * 20_000 + "<a href=x>t</a>")
    assert page["links"] == [{"href": "x", "text": "t"}]
    page = html.parse_page("<ul>" + "<li id=i><a href=x>t</a>" * 4000 + "</b>" * 4000)
    assert len(page["controls"]) == 4000 and page["controls"][1]["path"] == "ul > li#i > a"
    assert html.parse_page("<ul><li><a>x</a><li><a>y</a></ul>")["controls"][1]["path"] == "ul > li:nth-of-type(2) > a"


def test_tables_round_trip(spark):
    path = shared_path(spark, "t")
    df = spark.createDataFrame([("s", "e", "u", "Finished", 1, "", "", 1, None), ("t", "e", "u", "Pending", 1, "", "", 2, None)], tables.PAGE_EVENT)
    tables.save_table(df, path)
    assert tables.load_table(spark, path, tables.PAGE_EVENT, "s").count() == 1
    fold.replace_partitions(df.filter("site = 's'").withColumn("status", F.lit("Failed")), path)
    assert sorted(x.status for x in tables.load_table(spark, path, tables.PAGE_EVENT).collect()) == ["Failed", "Pending"]
    states = shared_path(spark, "states")
    spark.createDataFrame([('{"site":"s","url":"u","links":[{"href":"h","text":"t"}]}',)], "value string").write.text(states)
    assert tables.snapshot_rows(tables.load_page_states(spark, states), "links").first().href == "h"


def test_registry(spark, sf_dir):
    assert registry.query(spark, sf_dir, "url_keys").count() > 0
    for name in ("_links", "nothing"):
        with pytest.raises(KeyError):
            registry.query(spark, sf_dir, name)
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "prompt string, plain string")
    write = lambda p: p.upper() if p == "a" else 1 / 0
    got = {x.text: x.failure for x in registry.with_user_text(rows, "prompt", "plain", write).collect()}
    assert got.keys() == {"A", "y"} and got["A"] is None and got["y"].startswith("ZeroDivisionError")


def _brute_betweenness(pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = {v: [b for a, b in pairs if a == v and b != v] for v in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, ways, depth = [s], {v: [] for v in nodes}, {s: 1.0}, {s: 0}
        for v in order:
            for w in out[v]:
                if w not in depth:
                    depth[w], ways[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        share = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def _is_cut(pairs, gone):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    reached = todo = {min(near[gone])}
    while todo:
        todo = {y for x in todo for y in near[x]} - reached - {gone}
        reached = reached | todo
    return not near[gone] <= reached


def test_graph_queries_use_every_edge(spark, sf_dir):
    from siteloom.plans import derived
    from siteloom.plans.queries import QUERIES

    pairs = {(x.src, x.dst) for x in derived.simple_edges(spark, sf_dir).collect()}
    want = _brute_betweenness(pairs)
    got = {x.id: x.betweenness for x in QUERIES["betweenness"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-8 for v in want)
    cut = {x.id for x in graph.articulation_points(derived.simple_edges(spark, sf_dir)).collect()}
    assert cut == {v for v in want if _is_cut(pairs, v)}
    some = {x.id: x.betweenness for x in graph.betweenness(derived.simple_edges(spark, sf_dir), sources=60).collect()}
    assert some.keys() == want.keys() and all(abs(some[v] - want[v]) < 0.05 for v in want)


def test_betweenness_until_bounds_are_narrow(spark, monkeypatch):
    # Two hubs of 150 vertices each, joined by a vertex in the middle; part of the sources is enough for a wide bound only.
    edges = [(f"v{i}", f"h{i % 2}") for i in range(300)] + [(f"h{i % 2}", f"v{i}") for i in range(300)] + [(a, b) for h in ("h0", "h1") for a, b in ((h, "mid"), ("mid", h))]
    df, seen = spark.createDataFrame(edges, "src string, dst string"), []
    plain = graph._widest
    monkeypatch.setattr(graph, "_widest", lambda total, n, k, chance: seen.append((k, plain(total, n, k, chance))) or seen[-1][1])
    want = _brute_betweenness(set(edges))
    got = {x.id: x.betweenness for x in graph.betweenness(df, batch=38, error=0.6).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) <= 0.6 for v in want)
    assert seen[-1][1] <= 0.6 and seen[-1][0] < len(want) and all(bound > 0.6 for _, bound in seen[:-1])
    assert abs(got["mid"] - want["mid"]) < 0.1
    whole = {x.id: x.betweenness for x in graph.betweenness(df, batch=152, error=1e-3).collect()}
    assert all(abs(whole[v] - want[v]) < 1e-8 for v in want)


def test_first_cycles_by_small_beams(spark):
    edges = random_edges(7, 26, 9)
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes, known = sorted({x for e in edges for x in e}), set(edges)
    cycles = sorted(c for k in range(1, 6) for c in itertools.permutations(nodes, k) if c[0] == min(c) and all((a, b) in known for a, b in zip(c, c[1:] + c[:1], strict=True)))
    for most, beam in ((5, 2), (12, 3)):
        assert sorted(tuple(x.cycle) for x in graph.simple_cycles(df, longest=5, most=most, beam=beam).collect()) == cycles[:most]


def test_running_over_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, n int, v int").repartition(5)
    got = {(x.g, x.n): (x.total, x.low, x.i) for x in ordered.running(df, ["g"], [F.col("n")], {"total": F.col("v"), "i": F.lit(1)}, {"low": F.col("v")}).collect()}
    for g, n, _ in rows:
        seen = [v for h, m, v in rows if h == g and m <= n]
        assert got[g, n] == (sum(seen), min(seen), len(seen))
    assert sorted(x.n2 for x in ordered.numbered(df, [], [F.col("n")], "n2").collect()) == list(range(1, 401))
    assert ordered.numbered(df.limit(0), ["g"], [F.col("n")]).count() == 0


def test_option_shapes(spark):
    raw = ['{"increment_path": "u", "decrement_path": "d", "container": "c", "current_value": null, "value_path": "v"}', '{"group": "g", "options": [{"path": null, "text": "a", "selected": true}]}',
           '{"trigger": "t", "revealed_options": [{"text": "x"}]}', '{"a": 1}', "no json", None, '{"group": "g"}']
    df = spark.createDataFrame([("p", str(i), x, 1) for i, x in enumerate(raw)], "page_url string, path string, options string, event_seq long")
    got = {x.path: (x.group_name, [tuple(o) for o in x.options]) for x in fold.parsed_options(df).collect()}
    assert got["0"] == ("stepper", [("c", "container", False), ("u", "increment", False), ("d", "decrement", False), ("v", "value:", False)])
    assert got["1"] == ("g", [("", "a", True)]) and got["2"] == ("t", [("", "x", False)]) and all(got[k] == ("", []) for k in "3456")


def test_breadth_first_loops_have_no_bound():
    import inspect

    for run in (graph.click_depth, graph.betweenness, graph.articulation_points):
        assert "max_rounds" not in inspect.signature(run).parameters
        assert "max_rounds" not in inspect.getsource(run)


def test_nested_entities_tell_sources_once_a_name(spark):
    """A name that many fields of a form share doesn't repeat its sources with each of them."""
    schema = "page_url string, form string, name string, label string, placeholder string, component_type string, input_type string, required boolean, path string"
    fields = spark.createDataFrame([("p", "form#f", f"n{i % 2}", "", "", "text field (text)", "", False, f"p{i}") for i in range(6)], schema)
    got = rules.nested_entities(rules.entity_tables(rules.entities(fields), "r", "g")).collect()
    assert [x.field for x in got[0].fields] == ["n0"] * 3 + ["n1"] * 3
    assert [tuple(x) for x in got[0].sources] == [("n0", ["p0", "p2", "p4"]), ("n1", ["p1", "p3", "p5"])]
    assert got[0].derived_from == [f"p{i}" for i in range(6)]


def test_cycles_where_beams_leave_the_search_open(spark):
    """Long rings with chords have many paths and no short cycle; edges on no short closed walk go, and the rest is searched."""
    rings = [(f"a{r:02d}{i:02d}", f"a{r:02d}{(i + d) % 30:02d}") for r in range(3) for i in range(30) for d in (1, 2)]
    edges = spark.createDataFrame([*rings, ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("b2", "b1")], "src string, dst string")
    assert {tuple(x) for x in graph._on_short_walks(edges, 8).collect()} == {("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("b2", "b1")}
    got = graph.simple_cycles(edges, 8, beam=4, patience=2)
    assert [x.cycle for x in got.orderBy("cycle").collect()] == [["b1", "b2"], ["b1", "b2", "b3"]]


def test_sweeps_start_where_there_is_a_way_out(spark, monkeypatch):
    """Leaves of a star are no sources: one sweep in place of one for each batch of leaves."""
    sweeps = []
    monkeypatch.setattr(graph, "Levels", lambda *a, own=graph.Levels: sweeps.append(a) or own(*a))
    edges = spark.createDataFrame([("h", f"l{i}") for i in range(9)] + [("r", "h")], "src string, dst string")
    got = {x.id: x.betweenness for x in graph.betweenness(edges, batch=2).collect()}
    assert got.pop("h") == pytest.approx(9 / 90) and set(got.values()) == {0.0}
    assert len(sweeps) == 1


def test_contract_fields_of_shapes_that_are_given_many_times(spark):
    shapes = spark.createDataFrame([("e", '{"a": "number"}')] * 3 + [("e", '{"a": "number", "b": ["string"]}')] * 2 + [("e", '{"b": []}')], "id string, shape string")
    got = sorted(tuple(x) for x in rules.contract_fields(shapes, ["id"]).collect())
    assert got == [("e", "$.a", "number", False), ("e", "$.b", "array", False), ("e", "$.b[]", "string", False)]
